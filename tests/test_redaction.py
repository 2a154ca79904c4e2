"""Typed and JSON redaction agree on whole values under address keys."""

import json

from pyspark.sql import functions as F

from skilloom.functions import pii
from skilloom.session import NoSharedFolder, materialize, release, shared_dir


def test_typed_and_json_forms_agree(spark):
    docs = [{"zip": 94103, "street": ["1 A"], "note": "mail a@b.co", "home": {"pincode": {"x": 1}, "zip_code": 0, "ok": [1]}},
            {"zip": None, "street": [], "note": "", "home": {"pincode": None, "zip_code": 7, "ok": None}}]
    schema = "zip long, street array<string>, note string, home struct<pincode: struct<x: int>, zip_code: int, ok: array<int>>"
    d = spark.createDataFrame([(json.dumps(x),) for x in docs], "j string").withColumn("v", F.from_json("j", schema))
    row = d.select(F.to_json(pii.redact_typed(F.col("v"), d.schema["v"].dataType), {"ignoreNullFields": "false"}).alias("a"), pii.redact_json("j").alias("b")).collect()
    first, other = json.loads(row[0].a), json.loads(row[0].b)
    assert first["zip"] == other["zip"] == "[POSTAL_REDACTED]" and first["street"] == other["street"] == "[ADDRESS_REDACTED]"
    assert first["home"]["pincode"] == other["home"]["pincode"] == "[POSTAL_REDACTED]" and first["note"] == other["note"] == "mail [EMAIL_REDACTED]"
    assert first["home"]["zip_code"] == "0" and other["home"]["zip_code"] == 0  # a typed field under an address key is a string
    second = json.loads(row[1].a)
    assert second["zip"] is None and second["home"]["zip_code"] == "[POSTAL_REDACTED]" and second["home"]["pincode"] is None


def test_maps(spark):
    d = spark.sql("SELECT map('zip', '94103', 'street', 'x y', 'mail', 'a@b.co', 'pincode', '') AS m, map('zip', 94103, 'age', 7) AS n")
    r = d.select(*(pii.redact_typed(F.col(c), d.schema[c].dataType).alias(c) for c in ("m", "n"))).first()
    assert r.m == {"zip": "[POSTAL_REDACTED]", "street": "[ADDRESS_REDACTED]", "mail": "[EMAIL_REDACTED]", "pincode": ""}
    assert r.n == {"zip": "[POSTAL_REDACTED]", "age": "7"}


def test_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

    try:
        shared_dir(Cluster())
        raise AssertionError("a cluster without a shared folder must fail")
    except NoSharedFolder:
        pass
    assert materialize(spark.range(3), "t").count() == 3
    release(spark)
