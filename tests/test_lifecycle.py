import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skilloom.operators import lifecycle as lc
from skilloom.streaming import jobs

BASE = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp_ntz, event_id long"


def _requests(n=400, seed=3):
    rnd, out = random.Random(seed), []
    for i in range(n):
        # one key holds most of the traffic; gaps of all sizes, some exact ties
        key = 1 if rnd.random() < 0.7 else rnd.randint(2, 5)
        out.append((key, BASE + timedelta(seconds=rnd.choice([rnd.randint(0, 900), rnd.randint(5000, 5100), 60 * rnd.randint(0, 20)])), i))
    return out


def _brute(rows, window=60, limit=3):
    log, out = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        recent = [t for t in log.get(key, []) if (ts - t).total_seconds() < window]
        ok = len(recent) < limit
        left = None if ok else max(1, -int(-((recent[0] + timedelta(seconds=window) - ts).total_seconds()) // 1))
        log[key] = recent + [ts] if ok else recent
        out[i] = (ok, left)
    return out


def test_rate_limit_equals_brute_force(spark):
    rows = _requests()
    d = lc.rate_limit_decisions(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 60, 3)
    assert {r.event_id: (r.accepted, r.retry_after_seconds) for r in d.collect()} == _brute(rows)


def test_requests_without_a_key_share_one(spark):
    rows = [(None if k == 1 else k, t, i) for k, t, i in _requests()]
    d = lc.rate_limit_decisions(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 60, 3)
    want = _brute([(-1 if k is None else k, t, i) for k, t, i in rows])
    assert {r.event_id: (r.accepted, r.retry_after_seconds) for r in d.collect()} == want
    nan = spark.createDataFrame([(float("nan"), t, i) for _, t, i in rows], "user_id double, ts timestamp_ntz, event_id long")
    d = lc.rate_limit_decisions(nan, "user_id", "ts", "event_id", 60, 3)
    assert {r.event_id: (r.accepted, r.retry_after_seconds) for r in d.collect()} == _brute([(0, t, i) for _, t, i in rows])


def test_range_counts(spark):
    rows = _requests(200)
    d = lc.range_counts(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 60)
    for r in d.collect():
        assert r.requests == sum(k == r.user_id and timedelta(0) <= r.ts - t < timedelta(seconds=60) for k, t, _ in rows)


def test_cooldown(spark):
    got = [spark.range(1).select(lc.cooldown_seconds(F.lit(0), F.lit(ms * 1000)).alias("s")).first().s for ms in (0, 4800, 9000, 9750, 10001)]
    assert got == [10, 6, 1, 1, 0]


def _attempts(n=300, seed=5):
    rnd = random.Random(seed)
    return [(rnd.randint(1, 12), rnd.choice(["upload", "claim", "claim", "complete", "fail", "fail"]), rnd.randint(0, 200) * 1_000_000, i,
             rnd.randint(1, 3), rnd.choice([lc.TIMEOUT_CODE, "CORRUPTED_DOCUMENT"])) for i in range(n)]


def _fold(rows, limit_us=None, as_of=None):
    docs = {}

    def time_out(s, now):
        if limit_us is not None and s["status"] == "PROCESSING" and now > s["start"] + limit_us:
            s.update(status="FAILED", err=lc.STALE_CODE, end=s["start"] + limit_us)

    for doc, kind, us, seq, token, err in sorted(rows, key=lambda r: (r[2], r[3])):
        if as_of is not None and us > as_of:
            continue
        s = docs.get(doc)
        if s:
            time_out(s, us)
        if kind == "upload":
            docs.setdefault(doc, dict(status="PENDING", n=0, err=None, start=None, end=None))
        elif s and kind == "claim" and s["status"] in ("PENDING", "FAILED") and s["n"] < 3 and not (s["err"] == lc.TIMEOUT_CODE and us < s["end"] + 10_000_000):
            s.update(status="PROCESSING", n=s["n"] + 1, err=None, start=us, end=None)
        elif s and kind in ("complete", "fail") and s["status"] == "PROCESSING" and token == s["n"]:
            s.update(status="COMPLETED" if kind == "complete" else "FAILED", err=None if kind == "complete" else err, end=us)
    for s in docs.values():
        time_out(s, float("inf") if as_of is None else as_of)
    return {d: (s["status"], s["n"], s["err"], s["start"], s["end"]) for d, s in docs.items()}


ATTEMPTS = "doc_id long, kind string, us long, seq long, token long, error_code string"


def test_attempt_states_equal_fold(spark):
    rows = _attempts()
    d = lc.attempt_states(spark.createDataFrame(rows, ATTEMPTS))
    assert {r.doc_id: (r.status, r.attempts, r.error_code, r.started_us, r.finished_us) for r in d.collect()} == _fold(rows)


def test_attempt_states_with_a_time_limit(spark):
    rows = [r for seed in range(8) for r in ((d + 100 * seed, *rest) for d, *rest in _attempts(150, seed))]
    events = spark.createDataFrame(rows, ATTEMPTS).cache()
    for as_of in (None, 90_000_000):
        d = lc.attempt_states(events, stale_minutes=1, as_of_us=as_of)
        got = {r.doc_id: (r.status, r.attempts, r.error_code, r.started_us, r.finished_us) for r in d.collect()}
        assert got == _fold(rows, 60_000_000, as_of)
        assert {lc.STALE_CODE, None, lc.TIMEOUT_CODE} <= {v[2] for v in got.values()}


def test_a_late_claim_follows_a_time_out(spark):
    s = 1_000_000
    rows = [(1, "upload", 0, 0, 0, None), (1, "claim", s, 1, 0, None), (1, "claim", 600 * s, 2, 0, None), (1, "complete", 601 * s, 3, 2, None)]
    r = lc.attempt_states(spark.createDataFrame(rows, ATTEMPTS), stale_minutes=5).first()
    assert (r.status, r.attempts, r.started_us, r.finished_us) == ("COMPLETED", 2, 600 * s, 601 * s)


def _drain(stream, name, tmp_path):
    """Runs a stream to its end; returns the rows left in its state store."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else 0
    finally:
        q.stop()


def _write(df, tmp_path, name):
    """Two files: the data, then one far-future row that moves the watermark past everything."""
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return str(tmp_path / name)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = _requests(150)
    tail = [(99, BASE + timedelta(days=d), 10_000 + d) for d in (2, 4)]
    path = _write(spark.createDataFrame(rows, SCHEMA), tmp_path, "in")
    for t in tail:
        _write(spark.createDataFrame([t], SCHEMA), tmp_path, "in")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    left = _drain(jobs.rate_limit_stream(src, "user_id", "ts", "event_id", 60, 3), "limits", tmp_path)
    assert left <= 1  # the key of the last rows; the logs of all others are empty and gone
    got = {r.event_id: (r.accepted, None if r.retry_after_seconds is None else int(r.retry_after_seconds)) for r in spark.table("limits").collect()}
    want = _brute(rows)
    assert {k: v for k, v in got.items() if k < 10_000} == want


def test_attempt_stream_equals_batch_and_sweeps(spark, tmp_path):
    rows = _attempts(120)
    schema = ATTEMPTS + ", ts timestamp_ntz"
    stamped = [(*r, BASE + timedelta(microseconds=r[2])) for r in rows]
    path = _write(spark.createDataFrame(stamped, schema), tmp_path, "at")
    for d in (2, 4, 6):
        _write(spark.createDataFrame([(999, "claim", 0, 9000 + d, 1, None, BASE + timedelta(days=d))], schema), tmp_path, "at")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    _drain(jobs.attempt_stream(src), "attempts_plain", tmp_path)
    last = {}
    for r in sorted(spark.table("attempts_plain").collect(), key=lambda r: (r.at_us, r.seq)):
        last[r.doc_id] = (r.status, r.attempts, r.error_code)
    assert last == {d: v[:3] for d, v in _fold(rows).items()}
    _drain(jobs.attempt_stream(src, stale_minutes=5), "attempts_swept", tmp_path)
    limited = _fold(rows, 300_000_000)
    swept = {}
    for r in sorted(spark.table("attempts_swept").collect(), key=lambda r: (r.at_us, r.attempts)):
        swept[r.doc_id] = (r.status, r.attempts, r.error_code)
    left = _drain(jobs.attempt_stream(src, stale_minutes=5, forget_minutes=60), "attempts_forgotten", tmp_path)
    final = {d for d, v in limited.items() if v[0] == "COMPLETED" or v[1] == lc.MAX_ATTEMPTS}
    assert left <= len(limited) - len(final) + 1 and spark.table("attempts_forgotten").count() == spark.table("attempts_swept").count()
    assert swept == {d: v[:3] for d, v in limited.items()} and any(v[2] == lc.STALE_CODE for v in limited.values())


def test_scoring_stream(spark, tmp_path):
    path = _write(spark.createDataFrame([(1, "Skills: Python")], "resume_id int, extracted_text string"), tmp_path, "res")
    src = spark.readStream.schema("resume_id int, extracted_text string").parquet(path)
    _drain(jobs.score_documents(src).select("resume_id", "skills.skill_name"), "scored", tmp_path)
    assert spark.table("scored").first().skill_name == ["Python"]


def test_nested_summary_equals_summary_of_item_rows(spark):
    from skilloom.operators import scoring
    rows = [("a", [("REQUIRED", "MATCHED"), ("REQUIRED", "MISSING"), ("PREFERRED", "MATCHED")]), ("b", [("PREFERRED", "MISSING")] * 3), ("c", [])]
    d = spark.createDataFrame(rows, "analysis_id string, items array<struct<requirement_type:string,status:string>>")
    flat = scoring.explode_items(d, "analysis_id").selectExpr("analysis_id", "status", "concat('[', requirement_type, '] said') AS evidence")
    want, got = scoring.summarise_items(flat, "analysis_id"), scoring.summarise_nested(d, "analysis_id")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_named_item_fields_are_made(spark):
    from skilloom.operators import scoring
    pair = spark.createDataFrame([(1, [0, 3], [5])], "k int, required_pos array<int>, preferred_pos array<int>").selectExpr(
        "*", "array(named_struct('skill_pos', 3, 'score', 80D, 'confidence', 0.8D, 'in_skills_section', false, 'match_type', 'EXACT', 'token', 'Java')) AS skills")
    whole = pair.select(scoring.items_column().alias("items")).first()["items"]
    for fields in (("skill_name",), ("status", "confidence"), ("requirement_type", "evidence", "skill_name")):
        d = pair.select(scoring.items_column(fields=fields).alias("items"))
        assert [tuple(i) for i in d.first()["items"]] == [tuple(i[f] for f in fields) for i in whole]
        assert d.schema["items"].dataType.elementType.names == list(fields)


def test_nested_counts_equal_counted_recommendations(spark):
    from skilloom.operators import recommend
    item = lambda kind, status: ("Java", kind, status, f"[{kind}] said")
    rows = [("a", 1, [item("REQUIRED", "MISSING"), item("REQUIRED", "MISSING"), item("PREFERRED", "MISSING")]), ("b", 2, [item("REQUIRED", "MATCHED")]),
            ("c", 9, [item("PREFERRED", "MISSING")]), ("d", 9, [])]
    d = spark.createDataFrame(rows, "analysis_id string, resume_id int, items array<struct<skill_name:string,requirement_type:string,status:string,evidence:string>>")
    resumes = spark.createDataFrame([(1, "Skills: Java\nshort"), (2, None)], "resume_id int, extracted_text string")
    want = (recommend.nested_recommendations(d, resumes).groupBy("priority", "category")
            .agg(F.count("*").alias("n"), F.count_distinct("analysis_id").alias("analyses")))
    assert sorted(recommend.nested_counts(d, resumes).collect()) == sorted(want.collect())
