"""The pipeline against a row-at-a-time version of its stages, and its edges."""

import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

import corpus_pipeline  # noqa: E402
from skilloom.llm import quality, secrets, vocabulary  # noqa: E402
from skilloom.llm.common import DOCUMENT_COLUMNS  # noqa: E402
from test_nearcopies import naive_kept  # noqa: E402
from test_secrets import OWNED, base_spans  # noqa: E402

SF = "/root/testdata/sf0.001"


def mask_all(rows):
    owners, repositories, spans_of = defaultdict(set), defaultdict(set), []
    for r in rows:
        text = r["text"] or ""
        base = base_spans(text)
        spans = base + [(m.start(), 3, m.end(), "owned", m[0]) for m in OWNED.finditer(text) if not any(b[0] < m.end() and m.start() < b[2] for b in base)]
        for s in spans:
            owners[s[4]].add(r["source"])
            repositories[s[4]].add((r["source"], r["lang"]))
        spans_of.append(spans)
    for r, spans in zip(rows, spans_of, strict=True):
        text, inside = r["text"] or "", set()
        live = [s for s in spans if len(owners[s[4]]) < secrets.EXAMPLE_OWNERS and len(repositories[s[4]]) < secrets.EXAMPLE_REPOSITORIES]
        for s in live:
            inside |= set(range(s[0], s[2]))
        yield "".join("<secret>" if i in inside and i - 1 not in inside else "" if i in inside else c for i, c in enumerate(text))


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    first = set(naive_kept([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if r["doc_id"] in first]
    encode = Tokenizer.from_file(vocabulary.default_path()).encode
    want = {r["doc_id"]: encode(t, add_special_tokens=False).ids + [1] for r, t in zip(rows, mask_all(rows), strict=True)}
    got = defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got == want


def test_stages_take_edges_and_empty_tables(spark, edges):
    for docs in (edges, edges.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "pack":
                assert docs.columns == list(DOCUMENT_COLUMNS)
        assert docs.count() >= 0
