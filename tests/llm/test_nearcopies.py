"""Near copies against brute-force Jaccard similarities on five-word shingles."""

import itertools
import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

import corpus_pipeline  # noqa: E402
from skilloom.llm import nearcopies  # noqa: E402
from test_operators import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def naive_shingles(text):
    w = words(text)
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def naive_pairs(sets):
    """Pairs of positions with a similarity of 0.8 or more, in whole numbers: five times the shared, four times all."""
    holding = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holding[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holding[x]:
                if j < i:
                    shared[j] += 1
        yield from ((j, i) for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n))


def naive_kept(rows):
    """doc_id of the first of each group: rows as (doc_id, text)."""
    sets = sorted({naive_shingles(t) for _, t in rows}, key=sorted)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in naive_pairs(sets):
        up[top(a)] = top(b)
    at, least = {s: i for i, s in enumerate(sets)}, {}
    for i, t in rows:
        g = top(at[naive_shingles(t)])
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    return sorted(least.values(), key=repr)


@pytest.fixture(scope="module")
def copies():
    """Originals, copies with few words changed (far more than 3 fingerprint bits), chains of them, and texts under 0.8."""
    rng, vocabulary, out = random.Random(7), [f"w{i}" for i in range(3000)], []
    for n in [3, 5, 6, 9, 10, 14, 15, 24, 25, 60, 60, 100, 200, 400]:
        text = [rng.choice(vocabulary) for _ in range(n)]
        out.append(" ".join(text))
        for step in range(12):  # a chain of edits: neighbours are close, its ends are not
            text = list(text)
            for _ in range(max(1, n // 60) if step % 3 else max(1, n // 30)):
                at = rng.randrange(len(text))
                text[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            out.append(" ".join(text))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(out)]


def test_against_all_pairs(spark, small, edges, copies):
    docs = small.union(edges.select(small.columns)).union(spark.createDataFrame([(r[0] + 10_000, *r[1:]) for r in copies], SCHEMA))
    want = naive_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    for shard in (nearcopies.SHARD, 3):
        got = nearcopies.deduplicated(docs, shard=shard)
        assert got.columns == list(small.columns)
        assert sorted((r["doc_id"] for r in got.collect()), key=repr) == want


def test_pipeline_stage_links_at_four_fifths(spark):
    a = [f"w{i}" for i in range(400)]
    b = [x if i % 80 else f"v{i}" for i, x in enumerate(a)]  # 5 of 400 words, about 23 shingles of 396: similarity 0.89
    c = [x if i % 20 else f"u{i}" for i, x in enumerate(a)]  # 20 words, about 98 shingles: similarity 0.6
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate((a, b, c))], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [0, 2]


def test_shards_decide_every_pair(copies):
    sets = [naive_shingles(r[1]) for r in copies]
    named = [(i, nearcopies.shingles(r[1])) for i, r in enumerate(copies)]
    want = {(a, b) for a, b in naive_pairs(sets)}
    side = random.Random(1).sample([0, 1] * len(named), len(named))
    sides = [[n for n, k in zip(named, side, strict=True) if k == which] for which in (0, 1)]
    across = {(min(p), max(p)) for p in nearcopies.shard_links(*sides)}
    met = across | {(min(p), max(p)) for one in sides for p in nearcopies.shard_links(one, [])}
    assert met <= want and all(side[a] != side[b] for a, b in across)

    def reached(pairs):
        group = list(range(len(named)))
        for a, b in pairs:
            group = [group[a] if g == group[b] else g for g in group]
        return {(a, b) for a, b in itertools.combinations(range(len(named)), 2) if group[a] == group[b]}

    assert reached(met) == reached(want)
    inside = {(min(p), max(p)) for p in nearcopies.shard_links(named, [])}
    assert inside <= want and len(inside) < len(want)
    assert want == {p for p in itertools.combinations(range(len(sets)), 2) if len(sets[p[0]] & sets[p[1]]) / max(1, len(sets[p[0]] | sets[p[1]])) >= 0.8}


def test_candidates_come_from_bk_trees_and_bands(spark):
    """Fingerprints within 3 bits make candidates where no band key is shared, and so do equal ones; farther ones do not."""
    rows = [(1, 5, 0b0, [1]), (2, 5, 0b111, [2]), (3, 5, 0b111 << 20, [3]), (4, 5, 0b1111 << 40, [4]), (5, 5, -1, [5]), (6, 5, -1, [6]),
            (7, 5, 0x0F0F0F0F, [7]), (8, 5, 0x70F0F0F00F0F0F0F, [7]), (9, 0, 0b1, [])]
    nodes = spark.createDataFrame(rows, "mark long, shingles long, fingerprint long, bands array<long>")
    got = {r["mark"]: r["component"] for r in nearcopies.candidates(nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7}


def test_no_pair_near_in_bits_is_left_out(spark, copies):
    """Every pair within 3 bits shares a candidates' component."""
    sets = {nearcopies.mark(s): s for s in (nearcopies.shingles(r[1]) for r in copies)}
    bits = {m: nearcopies.majority(s.astype(">u8")) & 0xFFFFFFFFFFFFFFFF for m, s in sets.items()}
    nodes = spark.createDataFrame([(m, len(s), nearcopies.majority(s.astype(">u8")), []) for m, s in sets.items()],
                                  "mark long, shingles long, fingerprint long, bands array<long>")
    component = {r["mark"]: r["component"] for r in nearcopies.candidates(nodes).collect()}
    near = [(a, b) for a, b in itertools.combinations(bits, 2) if (bits[a] ^ bits[b]).bit_count() <= 3]
    assert near and all(component[a] == component[b] for a, b in near)
