"""Every operator against a brute-force version, on a whole small table and on edge cases."""

import itertools
import math
import random
import time
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from skilloom.llm import html, licenses, merkle, ngram, packing, quality, simhash, token_counts, vocabulary
from skilloom.llm.common import materialize

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPLIT.findall(lower(text))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary.default_path())


# --- 1


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = []
    for r in pages.collect():
        body = r["html"][r["html"].find("<article>") + 9:r["html"].find("</article>")]
        parts = (" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?p>|</?h1>", body))
        text = "\n".join(p for p in parts if p)
        want.append((r["page_id"], r["url"], text, len(text)))
    assert rows_of(html.extract_pages(pages), "page_id", "url", "text", "n_chars") == sorted(want, key=repr)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<script>x", "a"), ("<!-- x", ""), ("<div hidden>no</div><p>yes, it is.", "yes, it is."),
    ('<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="post"><h2>Title</h2><p>Some long text, with commas,'
     ' and so on. It goes on.</p><p>Short.</p><ul><li>one, ok</li><li>two</li></ul><p>Another long paragraph, with punctuation; indeed.</p></div>'
     '<div class="side-bar"><ul><li><a href=x>Link a</a></li></ul></div><div id="comments"><p>Great post, thanks a lot, really. I love it.</p></div>'
     '<div class="cookie-notice">We use cookies, okay?</div><form>Name, please</form><footer>(c) me</footer></body>',
     "Title\nSome long text, with commas, and so on. It goes on.\nShort.\none, ok\ntwo\nAnother long paragraph, with punctuation; indeed."),
])
def test_page_cases(page, text):
    assert html.main_text(page) == text


def test_link_lists_of_the_article_stay():
    refs = "<h2>References</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>"
    body = "<h1>Title</h1><p>A paragraph of the article, with some commas, and an end.</p>"
    page = "<body><ul><li><a href=/>Home</a></li></ul><{0}>{1}{2}</{0}></body>"
    for name in ("article", "main"):
        assert html.main_text(page.format(name, body, refs)).split("\n")[1:] == [
            "A paragraph of the article, with some commas, and an end.", "References", "First source", "Second source"]


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>x &lt; y\xa0z</p>" * 20000, 6)], "page_id long, url string, html string, text int")
    big = "\n".join(["x < y z"] * 20000)
    assert rows_of(html.extract_pages(df), "page_id", "url", "text", "n_chars") == sorted([(1, "u", "", 0)] * 2 + [(None, None, big, len(big))], key=repr)
    assert html.extract_pages(df.limit(0)).count() == 0


# --- 2


def model(rows):
    docs = [(str(i), [*words(t), None]) for i, t in rows]
    train = [w for i, w in docs if zlib.crc32(i.encode()) % 7 != 2]
    c1, c2 = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([None, *w[:-1]], w))
    n, v, counts = sum(c1.values()), len(c1), Counter(c1.values())
    once, twice = counts[1], counts[2]
    d = once / (once + 2 * twice) if once else 0.5
    unseen = max(1.0, once * once / (2 * max(1, twice)))
    uni = lambda x: (c1[x] - d) / n if c1[x] else (d * v / n if n else 1) / unseen
    out = []
    for i, w in docs:
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((c2[h, x] + ngram.MU * uni(x)) / (c1[h] + ngram.MU)) for h, x in zip([None, *w[:-1]], w))
        out.append((i, zlib.crc32(i.encode()) % 7 == 2, len(w), sum(c1[x] > 0 for x in w), n, base, score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 3])
def test_scores(small, edges, blocks):
    docs = small.union(edges.select(small.columns))
    rows = [("null" if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((("null" if r["doc_id"] is None else str(r["doc_id"]), *r[1:]) for r in ngram.scored(docs, blocks).collect()), key=repr)
    for a, b in zip(got, model(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) <= 2e-3 * a[2] + 1e-6
    held = [a for a in got if a[1]]
    assert sum(a[6] for a in held) > sum(a[5] for a in held)


def test_scores_edges(edges):
    assert ngram.scored(edges).count() == edges.count()
    assert ngram.scored(edges.limit(0)).count() == 0


@pytest.mark.parametrize("n, bound", [(0, 1), (1, 5), (10, 3), (1000, 10**6), (1000, 10**12), (5000, 4000), (3, 2**50)])
def test_elias_fano(n, bound):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, bound, n)).astype(np.uint64)
    packed = ngram.EliasFano(ngram.EliasFano.packed(values))
    assert (packed.get(np.arange(n)) == values).all()
    x = np.concatenate([rng.integers(0, bound + 10, 200).astype(np.uint64), values, values + np.uint64(1)])
    assert (packed.successor(x) == np.searchsorted(values, x)).all()


def test_trie_in_a_file(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 50, 600) << 32 | rng.integers(0, 50, 600))
    pairs = pairs[(pairs >> 32) != 7]
    c, w, log, word, back = pairs >> 32, pairs & 0xFFFFFFFF, -rng.random(len(pairs)), -rng.random(50) * 6, -rng.random(50)
    path = str(tmp_path / "trie")
    ngram.Trie.save(ngram.Trie.packed(word, back, c, w, log), path)
    a, b = (x.ravel() for x in np.mgrid[0:50, 0:50])
    own = dict(zip(zip(c.tolist(), w.tolist()), log, strict=True))
    want = [own.get((x, y), back[x] + word[y]) for x, y in zip(a.tolist(), b.tolist())]
    assert np.abs(ngram.Trie.open(path).log10(a, b) - want).max() <= ngram.STEP


# --- 4


def naive_statistics(text):
    text = text or ""
    w, lines = SPLIT.findall(text), [x for x in text.split("\n") if SPLIT.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, small, edges):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = small.union(edges.select(small.columns))
    want = []
    for r in docs.collect():
        s = naive_statistics(r["text"])
        want.append((r["doc_id"], *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    judged = materialize(quality.judged(docs, labels), "test")
    assert rows_of(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in judged.collect())
    empty = quality.judged(edges, labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in empty.collect())
    assert quality.judged(edges.limit(0), labels).count() == 0


def test_decision_list_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("doc_id % 2 = 0"))
    held = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed")
    got = {(r["quality"], r["hit"]): r["count"] for r in held.withColumn("hit", held["rule"] > 0).groupBy("quality", "hit").count().collect()}
    assert got.get((1, True), 0) <= 0.005 * got[1, False] and got[0, True] >= 0.9 * (got[0, True] + got.get((0, False), 0))


def test_learning_finds_a_planted_rule():
    rng = np.random.default_rng(2)
    rows = {k: rng.random(3000) for k in quality.FEATURES}
    bad = (rows["upper"] >= 0.7) & (rows["repeated"] <= 0.4)
    rules = quality.learn(rows, bad, np.arange(3000) % 3 != 0)
    hit = np.logical_or.reduce([quality._covered(r, rows) for r in rules])
    assert (hit == bad).mean() > 0.99 and quality.expression([]) == "0"
    assert quality.learn(rows, np.zeros(3000, bool), np.arange(3000) % 3 != 0) == []


# --- 5


def test_token_counts(small, edges, tokenizer):
    docs = small.union(edges.select(small.columns))
    want = []
    for r in docs.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024))
    got = token_counts.token_counts(docs, 1024)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(edges.limit(0), 1024).count() == 0
    over = {r["doc_id"]: r["kept_chars"] for r in token_counts.token_counts(small, 1024).filter("over_limit").collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for i, kept in list(over.items())[:20]:
        assert len(tokenizer.encode(texts[i][:kept], add_special_tokens=False).ids) <= 1024 < len(tokenizer.encode(texts[i][:kept + 1], add_special_tokens=False).ids)


def test_counts_at_every_prefix(tokenizer):
    rng = random.Random(1)
    parts = ["a", "e", "'", "re", "'re", "'ll", " ", "  ", "\n", " \n", "é", "日本", "1", "23", "<|endoftext|>", "<|end", "of", "text|>", "!", "?!", "the", " the",
             "ation", "😀", "\r\n", "'s", "²", "\x1c", "\x85", "\xa0", "Ⅷ", "_", " ", "x" * 250]
    count = token_counts.PrefixCounter(vocabulary.default_path())
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for text, counts in zip(texts, count.each(texts), strict=True):
        assert counts.tolist() == [len(tokenizer.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_many_added_tokens(tokenizer):
    """Exact at every prefix between added tokens, and eight times the text takes far less than 64 times the time."""
    count = token_counts.PrefixCounter(vocabulary.default_path())
    added = max(count.added, key=len)
    text = "".join(f"{added}{w}" for w in ("", "a b", "", "  ", "é'll", " \n")) + added
    assert count(text).tolist() == [len(tokenizer.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]

    def seconds(n):
        long = f"some words {added}" * n
        start = time.perf_counter()
        assert count(long)[-1] == len(tokenizer.encode(long, add_special_tokens=False).ids)
        return time.perf_counter() - start

    seconds(100)
    short = seconds(2500)
    assert seconds(20_000) < 24 * short


def test_truncated_and_prefix_table(edges, tokenizer):
    cut = {r["doc_id"]: r["text"] for r in token_counts.truncated(edges, 7).collect()}
    assert all(len(tokenizer.encode(t, add_special_tokens=False).ids) <= 7 for t in cut.values()) and cut[0] == ""
    assert {r["doc_id"]: r["counts"] for r in token_counts.prefix_counts(edges.filter("doc_id = 3")).collect()} == {3: [0, 1, 1, 1]}


# --- 6


def naive_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(values, radius=3):
    """The distinct values by the smallest value they reach."""
    distinct, group = sorted(set(values)), {}
    for v in distinct:
        group[v] = v
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return group


def test_simhash_components(small, edges):
    docs = small.union(edges.select(small.columns))
    rows = [(r["doc_id"], naive_fingerprint(r["text"])) for r in docs.collect()]
    group = naive_groups([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in rows), key=repr)
    assert rows_of(simhash.components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.components(edges.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept, key=repr) == sorted(least.values(), key=repr)


def test_links_keep_every_connection(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for s in seeds for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(nodes, shard=16).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    tops = simhash.Groups()
    at = {v: tops.add() for v in sorted(values)}
    for a, b in found:
        tops.join(at[a], at[b])
    want = naive_groups(values)
    assert len({tops.top(x) for x in at.values()}) == len(set(want.values()))
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(nodes, shard=16)).collect()}
    sizes = Counter(want.values())
    assert Counter(Counter(roots.values()).values()) == Counter(n - 1 for n in sizes.values() if n > 1)


def test_chain_of_links(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.connected(chain).collect()} == {(i, 0) for i in range(1, 61)}


# --- 7


def test_packing_round_trip(small, edges, tokenizer):
    docs = small.union(edges.select(small.columns).filter("doc_id is not null")).dropDuplicates(["doc_id"])
    want = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    got = packing.pieces(docs).collect()
    again = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] == 1 << r["bucket"] <= 2048 and r["offset"] == 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["start"] == len(again.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(want[r["doc_id"]])
        again[r["doc_id"]] += ids.tolist()
    assert again == want and len({r["sequence_id"] for r in got}) == len(got)
    assert packing.pieces(edges).count() > edges.count() and packing.pieces(edges.limit(0)).count() == 0
    assert packing.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


# --- 9 and 10


@pytest.mark.parametrize("name, operator", [("op9_license_rare_index", licenses), ("op10_merkle_fingerprints", merkle)])
def test_against_sql(spark, small, edges, duck, monkeypatch, name, operator):
    whole = small.union(edges.select(small.columns))
    for docs in (whole, edges, edges.limit(0), edges.limit(1)):
        monkeypatch.setattr(operator, "table", lambda *_, docs=docs: docs)
        got = operator.QUERIES[name](spark, "")
        columns, rows = duck(operator.ORACLES[name], docs)
        assert sorted(got.columns) == sorted(columns)
        exact = lambda r: repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
        assert sorted(exact(r[c] for c in columns) for r in got.collect()) == sorted(map(exact, rows))


def test_license_places(spark, duck):
    text = "x MIT license, the GNU General\nPublic-License! apache_license CC\x00BY gnu general public mit licenses"
    docs = spark.createDataFrame([(1, text), (2, "Licensed under the Apache License, Version 2.0 and Mozilla Public License, v. 2.0")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base"]) == (4, 1, 10, ["apache", "cc-by", "gpl", "mit"])
    assert got[2]["own"] == ["apache-2.0", "mpl-2.0"] or set(got[2]["own"]) >= {"apache-2.0", "mpl-2.0"}


def naive_likeness(a, b):
    """Shared leaves with multiplicity, level by level, over the parsed trees."""
    if a == b:
        return 1.0
    cut = lambda f: Counter(x for x in f.split("/")[1].split(")") if x)
    below = {1: lambda x: x.split("(")[1].split(","), 2: lambda x: x.split(":")[1].split(".")}
    size = lambda x: x.count(":") + x.count(".")
    one, two, shared = cut(a), cut(b), 0
    total = sum(size(x) * n for c in (one, two) for x, n in c.items())
    for depth in (1, 2, 3):
        both = one & two
        shared += sum(n * (size(x) if depth < 3 else 1) for x, n in both.items())
        if depth < 3:
            one, two = (sum((Counter({y: n * m for y, m in Counter(below[depth](x)).items()}) for x, n in (c - both).items()), Counter()) for c in (one, two))
    return 2 * shared / (total + 2)


def test_merkle_likeness_counts_repeats(spark):
    rng = random.Random(9)
    lines = ["x, y.", "a; b", "one. two. two.", ""]
    texts = ["x, y.\nx, y.\nx, y.\nx, y.", "x, y.", "\n".join(["same line"] * 1000), "\n".join(["same line"] * 500 + [f"other {i}" for i in range(500)])]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = [r["fingerprint"] for r in merkle.fingerprints(docs).orderBy("doc_id").collect()]
    pairs = [(i, j, marks[i], marks[j]) for i in range(len(marks)) for j in range(len(marks))]
    got = spark.createDataFrame(pairs, "i int, j int, a string, b string").selectExpr("i", "j", f"{merkle.likeness('a', 'b')} as near").collect()
    near = {(r["i"], r["j"]): r["near"] for r in got}
    assert near[0, 1] == 4 / 12 and near[2, 3] == 1000 / 2002
    for i, j, a, b in pairs:
        assert abs(near[i, j] - naive_likeness(a, b)) < 1e-12, (texts[i], texts[j])
        assert (near[i, j] == 1) == (texts[i] == texts[j])


def test_merkle_finds_the_edit(spark):
    a, b = "one. two.\nthree, four.\n\nfive.", "one. two.\nthree, 4.\n\nfive."
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    one, two = (r["fingerprint"] for r in merkle.fingerprints(docs).orderBy("doc_id").collect())
    diff = spark.createDataFrame([(one, two)], "a string, b string").selectExpr(f"{merkle.edited_paragraphs('a', 'b')} as d", f"{merkle.likeness('a', 'b')} as n").first()
    assert len(diff["d"]) == 1 and diff["n"] == pytest.approx(2 * 4 / 12)
