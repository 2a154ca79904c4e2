"""Shared-prefix Viterbi against trying every segmentation, and round trips."""

import random

import pytest

from skilloom.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(sp.default_path())


def best(pieces, word):
    """Best score over all segmentations, by recursion."""
    if not word:
        return 0.0
    out = []
    for n in range(1, min(len(word), pieces.longest) + 1):
        if word[:n] in pieces.pieces:
            out.append(pieces.pieces[word[:n]][1] + best(pieces, word[n:]))
    if word[0] not in pieces.pieces:
        out.append(pieces.byte_score * len(pieces.fallback(word[0])) + best(pieces, word[1:]))
    return max(out)


def test_best_segmentation(pieces):
    rng = random.Random(1)
    words = sorted({sp.MARK + "".join(rng.choice("aetnohs\U0001f600é\udfff") for _ in range(rng.randint(0, 8))) for _ in range(300)})
    scores = {i: s for i, s in pieces.pieces.values()}
    for word, ids in pieces.encoded(words):
        assert sum(scores.get(i, pieces.byte_score) for i in ids) == pytest.approx(best(pieces, word))


def test_round_trips(pieces, small, edges):
    texts = ["", " ", "  a  b ", "x▁y ▁", "😀 日本 \n\t", "word" * 100]
    assert [pieces.decode(x.tolist()) for x in pieces.encode_all(texts)] == texts
    got = sp.digests(small.union(edges.select(small.columns))).collect()
    assert len(got) == small.count() + edges.count() and all(r["round_trip"] for r in got)
    assert sp.digests(edges.limit(0)).count() == 0 and sp.encode(edges).filter("doc_id = 0").first()["ids"] == []
