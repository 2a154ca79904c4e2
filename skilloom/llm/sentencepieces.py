"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut at its blanks into words, each marked with ``▁`` in front.  The
distinct marked words of many texts are sorted, which walks their trie depth
first: the forward scores of a word up to the prefix that it shares with the
word before are kept, only the rest is scored.  A forward score is the best sum
of piece scores up to a position; pieces come from a model file, scored
-log(1 + rank) by their order there.  Characters without a piece (and a ``▁``
of the text itself) become their UTF-8 bytes, each scored twice the worst piece.

Decoding joins the pieces' bytes, turns marks into blanks and drops the first,
so it gives back every text exactly.

Ties go to the segmentation whose last piece is longer, at every position.
Defined cases: null and empty texts have no pieces; repeated rows give repeated
rows; texts and words of any length are encoded whole; extra input columns are
ignored.  A full table of known words is emptied, which changes no result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table, whole_text

MARK = "▁"
#: Stands for a mark that belongs to the text; no text holds a lone surrogate.
OWN_MARK = "\udfff"
#: Most words that a worker remembers, and from which length a word is not.
REMEMBERED, LONG = 500_000, 200


class Pieces:
    """The pieces of a model file, their scores, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        normal.sort(key=lambda i: (-model.get_score(i), i))
        self.pieces = {model.id_to_piece(i): (i, -math.log(1 + rank)) for rank, i in enumerate(normal, 1)}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.byte_score = -2 * math.log(1 + len(normal))
        self.longest = max(map(len, self.pieces))
        self.raw = [b""] * len(ids)
        for piece, (i, _) in self.pieces.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes((b,))
        self.known: dict[str, bytes] = {}

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if char == OWN_MARK else char).encode("utf-8", "surrogatepass")]

    def encoded(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each marked word with its ids; forward scores of a prefix shared with the word before are reused."""
        before, best, back = "", [0.0], [(0, -1)]
        get, longest = self.pieces.get, self.longest
        for word in words:
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del best[same + 1:], back[same + 1:]
            for end in range(same + 1, len(word) + 1):
                top, link = -math.inf, (0, -1)
                for start in range(max(0, end - longest), end):
                    piece = get(word[start:end])
                    if piece is not None and best[start] + piece[1] > top:
                        top, link = best[start] + piece[1], (start, piece[0])
                if word[end - 1] not in self.pieces:
                    score = best[end - 1] + self.byte_score * len(self.fallback(word[end - 1]))
                    if score > top:
                        top, link = score, (end - 1, -1)
                best.append(top)
                back.append(link)
            ids, end = [], len(word)
            while end:
                start, piece = back[end]
                ids += [piece] if piece >= 0 else self.fallback(word[start:end])[::-1]
                end = start
            before = word
            yield word, ids[::-1]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.replace(MARK, OWN_MARK).split(" ") if t else [] for t in texts]
        missing = set().union(*cut).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = set().union(*cut)
        now = {w[1:]: np.array(ids, "<u4").tobytes() for w, ids in self.encoded(sorted(MARK + w for w in missing))}
        out = [np.frombuffer(b"".join([now[w] if w in now else self.known[w] for w in words]), "<u4") for words in cut]
        self.known.update((w, ids) for w, ids in now.items() if len(w) < LONG)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array of long) of every document; one pass, nothing is shuffled."""
    path = path or default_path()
    return per_text(docs, ["doc_id"], whole_text(), lambda: lambda texts: {"ids": [x.astype(np.int64) for x in loaded(path).encode_all(texts)]},
                    {"ids": "array<long>"})


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_bytes_used (pieces that are single bytes), ids_crc32 (little-endian 32-bit ids), round_trip of every document."""
    path = path or default_path()

    def make() -> Callable[[list[str]], dict]:
        pieces = loaded(path)
        single = np.zeros(len(pieces.raw), bool)
        single[list(pieces.bytes.values())] = True

        def columns(texts: list[str]) -> dict:
            ids = pieces.encode_all(texts)
            return {"n_pieces": [len(x) for x in ids], "n_bytes_used": [int(single[x].sum()) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                    "round_trip": [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]}

        return columns

    return per_text(docs, ["doc_id"], whole_text(), make, {"n_pieces": "long", "n_bytes_used": "long", "ids_crc32": "long", "round_trip": "boolean"})


def op3_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_shared_prefix_viterbi": op3_shared_prefix_viterbi}
ORACLES: dict[str, str] = {}
