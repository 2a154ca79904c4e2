r"""Language-model scoring with Elias-Fano n-gram tries, sliced by document block.

The model is a bigram model over all training documents, smoothed with a
Dirichlet prior: p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU), with unigrams
p(w) = (c(w) - D) / N by absolute discounting; the discounted mass is shared
evenly among as many unseen words as the counts of counts suggest (Chao's
estimate).  Every text starts after a begin mark and stops with an end token.

No task holds the whole model, which grows with the corpus.  Documents are
dealt into blocks of bounded size, n-grams into shards:

1. each block sends every shard its distinct words and bigrams with its own
   training counts (one packed row per shard);
2. each shard adds the counts up and answers each block with corpus-wide
   counts for just what that block asked for, in the order of asking;
3. each block builds a trie of what its own texts can look up, scores its
   texts with it, and drops it.

So what is shuffled is at most proportional to the distinct n-grams of blocks,
one common word or bigram counts once per block, and a lost task is computed
again from its inputs.

The trie has two levels, laid out one after the other in a memory map: words
with quantised log-probabilities, back-off weights and Elias-Fano pointers to
the ranges of their followers; followers as one Elias-Fano sequence, made
monotone by adding up the ends of ranges, with quantised probabilities.  A
follower is searched as the successor of (range base + word) within the
range of its context.

Words are counted exactly, by their bytes.  Bigrams are counted by a 64-bit
hash of their two words, which can only touch the model's own score.

Defined cases: null and empty texts are an end token; repeated rows count and
are scored each; a null ``doc_id`` hashes as the text "null"; with no training
documents all known counts are zero and unknown words share all mass; an empty
table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, ascii_words, partitions, table, whole_text

#: Production parameters: weight of the prior, held-out remainder of crc32(doc_id) by 7, step of quantised log10 values.
MU, HELD_OUT, STEP = 256.0, 2, 1 / 1024
#: The end token as a word; no text holds it, since words have no blanks.
END = b" "


# --- Elias-Fano sequences ----------------------------------------------------------------------------------------------------------

class EliasFano:
    """A monotone sequence of n numbers below a bound: low bits packed, high bits in unary, about 2 + log2(bound / n) bits each."""

    HEAD = struct.Struct("<qqqqq")

    def __init__(self, buffer: memoryview | bytes, at: int = 0) -> None:
        self.n, self.bits, high, low, _ = self.HEAD.unpack_from(buffer, at)
        at += self.HEAD.size
        self.high = np.frombuffer(buffer, np.uint64, high, at)
        at += 8 * high
        self.low = np.frombuffer(buffer, np.uint64, low, at)
        at += 8 * low
        self.ones = np.frombuffer(buffer, np.uint32, high + 1, at)  # ones before each word of the high bits
        self.end = at + 4 * (high + 1) + (-4 * (high + 1)) % 8

    @classmethod
    def packed(cls, values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        bits = max(0, (bound // n).bit_length() - 1) if n else 0
        highs = (values >> np.uint64(bits)).astype(np.int64)
        places = highs + np.arange(n)
        high = np.zeros((int(places[-1]) + 1 if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            rest = values & np.uint64((1 << bits) - 1)
            spot = np.arange(n) * bits
            word, shift = spot >> 6, (spot & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << shift)
            over = (spot & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        ones = np.zeros(len(high) + 1, np.uint32)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        body = cls.HEAD.pack(n, bits, len(high), len(low), 0) + high.tobytes() + low.tobytes() + ones.tobytes()
        return body + bytes(-len(body) % 8)

    def _select(self, counts: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Position of the rank-th set bit (from 0), given the set bits before each word and the words."""
        word = np.searchsorted(counts, rank, "right") - 1
        rest, value, place = rank - counts[word], words[word], word << 6
        for width in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(value & np.uint64((1 << width) - 1)).astype(np.int64)
            up = rest >= lower
            rest = rest - np.where(up, lower, 0)
            value = np.where(up, value >> np.uint64(width), value)
            place = place + np.where(up, width, 0)
        return place

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        spot = i * self.bits
        word, shift = spot >> 6, (spot & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = (spot & 63) + self.bits > 64
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        high = self._select(self.ones.astype(np.int64), self.high, i) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is at least x (n if there is none)."""
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        low = x & np.uint64((1 << self.bits) - 1)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        last = int(zeros[-1]) - 1  # zeros there are; beyond them there is no value
        flipped = ~self.high

        def before(bucket: np.ndarray) -> np.ndarray:
            """Values whose high bits are below the bucket."""
            out = np.full(len(bucket), self.n)
            out[bucket <= 0] = 0
            inside = (bucket > 0) & (bucket <= last)
            b = bucket[inside]
            out[inside] = self._select(zeros, flipped, b - 1) - (b - 1)
            return out

        left, right = before(high), before(high + 1)
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            less = self.lows(mid) < low[open_]
            left[open_[less]] = mid[less] + 1
            right[open_[~less]] = mid[~less]
            open_ = open_[left[open_] < right[open_]]
        return left


class Trie:
    """Words and their followers with quantised log10 values, in levels that can lie in a file or an anonymous memory map."""

    HEAD = struct.Struct("<qqd")

    def __init__(self, buffer: memoryview | bytes | mmap.mmap) -> None:
        self.words, self.followers, self.step = self.HEAD.unpack_from(buffer, 0)
        at = self.HEAD.size
        self.word_codes = np.frombuffer(buffer, np.uint16, self.words, at)
        self.back_codes = np.frombuffer(buffer, np.uint16, self.words, at := at + 2 * self.words)
        self.codes = np.frombuffer(buffer, np.uint16, self.followers, at := at + 2 * self.words)
        at += 2 * self.followers
        at += -at % 8
        self.pointers = EliasFano(buffer, at)
        self.next = EliasFano(buffer, self.pointers.end)

    @classmethod
    def packed(cls, word_log: np.ndarray, back_log: np.ndarray, context: np.ndarray, follower: np.ndarray, log: np.ndarray, step: float = STEP) -> bytes:
        """Levels for words 0.. with log10 values (none positive) and bigrams sorted by (context, follower)."""
        words, n = len(word_log), len(context)
        code = lambda x: np.minimum(np.rint(-x / step), 65535).astype(np.uint16).tobytes()
        starts = np.searchsorted(context, np.arange(words + 1))
        ends = np.append(0, np.where(starts[1:] > starts[:-1], follower[np.maximum(starts[1:] - 1, 0)] + 1 if n else 0, 0))
        body = cls.HEAD.pack(words, n, step) + code(word_log) + code(back_log) + code(log)
        body += bytes(-len(body) % 8)
        return body + EliasFano.packed(starts) + EliasFano.packed(follower + np.cumsum(ends)[context])

    @classmethod
    def mapped(cls, packed: bytes) -> Trie:
        """The levels in an anonymous memory map."""
        area = mmap.mmap(-1, max(1, len(packed)))
        area.write(packed)
        return cls(area)

    @classmethod
    def save(cls, packed: bytes, path: str) -> None:
        with open(path, "wb") as f:
            f.write(packed)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The levels of a file, memory-mapped."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context); the bigram's own value, or the context's back-off weight and the word's value."""
        out = -(self.back_codes[context].astype(float) + self.word_codes[word]) * self.step
        if not self.followers:
            return out
        left, right = self.pointers.get(context), self.pointers.get(context + 1)
        some = np.flatnonzero(left < right)
        left, right = left[some].astype(np.int64), right[some].astype(np.int64)
        # The base of a range: the largest number of the ranges before it, plus one.
        base = np.where(left > 0, self.next.get(np.maximum(left - 1, 0)) + np.uint64(1), 0).astype(np.uint64)
        sought = base + word[some].astype(np.uint64)
        at = self.next.successor(sought)
        hit = at < right
        hit[hit] = self.next.get(at[hit]) == sought[hit]
        out[some[hit]] = -self.codes[at[hit]].astype(float) * self.step
        return out


# --- Packed rows between blocks and shards -----------------------------------------------------------------------------------------

_ZIP = zstandard.ZstdCompressor(level=1)


def pack(values: np.ndarray) -> bytes:
    """Numbers, byte planes one after the other, compressed."""
    values = np.ascontiguousarray(values)
    return _ZIP.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def pack_words(words: list[bytes]) -> bytes:
    return _ZIP.compress(b"\n".join(words))


def unpack_words(data: bytes, n: int) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n") if n else []


class Block:
    """The distinct words and bigrams of a block of documents, in an order that depends on the block's rows only."""

    def __init__(self, doc_ids: Iterable, texts: Iterable[str]) -> None:
        numbering = Numbering()
        ids, parts, sizes, train = numbering.of, [np.zeros(0, np.int64)], [], []
        end = ids[END]
        for doc_id, text in zip(doc_ids, texts, strict=True):
            words = ascii_words(text)
            words.append(END)
            parts.append(numbering.numbers(words, len(words)))
            sizes.append(len(words))
            train.append(zlib.crc32(str(doc_id).encode()) % 7 != HELD_OUT)
        self.train = np.array(train, bool)
        self.sizes = np.array(sizes, np.int64)
        self.words = sorted(ids)
        rank = np.empty(len(ids), np.int64)
        rank[np.fromiter(map(ids.__getitem__, self.words), np.int64, len(ids))] = np.arange(len(ids))
        self.tokens = rank[np.concatenate(parts)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[self.starts] = rank[end]  # a text begins after an end
        self.pairs, self.pair_of = np.unique(context << 32 | self.tokens, return_inverse=True)
        self.token_trains = np.repeat(self.train, self.sizes)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in self.words), np.uint64, len(self.words))
        first, second = hashes[self.pairs >> 32], hashes[self.pairs & 0xFFFFFFFF]
        mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (second ^ (second >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.keys = mixed ^ (mixed >> np.uint64(32))
        self.key_order = np.argsort(self.keys, kind="stable")
        self.word_hashes = hashes

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.token_trains], minlength=len(self.words))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.token_trains], minlength=len(self.pairs))

    def by_shard(self, shards: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Positions of words and of pairs that belong to each shard, in the order in which they are sent."""
        word_shard = (self.word_hashes % np.uint64(shards)).astype(np.int64)
        order = np.argsort(word_shard, kind="stable")
        words = np.split(order, np.searchsorted(word_shard[order], np.arange(1, shards)))
        pair_shard = (self.keys[self.key_order] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        return words, np.split(self.key_order, np.searchsorted(pair_shard, np.arange(1, shards)))


REQUEST = "shard int, block int, n_words int, words binary, word_counts binary, keys binary, key_counts binary"
REPLY = "block int, shard int, word_counts binary, key_counts binary, n long, v long, once long, twice long"


def ask(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """What a block sends to each shard."""
    block = Block(pdf["id"], pdf["text"])
    word_counts, pair_counts = block.word_counts().astype(np.uint32), block.pair_counts().astype(np.uint32)
    rows = []
    for shard, (w, p) in enumerate(zip(*block.by_shard(shards), strict=True)):
        rows.append((shard, pdf["block"].iloc[0], len(w), pack_words([block.words[i] for i in w]), pack(word_counts[w]),
                     pack(np.diff(block.keys[p], prepend=np.uint64(0))), pack(pair_counts[p])))
    return pd.DataFrame(rows, columns=["shard", "block", "n_words", "words", "word_counts", "keys", "key_counts"])


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's corpus-wide counts for every block, and what it adds to the statistics."""
    total: dict[bytes, int] = {}
    asked = [unpack_words(w, n) for w, n in zip(pdf["words"], pdf["n_words"], strict=True)]
    for words, counts in zip(asked, pdf["word_counts"], strict=True):
        for w, c in zip(words, unpack(counts, np.uint32).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(back, weights=np.concatenate([unpack(c, np.uint32) for c in pdf["key_counts"]])).astype(np.uint64)
    seen = np.fromiter(total.values(), np.int64, len(total))
    statistics = (int(seen.sum()), int((seen > 0).sum()), int((seen == 1).sum()), int((seen == 2).sum()))
    rows, at = [], 0
    for block, words, k in zip(pdf["block"], asked, keys, strict=True):
        rows.append((block, pdf["shard"].iloc[0], pack(np.array([total[w] for w in words], np.uint64)), pack(sums[back[at:at + len(k)]]), *statistics))
        at += len(k)
    return pd.DataFrame(rows, columns=["block", "shard", "word_counts", "key_counts", "n", "v", "once", "twice"])


SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: pd.DataFrame, replies: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Scores of a block's documents from the shards' answers."""
    block = Block(docs["id"], docs["text"])
    replies = replies.sort_values("shard")
    n, v, once, twice = (int(replies[c].sum()) for c in ("n", "v", "once", "twice"))
    c1, c2 = np.zeros(len(block.words), np.int64), np.zeros(len(block.pairs), np.int64)
    for w, p, wc, pc in zip(*block.by_shard(shards), replies["word_counts"], replies["key_counts"], strict=True):
        c1[w], c2[p] = unpack(wc, np.uint64), unpack(pc, np.uint64)
    base = np.log10((c1 + 1) / (n + v + 1))
    discount = once / (once + 2 * twice) if once else 0.5
    unseen = max(1.0, once * once / (2 * max(1, twice)))
    unigram = np.where(c1 > 0, (c1 - discount) / max(1, n), (discount * v / n if n else 1.0) / unseen)
    context, word = block.pairs >> 32, block.pairs & 0xFFFFFFFF
    known = c2 > 0  # pairs are sorted by context and word already
    own = (c2[known] + MU * unigram[word[known]]) / (c1[context[known]] + MU)
    trie = Trie.mapped(Trie.packed(np.log10(unigram), np.log10(MU / (c1 + MU)), context[known], word[known], np.log10(own)))
    of_pair = np.concatenate([trie.log10(context[i:i + (1 << 18)], word[i:i + (1 << 18)]) for i in range(0, len(context), 1 << 18)])
    add = lambda x: np.add.reduceat(x, block.starts)
    return pd.DataFrame({"held_out": ~block.train, "n_tokens": block.sizes, "n_known": add((c1 > 0).astype(np.int64)[block.tokens]),
                         "train_tokens": n, "base_score": add(base[block.tokens]), "score": add(of_pair[block.pair_of])})


def scored(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    blocks: number of document blocks and of shards (default: the session's
    number of shuffle partitions); a block's texts are held by one task.
    """
    count = partitions(docs.sparkSession, blocks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), whole_text().alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)).cast("int"))
    requests = rows.groupBy("block").applyInPandas(lambda pdf: ask(pdf, count), REQUEST)
    replies = requests.groupBy("shard").applyInPandas(answer, REPLY)

    def both(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = score(docs, replies, count)
        out.insert(0, "doc_id", docs["id"].where(docs["id"] != "null").to_numpy())
        return out

    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(both, f"doc_id string, {SCORED}").withColumn(
        "doc_id", F.col("doc_id").cast(kind))


def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op2_elias_fano_lm": op2_elias_fano_lm}
ORACLES: dict[str, str] = {}
