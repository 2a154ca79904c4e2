r"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair encoding is valid exactly if every two neighbouring tokens are the
encoding of their joined bytes, and each text has one valid encoding.  So the
last token of a prefix is the one token ending there that agrees with the last
token of the prefix before it, and its count is one more than there: one pass
from left to right gives the exact count of *every* prefix of a piece.  Pieces
(words with their blank, numbers, runs of marks or white space) are encoded on
their own, so a text's counts are running sums over its pieces.  The table of
a frequent piece is kept by the worker; a full table is emptied, which changes
no result.

From the counts follow, without encoding again: the token count of the text,
of any cut of it, and the longest prefix within a budget (counts may fall when
a letter completes a token, so it is the *last* prefix within the budget).

Where a prefix ends changes how its end is cut into pieces in three places,
which the counts allow for: within a run of white space, within "'re", "'ve"
and "'ll", and within the string of an added token (which is one token when
whole, as the library has it by default).

Defined cases: null and empty texts have no tokens; repeated rows give
repeated rows; an empty table gives an empty one; texts of any length are
encoded whole, in time that grows with their length; extra input columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import vocabulary
from .common import per_text, table, whole_text

COUNT = np.dtype("<u2")
#: Most pieces and pairs that a worker remembers (memory only: about 250 bytes each).
REMEMBERED = 1_000_000
#: Code points from which a piece is counted on its own: it isn't remembered, and its counts need more than 16 bits.
LONG = 200
#: A prefix that ends within one of these pieces is two pieces.
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
BLANKS = re.compile(r"\s\s")


class Suffixes:
    """All tokens that end at each byte, longest first: an automaton over the tokens, whose steps are found when first needed."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.starts = {b[:i] for b in ranks for i in range(1, len(b) + 1)}
        self.names, self.states, self.steps = [b""], {b"": 0}, {}
        self.ending: list[tuple[tuple[int, int], ...]] = [()]

    def step(self, state: int, byte: int) -> int:
        """The longest end of (what the state stands for + byte) with which a token starts."""
        name = self.names[state] + bytes((byte,))
        while name not in self.starts and name:
            name = name[1:]
        if name not in self.states:
            self.states[name] = len(self.names)
            self.names.append(name)
            self.ending.append(tuple((self.ranks[t], len(t)) for i in range(len(name)) if (t := name[i:]) in self.ranks))
        self.steps[state << 8 | byte] = self.states[name]
        return self.states[name]


class PrefixCounter:
    """Token counts of all code-point prefixes of texts."""

    def __init__(self, path: str) -> None:
        self.ranks, self.added = vocabulary.load(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.ends = Suffixes(self.ranks)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Token ids of a few bytes, by merging in the order of ranks."""
        parts, none = [data[i:i + 1] for i in range(len(data))], 1 << 60
        rank = self.ranks.get
        joined = [rank(data[i:i + 2], none) for i in range(len(data) - 1)]
        while joined and (best := min(joined)) < none:
            at = joined.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def agree(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        yes = self.pairs[left << 20 | right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return yes

    def tables(self, pieces: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each piece with its counts after each code point; what a piece shares with the one before it isn't worked out again."""
        last, count, state_at, data = [-1], [0], [0], b""
        steps, ending, pairs = self.ends.steps, self.ends.ending, self.pairs
        for piece in pieces:
            old, data, same = data, piece.encode("utf-8", "surrogatepass"), 0
            for x, y in zip(old, data):
                if x != y:
                    break
                same += 1
            del last[same + 1:], count[same + 1:], state_at[same + 1:]
            state, end = state_at[-1], same
            for byte in data[same:]:
                end += 1
                state = step if (step := steps.get(state << 8 | byte)) is not None else self.ends.step(state, byte)
                for token, length in ending[state]:
                    before = last[end - length]
                    if before < 0 or ((yes := pairs.get(before << 20 | token)) is None and self.agree(before, token)) or yes:
                        last.append(token)
                        count.append(count[end - length] + 1)
                        break
                state_at.append(state)
            if piece in CONTRACTIONS:
                yield piece, [count[1], 2, count[3]]
            elif len(data) == len(piece):
                yield piece, count[1:]
            else:
                yield piece, [count[i] for i in itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]

    def piece(self, piece: str) -> list[int]:
        return next(self.tables([piece]))[1]

    def learn(self, pieces: set[str]) -> None:
        """Makes sure that the tables of these pieces are at hand."""
        if missing := pieces.difference(self.known):
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = pieces
            for p, counts in self.tables(sorted(missing)):
                self.known[p] = array("H", counts).tobytes()

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """The counts of each text."""
        cut = [vocabulary.pieces(t) for t in texts]
        short = [p for p in cut if not p or max(map(len, p)) < LONG]
        self.learn(set().union(*short))
        return [self.plain(t, p) if not any(a in t for a in self.added) else self(t) for t, p in zip(texts, cut, strict=True)]

    def __call__(self, text: str) -> np.ndarray:
        """counts[i]: tokens of the first i + 1 code points."""
        if self.cut is None or not any(a in text for a in self.added):
            return self.plain(text)
        out, total, own = [], 0, 0  # own: tokens of the ordinary part before
        parts = self.cut.split(text)
        for i, part in enumerate(parts):
            if i % 2:  # an added token: its own prefixes are ordinary text that goes on where the last part ended
                before = parts[i - 1]
                inner = self.plain(before + part)[len(before):-1].astype(np.int64) + (total - own)
                total += 1
                out.append(np.append(inner, total))
            elif part:
                counts = self.plain(part).astype(np.int64) + total
                own, total = int(counts[-1]) - total, int(counts[-1])
                out.append(counts)
            else:
                own = 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def plain(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """As __call__, with the strings of added tokens taken as ordinary text. pieces: those of the text, if already cut."""
        pieces = vocabulary.pieces(text) if pieces is None else pieces
        if not pieces:
            return np.zeros(0, np.int64)
        known = self.known
        if max(map(len, pieces)) >= LONG:
            counts, ends, base = self._long(pieces)
        else:
            try:
                tables = [known[p] for p in pieces]
            except KeyError:
                self.learn(set(pieces))
                tables = [known[p] for p in pieces]
            counts = np.frombuffer(b"".join(tables), COUNT).astype(np.int64)
            lengths = np.fromiter(map(len, tables), np.int64, len(tables)) // COUNT.itemsize
            ends = np.cumsum(lengths)
            totals = counts[ends - 1]
            base = np.cumsum(totals) - totals
            counts += np.repeat(base, lengths)
        if BLANKS.search(text):
            for i, p in enumerate(pieces[:-1]):  # a run of white space whose last blank went to the next piece
                if p[0].isspace() and pieces[i + 1][0].isspace():
                    counts[ends[i]] = base[i] + self.piece(p + pieces[i + 1][0])[-1]
        return counts

    def _long(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, ends and bases of pieces of any length."""
        tables = [np.array(self.piece(p), np.int64) for p in pieces]
        totals = np.array([t[-1] for t in tables])
        base = np.cumsum(totals) - totals
        return np.concatenate(tables) + np.repeat(base, [len(t) for t in tables]), np.cumsum([len(t) for t in tables]), base


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _counted(docs: DataFrame, path: str | None, columns: Callable[[list[str], list[np.ndarray]], dict], fields: dict[str, str]) -> DataFrame:
    """doc_id and new columns from texts and their counts for every document, in one pass over the texts."""
    path = path or vocabulary.default_path()

    def make() -> Callable[[list[str]], dict]:
        count = counter(path)
        return lambda texts: columns(texts, count.each(texts))

    return per_text(docs, ["doc_id"], whole_text(), make, fields)


def within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``counts``: element i is the number of tokens of the first i code points (element 0 is 0)."""
    return _counted(docs, path, lambda texts, counts: {"counts": [np.append(0, c) for c in counts]}, {"counts": "array<long>"})


def token_counts(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_chars: code points of the longest prefix within the budget."""

    def columns(texts: list[str], counts: list[np.ndarray]) -> dict:
        n = [int(c[-1]) if len(c) else 0 for c in counts]
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > budget for x in n],
                "kept_chars": [within(c, budget) if x > budget else len(c) for x, c in zip(n, counts, strict=True)]}

    return _counted(docs, path, columns, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean", "kept_chars": "long"})


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, text: each text cut to its longest prefix within the budget (null: empty)."""
    return _counted(docs, path, lambda texts, counts: {"text": [t[:within(c, budget)] for t, c in zip(texts, counts, strict=True)]},
                    {"text": "string"})


#: The token limit of the registered query.
LIMIT = 1024


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), LIMIT)


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
