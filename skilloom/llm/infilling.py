r"""Fill-in-middle transformation, cut through a sparse exception index.

Texts stay UTF-8 bytes.  Of a text only its multibyte characters are recorded:
their positions and how many bytes more than one they take.  ``searchsorted``
over these exceptions turns a code-point cut into a byte cut and back; between
two exceptions, and everywhere in an ASCII text, both differ by a constant.  So
cuts are found and applied on bytes, and lengths are reported in code points,
without decoding a text.

A text is cut into units, by default the tokens ``[A-Za-z]+|[^A-Za-z]``.  Two
cuts and the form come from a hash of the id: prefix, middle and suffix are
written in the order prefix-suffix-middle (psm) or suffix-prefix-middle (spm),
each behind its mark; other texts stay as they are (plain).  A text that holds
a mark stays plain, so every output can be turned back (``restored``).

One pass in Arrow batches, without a shuffle; work and memory are proportional
to the text.

Defined cases: null and empty texts are plain and empty (0 units); a null
``doc_id`` is hashed as the empty word; repeated rows are cut alike, each a row
of the result; an empty table gives an empty result; very long texts are cut
whole; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table, whole_text

#: Production parameters: seed of the hash, percent of texts that are cut, percent of those in the form spm.
SEED, CUT_PERCENT, SPM_PERCENT = 1, 90, 20
#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes among which units are counted at once.
BLOCK = 1 << 16


class Exceptions:
    """The multibyte characters of a UTF-8 text: what to add to or take from a position to change between code points and bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.at_byte = np.flatnonzero(data >= 0xC0)
        first = data[self.at_byte]
        self.excess = np.append(0, np.cumsum(1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)))
        self.at_char = self.at_byte - self.excess[:-1]
        self.n_chars = len(data) - int(self.excess[-1])

    def to_byte(self, chars: int) -> int:
        return int(chars + self.excess[np.searchsorted(self.at_char, chars)])

    def to_char(self, byte: int) -> int:
        """The code points before a byte position that lies between two characters."""
        return int(byte - self.excess[np.searchsorted(self.at_byte, byte)])


class Tokens:
    """Where the units ``[A-Za-z]+|[^A-Za-z]`` begin."""

    def __init__(self, data: np.ndarray) -> None:
        letter = ((data | 0x20) - 97).astype(np.uint8) < 26
        self.begins = (data & 0xC0) != 0x80
        self.begins[1:] &= ~(letter[1:] & letter[:-1])
        self.end = len(data)
        blocks = [np.count_nonzero(self.begins[i:i + BLOCK]) for i in range(0, self.end, BLOCK)]
        self.before = np.append(0, np.cumsum(blocks))
        self.n = int(self.before[-1])

    def start(self, unit: int) -> int:
        """The byte at which a unit begins; behind the last one, the length."""
        if unit >= self.n:
            return self.end
        block = int(np.searchsorted(self.before, unit, side="right")) - 1
        inside = np.flatnonzero(self.begins[block * BLOCK:(block + 1) * BLOCK])
        return block * BLOCK + int(inside[unit - self.before[block]])


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def cut(data: bytes, hashes: tuple[int, int, int, int], units: str = "tokens") -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle (None if plain), and the output of a text in UTF-8."""
    view = np.frombuffer(data, np.uint8)
    index, tokens = Exceptions(view), Tokens(view) if units == "tokens" else None
    n = tokens.n if tokens else index.n_chars
    if not data or hashes[2] % 100 >= CUT_PERCENT or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    a, b = (tokens.start(u) if tokens else index.to_byte(u) for u in sorted(h % (n + 1) for h in hashes[:2]))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = hashes[3] % 100 < SPM_PERCENT
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    first = index.to_char(a)
    return n, "spm" if spm else "psm", first, index.to_char(b) - first, output


def transformed(docs: DataFrame, units: str = "tokens", seed: int = SEED) -> DataFrame:
    """doc_id, n (units: "tokens" or "chars"), form, prefix_chars, middle_chars and output of every document."""
    if units not in ("tokens", "chars"):
        raise ValueError(f"unknown units: {units}")

    def make() -> Callable[[list], dict]:
        def columns(rows: list[dict]) -> dict:
            out: dict[str, list] = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for row in rows:
                for name, value in zip(out, cut(row["data"], draws(row["doc_id"], seed), units), strict=True):
                    out[name].append(value)
            return out

        return columns

    data = F.struct(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("data"))
    return per_text(docs, ["doc_id"], data, make,
                    {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"})


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from: marks part its pieces, since no piece holds one and none overlaps a piece's end."""
    first = {"psm": SUFFIX, "spm": PREFIX}
    second, third = (f"locate('{{}}', {output}, 4)", f"locate('{MIDDLE}', {output}, {{}})")
    pieces = {}
    for name, mark in first.items():
        at = second.format(mark)
        to = third.format(at)
        pieces[name] = (f"substring({output}, 4, {at} - 4)", f"substring({output}, {at} + 3, {to} - {at} - 3)", f"substring({output}, {to} + 3)")
    (prefix, suffix, middle), (tail, head, between) = pieces["psm"], pieces["spm"]
    return F.expr(f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN concat({prefix}, {middle}, {suffix}) "
                  f"WHEN 'spm' THEN concat({head}, {between}, {tail}) END")


def op11_exception_index_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


QUERIES = {"op11_exception_index_infilling": op11_exception_index_infilling}

_GROUP = "('0x' || sha[{0}:{1}])::BIGINT"
ORACLES = {"op11_exception_index_infilling": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM t),
h AS (SELECT *, len(units) AS n, {_GROUP.format(1, 8)} % (len(units) + 1) AS a, {_GROUP.format(9, 16)} % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_GROUP.format(17, 24)} % 100 >= {CUT_PERCENT} THEN 'plain'
    WHEN {_GROUP.format(25, 32)} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
  array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""}
