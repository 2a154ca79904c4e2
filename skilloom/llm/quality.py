r"""Quality rules as a learned decision list.

Statistics of every text come from one pass.  From the labelled documents'
statistics, sequential covering learns an ordered list of rules that reject: a
rule grows one threshold at a time by information gain on one part of the
labelled rows, is pruned on the other part, and stands only if it is precise
there; what it covers is taken out before the next rule grows.  The list is
emitted as an ordered Spark conditional expression over the statistics, so
applying it is ordinary generated code, and it can be read and stored as text.

Defined cases: null and empty texts have no words and fail the base rule;
repeated rows and repeated labels count as often as they occur; unlabelled
rows and null labels teach nothing; without both kinds of labels the list is
empty and the base rule alone decides; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, materialize, per_text, table, whole_text

#: Production parameters: labelled rows to learn from (in the mean; twice as many at most), rules, conditions of a rule, least precision and cover of a rule.
SAMPLE, RULES, CONDITIONS, PRECISION, COVER = 20_000, 12, 4, 0.9, 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim",
              "n_short_words")
#: What rules may test, as Spark expressions over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "short_words": "n_short_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
#: Fixed values of the base rule: words of a window, least words, most words in repeated windows in a hundred.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
BLANKS, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
NOT_UPPER = bytes(sorted(set(range(256)) - set(range(65, 91))))
NOT_LETTER = bytes(sorted(set(range(256)) - set(range(65, 91)) - set(range(97, 123))))
MIX = np.random.default_rng(5).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[list[bytes]]) -> list[int]:
    """For each text, its words that lie in a window which the text holds twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    ids = Numbering().numbers((w for text in words for w in text), total).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    if total < WINDOW:
        return [0] * len(words)
    n = total - WINDOW + 1
    whole = owner[:n] == owner[WINDOW - 1:]
    key = owner[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key += ids[k:k + n] * MIX[k]
    at = np.flatnonzero(whole)
    _, back, count = np.unique(key[at], return_inverse=True, return_counts=True)
    marks = np.zeros(total + 1, np.int64)
    twice = at[count[back] > 1]
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    inside = np.cumsum(marks[:-1]) > 0
    return np.bincount(owner, weights=inside, minlength=len(words)).astype(np.int64).tolist()


def text_statistics(texts: list[str]) -> dict[str, list[int]]:
    out: dict[str, list] = {k: [] for k in STATISTICS}
    split = []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        split.append(words)
        lines = [line for line in data.split(b"\n") if line.strip()]
        blanks = len(data) - len(data.translate(None, BLANKS))
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - blanks)
        out["n_symbols"].append(len(data) - len(data.translate(None, SYMBOLS)))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_upper"].append(len(data.translate(None, NOT_UPPER)))
        out["n_letters"].append(len(data.translate(None, NOT_LETTER)))
        out["n_exclaim"].append(data.count(b"!"))
        out["n_short_words"].append(sum(map((4).__gt__, map(len, words))))
    out["n_repeat_words"] = repeated_words(split)
    return out


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of every document."""
    return per_text(docs, keep, whole_text(), lambda: text_statistics, dict.fromkeys(STATISTICS, "long"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] >= self.threshold if self.above else rows[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(rows.values()))), bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _best(rows: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, without: set[str]) -> Condition | None:
    """The condition with the largest information gain (Foil's) among the rows inside."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base, best, chosen = np.log2(p0 / (p0 + n0)), 1e-9, None
    for name in (f for f in FEATURES if f not in without):
        x, y = rows[name][inside], bad[inside]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cuts = np.flatnonzero(np.diff(x) > 0)
        if not len(cuts):
            continue
        p_low = np.cumsum(y)[cuts]
        n_low = cuts + 1 - p_low
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best = float(gain[at])
                chosen = Condition(name, above, float((x[cuts[at]] + x[cuts[at] + 1]) / 2))
    return chosen


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """Rules that say "bad", in order. grow: rows to grow rules on; the others prune them."""
    rules: list[Rule] = []
    left, failed = np.ones(len(bad), bool), set()  # failed: features with which no rule starts until one stands
    while len(rules) < RULES and (bad & left & grow).any():
        rule: Rule = ()
        inside = left & grow
        while len(rule) < CONDITIONS and (~bad & inside).any():
            condition = _best(rows, bad, inside, failed if not rule else set())
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.holds(rows)
        if not rule:
            break
        held = left & ~grow

        def worth(r: Rule, held: np.ndarray = held) -> tuple[float, int]:
            on = _covered(r, rows) & held
            p, n = int((bad & on).sum()), int((~bad & on).sum())
            return (p - n) / max(1, p + n), p

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        on = _covered(rule, rows) & left
        p, n = int((bad & on).sum()), int((~bad & on).sum())
        if p < COVER or p < PRECISION * (p + n) or worth(rule)[0] < 2 * PRECISION - 1:
            failed.add(rule[0].feature)
            continue
        rules.append(rule)
        left &= ~on
        failed.clear()
    return rules


def expression(rules: list[Rule]) -> str:
    """The decision list as an ordered conditional: the number of the first rule that holds, else 0."""
    cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN {i}" for i, r in enumerate(rules, 1))
    return f"CASE {cases} ELSE 0 END" if rules else "0"


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from about ``sample`` labelled rows, those whose hashes lie below a bound; what reaches the driver doesn't grow with the input."""
    named = labels.filter("quality IS NOT NULL").selectExpr("doc_id", "quality", "xxhash64(doc_id) AS h")
    share = min(1.0, sample / max(1, named.count()))
    known = stats.join(named.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))), "doc_id")
    pick = known.selectExpr("h", "quality = 0 AS bad", *(f"{e} AS {k}" for k, e in FEATURES.items()))
    got = pick.limit(2 * sample).toPandas().sort_values(["h", *FEATURES, "bad"])
    rows = {k: got[k].to_numpy(float) for k in FEATURES}
    return learn(rows, got["bad"].to_numpy(bool), got["h"].to_numpy(np.int64) % 3 != 0)


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: doc_id), the statistics, base_failed, rule (number of the rejecting rule, 0: none), kept."""
    keep = keep or ["doc_id"]
    stats = materialize(statistics(docs, keep), "quality")
    verdict = F.expr(expression(fit(stats, labels)))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op4_decision_list": op4_decision_list}
ORACLES: dict[str, str] = {}
