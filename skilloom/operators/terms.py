"""Match texts against a term *table* (names with aliases), for taxonomies kept as data.

A text is cut once into pieces and the separators between them.  Every run of
one to ``most_pieces`` neighbouring pieces is an occurrence with its position;
occurrences meet the spellings in an equi-join on the whole lower-cased core of
a spelling, so no text meets every term, no pattern is built from data and no
text travels with a term.  What stands before and behind a core decides on the
boundary rule; the first occurrence of a term wins, as in a scan of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skilloom.functions import js
from skilloom.operators.skills import LEFT, RIGHT

# Both delimiter classes: texts and spellings are cut into the same pieces.
_DELIMITERS = f"{js.WS},;:(/\\[{{<>\"'`)\\]}}!?."
CUT = f"[{_DELIMITERS}]+"
_SEAM = f"(?<=[{_DELIMITERS}])(?=[^{_DELIMITERS}])|(?<=[^{_DELIMITERS}])(?=[{_DELIMITERS}])"


def spellings(terms: DataFrame) -> DataFrame:
    """name and, per spelling, lead and trail (delimiters at its ends), core (between them, in lower case), pieces, length."""
    every = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    one = terms.select("name", F.explode_outer(every).alias("_s")).filter(F.col("_s").isNotNull())
    lead, trail = F.regexp_extract("_s", f"^{CUT}", 0), F.regexp_extract("_s", f"{CUT}$", 0)
    core = F.regexp_replace("_s", f"^{CUT}|{CUT}$", "")
    return one.filter(core != "").select("name", lead.alias("lead"), trail.alias("trail"), F.lower(core).alias("core"),
                                         F.size(F.split(core, CUT)).alias("pieces"), F.length("_s").alias("length"))


def occurrences(texts: DataFrame, key: str, text: str, most_pieces: int) -> DataFrame:
    """key, at, raw, before, after of every run of up to ``most_pieces`` neighbouring pieces; no shuffle."""
    # Pieces stand at the odd places, separators at the even ones, at both ends too.
    cut = F.split(F.concat(F.lit("\n"), F.col(text), F.lit("\n")), _SEAM)

    def run(w: Column, at: Column, k: int) -> Column:
        return F.struct(at.alias("at"), F.array_join(F.slice(w, at + 1, F.lit(2 * k - 1)), "").alias("raw"),
                        F.get(w, at - 1).alias("before"), F.get(w, at + (2 * k - 1)).alias("after"))

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) > 2, F.sequence(F.lit(1), F.size(w) - 2, F.lit(2)))
        return F.flatten(F.transform(places, lambda at: F.array(*(run(w, at, k) for k in range(1, most_pieces + 1)))))

    # Bound in a lambda, so that a text is cut once and not once for each of its pieces.
    found = F.flatten(F.transform(F.array(cut), runs))
    return texts.select(key, F.explode_outer(found).alias("_o")).filter(F.col("_o.after").isNotNull()).select(key, "_o.*")


def match_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, most_pieces: int | None = None) -> DataFrame:
    """First match of every (text, term): key, term, token, match_type.

    Of spellings that match at the same place the longest wins.  Case folds by
    ``lower``.  ``most_pieces`` is the number of pieces of the longest spelling;
    where it is not given, a small job over the terms finds it.
    """
    names = spellings(terms)
    if most_pieces is None:
        most_pieces = names.agg(F.max("pieces")).first()[0] or 1
    d = occurrences(texts, key, text, most_pieces).withColumn("core", F.lower("raw")).join(names.drop("pieces"), "core")
    ahead, behind = F.length("before") - F.length("lead"), F.length("trail") + 1
    fits = ((ahead > 0) & F.endswith("before", F.col("lead")) & F.substring(F.col("before"), ahead, F.lit(1)).rlike(LEFT)
            & F.startswith("after", F.col("trail")) & F.concat(F.substring(F.col("after"), behind, F.lit(1)), F.lit("_")).rlike(f"^{RIGHT}"))
    first = F.struct("at", -F.length("lead"), -F.col("length"))
    best = d.filter(fits).groupBy(key, "name").agg(F.min_by(F.concat("lead", "raw", "trail"), first).alias("token"))
    return best.select(key, F.col("name").alias("term"), "token",
                       F.when(F.lower("token") == F.lower("name"), "EXACT").otherwise("ALIAS").alias("match_type"))
