r"""Licence scans with a positional rare-token index, in built-in functions only.

The templates are a fixed list of licence notices; their words' document
frequencies are counted over all documents.  A template's words of highest IDF
(those of lowest positive frequency) are its index words.  For every file the
positions of the index words are looked up in the postings; a file position
less a template position is where the template would start, and postings that
agree on (template, start) support each other.  A start counts if two index
words agree on it and every word of the template's mandatory key phrases
stands in its place; then the file gets the template's label.  The score is
the largest share of a template's index and key words found in place.

Apart from that every place of the four base phrases is counted.

One pass over the texts writes words counts, base places and the positions of
template words (only for files that hold a word without which no template can
be verified); the rest works on those.  Only the template vocabulary's counts
(a fixed number of words) come to the driver.

Defined cases: null texts are empty, without words; repeated rows are each
reported; texts of any length are searched whole; with no documents the result
is empty; extra input columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, whole_text

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Label, notice as published, mandatory key phrases (each once in the notice).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
     License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
     ("apache org licenses license 2 0", "unless required by applicable law")),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
     (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
     publish, distribute, sublicense, and/or sell copies of the Software""",
     ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("gpl-3.0", """it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
     License, or (at your option) any later version.""", ("gnu general public license as published", "version 3 of the license")),
    ("gpl-2.0", """it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the
     License, or (at your option) any later version.""", ("gnu general public license as published", "version 2 of the license")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("gnu lesser general public license",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met""", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
     that the above copyright notice and this permission notice appear in all copies""",
     ("for any purpose with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
)
#: Production parameters: index words of a template, index words that must agree on a start.
INDEX_WORDS, AGREE = 6, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


NOTICES = [words_of(text) for _, text, _ in TEMPLATES]
VOCABULARY = sorted({w for n in NOTICES for w in n})


def _key_places(t: int) -> set[int]:
    """Positions of a template's key phrases."""
    out: set[int] = set()
    for phrase in TEMPLATES[t][2]:
        p = phrase.split()
        starts = [i for i in range(len(NOTICES[t]) - len(p) + 1) if NOTICES[t][i:i + len(p)] == p]
        if len(starts) != 1:
            raise ValueError(f"{phrase!r} must stand once in template {t}")
        out |= set(range(starts[0], starts[0] + len(p)))
    return out


#: (template, word, position) of all templates, and whether the word is part of a key phrase.
POSTINGS = [(t, w, i, i in keys) for t, n in enumerate(NOTICES) for keys in [_key_places(t)] for i, w in enumerate(n)]
#: Every base phrase and every template's key phrases hold one of these.
GATE = ("license", "licenses", "granted", "redistribution", "cc", "commons", "unencumbered")


def found(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, base places and labels, template words present, and their positions in files that pass the gate; written once."""
    vocabulary = "array(" + ", ".join(f"'{w}'" for w in VOCABULARY) + ")"
    phrase = "r'(?<= )(" + "|".join(PHRASES) + ")(?= )'"
    label = "map(" + ", ".join(f"'{p}', '{v}'" for p, v in PHRASES.items()) + ")"
    blanks = "(length({0}) - length(replace({0}, ' ', '')))"
    # lower() also changes letters beyond A-Z, but never into words of a phrase or a template: what it makes an ASCII letter (the Kelvin sign)
    # is a k, which no phrase holds, and word borders stay.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lower(whole_text()).alias("t"))
    rows = rows.withColumn("words", F.array_remove(F.split("t", SEPARATORS, -1), ""))
    rows = rows.withColumn("gated", F.expr(" or ".join(f"contains(t, '{w}')" for w in GATE)))
    rows = rows.withColumn("s", F.expr("if(gated, concat(' ', array_join(words, ' '), ' '), '')"))
    rows = rows.withColumn("hits", F.expr(f"if(gated, regexp_extract_all(s, {phrase}, 1), cast(array() as array<string>))"))
    rows = rows.withColumn("parts", F.expr(f"if(size(hits) > 0, split(s, {phrase}, -1), cast(array() as array<string>))"))
    return materialize(rows.selectExpr(
        "row", "doc_id", "cast(size(words) as long) as n_words", "cast(size(hits) as long) as n_base",
        f"cast(if(size(hits) > 0, {blanks.format('element_at(parts, 1)')} - 1, null) as long) as first_word",
        f"cast(if(size(hits) > 0, size(words) - ({blanks.format('element_at(parts, -1)')} - 1) - {blanks.format('element_at(hits, -1)')} - 1, null) as long)"
        " as last_word",
        f"array_sort(array_distinct(transform(hits, h -> {label}[h]))) as base",
        f"array_intersect(words, {vocabulary}) as present",
        f"if(gated, filter(transform(words, (w, i) -> struct(w as word, i as place)), x -> array_contains({vocabulary}, x.word)),"
        " cast(array() as array<struct<word: string, place: int>>)) as places"), "licences")


def index_words(frequency: dict[str, int]) -> dict[int, list[str]]:
    """Each template's words of highest IDF among those that occur: lowest document frequency first, then by name."""
    return {t: sorted({w for w in n if frequency.get(w)}, key=lambda w: (frequency[w], w))[:INDEX_WORDS] for t, n in enumerate(NOTICES)}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), own (labels the method adds), score of every document."""
    seen = found(docs)
    counts = seen.select(F.explode("present").alias("word")).groupBy("word").count().collect()  # at most one row per template word
    index = index_words({r["word"]: r["count"] for r in counts})
    needed = [(t, w, i, w in index[t], key) for t, w, i, key in POSTINGS if key or w in index[t]]
    postings = "array(" + ", ".join(f"named_struct('word', '{w}', 't', {t}, 'at', {i}, 'rare', {str(r).lower()}, 'key', {str(k).lower()})"
                                    for t, w, i, r, k in needed) + ")"
    lists = docs.sparkSession.range(1).selectExpr(f"inline({postings})")
    per = docs.sparkSession.range(1).selectExpr("inline(array(" + ", ".join(
        f"named_struct('t', {t}, 'label', '{TEMPLATES[t][0]}', 'n_needed', {sum(x[0] == t for x in needed)}, 'n_key', {sum(x[0] == t and x[4] for x in needed)})"
        for t in range(len(TEMPLATES))) + "))")
    votes = (seen.filter("size(places) > 0").selectExpr("row", "inline(places)").join(F.broadcast(lists), "word")
             .groupBy("row", "t", (F.col("place") - F.col("at")).alias("start"))
             .agg(F.count("*").alias("n"), F.count_if("rare").alias("agree"), F.count_if("key").alias("keys")))
    verified = votes.filter(f"agree >= {AGREE}").join(F.broadcast(per), "t").filter("keys = n_key").groupBy("row").agg(
        F.array_sort(F.collect_set("label")).alias("own"), F.max(F.col("n") / F.col("n_needed")).alias("score"))
    return seen.drop("present", "places").join(verified, "row", "left").drop("row")


def op9_license_rare_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base, ',') as base_labels",
        "array_join(array_sort(array_union(base, coalesce(own, array()))), ',') as labels", "coalesce(score, 0D) as score")


def _oracle() -> str:
    """DuckDB SQL for the query, from the same templates."""
    postings = ", ".join(f"({t}, '{w}', {i}, {str(k).lower()})" for t, w, i, k in POSTINGS)
    labels = ", ".join(f"({t}, '{x[0]}')" for t, x in enumerate(TEMPLATES))
    phrases = ", ".join(f"({i}, {len(p.split())}, '{w}', {j}, '{label}')" for i, (p, label) in enumerate(PHRASES.items()) for j, w in enumerate(p.split()))
    return rf"""
WITH postings(t, word, spot, key) AS (VALUES {postings}), names(t, label) AS (VALUES {labels}),
phrases(p, len, word, spot, label) AS (VALUES {phrases}),
texts AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS s FROM documents),
split AS MATERIALIZED (SELECT r, doc_id, CASE WHEN s = '' THEN []::VARCHAR[] ELSE string_split(s, ' ') END AS words FROM texts),
places AS MATERIALIZED (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM split),
base AS (SELECT r, place - spot AS start, any_value(label) AS label FROM places JOIN phrases USING (word) GROUP BY r, p, place - spot, len HAVING count(*) = len),
base_of AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS base FROM base GROUP BY r),
frequency AS (SELECT word, count(DISTINCT r) AS n FROM places WHERE word IN (SELECT word FROM postings) GROUP BY word),
rare AS (SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY n, word) AS k FROM (SELECT DISTINCT t, word FROM postings) JOIN frequency USING (word)) WHERE k <= {INDEX_WORDS}),
needed AS (SELECT p.*, r.word IS NOT NULL AS rare FROM postings p LEFT JOIN rare r ON p.t = r.t AND p.word = r.word WHERE key OR r.word IS NOT NULL),
votes AS (SELECT r, t, place - spot AS start, count(*) AS n, count(*) FILTER (rare) AS agree, count(*) FILTER (key) AS keys FROM places JOIN needed USING (word) GROUP BY r, t, place - spot),
per AS (SELECT t, count(*) AS n_needed, count(*) FILTER (key) AS n_key FROM needed GROUP BY t),
own AS (SELECT r, list_sort(list(DISTINCT label)) AS own, max(n / n_needed) AS score FROM votes JOIN per USING (t) JOIN names USING (t) WHERE agree >= {AGREE} AND keys = n_key GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM split LEFT JOIN base_of USING (r) LEFT JOIN own USING (r)"""


QUERIES = {"op9_license_rare_index": op9_license_rare_index}
ORACLES = {"op9_license_rare_index": _oracle()}
