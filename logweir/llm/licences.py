"""Licence scans by diagonal voting, in DataFrame functions only.

Every run of ``GRAM`` consecutive words of a document is hashed and joined to the runs of the licence texts.
Runs whose words are not as long as those of any licence's run are left out before anything else is done to them.
A hit at word p of the document and word q of a licence votes for the diagonal p - q: an unchanged copy puts all its
votes on one diagonal, a word put in or left out moves the rest to the next one. Votes are counted by diagonal,
neighbouring diagonals that go on where the other ends are merged, and the spans found that way are verified.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of digits, lower-case Latin letters and anything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered. A class of what it leaves out, like the one above, takes Java's patterns six times as long.
RAW_WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a run, and how far apart the diagonals of one span may be.
GRAM, SHIFT = 3, 8
#: A span holds this share of the licence's words, and of its own length that share is the licence's.
COVERAGE, DENSITY = 0.75, 0.6

# Phrases that name a licence by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, words a span must hold to carry it, and the licence's own words as they are published.
TEMPLATES = [
    ("mit", "mit", "released under the MIT License"),
    ("mit", "mit", "this project is licensed under the terms of the MIT License"),
    ("mit", "permission granted charge", """Permission is hereby granted, free of charge, to any person obtaining a copy
      of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
      including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
      copies of the Software"""),
    ("apache-2", "apache 2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "apache 2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
      except in compliance with the License. You may obtain a copy of the License at
      http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache-2", "express implied", """Unless required by applicable law or agreed to in writing, software distributed
      under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
      or implied"""),
    ("cc-by-nc", "nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "noncommercial", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
      International License"""),
    ("cc-by", "attribution international", """This work is licensed under a Creative Commons Attribution 4.0 International
      License"""),
    ("cc-by-sa", "sharealike", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International
      License"""),
    ("cc0", "cc0 dedication", "released under the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-3", "3", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "2", "this work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
      General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
      option) any later version"""),
    ("gpl-2", "2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
      General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
      option) any later version"""),
    ("lgpl", "lesser", """This library is free software; you can redistribute it and/or modify it under the terms of the
      GNU Lesser General Public License as published by the Free Software Foundation"""),
    ("agpl-3", "affero 3", """you can redistribute it and/or modify it under the terms of the GNU Affero General Public
      License as published by the Free Software Foundation, either version 3 of the License"""),
    ("mpl-2", "mozilla 2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
      copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("bsd", "redistributions binary", """Redistribution and use in source and binary forms, with or without modification,
      are permitted provided that the following conditions are met: Redistributions of source code must retain the above
      copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
      reproduce the above copyright notice"""),
    ("isc", "permission fee", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
      without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
      copies"""),
    ("unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
]


def raw_words(text: Column) -> Column:
    """The words of a text in order, as they are written; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORDS), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return raw_words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def lowered(word: Column) -> Column:
    """A word with A-Z lowered; that is what ``lower`` does, in less time, to a word of ASCII alone."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _grams(rows: DataFrame, at: str, shapes: DataFrame | None = None) -> DataFrame:
    """``rows`` without ``words``: one row for each run of GRAM words with its place, its shape, its words lowered and their hash.

    The shape tells the lengths of the words in bytes, which lowering leaves alone; only runs that have one of ``shapes``
    are kept, if they are given.
    """
    kept = [c for c in rows.columns if c != "words"]
    first = F.slice("words", F.lit(1), F.greatest(F.size("words") - (GRAM - 1), F.lit(0)))
    run = [F.coalesce(F.get("words", F.col(at) + i), F.lit("")) for i in range(GRAM)]
    shape = F.lit(0).cast("long")
    for word in run:
        shape = shape * 1000 + F.octet_length(word) % 1000
    dealt = rows.select(*kept, "words", F.posexplode(first).alias(at, "first")).withColumn("shape", shape)
    if shapes is not None:
        dealt = dealt.join(F.broadcast(shapes.select("shape")), "shape", "left_semi")
    parts = [lowered(word).alias(f"g{i}") for i, word in enumerate(run)]
    return dealt.select(*kept, at, "shape", *parts).withColumn("gram", F.xxhash64(*[f"g{i}" for i in range(GRAM)]))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]], phrases: dict[str, str] | None = None) -> DataFrame:
    """(template, label, needs, words, exact, n_template) of every licence text, and of every phrase, which is met as it stands or not."""
    texts = [(label, needs, text, False) for label, needs, text in templates]
    texts += [(label, "", phrase, True) for phrase, label in (phrases or {}).items()]
    rows = [F.struct(F.lit(i).alias("template"), *[F.lit(x).alias(n) for n, x in zip(("label", "needs", "text", "exact"), row, strict=True)])
            for i, row in enumerate(texts)]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    cut = table.withColumn("words", words_of(F.col("text"))).where(~F.col("exact") | (F.array_join("words", " ") == F.col("text")))
    needs = F.when(F.col("exact"), F.array().cast("array<string>")).otherwise(F.split("needs", " "))
    return cut.select("template", "label", needs.alias("needs"), "words", "exact", F.size("words").alias("n_template"))


def _same_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.own") == F.col(f"{right}.own"))


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, own, template, exact, diagonal) with the licence's words that were met there, one row a diagonal.

    Only the few hundred runs of the licence texts travel to the tasks. Equal rows of one document meet the same
    words, so they count once; they are put together before anything is shuffled.
    """
    runs = _grams(templates.select("template", "exact", "words"), "tpos").select(
        "template", "exact", "tpos", "shape", "gram", *[F.col(f"g{i}").alias(f"t{i}") for i in range(GRAM)])
    met = _grams(docs.select("doc_id", "own", "words"), "pos", runs).join(F.broadcast(runs.drop("shape")), "gram").where(
        " AND ".join(f"g{i} = t{i}" for i in range(GRAM)))  # a hash alone decides nothing
    once = met.groupBy("doc_id", "own", "template", "exact", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos").agg(F.lit(1).alias("x"))
    return once.groupBy("doc_id", "own", "template", "exact", "diagonal").agg(
        F.min("tpos").alias("t_first"), F.max("tpos").alias("t_last"), F.array_sort(F.collect_list("tpos")).alias("met"))


def spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Verified spans: doc_id, own, template, exact, label, first_word, last_word, matched, coverage.

    A diagonal joins the one before it where both are at most SHIFT apart and cover different parts of the
    licence, as a changed, added or missing word leaves them. A span holds when it has COVERAGE of the licence's
    words, at least DENSITY of its own words are among them, and the words that tell the licence are. A phrase
    (``exact``) stands on one diagonal, with all its words.
    """
    counted = votes(docs, templates)
    order = Window.partitionBy("doc_id", "own", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(order) <= SHIFT
    goes_on = near & ~F.col("exact") & ~F.arrays_overlap("met", F.lag("met").over(order))
    opened = counted.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    placed = opened.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = placed.groupBy("doc_id", "own", "template", "exact", "span").agg(
        F.min(F.col("diagonal") + F.col("t_first")).alias("first_word"),
        F.max(F.col("diagonal") + F.col("t_last") + (GRAM - 1)).alias("last_word"),
        F.array_distinct(F.flatten(F.collect_list("met"))).alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (GRAM - 1)))))
    known = merged.withColumn("covered", covered).join(F.broadcast(templates.drop("exact")), "template")
    told = F.forall("needs", lambda w: F.array_contains(F.transform("covered", lambda t: F.get("words", t)), w))
    matched = F.size("covered")
    sized = known.withColumn("matched", matched).withColumn("coverage", matched / F.col("n_template"))
    length = F.col("last_word") - F.col("first_word") + 1
    holds = F.when(F.col("exact"), F.col("matched") == F.col("n_template")).otherwise(
        (F.col("coverage") >= COVERAGE) & (F.col("matched") >= DENSITY * length) & told)
    return sized.where(holds).select(
        "doc_id", "own", "template", "exact", "label", "first_word", "last_word", "matched", "coverage")


def _places(phrase: str) -> Column:
    """Where the words of a phrase start, one after the other; looked for only where they occur at all."""
    parts = phrase.split(" ")
    here = lambda i: F.expr("true") if not parts else _all(
        [F.get("words", i + n) == F.lit(p) for n, p in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), here)
    return F.when(F.contains(F.col("joined"), F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    held = conditions[0]
    for condition in conditions[1:]:
        held = held & condition
    return held


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the spans of every document.

    ``spans`` lists the verified spans (label, first_word, last_word, coverage), by place. The score is the best
    coverage of a span, and 1 where a phrase stands. A null text has no words, a document without words or licences
    no labels ('') and score 0. Documents are known by id and text: rows with one id and different texts, or without
    an id, are documents of their own, and equal rows have equal results. No rows give no rows. Other columns of
    ``docs`` play no part, whatever their names. A document is as large as its text, and a task holds one at a time.
    """
    phrases = PHRASES if phrases is None else phrases
    # Phrases of a whole run or more are found by their runs like the licence texts, shorter ones word by word.
    short = {p: label for p, label in phrases.items() if len(p.split(" ")) < GRAM}
    known = template_table(
        docs.sparkSession, TEMPLATES if templates is None else templates, {p: x for p, x in phrases.items() if p not in short})
    text, none = F.col("text"), F.array().cast("array<string>")
    own = F.xxhash64(F.coalesce(text, F.lit(""))).alias("own")
    standing, span = F.col("exact"), F.struct("first_word", "last_word", "label", "coverage")
    found = spans(docs.select("doc_id", own, raw_words(text).alias("words")), known).groupBy("doc_id", "own").agg(
        F.array_sort(F.collect_list(F.when(~standing, span))).alias("spans"),
        F.max(F.when(~standing, F.col("coverage"))).alias("best"),
        F.collect_list(F.when(standing, F.col("first_word"))).alias("at"),
        F.collect_list(F.when(standing, F.col("label"))).alias("named"))
    cut = docs.select("doc_id", own, F.size(raw_words(text)).cast("long").alias("n_words"), (words_of(text) if short else none).alias("words"))
    joined = F.when(F.size("words") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(F.lit(""))
    places = [_places(p).alias(f"p{i}") for i, p in enumerate(short)]
    counted = cut.withColumn("joined", joined).select("doc_id", "own", "n_words", *places)
    told = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(short.values())]
    rows = counted.alias("d").join(found.alias("s"), _same_document("d", "s"), "left").select(
        "d.doc_id", "n_words", F.concat(*[f"p{i}" for i in range(len(short))], F.coalesce("at", F.array().cast("array<int>"))).alias("starts"),
        F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*told).cast("array<string>")), F.coalesce("named", none)))).alias("base"),
        F.when(F.size("spans") > 0, F.col("spans")).alias("spans"), "best")
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), none)
    score = F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        score.alias("score"), "spans")


def duckdb_sql() -> str:
    """The same scan as DuckDB SQL, without the list of spans."""
    quoted = lambda s: "'" + " ".join(s.split()).replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(a)}, {quoted(b)}, {quoted(c)})" for i, (a, b, c) in enumerate(TEMPLATES))
    named = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in PHRASES.items())
    cut = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"
    gram = "list_transform(range(1, len(w) - {n} + 2), lambda i: [w[i], w[i + 1], w[i + 2]])".format(n=GRAM)
    return f"""
WITH t AS (SELECT template, label, string_split(needs, ' ') AS needs, {cut('text')} AS w
           FROM (VALUES {rows}) v(template, label, needs, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, {cut('text')} AS w FROM documents),
tg AS (SELECT template, unnest({gram}) AS g, unnest(range(len(w) - {GRAM - 1})) AS tpos FROM t WHERE len(w) >= {GRAM}),
dg AS (SELECT r, unnest({gram}) AS g, unnest(range(len(w) - {GRAM - 1})) AS pos FROM d WHERE len(w) >= {GRAM}),
v AS (SELECT r, template, pos - tpos AS diagonal, min(tpos) AS t_first, max(tpos) AS t_last, list(tpos) AS met
      FROM dg JOIN tg USING (g) GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {SHIFT}
             AND NOT list_has_any(met, lag(met) OVER x) THEN 0 ELSE 1 END AS opens
      FROM v WINDOW x AS (PARTITION BY r, template ORDER BY diagonal)),
p AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM o),
m AS (SELECT r, template, span, min(diagonal + t_first) AS lo, max(diagonal + t_last + {GRAM - 1}) AS hi,
             list_distinct(flatten(list_transform(flatten(list(met)), lambda s: range(s, s + {GRAM})))) AS covered
      FROM p GROUP BY ALL),
s AS (SELECT m.r, t.label, len(covered) / len(t.w) AS coverage FROM m JOIN t USING (template)
      WHERE len(covered) / len(t.w) >= {COVERAGE} AND len(covered) >= {DENSITY} * (hi - lo + 1)
        AND len(list_filter(t.needs, lambda n: NOT list_contains(list_transform(covered, lambda c: t.w[c + 1]), n))) = 0),
f AS (SELECT r, list(label) AS found, max(coverage) AS best FROM s GROUP BY r),
b AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(q)] = q)) AS place
      FROM d, (SELECT string_split(phrase, ' ') AS q, label FROM (VALUES {named}) n(phrase, label))),
a AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(label) AS base FROM b GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN a USING (r) LEFT JOIN f USING (r)
"""
