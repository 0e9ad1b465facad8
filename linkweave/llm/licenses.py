"""License scan by diagonal voting, in DataFrame functions only.

Every rolling pair of words of every text is joined to the places of that pair in the templates. A match votes for the diagonal document
place less template place; votes are summed by diagonal, diagonals that neighbour each other are merged in bands of bounded width, and the
merged span is verified: enough of the template's pairs must match, in the template's order. A band holds 2 * BAND diagonals and overlaps
the next by half, so all spans whose matches drift by BAND words at most, in all, lie within one. Pairs are joined by their words
themselves, so no hash collision counts. Templates of a bare phrase must be matched whole on one diagonal, which is the phrase standing there
word by word.

Null and empty texts have no words and no matches. Each row is judged by its own text, rows that repeat an id included: rows are told apart by
id and a hash of the text. Rows without an id are scanned too. Very long texts are scanned whole: a span's matches are at most the band's
width times the template's length, whatever the text's. An empty table gives an empty table. Other columns of the input are ignored, whatever their names. Ties
between templates don't matter: all labels count, and the score is the greatest share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import ascii_lower, let, table

#: What isn't part of a word: ASCII but for digits and lower-case letters.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words that a span's matches may drift by, in all.
BAND = 8
#: Thousandths of a notice's word pairs that a span must match.
LEAST_SHARE = 700
#: Phrases, each with its label; whole matches only.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices, as their publishers recommend them, each with its label.
NOTICES = (
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        "gpl",
    ),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("licensed under cc by 4 0", "cc"),
    ("licensed under cc by nc 4 0", "cc"),
    ("licensed under cc by sa 4 0", "cc"),
    ("all rights reserved", "reserved"),
)


def template_rows() -> list[tuple[int, str, int, int, int, str]]:
    """(template, pair, place, pairs in the template, phrase or not, label), by the tables above: a fixed few hundred rows."""
    out = []
    for k, (text, label) in enumerate([*PHRASES, *NOTICES]):
        words = text.split()
        out += [(k, f"{a} {b}", i, len(words) - 1, int(k < len(PHRASES)), label) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def plain_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def pairs(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def row_keys() -> list[Column]:
    """What tells rows apart: two hashes of id and text, so no key is null."""
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("row_b")]


def matches(docs: DataFrame) -> DataFrame:
    """row_a, row_b, template, label, phrase, pairs, diagonal, place: each rolling pair of words joined to its template places."""
    # The templates above, a fixed few hundred rows, so broadcasting them is bounded.
    templates = docs.sparkSession.sql(f"SELECT *, xxhash64(pair) AS h FROM VALUES {_values()} AS t(template, pair, place, pairs, phrase, label)")
    rolled = docs.select(*row_keys(), F.posexplode(let(plain_words(F.col("text")), pairs)).alias("at", "words")).where("words is not null")
    rolled = rolled.withColumn("rolled_h", F.xxhash64("words"))
    found = rolled.join(F.broadcast(templates), (F.col("rolled_h") == F.col("h")) & (F.col("words") == F.col("pair")))
    return found.select("row_a", "row_b", "template", "label", "phrase", "pairs", (F.col("at") - F.col("place")).alias("diagonal"), "place")


def in_order(found: Column) -> Column:
    """The most of found, an array of (place, at), that can be read in one go: places and words both ascending."""
    by_place = F.array_sort(F.transform(found, lambda x: F.struct(x["place"].alias("place"), (-x["at"]).alias("back"))))
    longest = lambda runs, back: F.coalesce(F.array_max(F.transform(F.filter(runs, lambda r: r["back"] > back), lambda r: r["n"])), F.lit(0))
    none = F.array().cast("array<struct<back:int,n:int>>")
    runs = F.aggregate(by_place, none, lambda runs, x: F.concat(runs, F.array(F.struct(x["back"].alias("back"), (longest(runs, x["back"]) + 1).alias("n")))))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: r["n"])), F.lit(0))


def spans(docs: DataFrame) -> DataFrame:
    """row_a, row_b, template, label, phrase, start (word), share: the verified spans. One that lies in two bands has a row for each."""
    own = ["row_a", "row_b", "template", "label", "phrase", "pairs"]
    votes = matches(docs).groupBy(*own, "diagonal").agg(F.collect_set("place").alias("places"))
    # Phrases: a diagonal by itself, whole. Notices: the diagonals of a band are merged.
    band = F.floor(F.col("diagonal") / BAND)
    bands = F.when(F.col("phrase") == 1, F.array(F.col("diagonal").cast("long"))).otherwise(F.array(band - 1, band))
    least = F.when(F.col("phrase") == 1, 1000).otherwise(LEAST_SHARE)
    enough = lambda n: n * 1000 >= F.col("pairs") * least
    at = lambda v: F.transform(v["places"], lambda p: F.struct(p.alias("place"), (p + v["diagonal"]).alias("at")))
    merged = votes.select(*own, F.struct("diagonal", "places").alias("vote"), F.explode(bands).alias("band")).groupBy(*own, "band").agg(
        F.flatten(F.transform(F.collect_list("vote"), at)).alias("found"), F.min("vote.diagonal").cast("long").alias("start")
    )
    merged = merged.where(enough(F.size(F.array_distinct(F.transform("found", lambda x: x["place"])))))
    return merged.withColumn("matched", in_order(F.col("found"))).where(enough(F.col("matched"))).withColumn("share", F.col("matched") / F.col("pairs"))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: its words, places of phrases, labels and score."""
    found = spans(docs).groupBy("row_a", "row_b").agg(
        F.sum("phrase").cast("long").alias("n_base"),
        F.min(F.when(F.col("phrase") == 1, F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("phrase") == 1, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase") == 1, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    all_docs = docs.select("doc_id", *row_keys(), F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    joined = all_docs.join(found, ["row_a", "row_b"], "left")
    blank = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    value = lambda c: F.coalesce(c, blank[c]).alias(c) if c in blank else F.col(c)
    return joined.select("doc_id", "n_words", *map(value, ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _values() -> str:
    return ", ".join(f"({k}, '{p}', {i}, {n}, {b}, '{s}')" for k, p, i, n, b, s in template_rows())


OP2_SQL = f"""
WITH t(template, pair, place, pairs, phrase, label) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
r AS (SELECT own, unnest(range(len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM d WHERE len(ws) > 1),
m AS (SELECT own, template, label, phrase, pairs, pos - place AS diagonal, place, pos FROM r JOIN t USING (pair)),
b AS (SELECT *, unnest(CASE WHEN phrase = 1 THEN [diagonal] ELSE [CAST(floor(diagonal / {BAND}) AS BIGINT) - 1, CAST(floor(diagonal / {BAND}) AS BIGINT)] END) AS band FROM m),
g AS (SELECT own, template, label, phrase, pairs, band, min(diagonal) AS start, list(-pos ORDER BY place, -pos) AS backs
      FROM b GROUP BY ALL HAVING count(DISTINCT place) * 1000 >= pairs * CASE WHEN phrase = 1 THEN 1000 ELSE {LEAST_SHARE} END),
q AS (SELECT *, list_max(list_transform(list_reduce(list_transform(backs, lambda x: [{{'back': x, 'n': CAST(1 AS BIGINT)}}]), lambda runs, x:
        list_concat(runs, [{{'back': x[1].back, 'n': 1 + coalesce(list_max(list_transform(list_filter(runs, lambda r: r.back > x[1].back), lambda r: r.n)), 0)}}])), lambda r: r.n)) AS matched FROM g),
k AS (SELECT * FROM q WHERE matched * 1000 >= pairs * CASE WHEN phrase = 1 THEN 1000 ELSE {LEAST_SHARE} END),
f AS (SELECT own, CAST(sum(phrase) AS BIGINT) AS n_base, min(start) FILTER (WHERE phrase = 1) AS first_word, max(start) FILTER (WHERE phrase = 1) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(matched / pairs) AS score
      FROM k GROUP BY own)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f USING (own)
"""
