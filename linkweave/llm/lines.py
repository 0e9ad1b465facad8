"""Line dedup: overlapping windows of three lines, found repeated over all documents, whose later occurrences go.

Lines are parted by line feeds. A line with a character that is no white space counts; windows run over three such lines in a row, blank
ones between them aside. A line of LONG words or more is a window by itself as well, whatever stands about it and however few lines its document has.
Occurrences are ordered by document id, then text, then place; the first stays. The lines that later occurrences cover, merged, are removed;
blank lines stay. Other documents of under three lines that count have no window and stay as they are.

Null text stays null. Each row is judged by its own text: rows are told apart by id and a hash of the text, and equal rows are treated alike.
Rows without an id come before all others. Ties can't arise between rows that differ. Very long texts are read whole; a window that very many lines
share is no single task's work: see join_values(). An empty table gives an empty table. Other columns pass through unchanged, whatever
their names, but n_removed, which is replaced. Only DataFrame functions are used. Windows are told apart by two hashes of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import join_values, let, materialize, packed, table

WINDOW = 3
#: Words of a line that is a window by itself.
LONG = 50


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def counted(lines: Column) -> Column:
    """Places of the lines that count, in order."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("[^ \\t-\\r]"), i)), lambda i: i.isNotNull())


def windows(text: Column, width: int = WINDOW, long: int = LONG) -> Column:
    """An array of (at, n, a, b): the place of a window among the lines that count, how many it has, and two hashes of them."""
    lines = F.filter(split_lines(text), lambda x: x.rlike("[^ \\t-\\r]"))
    # Read no further than the word that decides.
    is_long = lambda x: x.rlike(rf"^[ \t-\r]*+(?:[^ \t-\r]++[ \t-\r]++){{{long - 1}}}[^ \t-\r]")
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), is_long(x).alias("long")))

    def of(h: Column) -> Column:
        starts = F.when(F.size(h) >= width, F.sequence(F.lit(0), F.size(h) - width)).otherwise(F.array().cast("array<int>"))
        part = lambda i, name: F.xxhash64(*[F.get(h, i + k)[name] for k in range(width)])
        each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(width).alias("n"), part(i, "a").alias("a"), part(i, "b").alias("b")))
        alone = F.transform(h, lambda x, i: F.when(x["long"], F.struct(i.alias("at"), F.lit(1).alias("n"), x["a"].alias("a"), x["b"].alias("b"))))
        return F.concat(each, F.filter(alone, lambda x: x.isNotNull()))

    return let(hashes, of)


def row_key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own")]


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """row_a, row_b, places: for each row, by its key, the (at, n) of windows that occur earlier."""
    each = docs.select(*row_key(docs), F.explode(windows(F.col("text"), width)).alias("w")).select("id", "own", "w.at", "w.n", "w.a", "w.b")
    place = F.struct("id", "own", "at")
    # A window with one occurrence can't be a later one; map-side sums make a hot window a row a task.
    found = each.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = materialize(found.where("first < last").drop("last"), "line-windows")
    # Of the repeated windows alone: then the hot ones are still fewer than one in HOT_SHARE of these, and so bounded.
    total = first.agg(F.sum("n")).first()[0] or 0
    later = join_values(each.withColumnRenamed("n", "lines"), first, ["a", "b"], total).where(place > F.col("first"))
    return later.groupBy(*row_hashes("id", "own")).agg(F.collect_set(F.struct("at", "lines")).alias("places"))


def row_hashes(id: str, own: str) -> list[Column]:
    """The key of a row as two hashes, none of which is null."""
    return [F.xxhash64(id, own).alias("row_a"), F.xxhash64(F.lit("second"), own, id).alias("row_b")]


def without(text: Column, places: Column) -> Column:
    """(text, n_removed): the text without the lines that windows at these (at, lines) cover."""

    def of(lines: Column) -> Column:
        own = counted(lines)
        gone = let(own, lambda o: F.array_distinct(F.flatten(F.transform(places, lambda p: F.slice(o, p["at"] + 1, p["lines"])))))
        kept = lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda i: F.get(lines, i))
        return let(gone, lambda g: F.struct(F.array_join(kept(g), "\n").alias("text"), F.size(g).cast("long").alias("n_removed")))

    return let(split_lines(text), of)


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with text deduplicated, and n_removed (long). Columns of those names are replaced."""
    rows = docs.select(packed(docs, "row"), *row_key(docs)).select("row", *row_hashes("id", "own"))
    joined = rows.join(later_windows(docs, width), ["row_a", "row_b"], "left")
    cut = F.when(F.col("places").isNotNull() & F.col("row")["text"].isNotNull(), without(F.col("row")["text"], F.col("places")))
    out = joined.select("row", cut.alias("cut"))
    text = F.coalesce(F.col("cut")["text"], F.col("row")["text"]).alias("text")
    columns = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "n_removed"]
    return out.select(*columns, F.coalesce(F.col("cut")["n_removed"], F.lit(0).cast("long")).alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


OP4_SQL = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, pos, line AS x, lead(line, 1) OVER o AS y, lead(line, 2) OVER o AS z FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, {WINDOW} AS n FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k FROM w WHERE z IS NOT NULL) WHERE k > 1
  UNION ALL SELECT doc_id, pos, 1 FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM c WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {LONG}) WHERE k > 1),
g AS (SELECT DISTINCT c.doc_id, c.i FROM r JOIN c ON c.doc_id = r.doc_id AND c.pos BETWEEN r.pos AND r.pos + r.n - 1),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed FROM documents d LEFT JOIN k USING (doc_id)
"""
