"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Null text counts as no words, and so fails, as an empty one does. Ties can't arise: a bound itself passes. Very long texts are measured
whole. Repeated rows are judged each alike; an empty table gives an empty table. Columns of the input other than the text play no part,
whatever their names; those named as a measure are replaced.

The stop-word rule knows the function words of four languages, English, French, German and Spanish. Clean text of a language that shares few of them
fails it: give such text rules without it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import SPACE_CHARS, ascii_lower, let, packed, space_words, table, unpacked

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Function words of the languages at hand, without marks of punctuation.
STOP_WORDS = (
    "the and of to in is that it for was on are as with they at be this from or had by a an he she not have "
    "de la le les et des en un du une que est pour qui dans par sur au pas plus ce il elle "
    "der die und den von zu das mit sich ist ein eine auf im dem nicht als auch es war "
    "el los las del se con su y una al lo como para por no"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high, in whole numbers: each bound is over 1000."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: Production thresholds, in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2000, 12000),
    Rule("symbols_a_word", "n_symbols", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 30, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 300),
    Rule("same_word_again", "n_same_again", "n_words", None, 300),
)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of width words that the array holds twice or more, the first included.

    Windows are sorted by a hash of 64 bits and their place; neighbours of equal hash whose words are equal are repeats, and their sorted places
    are merged into spans. So windows that differ never count; a collision within a text could hide one only between two equal ones.
    """

    def keyed(w: Column) -> Column:
        starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, width)))

    def spans(w: Column, h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        window = lambda s, i: F.slice(w, F.get(s, i)["at"] + 1, width)
        same = lambda s, i, j: F.coalesce((F.get(s, i)["h"] == F.get(s, j)["h"]) & (window(s, i) == window(s, j)), F.lit(False))
        places = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["at"])))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    return let(words, lambda w: let(keyed(w), lambda h: spans(w, h)))


def same_again(words: Column) -> Column:
    """Words equal to the one before."""
    return F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda same: same))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words, n_same_again (long), replacing columns of those names."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    # Stop words are compared in lower case; the windows keep the case of the text.
    words = space_words(F.col(text))
    lowered = space_words(ascii_lower(body))
    measured = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), same_again(w).cast("long").alias("n_same_again"))).alias("w"),
        F.size(F.filter(lowered, lambda x: F.rtrim(x, F.lit(".,;:!?#*$%&|<>")).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    out = df.select(packed(df, "row"), measured.alias("m"), body.alias("body"))
    columns = {
        "n_words": F.col("m.w.n_words"),
        "word_chars": F.length(F.translate("body", SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long"),
        "n_lines": F.col("m.l.n"),
        "n_dup_lines": F.col("m.l.dup"),
        "n_stop_words": F.col("m.n_stop_words"),
        "n_repeat_words": F.col("m.w.n_repeat_words"),
        "n_same_again": F.col("m.w.n_same_again"),
    }
    return out.select(*unpacked(df, "row", tuple(columns)), *[c.alias(n) for n, c in columns.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every rule holds; a rule whose denominator is 0 holds."""
    out = F.lit(True)
    for r in rules:
        n, d = F.col(r.numerator) * 1000, F.col(r.denominator)
        for bound, holds in ((r.low, lambda b: n >= b * d), (r.high, lambda b: n <= b * d)):
            if bound is not None:
                out = out & holds(bound)
    return out


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its measures, base_failed and kept."""
    return with_measures(df, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for r in rules:
        parts += [f"{r.numerator} * 1000 >= {r.low} * {r.denominator}"] * (r.low is not None)
        parts += [f"{r.numerator} * 1000 <= {r.high} * {r.denominator}"] * (r.high is not None)
    return " AND ".join(parts)


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM k) WHERE c > 1),
n AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS BIGINT) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}],
             rtrim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?#*$%&|<>')))) AS BIGINT) AS n_stop_words,
        CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_same_again,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_rules_sql()}) AS kept FROM f
"""
