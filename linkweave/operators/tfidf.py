"""Retrieval by TF-IDF cosine: n-grams weighted and joined in the JVM, similarities summed in numpy over tiles, without vectors on the driver.

Weights: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1, fitted on the targets whose text isn't blank; terms in fewer than
min_df of them are dropped, and of more terms than max_features the most frequent stay.

Equal texts are compared once. Texts are dealt into blocks; where a block of queries meets one of targets, each query's similarities to all targets of the
block are summed term by term from the block's lists, and the k nearest stay. Pairs that share a term are never rows, so what is
shuffled is the texts' vectors, once for each block of the other side. All targets are compared: work grows with queries times targets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.sources.tables import written


def word_terms(c: Column) -> Column:
    """Words of two characters at least, and pairs of neighbours."""
    w = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), 0)
    seconds = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    return F.concat(w, F.filter(F.zip_with(w, seconds, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull()))


def char_terms(c: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Runs of characters within words, each padded by a space at either end."""
    words = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(w: Column, n: int) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        # A word shorter than the first size is one run; it isn't repeated for larger sizes.
        short = F.array(w) if n == sizes[0] else F.array().cast("array<string>")
        return F.when(F.length(w) >= n, many).otherwise(short)

    return F.flatten(F.transform(padded, lambda w: F.concat(*[runs(w, n) for n in sizes])))


def texts_of(df: DataFrame, column: str, most: int) -> DataFrame:
    """text, key (the least id), n and ids (the first ids, so many at most) of each text that isn't blank."""
    rows = df.select("entity_id", F.col(column).alias("text")).where(F.trim("text") != "")
    # The rank is limited before the shuffle; counts are summed there too: a text that very many rows have is a few rows a task.
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("text").orderBy("entity_id"))).where(F.col("at") <= most)
    lists = first.groupBy("text").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    return lists.join(rows.groupBy("text").agg(F.count("*").alias("n")), "text").withColumn("key", F.col("ids")[0])


#: Texts of a tile's queries and of its targets, about.
HEAD_BLOCK, TARGET_BLOCK = 16_384, 32_768
#: What rounding may take from a similarity.
SLACK = 2e-6


def vectors(texts: DataFrame, terms: Column, known: DataFrame) -> DataFrame:
    """key, terms, weights: the numbers of a text's known terms, and their weights, scaled to length 1. known: term, no, idf; its rows are max_features at most."""
    found = texts.select("key", F.explode(terms).alias("term")).join(F.broadcast(known), "term").select("key", "no", "idf")
    # Dealt out by key, both sums need no other shuffle.
    each = found.repartition("key").groupBy("key", "no", "idf").agg(F.count("*").alias("tf")).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    rows = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select("key", F.col("v.no").alias("terms"), F.transform("v.w", lambda w: w / F.col("norm")).alias("weights"))


def nearest_in_tile(heads: pa.Table, targets: pa.Table, top_k: int) -> pa.Table:
    """head, target, sim: the first top_k targets of each head by rounded similarity over 0, then by key. Of all targets of the tile, none is left out."""
    flat = lambda c: (pc.list_value_length(c).to_numpy(zero_copy_only=False), c.flatten().to_numpy(zero_copy_only=False))
    column = lambda t, name: t.column(name).combine_chunks() if t.num_rows else pa.array([], t.schema.field(name).type)
    targets = targets.take(pc.sort_indices(targets.column("target")))
    lengths, numbers = flat(column(targets, "terms"))
    weights = flat(column(targets, "weights"))[1]
    by_term = np.argsort(numbers, kind="stable")
    place, weights = np.repeat(np.arange(len(lengths)), lengths)[by_term], weights[by_term]
    own_lengths, own_numbers = flat(column(heads, "terms"))
    own_weights = flat(column(heads, "weights"))[1]
    ordered = numbers[by_term]
    starts, ends = np.searchsorted(ordered, own_numbers, "left").tolist(), np.searchsorted(ordered, own_numbers, "right").tolist()
    sums, found, at = np.zeros(len(lengths)), [], 0
    for h, n in enumerate(own_lengths.tolist()):
        sums[:] = 0.0
        for t in range(at, at + n):
            if starts[t] < ends[t]:
                sums[place[starts[t] : ends[t]]] += own_weights[t] * weights[starts[t] : ends[t]]
        at += n
        # All that may round to as much as the k-th; more than k if there are ties.
        least = max(np.partition(sums, len(sums) - top_k)[len(sums) - top_k] - SLACK, 0.0) if len(sums) > top_k else 0.0
        near = np.flatnonzero(sums > least)
        sims = np.floor(sums[near] * 1e6 + 0.5) / 1e6
        first = np.lexsort((near, -sims))[:top_k]
        first = first[sims[first] > 0]
        found.append((np.full(len(first), h), near[first], sims[first]))
    h, t, sim = (np.concatenate([f[k] for f in found]) if found else np.array([], dtype=kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
    return pa.table({"head": column(heads, "head").take(pa.array(h)), "target": column(targets, "target").take(pa.array(t)), "sim": pa.array(sim)})


def top_similar(heads: DataFrame, targets: DataFrame, column: str, terms_of: Callable[[Column], Column], top_k: int, min_df: int = 2, max_features: int = 200_000) -> DataFrame:
    """s1_id, cand_id, sim, rank: the nearest targets of each query entity with a similarity over 0; ties go by id. Blank texts have none."""
    terms = terms_of(F.col("text"))
    # All that is written here is read several times below.
    head_texts, target_texts = (written(texts_of(df, column, most), "tfidf") for df, most in ((heads, 1), (targets, top_k)))
    places = target_texts.select("n", terms.alias("terms")).select("n", F.explode(F.transform("terms", lambda x, i: F.struct(x.alias("term"), (F.array_position("terms", x) == i + 1).alias("first")))).alias("t"))
    stats = places.groupBy("t.term").agg(F.sum(F.when(F.col("t.first"), F.col("n")).otherwise(0)).alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_df)
    n = target_texts.agg(F.sum("n").alias("n_rows"))
    # Numbered in one task: max_features rows at most.
    kept = stats.orderBy(F.desc("total"), "term").limit(max_features).withColumn("no", F.row_number().over(Window.orderBy(F.desc("total"), "term")))
    known = written(kept.join(F.broadcast(n), how="cross").select("term", "no", (F.log((1 + F.col("n_rows")) / (1 + F.col("df"))) + 1).alias("idf")), "tfidf")

    a, b = written(vectors(head_texts, terms, known), "tfidf"), written(vectors(target_texts, terms, known), "tfidf")
    blocks = [max(1, -(-df.count() // block)) for df, block in ((a, HEAD_BLOCK), (b, TARGET_BLOCK))]

    def dealt(df: DataFrame, name: str, own: int) -> DataFrame:
        """A copy of each row for each block of the other side."""
        at = [F.pmod(F.xxhash64("key"), F.lit(blocks[own])).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)))]
        return df.select(F.col("key").alias(name), "terms", "weights", at[own].alias("head_block"), at[1 - own].alias("target_block")).groupBy("head_block", "target_block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_in_tile(left, right, top_k)

    sims = dealt(a, "head", 0).cogroup(dealt(b, "target", 1)).applyInArrow(run, "head string, target string, sim double")
    # The first k ids lie in the first k texts by similarity and least id, since each text before has an id before.
    nearest = sims.withColumn("at", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("sim"), "target"))).where(F.col("at") <= top_k)
    with_ids = nearest.join(target_texts.select(F.col("key").alias("target"), "ids"), "target").select("head", "sim", F.explode("ids").alias("cand_id"))
    last = with_ids.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("sim"), "cand_id"))).where(F.col("rank") <= top_k)
    names = head_texts.select(F.col("key").alias("head"), "text")
    own = heads.select(F.col("entity_id").alias("s1_id"), F.col(column).alias("text"))
    return last.join(names, "head").join(own, "text").select("s1_id", "cand_id", "sim", "rank")
