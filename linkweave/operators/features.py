"""Pairwise features: three sets as projections over joined pairs, and the sampling of training pairs.

Edit ratios of names and addresses come from one Arrow function each; everything else is built in. fuzzy=False takes positional ratios
in their place, which need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import similarity as S
from linkweave.functions import text as T


def pair_rows(pairs: DataFrame, heads: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Each pair with both sides' columns, as a_... and b_...; pairs of unknown ids drop out."""
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pairs.join(side(heads, "s1_id", "a"), "s1_id").join(side(targets, "cand_id", "b"), "cand_id")


def _edits(df: DataFrame, a: str, b: str, name: str, fuzzy: bool) -> DataFrame:
    if fuzzy:
        return df.withColumn(name, S.edit_ratios(F.col(a), F.col(b)))
    x, y = F.col(a), F.col(b)
    sorted_ratio = S.positional_token_ratio(x, y)
    return df.withColumn(
        name,
        F.struct(
            S.positional_ratio(x, y).alias("ratio"),
            S.positional_partial(x, y).alias("partial"),
            S.positional_ratio(x, y).alias("weighted"),
            sorted_ratio.alias("token_sort"),
            sorted_ratio.alias("token_set"),
        ),
    )


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("float")


def _float(c: Column) -> Column:
    return c.cast("float")


FULL_COLUMNS = ["business_name", "business_address", "norm_name", "norm_addr", "norm_country", "name_toks", "addr_toks", "addr_nums", "postal"]


def full_features(pairs: DataFrame, heads: DataFrame, targets: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The 34 features of named and tokened entities with a postal column."""
    df = pair_rows(pairs, heads, targets, FULL_COLUMNS)
    df = _edits(_edits(df, "a_norm_name", "b_norm_name", "n", fuzzy), "a_norm_addr", "b_norm_addr", "d", fuzzy)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    no_a, no_b = F.trim(a("business_address")) == "", F.trim(b("business_address")) == ""
    of_address = lambda c: F.when(no_a | no_b, F.lit(0.0)).otherwise(c)
    columns = {
        "name_exact": _flag(F.lower(a("business_name")) == F.lower(b("business_name"))),
        "name_norm_exact": _flag((a("norm_name") == b("norm_name")) & (a("norm_name") != "")),
        "name_ratio": _float(F.col("n.ratio")),
        "name_partial": _float(F.col("n.partial")),
        "name_wratio": _float(F.col("n.weighted")),
        "name_token_sort": _float(F.col("n.token_sort")),
        "name_token_set": _float(F.col("n.token_set")),
        "name_jaccard": _float(S.jaccard(a("name_toks"), b("name_toks"))),
        "name_len_diff": _float(S.length_difference(a("norm_name"), b("norm_name"))),
        "addr_empty_s1": _flag(no_a),
        "addr_empty_s2": _flag(no_b),
        "addr_exact": _flag((F.lower(a("business_address")) == F.lower(b("business_address"))) & (a("business_address") != "")),
        "addr_norm_exact": _flag((a("norm_addr") == b("norm_addr")) & (a("norm_addr") != "")),
        "addr_ratio": _float(of_address(F.col("d.ratio"))),
        "addr_partial": _float(of_address(F.col("d.partial"))),
        "addr_token_sort": _float(of_address(F.col("d.token_sort"))),
        "addr_token_set": _float(of_address(F.col("d.token_set"))),
        "addr_jaccard": _float(S.jaccard(a("addr_toks"), b("addr_toks"))),
        "addr_len_diff": _float(S.length_difference(a("norm_addr"), b("norm_addr"))),
        "addr_numeric_overlap": _float(S.containment(a("addr_nums"), b("addr_nums"))),
        "addr_numeric_exact": _flag(S.same_set(a("addr_nums"), b("addr_nums"))),
        "postal_match": _flag((a("postal") == b("postal")) & (a("postal") != "")),
        "postal_both_present": _flag((a("postal") != "") & (b("postal") != "")),
        "country_match": _flag((a("norm_country") == b("norm_country")) & (a("norm_country") != "")),
        "name_len_s1": _float(F.length(a("norm_name"))),
        "name_len_s2": _float(F.length(b("norm_name"))),
        "addr_len_s1": _float(F.length(a("norm_addr"))),
        "addr_len_s2": _float(F.length(b("norm_addr"))),
        "name_missing_s1": _flag(F.trim(a("business_name")) == ""),
        "name_missing_s2": _flag(F.trim(b("business_name")) == ""),
        "addr_missing_s1": _flag(no_a),
        "addr_missing_s2": _flag(no_b),
        "is_s2": _flag(F.col("cand_id").startswith("S2-")),
        "is_s3": _flag(F.col("cand_id").startswith("S3-")),
    }
    return df.select("s1_id", "cand_id", *[c.alias(n) for n, c in columns.items()])


PROFILE_COLUMNS = ["c", "norm_name", "norm_addr", "stem_name", "sorted_stem", "tokens", "nums"]


def compact_features(pairs: DataFrame, heads: DataFrame, targets: DataFrame, fuzzy: bool = True, both_names: bool = False) -> DataFrame:
    """The 16 features of profiles. both_names: token overlap and length difference need both names."""
    df = pair_rows(pairs, heads, targets, PROFILE_COLUMNS)
    df = _edits(_edits(df, "a_norm_name", "b_norm_name", "n", fuzzy), "a_norm_addr", "b_norm_addr", "d", fuzzy)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    named, placed = (a("norm_name") != "") & (b("norm_name") != ""), (a("norm_addr") != "") & (b("norm_addr") != "")
    of_name = lambda c: _float(F.when(named, c).otherwise(0.0))
    of_address = lambda c: _float(F.when(placed, c).otherwise(0.0))
    gated = of_name if both_names else _float
    split = lambda c: T.words(c)
    columns = {
        "name_ratio": of_name(F.col("n.ratio")),
        "name_token_set_ratio": of_name(F.col("n.token_set")),
        "name_token_sort_ratio": of_name(F.col("n.token_sort")),
        "name_partial_ratio": of_name(F.col("n.partial")),
        "name_exact": _flag((a("norm_name") != "") & (a("norm_name") == b("norm_name"))),
        "name_stem_exact": _flag((a("stem_name") != "") & (a("stem_name") == b("stem_name"))),
        "name_jaccard": gated(S.jaccard(a("tokens"), b("tokens"), 0.0)),
        "name_len_diff": gated(S.length_difference(a("norm_name"), b("norm_name"))),
        "addr_ratio": of_address(F.col("d.ratio")),
        "addr_token_set_ratio": of_address(F.col("d.token_set")),
        "addr_exact": _flag(placed & (a("norm_addr") == b("norm_addr"))),
        "addr_jaccard": of_address(S.jaccard(split(a("norm_addr")), split(b("norm_addr")), 0.0)),
        "addr_num_overlap": of_address(S.numeric_jaccard(a("nums"), b("nums"))),
        "addr_num_exact": _flag(placed & S.same_set(a("nums"), b("nums"))),
        "addr_missing_s2": _flag(b("norm_addr") == ""),
        "source_is_s2": _flag(F.col("cand_id").startswith("S2-")),
    }
    return df.select("s1_id", "cand_id", *[c.alias(n) for n, c in columns.items()])


def rich_features(pairs: DataFrame, heads: DataFrame, targets: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The 30 features of profiles: n-grams, acronyms, number conflicts and interactions."""
    df = pair_rows(pairs, heads, targets, PROFILE_COLUMNS)
    df = _edits(_edits(df, "a_norm_name", "b_norm_name", "n", fuzzy), "a_norm_addr", "b_norm_addr", "d", fuzzy)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    named, placed = (a("norm_name") != "") & (b("norm_name") != ""), (a("norm_addr") != "") & (b("norm_addr") != "")
    numbered = placed & (F.size(a("nums")) > 0) & (F.size(b("nums")) > 0)
    of_name = lambda c: _float(F.when(named, c).otherwise(0.0))
    of_address = lambda c: _float(F.when(placed, c).otherwise(0.0))
    shared_nums = F.size(F.array_intersect(a("nums"), b("nums")))
    last = lambda side: F.try_element_at(side("nums"), F.lit(-1))
    first = lambda side: F.try_element_at(side("nums"), F.lit(1))
    acr_a, acr_b = T.acronym(a("tokens")), T.acronym(b("tokens"))
    acronyms = (F.length(acr_a) >= 2) & (F.length(acr_b) >= 2) & ((acr_a == acr_b) | F.contains(b("norm_name"), acr_a) | F.contains(a("norm_name"), acr_b))
    columns = {
        "name_ratio": of_name(F.col("n.ratio")),
        "name_partial_ratio": of_name(F.col("n.partial")),
        "name_token_sort_ratio": of_name(F.col("n.token_sort")),
        "name_token_set_ratio": of_name(F.col("n.token_set")),
        "name_exact": _flag(named & (a("norm_name") == b("norm_name"))),
        "name_stem_exact": _flag(named & (a("stem_name") != "") & (a("stem_name") == b("stem_name"))),
        "name_sorted_stem_exact": _flag(named & (a("sorted_stem") != "") & (a("sorted_stem") == b("sorted_stem"))),
        "name_3gram_jaccard": of_name(S.ngram_jaccard(T.char_ngrams(a("norm_name"), 3), T.char_ngrams(b("norm_name"), 3))),
        "name_4gram_jaccard": of_name(S.ngram_jaccard(T.char_ngrams(a("norm_name"), 4), T.char_ngrams(b("norm_name"), 4))),
        "name_token_jaccard": of_name(S.jaccard(a("tokens"), b("tokens"), 0.0)),
        "name_len_diff": of_name(S.length_difference(a("norm_name"), b("norm_name"))),
        "name_prefix_match": _flag(named & (F.length(a("norm_name")) >= 4) & (F.length(b("norm_name")) >= 4) & (F.left(a("norm_name"), F.lit(4)) == F.left(b("norm_name"), F.lit(4)))),
        "name_acronym_match": _flag(named & acronyms),
        "addr_ratio": of_address(F.col("d.ratio")),
        "addr_token_sort_ratio": of_address(F.col("d.token_sort")),
        "addr_token_set_ratio": of_address(F.col("d.token_set")),
        "addr_token_jaccard": of_address(S.jaccard(T.words(a("norm_addr")), T.words(b("norm_addr")), 0.0)),
        "addr_exact": _flag(placed & (a("norm_addr") == b("norm_addr"))),
        "addr_num_overlap": _float(F.when(numbered, S.containment(a("nums"), b("nums"))).otherwise(0.0)),
        "addr_num_exact": _flag(numbered & S.same_set(a("nums"), b("nums"))),
        "addr_num_conflict": _flag(numbered & (shared_nums == 0)),
        "addr_street_num_match": _flag(numbered & (first(a) == first(b))),
        "addr_postal_match": _flag(numbered & F.length(last(a)).isin(5, 6) & F.length(last(b)).isin(5, 6) & (last(a) == last(b))),
        "addr_missing_s1": _flag(a("norm_addr") == ""),
        "addr_missing_s2": _flag(b("norm_addr") == ""),
    }
    out = df.select("s1_id", "cand_id", *[c.alias(n) for n, c in columns.items()], (a("c") == b("c")).alias("__same"), (a("c") != "").alias("__known"))
    name, address = F.col("name_ratio"), F.col("addr_ratio")
    more = {
        "name_strong_num_conflict": _flag((name >= 0.85) & (F.col("addr_num_conflict") == 1)),
        "name_moderate_addr_strong": _flag((name >= 0.60) & (address >= 0.85)),
        "name_weak_addr_strong": _flag((name < 0.50) & (address >= 0.85)),
        "country_match": _flag(F.col("__same") & F.col("__known")),
        "is_source2": _flag(F.col("cand_id").startswith("S2-")),
    }
    return out.withColumns(more).drop("__same", "__known")


#: Characters of a hash under which rows are counted.
PREFIX = 4


def by_hash(seed: int, *columns: str) -> Column:
    """A rank key that any engine can make again: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def training_pairs(pairs: DataFrame, links: DataFrame, ratio: float = 5.0, most: int = 50, seed: int = 42) -> DataFrame:
    """s1_id, cand_id, label: true pairs, and others up to the ratio for each query entity, and then over all."""
    labelled = pairs.select("s1_id", "cand_id").join(links.select("s1_id", F.col("tid").alias("cand_id"), F.lit(1).alias("label")), ["s1_id", "cand_id"], "left")
    labelled = labelled.withColumn("label", F.coalesce("label", F.lit(0)))
    n_pos = F.sum("label").over(Window.partitionBy("s1_id"))
    at = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(by_hash(seed, "s1_id", "cand_id"), "cand_id"))
    allowed = F.least(F.greatest(F.lit(1), F.bround(n_pos * ratio).cast("int")), F.lit(most))
    own = labelled.withColumns({"at": at, "allowed": allowed}).where((F.col("label") == 1) | (F.col("at") <= F.col("allowed")))
    # The overall trim, by hash: counts under a prefix place the bound in one prefix, whatever the number of rows, and rows are ranked within prefixes only.
    total = own.agg(F.bround(F.sum("label") * ratio).cast("long").alias("most"))
    negatives = own.where("label = 0").select("s1_id", "cand_id", "label", by_hash(seed, "cand_id", "s1_id").alias("h")).withColumn("prefix", F.substring("h", 1, PREFIX))
    counts = negatives.groupBy("prefix").agg(F.count("*").alias("c"))
    # At most 16 ** PREFIX rows beside one.
    placed = counts.select("prefix", (F.sum("c").over(Window.orderBy("prefix")) - F.col("c")).alias("before")).join(F.broadcast(total), how="cross").where("before < most")
    local = F.row_number().over(Window.partitionBy("prefix").orderBy("h", "s1_id", "cand_id"))
    kept = negatives.join(F.broadcast(placed), "prefix").withColumn("local", local).where(F.col("before") + F.col("local") <= F.col("most"))
    return own.where("label = 1").select("s1_id", "cand_id", "label").unionByName(kept.select("s1_id", "cand_id", "label"))


def first_negatives(pairs: DataFrame, links: DataFrame, ratio: int = 5) -> DataFrame:
    """s1_id, cand_id, label: true pairs, and the first others by rank, ratio to one, one at least."""
    labelled = pairs.join(links.select("s1_id", F.col("tid").alias("cand_id"), F.lit(1).alias("label")), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    at = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy("rank", "cand_id"))
    n_pos = F.sum("label").over(Window.partitionBy("s1_id"))
    return labelled.withColumns({"at": at, "n_pos": n_pos}).where((F.col("label") == 1) | (F.col("at") <= F.greatest(F.lit(1), F.col("n_pos") * ratio))).select("s1_id", "cand_id", "label")
