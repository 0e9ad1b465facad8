"""SQL for DuckDB, put together from named parts: each query's SQL names the parts it needs, and those theirs."""

from __future__ import annotations

import re

from linkweave.functions import text as T

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body


def needed(body: str, done: dict[str, str]) -> None:
    for name in re.findall(r"\b[a-z_0-9]+\b", body):
        if name in PARTS and name not in done:
            done[name] = ""  # its place is after what it needs
            needed(PARTS[name], done)
            done.pop(name)
            done[name] = PARTS[name]


def query(body: str) -> str:
    done: dict[str, str] = {}
    needed(body, done)
    return ("WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" if done else "") + body


def lower(e: str) -> str:
    return f"translate({e}, '{T.UPPER}', '{T.UPPER.lower()}')"


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def replaced(e: str, table: tuple[tuple[str, str], ...]) -> str:
    for pattern, word in table:
        e = f"regexp_replace({e}, '\\b(?:{pattern})\\b', '{word}', 'g')"
    return e


MARKS = r"[\x00-\x08\x0E-\x1B!-/:-@\[-`{-\x7F]"


def spaced(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '{MARKS}', ' ', 'g'), '\\s+', ' ', 'g'))"


def name(e: str) -> str:
    """Normalized names, for values on which the regular expressions of both engines agree."""
    e = f"regexp_replace(regexp_replace(coalesce({e}, ''), '\\s*\\|.*', ''), '^--+\\s*', '')"
    e = f"regexp_replace({e}, '(^|[^\\w])\\.(?:com|org|net|in|co)\\b', '\\1', 'gi')"
    e = lower(f"regexp_replace({e}, '^#+\\s*', '')")
    e = f"regexp_replace({e}, '\\s*&\\s*', ' and ', 'g')"
    return spaced(replaced(replaced(e, T.DOTTED_FORMS), T.LONG_FORMS))


def address(e: str) -> str:
    return spaced(replaced(lower(f"regexp_replace(coalesce({e}, ''), '#+\\s*', '', 'g')"), T.ADDRESS_WORDS))


def country(e: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.COUNTRIES.items())
    return f"CASE lower(trim(coalesce({e}, ''))) {cases} ELSE trim(coalesce({e}, '')) END"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def jaccard(a: str, b: str, both_empty: float = 1.0) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN {both_empty} ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {union} END"


def positional(a: str, b: str) -> str:
    same = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE CAST(2 * {same} AS DOUBLE) / (length({a}) + length({b})) END"


def sorted_words(e: str) -> str:
    return f"coalesce(array_to_string(list_sort({words(e)}), ' '), '')"


def bits(a: str, b: str) -> str:
    """For each character of b, its places in a as bits."""
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))"
    return f"list_transform(string_split({b}, ''), lambda c: {mask})"


def common_length(n: str, masks: str) -> str:
    """Longest common subsequence of a value of n characters, 120 at most, and one whose characters have these places in it."""
    full = f"((1::HUGEINT << ({n})::INT) - 1)"
    return f"({n} - bit_count(list_reduce(list_prepend({full}, {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})))"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct({a})) END"


def same_set(a: str, b: str) -> str:
    return f"len({a}) > 0 AND len({b}) > 0 AND list_sort(list_distinct({a})) = list_sort(list_distinct({b}))"


def ngrams(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) >= {n} THEN list_distinct(list_transform(range(1, length({e}) - {n - 2}), lambda i: substr({e}, i, {n}))) WHEN {e} <> '' THEN [{e}] ELSE [] END"


def ngram_jaccard(a: str, b: str, n: int) -> str:
    x, y = f"({ngrams(a, n)})", f"({ngrams(b, n)})"
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {jaccard(x, y)} END"


def acronym(tokens: str) -> str:
    return f"lower(coalesce(array_to_string(list_transform({tokens}, lambda w: left(w, 1)), ''), ''))"


def postal(e: str) -> str:
    return f"coalesce(nullif(regexp_extract({e}, '\\b([0-9]{{5}})(?:-[0-9]{{4}})?\\b', 1), ''), regexp_extract({e}, '\\b([0-9]{{6}})\\b', 1))"


def length_difference(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE abs(length({a}) - length({b})) / greatest(length({a}), length({b})) END"


part("cut_docs", f"SELECT doc_id, lang, regexp_extract_all({lower('coalesce(text, chr(32))')}, '[a-z0-9]+') AS k FROM documents")
part(
    "entities",
    """SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, coalesce(array_to_string(k[1:6], ' '), '') AS business_name,
    coalesce(array_to_string(k[7:14], ' '), '') AS business_address, CASE lang WHEN 'en' THEN 'USA' WHEN 'fr' THEN 'fr' ELSE coalesce(lang, '') END AS country,
    CASE WHEN len(k) >= 12 THEN array_to_string(k[5:12], ' ') ELSE '' END AS link_key FROM cut_docs""",
)
part(
    "named",
    f"""SELECT *, left(entity_id, 2) AS src, {name('business_name')} AS norm_name, {address('business_address')} AS norm_addr, {country('country')} AS norm_country FROM entities""",
)


def profile_sql(legal: list[str], digits: int) -> str:
    return f"""SELECT *, coalesce(array_to_string(tokens, ' '), '') AS bare_stem, list_sort(tokens) AS sorted_tokens,
    CASE WHEN len(tokens) > 0 THEN array_to_string(tokens, ' ') ELSE norm_name END AS stem_name,
    CASE WHEN len(tokens) > 0 THEN array_to_string(list_sort(tokens), ' ') ELSE norm_name END AS sorted_stem
    FROM (SELECT entity_id, src, norm_country AS c, norm_name, norm_addr, business_name, business_address, country,
      list_filter({words('norm_name')}, lambda w: w NOT IN ({listed(legal)})) AS tokens,
      list_filter({words('norm_addr')}, lambda w: regexp_matches(w, '^[0-9]+$') AND length(w) >= {digits}) AS nums FROM named)"""


part("base_profiles", profile_sql(T.LEGAL_BASE, 3))
part("wide_profiles", profile_sql(T.LEGAL_ALL, 2))
part(
    "links",
    """SELECT a.entity_id AS s1_id, b.entity_id AS tid FROM entities a JOIN entities b ON a.link_key = b.link_key AND a.country = b.country
    WHERE a.link_key <> '' AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'""",
)
part("heads", "SELECT entity_id AS s1_id FROM entities WHERE entity_id LIKE 'S1-%'")
part(
    "tokened",
    f"""SELECT *, list_filter(list_distinct_in_order, lambda w: w <> '') AS name_toks FROM (SELECT entity_id, src, norm_country, norm_name, norm_addr, business_name, business_address,
      list_transform(list_filter(list_zip({words('norm_name')}, range(1, len({words('norm_name')}) + 1)), lambda z: list_position({words('norm_name')}, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_in_order,
      list_filter({words('norm_addr')}, lambda w: length(w) > 1 AND w NOT IN ({listed(T.ADDRESS_STOP_WORDS)})) AS addr_toks,
      list_filter({words('norm_addr')}, lambda w: regexp_matches(w, '^[0-9]+$')) AS addr_nums FROM named)""",
)


# Edit ratios of the candidates' names and addresses: distinct pairs of values, what is compared for them, common lengths, and the ratios made of those.
part("text_pairs", "SELECT a.norm_name AS x, b.norm_name AS y FROM base_pairs UNION SELECT a.norm_addr, b.norm_addr FROM base_pairs")
part(
    "token_parts",
    f"""SELECT x, y, {sorted_words('x')} AS sx, {sorted_words('y')} AS sy, coalesce(array_to_string(list_sort(list_intersect(p, q)), ' '), '') AS common_words,
    coalesce(array_to_string(list_sort(list_filter(p, lambda w: NOT list_contains(q, w))), ' '), '') AS ox, coalesce(array_to_string(list_sort(list_filter(q, lambda w: NOT list_contains(p, w))), ' '), '') AS oy, len(p) > 0 AND len(q) > 0 AS any_words
    FROM (SELECT x, y, list_distinct({words('x')}) AS p, list_distinct({words('y')}) AS q FROM text_pairs)""",
)
part(
    "ratios",
    f"""SELECT x, y, CASE WHEN x = y THEN 1.0::DOUBLE WHEN x = '' OR y = '' THEN 0.0 ELSE 2 * {common_length('length(x)', bits('x', 'y'))} / (length(x) + length(y)) END AS value
    FROM (SELECT x, y FROM token_parts UNION SELECT sx, sy FROM token_parts UNION SELECT trim(common_words || ' ' || ox), trim(common_words || ' ' || oy) FROM token_parts UNION SELECT common_words, trim(common_words || ' ' || ox) FROM token_parts UNION SELECT common_words, trim(common_words || ' ' || oy) FROM token_parts)""",
)
part("partial_values", "SELECT x, y FROM token_parts UNION SELECT sx, sy FROM token_parts UNION SELECT ox, oy FROM token_parts")
part(
    "stretches",
    f"""SELECT x, y, list_max(list_transform(range(2 - n, length(long) + 1), lambda i: 2 * {common_length('n', 'masks[greatest(1, i):least(length(long), i + n - 1)]')} / (n + least(length(long), i + n - 1) - greatest(1, i) + 1))) AS value
    FROM (SELECT x, y, long, length(short) AS n, {bits('short', 'long')} AS masks FROM (SELECT x, y, x AS short, y AS long FROM partial_values WHERE length(x) <= length(y) UNION SELECT x, y, y, x FROM partial_values WHERE length(y) <= length(x)) WHERE short <> '')""",
)
part(
    "partials",
    "SELECT p.x, p.y, CASE WHEN p.x = '' OR p.y = '' THEN CASE WHEN p.x = p.y THEN 1.0::DOUBLE ELSE 0.0 END ELSE max(value) END AS value FROM partial_values p LEFT JOIN stretches s ON s.x = p.x AND s.y = p.y GROUP BY p.x, p.y",
)
part(
    "edits",
    """SELECT *, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN greatest(length(x), length(y)) / least(length(x), length(y)) < 1.5 THEN greatest(ratio, 0.95::DOUBLE * greatest(token_sort, token_set))
      ELSE greatest(ratio, scale * partial, 0.95::DOUBLE * scale * greatest(partial_sort, partial_set)) END AS weighted
    FROM (SELECT t.x, t.y, r.value AS ratio, p.value AS partial, s.value AS token_sort, ps.value AS partial_sort,
      CASE WHEN NOT any_words THEN 0.0 WHEN common_words <> '' AND (ox = '' OR oy = '') THEN 1.0 WHEN common_words <> '' THEN greatest(w.value, u.value, v.value) ELSE w.value END AS token_set,
      CASE WHEN NOT any_words THEN 0.0 WHEN common_words <> '' THEN 1.0 ELSE po.value END AS partial_set,
      CASE WHEN greatest(length(t.x), length(t.y)) <= 8.0 * least(length(t.x), length(t.y)) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale
    FROM token_parts t JOIN ratios r ON r.x = t.x AND r.y = t.y JOIN ratios s ON s.x = sx AND s.y = sy JOIN ratios w ON w.x = trim(common_words || ' ' || ox) AND w.y = trim(common_words || ' ' || oy)
    JOIN ratios u ON u.x = common_words AND u.y = trim(common_words || ' ' || ox) JOIN ratios v ON v.x = common_words AND v.y = trim(common_words || ' ' || oy)
    JOIN partials p ON p.x = t.x AND p.y = t.y JOIN partials ps ON ps.x = sx AND ps.y = sy JOIN partials po ON po.x = ox AND po.y = oy)""",
)
