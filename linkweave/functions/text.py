"""Normalization of names, addresses and countries as column expressions.

Everything stays in the JVM but for two Arrow functions, NFKC and accent stripping, which have no built-in equivalent and pass ASCII
values through untouched. unicode=False leaves them out, for columns known to be ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal forms, their dotted spellings, and what they are shortened to, in this order.
DOTTED_FORMS = (
    (r"l\.l\.c\.?", "llc"),
    (r"l\.l\.p\.?", "llp"),
    (r"p\.c\.?", "pc"),
    (r"p\.l\.c\.?", "plc"),
    (r"l\.p\.?", "lp"),
    (r"pvt\.?", "pvt"),
    (r"ltd\.?", "ltd"),
    (r"inc\.?", "inc"),
    (r"corp\.?", "corp"),
)
LONG_FORMS = (("incorporated", "inc"), ("limited", "ltd"), ("private", "pvt"), ("corporation", "corp"), ("company", "co"), (r"co\.", "co"))

# Address words and what they are written out as, in this order.
ADDRESS_WORDS = (
    ("st", "street"),
    ("ave", "avenue"),
    ("blvd", "boulevard"),
    ("rd", "road"),
    ("dr", "drive"),
    ("ln", "lane"),
    ("ct", "court"),
    ("pl", "place"),
    ("cir", "circle"),
    ("fwy", "freeway"),
    ("hwy", "highway"),
    ("pkwy", "parkway"),
    ("pky", "parkway"),
    ("sq", "square"),
    ("fte", "suite"),
    ("ste", "suite"),
    ("apt", "apartment"),
    ("fl", "floor"),
    ("flr", "floor"),
    ("n", "north"),
    ("s", "south"),
    ("e", "east"),
    ("w", "west"),
    ("ne", "northeast"),
    ("nw", "northwest"),
    ("se", "southeast"),
    ("sw", "southwest"),
    (r"h\.no", "house no"),
    ("hn", "house no"),
    (r"no\.", "no"),
    (r"opp\.", "opposite"),
    ("opp", "opposite"),
    ("nr", "near"),
)

# Words of addresses that tell nothing.
ADDRESS_STOP_WORDS = "no and the of in at near to a an for by with is on or as be it 1st 2nd 3rd 4th".split()

# Country aliases; the second table is the wider one for free-form input.
COUNTRIES = {"us": "US", "usa": "US", "united states": "US", "united states of america": "US", "india": "India", "in": "India", "bharat": "India", "france": "France", "fr": "France"}
COUNTRIES_WIDE = {k: v for k, v in COUNTRIES.items() if k != "bharat"} | {"ind": "India", "fra": "France"}

# Tokens that name a legal form, by region.
LEGAL_BASE = "llc inc ltd pvt limited private corp corporation co company llp pc plc lp".split()
LEGAL_FRENCH = "sarl sas sasu sa eurl snc sci gie scop selarl ei micro entreprise".split()
LEGAL_OTHER = "gmbh ag bv nv spa srl sl opc".split()
LEGAL_ALL = LEGAL_BASE + LEGAL_FRENCH + LEGAL_OTHER

# Characters that part tokens in the fast profile, for names and for addresses.
FAST_NAME_MARKS = ",.;:!?\"'()[]{}/\\#@*+"
FAST_ADDRESS_MARKS = ",.;:#-/"

# Fixed value: letters and digits that make tokens, of ASCII and of eight scripts.
TOKEN_CLASS = r"[a-zA-Z0-9\u0900-\u097F\u0C00-\u0C7F\u0B80-\u0BFF\u0980-\u09FF\u0A00-\u0A7F\u0A80-\u0AFF\u0C80-\u0CFF\u0D00-\u0D7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII but for letters, digits and white space.
ASCII_MARKS = r"[\x00-\x08\x0E-\x1B!-/:-@\[-`{-\x7F]"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def bare(s: str) -> str:
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        s = s.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def strip_accents(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None or s.isascii() else bare(s))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; other scripts stay."""
    return F.translate(c, UPPER, UPPER.lower())


def marks_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, ASCII_MARKS, " ")


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def whole_words(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Each pattern, as a word by itself, by its replacement, one after the other."""
    for pattern, word in table:
        c = F.regexp_replace(c, rf"(?U)\b(?:{pattern})\b", word)
    return c


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits and of the scripts above, with ASCII in lower case."""
    return F.transform(F.regexp_extract_all(blank_if_null(c), F.lit(TOKEN_CLASS), 0), ascii_lower)


def words(c: Column) -> Column:
    """Parts between single spaces of a normalized value; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def composed(c: Column, unicode: bool) -> Column:
    return nfkc(blank_if_null(c)) if unicode else blank_if_null(c)


def by_word(c: Column, table: dict[str, str]) -> Column:
    """Whole words by their replacements, in one pass over the parts between single spaces."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(lookup[w], w)), " ")


def name_in_steps(t: Column) -> Column:
    """Every rule of names, one regular expression after the other."""
    t = F.regexp_replace(t, r"(?U)\s*\|.*", "")
    t = F.regexp_replace(t, r"(?U)^--+\s*", "")
    t = F.regexp_replace(t, r"(?iU)(?<!\w)\.(?:com|org|net|in|co)\b", "")
    t = ascii_lower(F.regexp_replace(t, r"(?U)^#+\s*", ""))
    t = F.regexp_replace(t, r"(?U)\s*&\s*", " and ")
    return one_space(marks_to_spaces(whole_words(whole_words(t, DOTTED_FORMS), LONG_FORMS)))


def address_in_steps(t: Column) -> Column:
    """Every rule of addresses, one regular expression after the other."""
    t = ascii_lower(F.regexp_replace(t, r"(?U)#+\s*", ""))
    return one_space(marks_to_spaces(whole_words(t, ADDRESS_WORDS)))


#: Where a name's or address's rules aren't just words for words: other scripts, marks that rules look at, dots that join words.
NAME_STEPS = r"[^\x00-\x7F]|[._|&#]|^--"
ADDRESS_STEPS = r"[^\x00-\x7F]|[#_]|(?i)h\.no|no\.|opp\."


def normalize_name(c: Column, unicode: bool = True) -> Column:
    """Noise cut at either end, legal forms shortened, marks to spaces, lower case; other scripts stay. Plain values take one pass."""
    t = composed(c, unicode)
    plain = by_word(one_space(marks_to_spaces(ascii_lower(t))), dict(LONG_FORMS[:-1]))
    return F.when(t.rlike(NAME_STEPS), name_in_steps(t)).otherwise(plain)


def normalize_address(c: Column, unicode: bool = True) -> Column:
    """Number signs cut, common words written out, marks to spaces, lower case; the order of parts stays. Plain values take one pass."""
    t = composed(c, unicode)
    plain = by_word(one_space(marks_to_spaces(ascii_lower(t))), {k: v for k, v in ADDRESS_WORDS if "." not in k})
    return F.when(t.rlike(ADDRESS_STEPS), address_in_steps(t)).otherwise(plain)


def normalize_country(c: Column, aliases: dict[str, str] | None = None) -> Column:
    trimmed = F.trim(blank_if_null(c))
    key = F.lower(trimmed)
    out = trimmed
    for alias, name in (aliases or COUNTRIES).items():
        out = F.when(key == alias, name).otherwise(out)
    return out


def name_tokens(norm_name: Column) -> Column:
    return F.array_distinct(tokens(norm_name))


def address_tokens(norm_address: Column) -> Column:
    return F.filter(tokens(norm_address), lambda t: (F.length(t) > 1) & ~t.isin(*ADDRESS_STOP_WORDS))


def numerics(c: Column) -> Column:
    """Runs of digits, with those that a slash or hyphen joins kept together."""
    return F.regexp_extract_all(blank_if_null(c), F.lit(r"(?U)\b\d+(?:[/\-]\d+)*\b"), 0)


def numeric_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: t.rlike(r"^(?U)\d+$"))


def digit_words(norm_address: Column, least: int) -> Column:
    """Words of digits only, of so many at least."""
    return F.filter(words(norm_address), lambda t: t.rlike(r"^(?U)\d+$") & (F.length(t) >= least))


def postal_code(address: Column) -> Column:
    """The first five digits by themselves, else the first six; empty if there are none."""
    a = blank_if_null(address)
    five = F.regexp_extract(a, r"(?U)\b(\d{5})(?:-\d{4})?\b", 1)
    return F.when(five != "", five).otherwise(F.regexp_extract(a, r"(?U)\b(\d{6})\b", 1))


def without_legal(norm_name: Column, legal: list[str]) -> Column:
    return F.filter(words(norm_name), lambda t: ~t.isin(*legal))


def joined(parts: Column, fallback: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(fallback)


def char_ngrams(c: Column, n: int) -> Column:
    """The set of runs of n characters of the trimmed value; a shorter one is its own; none if empty."""
    t = F.trim(blank_if_null(c))
    runs = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, F.array_distinct(runs)).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def acronym(parts: Column) -> Column:
    return F.lower(F.array_join(F.transform(parts, lambda t: F.substring(t, 1, 1)), ""))


def fast_name_tokens(c: Column, legal: list[str] | None = None, unicode: bool = True) -> Column:
    """The fast profile's tokens: lower case, cut at a bar, listed marks to spaces, legal forms out."""
    t = F.lower(strip_accents(blank_if_null(c)) if unicode else blank_if_null(c))
    t = F.substring_index(t, "|", 1)
    t = F.when(t.startswith("--"), F.regexp_replace(t, "^[- ]+", "")).otherwise(t)
    t = one_space(F.translate(t, FAST_NAME_MARKS, " " * len(FAST_NAME_MARKS)))
    return F.filter(words(t), lambda w: ~w.isin(*(legal or LEGAL_ALL)))


def fast_address(c: Column) -> Column:
    return one_space(F.translate(F.lower(blank_if_null(c)), FAST_ADDRESS_MARKS, " " * len(FAST_ADDRESS_MARKS)))
