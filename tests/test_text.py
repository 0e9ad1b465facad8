import random
import re

import pytest
from pyspark.sql import functions as F

from linkweave.functions import text as T


def apply(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").select("id", f(F.col("v")).alias("out")).orderBy("id").collect()
    return [r.out for r in rows]


NAMES = {
    "Custom Wealth Services LLC": "custom wealth services llc",
    "Callicoat & Dailey Inc": "callicoat and dailey inc",
    "Foo L.L.C.": "foo llc",
    "Dream Construction Limited": "dream construction ltd",
    "Dream Construction Ltd.": "dream construction ltd",
    "Smart Healthcare Private Limited": "smart healthcare pvt ltd",
    "Lumay Boral Inc.": "lumay boral inc",
    "Raj Investments L.L.P.": "raj investments llp",
    "SHIVSHAKTI VIDYALAYA | www.shivshakti.com": "shivshakti vidyalaya",
    "-- Holloway Peak Inc Seafood": "holloway peak inc seafood",
    "#centraleducation": "centraleducation",
    "heassociates.com": "heassociates com",
    "Hendricks and  Flowers Inc": "hendricks and flowers inc",
    "Kelly Advisory, Inc": "kelly advisory inc",
    "foo co.uk": "foo couk",
    "": "",
    "   ": "",
    None: "",
    "राम मार्केटिंग प्राइवेट लिमिटेड": "राम मार्केटिंग प्राइवेट लिमिटेड",
    "Ｆｕｌｌ Ｗｉｄｔｈ Co": "full width co",
}


def test_names(spark):
    assert apply(spark, list(NAMES), T.normalize_name) == list(NAMES.values())


def test_one_pass_and_steps_agree(spark):
    rng = random.Random(11)
    parts = ["st", "St.", "no", "no.", "opp", "h.no", "HN", "s", "Incorporated", "company", "co.", "ltd", "x_y", "-", "--", "/", "#", "&", "|", ",", "é", "12", "private", "l.p.", "ne,", "(fl)", "\t", "  "]
    values = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 7))) for _ in range(600)]
    assert apply(spark, values, lambda c: T.normalize_name(c, False)) == apply(spark, values, T.name_in_steps)
    assert apply(spark, values, lambda c: T.normalize_address(c, False)) == apply(spark, values, T.address_in_steps)


def test_names_again_are_the_same(spark):
    once = apply(spark, list(NAMES), T.normalize_name)
    assert apply(spark, once, T.normalize_name) == once


ADDRESSES = {
    "3315 FREMONT ST, PEORIA, IL": "3315 fremont street peoria il",
    "85 Wayne AVE, Ticonderoga, NY": "85 wayne avenue ticonderoga ny",
    "1795 Westchester DR, High Point, NC": "1795 westchester drive high point nc",
    "##8 Willow Oak Lane, Saint Louis, Missouri": "8 willow oak lane saint louis missouri",
    "S Y No 33/3, Somwarpet, Kodagu, Karnataka": "south y no 33 3 somwarpet kodagu karnataka",
    "Plot No.1-B": "plot no1 b",
    "Opp.Satyam": "oppositesatyam",
    "": "",
    None: "",
}


def test_addresses(spark):
    assert apply(spark, list(ADDRESSES), T.normalize_address) == list(ADDRESSES.values())


@pytest.mark.parametrize(
    "raw, numbers, postal",
    [
        ("3315 FREMONT ST, Peoria, IL 61602", ["3315", "61602"], "61602"),
        ("Los Angeles, CA 94102-3456", ["94102-3456"], "94102"),
        ("Sector 5, Haryana 121001", ["5", "121001"], "121001"),
        ("Peoria, IL", [], ""),
        ("20637 68, Robertsdale, AL", ["20637", "68"], "20637"),
        ("S No 33/3", ["33/3"], ""),
        (None, [], ""),
    ],
)
def test_numbers(spark, raw, numbers, postal):
    assert apply(spark, [raw], T.numerics) == [numbers]
    assert apply(spark, [raw], T.postal_code) == [postal]


def test_countries(spark):
    raw = ["US", "USA", "us", "United States", "India", "IN", "Bharat", "FR", " Deutschland ", "", None]
    assert apply(spark, raw, T.normalize_country) == ["US", "US", "US", "US", "India", "India", "India", "France", "Deutschland", "", ""]
    assert apply(spark, ["ind", "bharat", "fra"], lambda c: T.normalize_country(c, T.COUNTRIES_WIDE)) == ["India", "bharat", "France"]


def test_tokens(spark):
    assert apply(spark, ["olszewski holding co llc llc"], T.name_tokens) == [["olszewski", "holding", "co", "llc"]]
    assert apply(spark, ["Énterprises Payne"], T.tokens) == [["nterprises", "payne"]]
    assert apply(spark, ["8 willow of the lane a"], T.address_tokens) == [["willow", "lane"]]
    assert apply(spark, ["10 a 2 345"], lambda c: T.digit_words(c, 2)) == [["10", "345"]]


def test_accents(spark):
    assert apply(spark, ["Crème Brûlée œuvre", "plain", None], T.strip_accents) == ["Creme Brulee oeuvre", "plain", None]


def test_fast_profile(spark):
    assert apply(spark, ["-- Café SARL, Paris | x", "A+B Inc", None], T.fast_name_tokens) == [["cafe", "paris"], ["a", "b"], []]
    assert apply(spark, ["12-B, Main #4"], T.fast_address) == ["12 b main 4"]


def test_ngrams_against_plain_python(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(60)]

    def plain(s, n):
        t = s.strip(" ")
        return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else ({t} if t else set())

    for n in (3, 4):
        assert [set(x) for x in apply(spark, values, lambda c: T.char_ngrams(c, n))] == [plain(v, n) for v in values]


def test_stems(spark):
    rows = spark.createDataFrame([("acme llc",), ("llc inc",), ("zeta alpha co",)], "n string")
    tokens = T.without_legal(F.col("n"), T.LEGAL_BASE)
    out = rows.select(T.joined(tokens, F.col("n")).alias("s"), T.joined(F.array_sort(tokens), F.col("n")).alias("o")).collect()
    assert [tuple(r) for r in out] == [("acme", "acme"), ("llc inc", "llc inc"), ("zeta alpha", "alpha zeta")]
    assert re.fullmatch("[a-z ]+", out[0].s)
