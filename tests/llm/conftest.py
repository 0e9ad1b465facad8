import random

import pytest

#: Names that operators use themselves, beside those of the table.
CLASHING = "row row_a row_b own document body m w at places cut n fp first hot deal is_hot is_met length rank salt piece staying_id __key __places __id __d __m __row".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, n_words string, score double, label string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def rows_of(texts, langs=None):
    return [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}", len(t or ""), 7 * i, None, "clash", None, None, *CLASHING) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table with more columns, whose names operators use themselves."""

    def make(texts, langs=None):
        return spark.createDataFrame(rows_of(texts, langs), SCHEMA)

    return make


def awkward(seed=0):
    """Null, empty, blank, repeated, odd and very long texts."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "Zug", "été", "niño", "漢字", "🙂", "a", "x!", "mit", "License", "public"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [prose(rng.randint(3, 9)) for _ in range(12)]
    texts = [None, "", " ", "\n\n", "\t \x0b", "a", "a b", "a b c", "the the the", "same text here", "same text here", "\x00 nul", "no-break space", "🙂" * 5, "x" * 300]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts += [prose(rng.randint(1, 80)) for _ in range(40)]
    texts += [prose(30_000), "z" * 70_000, "\n".join(lines * 300)]
    texts += [texts[60], None, texts[70] + " more", texts[71].upper()]
    return texts
