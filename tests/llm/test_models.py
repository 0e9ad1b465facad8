import random

import pytest

from linkweave.llm import language, toxicity
from linkweave.llm.common import crc_of_id

from .conftest import awkward

VOCABULARY = {"en": "the and with house river stone", "de": "der und mit Haus Fluss Stein", "fr": "le et avec maison fleuve pierre", "es": "el y con casa fuego piedra"}


def prose(lang, n, rng):
    return " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(n))


def test_languages_on_held_out_rows(frame):
    rng = random.Random(1)
    langs = {i: rng.choice(list(VOCABULARY)) for i in range(400)}
    docs = frame([prose(langs[i], 30, rng) for i in range(400)], langs)
    rows = language.identify(docs, language.fit(docs)).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if crc_of_id(i) % 4 == 2}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_change_nothing(frame):
    rng = random.Random(2)
    langs = {i: rng.choice(list(VOCABULARY)) for i in range(120)}
    texts = [prose(langs[i], 12, rng) for i in range(120)]
    other = langs | {i: "zz" for i in langs if crc_of_id(i) % 4 == 2}
    a, b = (sorted(map(tuple, language.identify(d, language.fit(d)).collect())) for d in (frame(texts, langs), frame(texts, other)))
    assert a == b and not any(x[2] == "zz" for x in a)


def test_unknown_languages(frame):
    texts = awkward() + ["123 !!", "…"]
    docs = frame(texts)
    rows = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].lang_pred == "und") == (not t or not any(map(str.isalpha, t)))
    none = docs.limit(0)
    assert language.identify(none, language.fit(none)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len(code) == n and len({tuple(c) for c in code.tolist()}) == n


def toxic_world(n, seed):
    rng = random.Random(seed)
    clean = [a + b for a in "ba ko lu mi te re".split() for b in "no sa di ru pe".split()]
    bad = ["vilen", "vilest", "vilor", "grumpf"]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        y = rng.random() < 0.2
        if y:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad).upper() if rng.random() < 0.2 else rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, labels


def test_toxicity_on_held_out_rows(spark, frame):
    texts, y = toxic_world(900, 3)
    docs = frame(texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    held = [i for i in rows if crc_of_id(i) % 5 == 0]
    assert sum(rows[i].predicted == y[i] for i in held) >= 0.97 * len(held)
    for i in held:
        assert rows[i].predicted == int(rows[i].score >= 0.5)
        spans = [tuple(map(int, s.split("-"))) for s in rows[i].spans.split(",") if s]
        assert all(texts[i][a:b].lower().startswith(("vil", "grumpf")) for a, b in spans)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, field).collect()}
    assert kept == {i for i in rows if not rows[i].predicted}


def test_held_out_toxicity_labels_change_nothing(spark, frame):
    texts, y = toxic_world(300, 5)
    docs = frame(texts)
    tables = [spark.createDataFrame([(i, t if crc_of_id(i) % 5 or not flip else 1 - t) for i, t in enumerate(y)], "doc_id long, toxic int") for flip in (False, True)]
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, t)).collect())) for t in tables)
    assert a == b


def test_marginals_against_all_paths():
    import itertools

    import numpy as np

    field = toxicity.Field({"bad$": 2.0, "bad": 0.5}, -1.5, np.array([[0.4, -0.7], [-0.2, 0.9]]), (0, 0, 0))
    words = ["x", "bad", "y", "z", "bad", "bad", "w"]
    e = [field.evidence(w) for w in words]
    at = [k for k, v in enumerate(e) if v is not None]
    got = field.marginals(at, [e[k] for k in at], len(words))
    # The start is clean, before the first token.
    total, on = 0.0, np.zeros(len(words))
    for path in itertools.product((0, 1), repeat=len(words)):
        score = sum(field.move[a, b] for a, b in zip((0, *path), path)) + sum((v if v is not None else field.bias) * s for v, s in zip(e, path))
        total += np.exp(score)
        on += np.exp(score) * np.array(path)
    assert got == pytest.approx([on[k] / total for k in at], abs=1e-9)


def test_toxicity_of_awkward_texts(spark, frame):
    texts, y = toxic_world(200, 6)
    field = toxicity.learn(list(zip(texts, y)))
    rows = toxicity.score(frame(awkward()), field).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(frame(["a"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame([None, "", "a"]), none).where("predicted = 1").count() == 0
    assert toxicity.score(frame(["a"]).limit(0), field).count() == 0
    assert toxicity.learn([("a", 1), ("b", 1)]).tags("a")[0] < 0.5


def brute_languages(rows, texts):
    """The same codes from the definition: plain loops and dictionaries, a weight for each bucket and bit."""
    import math
    from collections import Counter

    def grams(t):
        raw = f" {t.lower()} ".encode()
        return Counter(((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761 % 2**32) >> (32 - language.BITS) for k in range(len(raw) - 2))

    counts = {}
    for lang, t in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
    names = sorted(counts)
    share = [[(counts[x][k] + 0.5) / (sum(counts[x].values()) + 0.5 * language.BUCKETS) for k in range(language.BUCKETS)] for x in names]
    code = language.codewords(len(names)).tolist()
    bits = range(len(code[0]))
    mean = lambda k, b, s: sum(share[i][k] for i in range(len(names)) if code[i][b] == s) / sum(c[b] == s for c in code)
    weight = [[math.log(mean(k, b, 1) / mean(k, b, -1)) for b in bits] for k in range(language.BUCKETS)]
    expected = [[sum(share[i][k] * weight[k][b] for k in range(language.BUCKETS)) * code[i][b] for b in bits] for i in range(len(names))]
    trust = [max(min(e[b] for e in expected), 1e-6) for b in bits]
    scale = 4 / (sum(abs(x) for e in expected for x in e) / len(names) / len(bits))
    out = []
    for t in texts:
        if not t or not any(map(str.isalpha, t)):
            out.append(("und", 0.0, True))
            continue
        g = grams(t)
        margin = [sum(n * weight[k][b] for k, n in g.items()) / sum(g.values()) * scale for b in bits]
        loss = [sum(math.log1p(math.exp(-c[b] * margin[b])) * trust[b] for b in bits) / sum(trust) for c in code]
        best = min(range(len(loss)), key=lambda i: loss[i])
        odds = [math.exp(-4 * (x - loss[best])) for x in loss]
        out.append((names[best], odds[best] / sum(odds), loss[best] > 0.9 * sorted(loss)[1]))
    return out


def test_languages_against_the_definition(frame):
    rng = random.Random(12)
    langs = {i: rng.choice(list(VOCABULARY)) for i in range(60)}
    texts = [prose(langs[i], rng.randint(1, 20), rng) for i in range(60)] + [None, "", "12", "und so und", "the casa", "Ñ é ß"]
    docs = frame(texts, langs | {k: None for k in range(60, 66)})
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    want = brute_languages([(langs[i], texts[i]) for i in range(60) if crc_of_id(i) % 4 != 2], texts)
    for i, (name, score, ambiguous) in enumerate(want):
        assert (got[i].lang_pred, got[i].ambiguous) == (name, ambiguous) and got[i].score == pytest.approx(score, abs=1e-6), texts[i]


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "the house and the river", "en"), (1, "der Fluss und das Haus", "de"), (1, "the river", "en")], "doc_id long, text string, lang string")
    found = language.identify(docs, language.fit(docs)).collect()
    assert len(found) == 3 and all(r.held_out in (True, False) for r in found)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3
