import hashlib
import random
import zlib

import numpy as np
import pytest

from linkweave.llm import html, jpeg, pieces

from .conftest import awkward


@pytest.fixture(scope="module")
def agenda():
    return pieces.Agenda()


def library(a, t):
    return np.array(a.library.encode(t, add_bos=True, add_eos=True), dtype="<u4").tobytes()


def test_pieces_are_the_librarys(agenda):
    rng = random.Random(9)
    letters = "ab  c\n\n▁éß漢🙂\x00\tthe and  "
    texts = [t or "" for t in awkward()] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += ["</s>", "<s>", "<0x0A>", "<unk>", " a", "a ", "\n", "\n\na", "a \n b", "ab" * 400]
    for t, ids in zip(texts, agenda.encode_batch(texts)):
        assert ids == library(agenda, t), t[:80]
    assert all(ok for _, _, ok in agenda.checked(texts))


def test_heap_and_side_by_side_agree(agenda):
    rng = random.Random(3)
    for _ in range(200):
        w = "▁" + "".join(rng.choice("thereaninguxqéß") for _ in range(rng.randint(1, 40)))
        agenda.seen.pop(w, None)
        agenda.side_by_side([w])
        assert agenda.seen[w] == agenda.spell(*agenda.by_heap(w))


def test_a_wrong_word_is_noticed_and_mended(agenda):
    agenda.encode_batch(["zebra"])
    agenda.seen["▁zebra"] = b"\0\0\0\0"
    assert not agenda.check({"▁zebra"}) and agenda.encode_batch(["zebra"])[0] == library(agenda, "zebra")


def test_kept_words_are_bounded(agenda, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    own = pieces.Agenda()
    for k in range(10):
        texts = [" ".join(f"w{k}x{i}" for i in range(20))]
        assert own.encode_batch(texts) == [library(own, texts[0])]
        assert len(own.seen) <= 71


def test_piece_digests(frame, agenda):
    texts = awkward()
    rows = {r.doc_id: r for r in pieces.digests(frame(texts)).collect()}
    for i, t in enumerate(texts):
        ids = library(agenda, t or "")
        decoded = agenda.library.decode(np.frombuffer(ids, dtype="<u4").tolist())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.ids for r in pieces.encode(frame(["a", None])).collect()} == {library(agenda, "a"), library(agenda, "")}
    assert pieces.digests(frame(["a"]).limit(0)).count() == 0


def test_payloads_come_back(frame):
    texts = awkward()
    rows = {r.doc_id: r for r in jpeg.read_back(jpeg.store(frame(texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t or "", set()).add(tuple(rows[i])[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert jpeg.store(frame(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("payload", [bytes(range(256)) * 9, b"\xff" * 576, b"\0" * 1152, b"\xfe\xff" * 2880])
def test_fixed_and_bitwise_readers_agree(payload, monkeypatch):
    file = jpeg.encode(payload)
    fast = jpeg.Image(file)
    assert fast.payload() == payload
    monkeypatch.setattr(jpeg.Image, "fixed", lambda *a: False)
    slow = jpeg.Image(file)
    for k, c in fast.components.items():
        assert (c.blocks == slow.components[k].blocks).all()
    assert slow.payload() == payload and (slow.rgb() == fast.rgb()).all()


def test_marker_structure():
    file = jpeg.encode(b"\xff" * 576)
    assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9" and file.count(b"\xff\xda") == 3 + 3 + 6 + 3 and b"\xff\xc2" in file


def test_inverse_transform_against_its_definition():
    rng = np.random.default_rng(1)
    zz = rng.integers(-200, 200, 64)
    natural = np.zeros(64)
    natural[jpeg.zigzag()] = zz
    f = natural.reshape(8, 8)
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[sum(c(u) * c(v) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    got = (zz @ jpeg.INVERSE / (1 << 13)).reshape(8, 8)
    assert np.abs(got - np.array(want)).max() < 1.0


def bits_of(pairs):
    text = "".join(format(v, f"0{n}b") if n else "" for v, n in pairs)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def test_a_file_with_runs_negative_values_and_refinements():
    """One gray block: DC -5, AC 0 0 3 0 ... -2, in halves and refinements, with zero runs and codes of several symbols."""
    tables = lambda kind, symbols: jpeg.segment(0xC4, bytes([kind << 4, 0, len(symbols), *[0] * 14, *symbols]))
    scan = lambda a, b, h, low: jpeg.segment(0xDA, bytes([1, 1, 0, a, b, h << 4 | low]))
    frame = jpeg.segment(0xC2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    head = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0]) + bytes([1]) * 64) + frame
    # DC in halves: -5 >> 1 = -3, of two bits: -3 is 00; then its last bit, 1.
    dc = tables(0, [0, 2]) + scan(0, 0, 0, 1) + bits_of([(1, 2), (0, 2)]) + scan(0, 0, 1, 0) + bits_of([(1, 1)])
    # AC in halves (towards zero): place 3 is 1, place 7 is -1: (run 2, size 1, bit 1), (run 3, size 1, bit 0), end of block.
    ac = tables(1, [0x21, 0x31, 0x00]) + scan(1, 63, 0, 1) + bits_of([(0, 2), (1, 1), (1, 2), (0, 1), (2, 2)])
    # Refinement: a new 1 at place 5: (run 1, size 1, bit 1) passes place 1, 2 ... so run 3 (places 1, 2, 4), with the bit of place 3; then the end, with place 7's.
    fine = tables(1, [0x31, 0x00]) + scan(1, 63, 1, 0) + bits_of([(0, 2), (1, 1), (1, 1), (1, 2), (0, 1)])
    image = jpeg.Image(head + dc + ac + fine + b"\xff\xd9")
    block = image.components[1].blocks[0]
    assert {int(k): int(block[k]) for k in np.nonzero(block)[0]} == {0: -5, 3: 3, 5: 1, 7: -2}
    assert image.rgb().shape == (8, 8, 3)


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy now</div><header>Site</header><article><h1>Head &amp; line</h1><p><b>First <i>par</i>t.<br><p>Second\n  line &lt;b&gt; &copy;</p>'
    '<aside>More</aside><form>Name <input></form><div id="comments"><p>Great post with many words in it, really</p></div></article><div class="cookie-notice">We use cookies</div><footer>&copy; me</footer></body></html>'
)


def test_main_text():
    tree = html.grow(list(html.LABELLED))
    assert html.main_text(PAGE, tree) == "Head & line First part. Second line <b> ©"
    for broken in (None, "", "<", "<p", "<article><p>text", "<article><p>a<script>b", "no markup at all", "<!-- open", "</p></div>"):
        html.main_text(broken, tree)
    assert html.main_text("<article><p>text", tree) == "text"
    assert html.main_text("<article><p>x &amp y &#233; &nbsp; z<img alt='>'></p>", tree) == "x & y é z"


def test_tree_fits_its_table():
    tree = html.grow(list(html.LABELLED))
    assert all(html.decide(tree, r[:-1]) == r[-1] for r in html.LABELLED)


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<article><p>" + "word " * 50_000 + "</article>", "x")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r.n_chars for r in out] == [len(r.text) for r in out] and out[1].text == "" and out[4].n_chars == 249_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
