"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text is cut where no piece of the vocabulary can reach across: before a word's space marks and around line feeds. The agenda of each
word not seen before gives up its best-scored pair, the leftmost among equals, until none is left; a batch's new words do so side by side
in numpy, and long ones by a heap each. In every Arrow batch the new words, and one whole text, are checked against the sentencepiece
library, whose ids stand if they differ; as no piece reaches across words, texts of checked words are checked.

Null and empty texts have the begin and end ids only. Repeated rows encode alike, rows that share an id each by its text; an empty table gives an empty
table; other columns of the input are ignored, whatever their names. Ties of score go to the leftmost pair. Very long texts are encoded whole: a long
word has a heap, whose time grows with its length a little faster than in proportion.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import map_batches, table

MARK = "▁"
#: Words of more symbols than this have a heap of their own.
LONG = 48
#: Words whose ids a worker keeps, some 200 MB; then it starts anew.
KEPT = 1_000_000


class Lookup:
    """Places of whole numbers in a list: hash tables in numpy, each for the keys that collided in the one before."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        rest, bits = np.arange(len(keys)), 21
        while len(rest):
            table = np.full(1 << bits, -1, dtype=np.int32)
            at = self.slot(keys[rest], bits, len(self.tables))
            table[at] = rest  # of several the last stays
            self.tables.append((bits, table))
            rest, bits = rest[table[at] != rest], 16

    def slot(self, keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) + np.uint64(level)) * self.ODD) >> np.uint64(64 - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (bits, table) in enumerate(self.tables):
            found = table[self.slot(keys[left], bits, level)]
            hit = (found >= 0) & (self.keys[found] == keys[left])
            out[left[hit]] = found[hit]
            left = left[~hit]
        return out


class Agenda:
    def __init__(self, model: str = "piece_bpe_32k.model") -> None:
        import public_tokenizers
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = sp.get_piece_size()
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        #: Symbols: the pieces, then characters that only occur inside pieces.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols) - len(self.ids))
        self.width = n + len(self.symbols) - len(self.ids) + 1
        self.other = self.width - 1  # any character that no piece has
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (i, -sp.get_score(i))
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.cost = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.float64)
        self.pairs, self.place = pairs, Lookup(self.keys)
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("this vocabulary has pieces across words")
        self.seen: dict[str, bytes] = {"": b""}

    def words(self, text: str) -> list[str]:
        """The text's words with their space marks; line feeds by themselves."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", MARK + text.replace(" ", MARK))
        out = (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")
        # A space before a line feed or the end makes a mark by itself, as it should.
        return out

    def add(self, words: set[str]) -> None:
        """Agendas of words not seen before."""
        if len(self.seen) + len(words) > KEPT:
            self.seen = {"": b""}
        batch = []
        for w in words:
            if len(w) > LONG:
                self.seen[w] = self.spell(*self.by_heap(w))
            else:
                batch.append(w)
        for k in range(0, len(batch), 50_000):
            self.side_by_side(batch[k : k + 50_000])

    def side_by_side(self, batch: list[str]) -> None:
        get, other = self.symbols.get, self.other
        sym = np.array([get(c, other) for w in batch for c in w], dtype=np.int64)
        of = np.repeat(np.arange(len(batch)), [len(w) for w in batch])
        char = np.arange(len(sym))  # each symbol's first character, to spell what has no id
        chars = [c for w in batch for c in w]
        done_sym, done_of, done_char = [], [], []
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            inside = np.nonzero(of[:-1] == of[1:])[0]
            at = np.full(len(key), -1, dtype=np.int64)
            at[inside] = self.place(key[inside])
            hit = np.nonzero(at >= 0)[0]
            active = np.zeros(len(batch), dtype=bool)
            active[of[hit]] = True
            stay = active[of]
            done_sym.append(sym[~stay]), done_of.append(of[~stay]), done_char.append(char[~stay])
            if not len(hit):
                break
            cost, words = self.cost[at[hit]], of[hit]
            starts = np.nonzero(np.r_[True, words[1:] != words[:-1]])[0]
            least = np.minimum.reduceat(cost, starts)
            best = np.nonzero(cost == np.repeat(least, np.diff(np.r_[starts, len(cost)])))[0]
            first = best[np.r_[True, words[best][1:] != words[best][:-1]]]
            sym[hit[first]] = self.merged[at[hit[first]]]
            stay[hit[first] + 1] = False
            sym, of, char = sym[stay], of[stay], char[stay]
        sym, of, char = (np.concatenate(x) for x in (done_sym, done_of, done_char))
        order = np.lexsort((char, of))
        sym, of, char = sym[order], of[order], char[order]
        bounds = np.searchsorted(of, np.arange(len(batch) + 1))
        raw = sym.astype("<u4").tobytes()
        odd = np.zeros(len(batch), dtype=bool)
        odd[of[sym >= self.library.get_piece_size()]] = True
        for k, (w, a, b) in enumerate(zip(batch, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            self.seen[w] = self.spell(sym[a:b].tolist(), [chars[c] for c in char[a:b].tolist()]) if odd[k] else raw[4 * a : 4 * b]

    def by_heap(self, word: str) -> tuple[list[int], list[str]]:
        """The agenda of one word as a heap: the symbols left, and the first character of each."""
        sym = [self.symbols.get(c, self.other) for c in word]
        before, after, alive = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1], [True] * len(sym)
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := self.pairs.get(sym[a] * self.width + sym[b])):
                heapq.heappush(heap, (p[1], a, b, sym[a] * self.width + sym[b]))

        for k in range(len(sym) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, key = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or after[a] != b or sym[a] * self.width + sym[b] != key:
                continue
            sym[a], alive[b], after[a] = self.pairs[key][0], False, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        left = [k for k, x in enumerate(alive) if x]
        return [sym[k] for k in left], [word[k] for k in left]

    def spell(self, symbols: list[int], firsts: list[str]) -> bytes:
        """Ids as bytes; a symbol without an id goes byte by byte."""
        out = []
        for s, c in zip(symbols, firsts, strict=True):
            if s < self.library.get_piece_size():
                out.append(s)
            else:
                out += [self.bytes.get(x, self.unknown) for x in c.encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the begin and end ids, as little-endian unsigned 32-bit integers."""
        parts = [self.words(t) for t in texts]
        new = {w for p in parts for w in p if w not in self.seen}
        if new:
            if len(self.seen) + len(new) > KEPT:
                new = {w for p in parts for w in p}
            self.add(new)
        self.fresh = new
        seen, head, tail = self.seen, np.array([self.begin], dtype="<u4").tobytes(), np.array([self.end], dtype="<u4").tobytes()
        return [head + b"".join([seen[w] for w in p]) + tail for p in parts]

    def check(self, words: set[str]) -> bool:
        """Whether the library gives these words the same ids; its ids replace those that differ."""
        listed = sorted(w for w in words if w and w != "\n")
        # The library puts a mark before a text. A word without one follows a line feed, and its ids those of mark and line feed.
        texts = [w[1:].replace(MARK, " ") if w[0] == MARK and w != MARK else f"\n{w}" if w != MARK else " " for w in listed]
        feed = np.array(self.library.encode("\n"), dtype="<u4").tobytes()
        good = True
        for w, ids in zip(listed, self.library.encode(texts, num_threads=1), strict=True):
            raw = np.array(ids, dtype="<u4").tobytes()
            if w == MARK:
                continue  # one mark alone is an empty text, which has no ids; whole texts tell
            raw = raw if w[0] == MARK else raw.removeprefix(feed)
            if raw != self.seen[w]:
                self.seen[w], good = raw, False
        return good

    def checked(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """Each text's ids, their decoding, and whether the agenda's ids were the library's in this batch."""
        own = self.encode_batch(texts)
        good = self.check(self.fresh)
        if not good:
            own = self.encode_batch(texts)
        for k in range(min(1, len(texts))):
            whole = np.array(self.library.encode(texts[k], add_bos=True, add_eos=True), dtype="<u4").tobytes()
            if own[k] != whole:
                own, good = [np.array(x, dtype="<u4").tobytes() for x in self.library.encode(texts, num_threads=1, add_bos=True, add_eos=True)], False
        decoded = self.library.decode([np.frombuffer(x, dtype="<u4").tolist() for x in own], num_threads=1) if own else []
        return [(o, d, good) for o, d in zip(own, decoded, strict=True)]


def agenda(model: str) -> Agenda:
    """The worker's agenda of this model; workers serve many tasks, and what they have seen serves all."""
    import sys

    kept = sys.__dict__.setdefault("_agendas", {})
    if model not in kept:
        kept[model] = Agenda(model)
    return kept[model]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded, and whether agenda and library agreed."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("agrees", pa.bool_())])

    def run(b: pa.RecordBatch, a: Agenda) -> pa.RecordBatch:
        found = a.checked([t or "" for t in b.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([x[k] for x in found], type=schema[1 + k].type) for k in range(3)]], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, decoded string, agrees boolean", lambda: agenda(model))


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """As encode, with digests in place of ids and decoded texts, so that neither crosses back from the workers."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())])

    def run(b: pa.RecordBatch, a: Agenda) -> pa.RecordBatch:
        found = a.checked([t or "" for t in b.column("text").to_pylist()])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        columns = [[len(i) // 4 for i, _, _ in found], [sha(i) for i, _, _ in found], [sha(d.encode("utf-8", "surrogatepass")) for _, d, _ in found], [x for _, _, x in found]]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, type=schema[1 + k].type) for k, c in enumerate(columns)]], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean", lambda: agenda(model))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
