"""Media columns: payloads kept losslessly as the coefficients of progressive JPEG files, read back as bytes and as RGB tensors.

JPEG's unit is the quantized coefficient: payload byte b is coefficient 256 + b, in zigzag order, blocks of 64. Files have three components
with chroma at half resolution, and eight kinds of scans: first and refined DC, two spectral bands of AC at half precision, and one
refinement of all AC. A comment segment holds the payload's length. The reader handles any baseline-precision progressive
Huffman file: it accumulates all scans into coefficient arrays. Scans whose Huffman table has one symbol have a fixed layout
and are read and written in numpy; others bit by bit. Coefficients are inverse-transformed by one matrix product of whole numbers,
chroma is repeated to full resolution, and the tensor is height x width x 3 of unsigned bytes.

Null and empty texts give a payload of one unit of filling. Equal texts give equal values, so repeated rows give equal rows and ties can't arise; rows
that share an id, or have none, are stored each by its text. A very long text is one file, whose pixels take some 20 bytes of memory a byte of text while it is
read; a picture's sides are under 65536 up to some 6 GB. An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import map_batches, table

UNIT = 576
FILL = 255
BASE = 256
MAGIC = b"payload bytes "


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along diagonals, turning each time."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * y + x for y, x in order])


def inverse_matrix() -> np.ndarray:
    """Coefficients in zigzag order to pixels, in whole numbers over 2 ** 13: sums are exact in any order."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    both = np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)
    return np.round(both * (1 << 13))[zigzag()]


INVERSE = inverse_matrix()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def layout(n_blocks: int) -> tuple[int, int]:
    """Rows and columns of units of four luma and two chroma blocks, near a square."""
    units = -(-n_blocks // 6)
    columns = max(1, int(np.ceil(np.sqrt(units))))
    return -(-units // columns), columns


def stuff(coded: bytes) -> bytes:
    """Entropy-coded bytes with a zero after each 255."""
    return coded.replace(b"\xff", b"\xff\x00")


def unstuff(coded: np.ndarray) -> np.ndarray:
    return np.frombuffer(coded.tobytes().replace(b"\xff\x00", b"\xff"), dtype=np.uint8)


#: Eight codes of 9 bits take nine bytes: how far the k-th value's bits are shifted in the k-th byte and the next.
SHIFTS = np.arange(8, dtype=np.uint16)


def nine_bits(values: np.ndarray) -> bytes:
    """For each byte the bit 0 and its 8 bits, filled up with ones."""
    n = values.size
    wide = np.full((-(-n // 8), 8), 255, dtype=np.uint16)
    wide.reshape(-1)[:n] = values.reshape(-1)
    out = np.zeros((len(wide), 9), dtype=np.uint8)
    out[:, :8] = wide >> (SHIFTS + 1)
    out[:, 1:] |= (wide << (7 - SHIFTS) & 255).astype(np.uint8)
    size = -(-9 * n // 8)
    flat = bytearray(out.tobytes()[:size])
    flat[-1] |= (1 << 8 * size - 9 * n) - 1
    return bytes(flat)


def from_nine_bits(coded: np.ndarray, n: int) -> np.ndarray | None:
    """The n values that nine_bits() wrote, or None if a code isn't the bit 0."""
    if len(coded) < -(-9 * n // 8):
        return None
    groups = -(-n // 8)
    wide = np.zeros(9 * groups, dtype=np.uint16)
    wide[: min(len(coded), 9 * groups)] = coded[: 9 * groups]
    wide = wide.reshape(groups, 9)
    # The last group's places past n hold fill or nothing.
    if (wide[:, :8] >> (7 - SHIFTS) & 1).reshape(-1)[:n].any():
        return None
    return ((wide[:, :8] << (SHIFTS + 1) | wide[:, 1:] >> (7 - SHIFTS)) & 255).reshape(-1)[:n]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def huffman(kind: int, symbol: int) -> bytes:
    """A table of one symbol, whose code is the bit 0."""
    return segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def scan(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low]))


def filled(bits: np.ndarray) -> np.ndarray:
    """Bits as bytes, filled up with ones."""
    rest = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(rest, dtype=np.uint8)]) if rest else bits)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file that holds the payload."""
    rows, columns = layout(-(-len(payload) // 64))
    values = np.full(rows * columns * 6 * 64, 255, dtype=np.uint8)
    values[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    blocks = values.reshape(-1, 64)
    luma = rows * columns * 4
    parts = [b"\xff\xd8", segment(0xFE, MAGIC + str(len(payload)).encode()), segment(0xDB, bytes([0]) + bytes([1]) * 64)]
    parts.append(segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    of = ((1, blocks[:luma]), (2, blocks[luma : luma + rows * columns]), (3, blocks[luma + rows * columns :]))
    # First halves: (256 + b) >> 1 is 128 + (b >> 1), of 8 bits, after the one-bit code of its category. DC predictions start anew at each block.
    parts += [huffman(0, 8), segment(0xDD, struct.pack(">H", 1))]
    for c, b in of:
        code = (128 | (b[:, 0] >> 1)).astype(np.uint16)
        word = code << 7 | 0x7F  # 0, 8 bits, then ones to fill
        two = np.stack([word >> 8, word & 255], axis=1).astype(np.uint8)
        out = np.empty((len(b), 4), dtype=np.uint8)
        out[:, :2], out[:, 2], out[:, 3] = two, 255, 0xD0 + np.arange(len(b)) % 8
        flat, full = out.reshape(-1)[:-2], np.nonzero(two.reshape(-1) == 255)[0]
        at = full // 2 * 4 + full % 2
        parts += [scan(c, 0, 0, 0, 1), (np.insert(flat, at + 1, 0) if len(at) else flat).tobytes()]
    parts.append(segment(0xDD, struct.pack(">H", 0)))
    for c, b in of:
        parts += [scan(c, 0, 0, 1, 0), stuff(filled(b[:, 0] & 1).tobytes())]
    parts.append(huffman(1, 0x08))
    for c, b in of:
        for first, last in ((1, 5), (6, 63)):
            parts += [scan(c, first, last, 0, 1), stuff(nine_bits(128 | (b[:, first : last + 1] >> 1)))]
    # Refinement: an end-of-block code, the bit 0, then a correction bit for each of 63 coefficients.
    parts.append(huffman(1, 0x00))
    for c, b in of:
        bits = b & 1
        bits[:, 0] = 0
        parts += [scan(c, 1, 63, 1, 0), stuff(filled(bits.reshape(-1)).tobytes())]
    return b"".join([*parts, b"\xff\xd9"])


class Component:
    def __init__(self, h: int, v: int, table: int) -> None:
        self.h, self.v, self.table = h, v, table
        self.rows = self.columns = self.own_rows = self.own_columns = 0
        self.blocks = np.zeros((0, 64), dtype=np.int32)


class Image:
    """A progressive file's coefficients, comment and quantization."""

    def __init__(self, data: bytes) -> None:
        self.data, self.comment = data, b""
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.components: dict[int, Component] = {}
        self.restart = 0
        raw = np.frombuffer(data, dtype=np.uint8)
        full = np.nonzero(raw[:-1] == 255)[0]
        after = raw[full + 1]
        self.marks = full[(after != 0) & (after != 255) & ~((after >= 0xD0) & (after <= 0xD7))]
        at = 2
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                return
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self.read_quant(body)
            elif marker == 0xC2:
                self.read_frame(body)
            elif marker == 0xC4:
                self.read_tables(body)
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                end = int(self.marks[np.searchsorted(self.marks, at)])
                self.read_scan(body, raw[at:end])
                at = end

    def read_quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, n = body[at] >> 4, body[at] & 15
            size = 128 if wide else 64
            self.quant[n] = np.frombuffer(body[at + 1 : at + 1 + size], dtype=">u2" if wide else np.uint8).astype(np.int32)
            at += 1 + size

    def read_frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for k in range(n):
            c, hv, q = body[6 + 3 * k : 9 + 3 * k]
            self.components[c] = Component(hv >> 4, hv & 15, q)
        self.h, self.v = (max(getattr(c, x) for c in self.components.values()) for x in ("h", "v"))
        self.unit_rows, self.unit_columns = -(-self.height // (8 * self.v)), -(-self.width // (8 * self.h))
        for c in self.components.values():
            c.rows, c.columns = self.unit_rows * c.v, self.unit_columns * c.h
            c.own_rows, c.own_columns = -(-(-(-self.height * c.v // self.v)) // 8), -(-(-(-self.width * c.h // self.h)) // 8)
            c.blocks = np.zeros((c.rows * c.columns, 64), dtype=np.int32)

    def read_tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            key, counts = (body[at] >> 4, body[at] & 15), body[at + 1 : at + 17]
            at, code, codes = at + 17, 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[length, code] = body[at]
                    at, code = at + 1, code + 1
                code <<= 1
            self.tables[key] = codes

    def read_scan(self, body: bytes, coded: np.ndarray) -> None:
        n = body[0]
        parts = [(self.components[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n == 1:
            c, dc, ac = parts[0]
            whole = (c.own_rows, c.own_columns) == (c.rows, c.columns)
            grid = np.arange(c.rows * c.columns).reshape(c.rows, c.columns)[: c.own_rows, : c.own_columns].reshape(-1)
            only = self.tables.get((1, ac) if first else (0, dc), {})
            if self.fixed(c, slice(None) if whole else grid, len(grid), only, coded, first, last, high, low):
                return
            units = [[(c, int(b), dc, ac)] for b in grid]
        else:
            units = [
                [(c, (y * c.v + v) * c.columns + x * c.h + h, dc, ac) for c, dc, ac in parts for v in range(c.v) for h in range(c.h)]
                for y in range(self.unit_rows)
                for x in range(self.unit_columns)
            ]
        self.bitwise(units, coded, first, last, high, low)

    def fixed(self, c: Component, grid: np.ndarray | slice, n: int, only: dict[tuple[int, int], int], coded: np.ndarray, first: int, last: int, high: int, low: int) -> bool:
        """Reads scans whose every code is the bit 0 of a table of one symbol. False if this is none."""
        symbol = next(iter(only.values())) if len(only) == 1 and (1, 0) in only else None
        width = last - first + 1
        if first == 0 and high and not self.restart:
            bits = np.unpackbits(unstuff(coded))[:n].astype(np.int32)
            c.blocks[grid, 0] += bits << low
        elif symbol is None:
            return False
        elif first == 0 and not high and self.restart == 1 and 0 < symbol <= 15:
            step = -(-(1 + symbol) // 8)
            clean = unstuff(coded)
            if len(clean) != n * (step + 2) - 2:
                return False
            rows = np.concatenate([clean, [255, 0xD0]]).reshape(n, step + 2)[:, :step].astype(np.uint8)
            if symbol == 8:
                value = ((rows[:, 0].astype(np.int32) << 1) | (rows[:, 1] >> 7)) & 255
                c.blocks[grid, 0] = np.where(value >= 128, value, value - 255) << low
            else:
                c.blocks[grid, 0] = self.signed(np.unpackbits(rows, axis=1)[:, 1 : 1 + symbol], symbol) << low
        elif first and not high and not self.restart and symbol == 8:
            value = from_nine_bits(unstuff(coded), n * width)
            if value is None:
                return False
            value = value.astype(np.int32)
            c.blocks[grid, first : last + 1] = (np.where(value >= 128, value, value - 255) << low).reshape(n, width)
        elif first and not high and not self.restart and 0 < symbol <= 15:
            size = 1 + symbol
            bits = np.unpackbits(unstuff(coded))[: n * width * size].reshape(-1, size)
            if bits[:, 0].any() or len(bits) != n * width:
                return False
            c.blocks[grid, first : last + 1] = (self.signed(bits[:, 1:], symbol) << low).reshape(n, width)
        elif first and high and not self.restart and symbol == 0 and (c.blocks[grid, first : last + 1] != 0).all():
            bits = np.unpackbits(unstuff(coded))[: n * (1 + width)].reshape(n, 1 + width)[:, 1:].astype(np.int32)
            old = c.blocks[grid, first : last + 1]
            c.blocks[grid, first : last + 1] = old + np.where(old > 0, bits, -bits) * (1 << low)
        else:
            return False
        return True

    @staticmethod
    def signed(bits: np.ndarray, size: int) -> np.ndarray:
        """Values of this category from their bits: those that begin with 0 are negative."""
        value = bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        return np.where(bits[:, 0] == 1, value, value - (1 << size) + 1)

    def bitwise(self, units: list, coded: np.ndarray, first: int, last: int, high: int, low: int) -> None:
        """Reads any scan, code by code."""
        raw = coded.tobytes()
        pieces, at = [], 0
        while at < len(raw):  # parted by restart marks
            stop = at
            while True:
                stop = raw.find(b"\xff", stop)
                if stop < 0 or raw[stop + 1 : stop + 2] and 0xD0 <= raw[stop + 1] <= 0xD7:
                    break
                stop += 2
            stop = len(raw) if stop < 0 else stop
            pieces.append(raw[at:stop].replace(b"\xff\x00", b"\xff"))
            at = stop + 2
        every = self.restart or len(units)
        for k, piece in enumerate(pieces):
            bits, at, run, prediction = np.unpackbits(np.frombuffer(piece, dtype=np.uint8)).tolist() + [1] * 64, 0, 0, {}

            def take(n: int) -> int:
                nonlocal at
                out = 0
                for b in bits[at : at + n]:
                    out = out << 1 | b
                at += n
                return out

            def symbol(codes: dict[tuple[int, int], int]) -> int:
                code = 0
                for length in range(1, 17):
                    code = code << 1 | take(1)
                    if (length, code) in codes:
                        return codes[length, code]
                raise ValueError("a code that no table has")

            def value(size: int) -> int:
                x = take(size)
                return x if not size or x >> (size - 1) else x - (1 << size) + 1

            for unit in units[k * every : (k + 1) * every]:
                for c, b, dc, ac in unit:
                    block = c.blocks[b]
                    if first == 0:
                        if high:
                            block[0] += take(1) << low
                        else:
                            prediction[id(c)] = prediction.get(id(c), 0) + value(symbol(self.tables[0, dc]))
                            block[0] = prediction[id(c)] << low
                        continue
                    codes, at_k = self.tables[1, ac], first
                    if high:
                        if run:
                            run -= 1
                        else:
                            while at_k <= last:
                                rs = symbol(codes)
                                zeros, new = rs >> 4, 0
                                if rs & 15:
                                    new = (1 if take(1) else -1) << low
                                elif zeros < 15:
                                    run = (1 << zeros) + take(zeros) - 1
                                    break
                                while at_k <= last:
                                    if block[at_k]:
                                        if take(1):
                                            block[at_k] += (1 if block[at_k] > 0 else -1) << low
                                    elif zeros == 0:
                                        block[at_k] = new
                                        at_k += 1
                                        break
                                    else:
                                        zeros -= 1
                                    at_k += 1
                        for j in range(at_k, last + 1):
                            if block[j] and take(1):
                                block[j] += (1 if block[j] > 0 else -1) << low
                        continue
                    if run:
                        run -= 1
                        continue
                    while at_k <= last:
                        rs = symbol(codes)
                        zeros, size = rs >> 4, rs & 15
                        if size:
                            at_k += zeros
                            block[at_k] = value(size) << low
                            at_k += 1
                        elif zeros == 15:
                            at_k += 16
                        else:
                            run = (1 << zeros) + take(zeros) - 1
                            break

    def payload(self) -> bytes:
        """The bytes that encode() stored."""
        n = int(self.comment[len(MAGIC) :])
        flat = np.concatenate([c.blocks.reshape(-1) for c in self.components.values()])
        return (flat[:n] - BASE).astype(np.uint8).tobytes()

    def rgb(self) -> np.ndarray:
        """The picture at full resolution, height x width x 3."""
        planes = []
        for c in self.components.values():
            pixels = np.empty((len(c.blocks), 64), dtype=np.uint8)
            for k in range(0, len(c.blocks), 16384):
                # Whole numbers below 2 ** 53 over 2 ** 13, so exact; then rounded, halves up.
                sums = (c.blocks[k : k + 16384] * self.quant[c.table]).astype(np.float64) @ INVERSE
                sums *= 2.0**-13
                sums += 128.5
                np.floor(sums, out=sums)
                np.clip(sums, 0, 255, out=sums)
                pixels[k : k + 16384] = sums
            plane = pixels.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns)
            plane = plane.repeat(self.v // c.v, axis=0) if self.v > c.v else plane
            planes.append((plane.repeat(self.h // c.h, axis=1) if self.h > c.h else plane)[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, blue, red = ((p.astype(np.int32) - less) for p, less in zip(planes, (0, 128, 128)))
        y = (y << 16) + (1 << 15)
        # 1.402, 0.344136, 0.714136 and 1.772 over 2 ** 16.
        out = np.empty((*planes[0].shape, 3), dtype=np.uint8)
        for k, plane in enumerate((y + 91881 * red, y - 22554 * blue - 46802 * red, y + 116130 * blue)):
            plane >>= 16
            out[:, :, k] = np.clip(plane, 0, 255, out=plane)
        return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and a check of all pixels."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (h * w)
    return f"{w}x{h} {means[0]},{means[1]},{means[2]} {zlib.crc32(rgb.tobytes()):08x}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a JPEG file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array([encode(payload_of(t)) for t in texts], type=pa.binary())], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """media with height, width and rgb (bytes, row by row), its column of files read back."""
    names = media.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pictures = [Image(m).rgb() for m in b.column("media").to_pylist()]
        more = [pa.array([p.shape[k] for p in pictures], type=pa.int32()) for k in (0, 1)] + [pa.array([p.tobytes() for p in pictures], type=pa.binary())]
        return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "height", "width", "rgb"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return map_batches(media, run, f"{schema}, height int, width int, rgb binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests of each stored file and of what is read back from it."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in fields.split(", ")])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m in b.column("media").to_pylist():
            image = Image(m)
            p = image.payload()
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(image.rgb())))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array([r[k] for r in rows], type=schema[2 + k].type) for k in range(6)]], schema=schema)

    return map_batches(media, run, fields)


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents", "doc_id", "text")))
