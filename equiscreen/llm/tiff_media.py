"""TIFF columns: every page of a stored image as a row, and text payloads stored as images.

``read_pages`` walks the image directories of a file in either byte order, reads strips or tiles that are
plain or packed by PackBits, LZW or deflate, undoes horizontal differencing and gives one page at a time.
Samples have 8 or 16 bits, chunky or planar.  ``write_pages`` is its inverse for 8-bit grey pages.

Scale: files are decoded in the map that reads them; a page's pixels are the most that is held at once besides
the file.  A file that is broken gives the pages before the break and one row with the error.

Defined results: null media give no pages; null text is the empty text; equal texts give equal bytes; very long texts
are stored whole, 64 rows a page; an empty table gives an empty result; a directory whose sizes are zero, or more than
the file can hold unpacked, is an error row.  Not read: floating-point predictors, 1, 4 and 32 bits, BigTIFF.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, field types' sizes and struct letters, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: A payload's unit, the width of its pages, and the most rows of a page.
UNIT, PAGE_WIDTH, PAGE_ROWS = 576, 576, 64


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, n = [], 0, 0
    while at < len(data) and n < size:
        k = data[at]
        at += 1
        if k < 128:
            out.append(data[at : at + k + 1])
            at += k + 1
        elif k > 128:
            out.append(data[at : at + 1] * (257 - k))
            at += 1
        n += len(out[-1]) if out and k != 128 else 0
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(bytes([len(part[i : i + 128]) - 1]) + part[i : i + 128])

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : m.start()])
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(data[at:])
    return b"".join(out)


CLEAR, END = 256, 257
#: Bits of each code after CLEAR, up to the CLEAR that the writer gives when its table is full.
WIDTHS = np.repeat([9, 10, 11, 12], [254, 512, 1024, 2048])
#: Codes that are taken from the bits at once.
CODES = 512


def lzw_decode(data: bytes, need: int | None = None) -> bytes:
    """What ``data`` unpacks to; little more than ``need`` bytes of it, if that is given, whatever the codes say."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    table, out = list(base), []
    made = at = 0  # bytes of the words, bits that are read
    width, last = 9, b""
    while need is None or made < need:
        grows = (1 << width) - 1 - len(table) + (not last) if width < 12 else CODES  # codes grow one early
        place = at + width * np.arange(min(CODES, grows, (8 * len(data) - at) // width))
        if not len(place):
            break
        codes = three[place >> 3] >> (24 - width - (place & 7)) & ((1 << width) - 1)
        ends = np.flatnonzero((codes == CLEAR) | (codes == END))
        some = codes[: ends[0]].tolist() if len(ends) else codes.tolist()
        at += width * (len(some) + (len(ends) > 0))
        met, size = len(out), len(table)
        for code in some:
            if code < size:
                word = table[code]
            elif code == size and last:
                word = last + last[:1]
            else:
                raise ValueError(f"LZW code {code} of {size}")
            if last:
                table.append(last + word[:1])
                size += 1
            out.append(word)
            last = word
        made += sum(map(len, out[met:])) if need is not None else 0
        if len(ends):
            if codes[ends[0]] == END:
                break
            table, width, last = list(base), 9, b""
        elif width < 12 and size >= (1 << width) - 1:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, table, size = [CLEAR], {}, 258
    put, find = codes.append, table.get
    word = data[0] if data else -1  # a word's code; the table has the code of a word and one more byte
    for byte in data[1:]:
        pair = word << 8 | byte
        longer = find(pair)
        if longer is not None:
            word = longer
            continue
        put(word)
        table[pair] = size
        size += 1
        if size == 4095:
            put(CLEAR)
            table.clear()
            size = 258
        word = byte
    if data:
        put(word)
    put(END)
    widths = np.concatenate([[9], np.resize(WIDTHS, len(codes) - 1)])
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        stream = zlib.decompressobj()
        out = stream.decompress(data, max(size, 1))
        if len(out) < size and not stream.eof:
            raise ValueError("deflate data end too early")
        return out
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression}")


def _packed(data: bytes, compression: int) -> bytes:
    return {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 3), PACKBITS: pack_bits}[compression](data)


def _directory(raw: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", raw, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind in TYPES and kind != 2:
            size = struct.calcsize(TYPES[kind]) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{TYPES[kind]}", raw, where))
    return tags, struct.unpack_from(order + "I", raw, at + 2 + 12 * count)[0]


#: Bytes that a byte of a file can unpack to at most: deflate's limit is 1032, LZW's 4096 for each 9 bits.
MOST_UNPACKED = 3_700


def read_pages(raw: bytes) -> Iterator[Page]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(raw[:4]))
    if order is None:
        raise ValueError("not a TIFF file")
    at, number, met = struct.unpack_from(order + "I", raw, 4)[0], 0, set()
    while at:
        if at in met:
            raise ValueError("image directories form a loop")
        met.add(at)
        tags, at = _directory(raw, order, at)
        yield _page(raw, order, tags, number)
        number += 1


def _page(raw: bytes, order: str, tags: dict[int, list[int]], number: int) -> Page:
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, samples, bits = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample")
    compression, predictor, planes = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    tiled = TILE_AT in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(STRIP_ROWS, height), height))
    places, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    if min(width, height, samples, w, h) < 1:
        raise ValueError(f"a page of {width} x {height}, parts of {w} x {h}, {samples} samples")
    if width * height * samples * bits // 8 > MOST_UNPACKED * len(raw) or w * h * samples * bits // 8 > MOST_UNPACKED * len(raw):
        raise ValueError(f"a page of {width} x {height} in {len(raw)} bytes")
    kind, deep = np.dtype(f"{order}u{bits // 8}"), samples // planes
    across, down = -(-width // w), -(-height // h)
    pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
    for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, k = divmod(i, across * down)
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        need = rows * w * deep * kind.itemsize
        block = np.frombuffer(_unpacked(raw[place : place + size], compression, need)[:need], kind).reshape(rows, w, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        block = block[: height - y, : width - x]
        pixels[y : y + block.shape[0], x : x + block.shape[1], plane * deep : (plane + 1) * deep] = block
    return Page(number, width, height, samples, bits, NAMES[compression], predictor, tiled, pixels)


def write_pages(pages: list[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """``pages``: 8-bit grey pixels (height x width), compression, predictor, whether in tiles (64 x 16) or in strips of 16 rows."""
    out, at = [], 8
    link = 4  # where the next directory's place is written
    links: list[tuple[int, int]] = []
    for pixels, compression, predictor, tiled in pages:
        height, width = pixels.shape
        w, h = (64, 16) if tiled else (width, 16)
        places, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = pixels[y : y + h, x : x + w]
                if tiled and block.shape != (h, w):
                    part, block = block, np.zeros((h, w), np.uint8)
                    block[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                data = _packed(block.astype(np.uint8).tobytes(), compression)
                places.append(at)
                sizes.append(len(data))
                out.append(data + b"\0" * (len(data) % 2))
                at += len(out[-1])
        layout = [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_AT, 4, places), (TILE_SIZE, 4, sizes)] if tiled else [(STRIP_AT, 4, places), (STRIP_ROWS, 4, [h]), (STRIP_SIZE, 4, sizes)]
        entries = sorted([(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), *layout])
        extra, after = [], at + 2 + 12 * len(entries) + 4
        table = struct.pack("<H", len(entries))
        for tag, kind, values in entries:
            data = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                table += struct.pack("<HHII", tag, kind, len(values), after)
                extra.append(data)
                after += len(data)
            else:
                table += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        links.append((link, at))
        link = at + len(table)
        out.append(table + b"\0\0\0\0" + b"".join(extra))
        at = after
    raw = bytearray(b"II*\0\0\0\0\0" + b"".join(out))
    for where, place in links:
        raw[where : where + 4] = struct.pack("<I", place)
    return bytes(raw)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of UNIT bytes as grey pages; each page's bytes decide how it is packed."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    pages = []
    for y in range(0, len(pixels), PAGE_ROWS):
        page = pixels[y : y + PAGE_ROWS]
        c = zlib.crc32(page.tobytes())
        compression = (PLAIN, PACKBITS, LZW, DEFLATE)[c % 4]
        pages.append((page, compression, 2 if compression in (LZW, DEFLATE) and c >> 8 & 1 else 1, bool(c >> 9 & 1)))
    return write_pages(pages)


def feature(pages: list[Page]) -> str:
    pixels = np.concatenate([p.pixels.ravel() for p in pages])
    share = np.bincount(pixels, minlength=256) / len(pixels)
    bits = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    packed = "+".join(sorted({p.compression for p in pages}))
    return f"pages={len(pages)};width={pages[0].width};rows={sum(p.height for p in pages)};packed={packed};mean={float(pixels.mean()):.4f};spread={float(pixels.std()):.4f};bits={bits:.4f}"


def pages(media: DataFrame, raw: str = "media") -> DataFrame:
    """One row a page: the other columns of ``media``, then page, width, height, samples, bits, compression, predictor, tiled, pixels, error.

    Other columns that have a page column's name come as ``media_<name>``.
    """
    keep = [c for c in media.columns if c != raw]
    kinds = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]

    labels = [f"media_{c}" if c in dict(kinds) else c for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(raw).to_pylist()):
                if data is None:
                    continue
                rows = []
                try:
                    for p in read_pages(data):
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                except (ValueError, ArithmeticError, MemoryError, LookupError, TypeError, struct.error, zlib.error) as e:
                    rows.append((len(rows), *[None] * 8, f"{type(e).__name__}: {e}"))
                if not rows:
                    continue
                own = [pa.array([b.column(c)[i].as_py()] * len(rows), b.schema.field(c).type) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*labels, *(n for n, _ in kinds)])

    fields = {f.name: f.dataType.simpleString() for f in media.schema}
    out = ", ".join([f"`{n}` {fields[c]}" for c, n in zip(keep, labels, strict=True)] + ["page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"])
    return media.mapInArrow(run, out)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, media for every row of ``docs``: its text, padded, as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([store(padded((t or "").encode("utf-8", "surrogatepass"))) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b, rows = whole.slice(at, 1000), []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    stored = store(padded(raw))
                    found = list(read_pages(stored))
                    payload = b"".join(p.pixels.tobytes() for p in found)
                    rows.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
