"""TIFF columns: reading every page of binary TIFF images, and writing bytes as grey images.

The reader walks the chain of image directories of either byte order, with offsets of 32 or 64 bits, decodes strips or
tiles that are stored plain or by PackBits, LZW or deflate, in either order of bits, undoes differencing of whole numbers
and of floating-point bytes, and gives one row per page. Samples are whole numbers of 1, 2, 4, 8, 16, 32 or 64 bits, with
or without a sign from 8 on, or floating-point numbers of 16, 32 or 64 bits. The writer stores bytes as 8-bit grey pages,
with a compression and layout that depend on the bytes alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stage
from .words import portions

#: Fixed values of the format: tags, field sizes and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END, LZW_FIRST = 256, 257, 258

#: Pixels in a row of the pages that are written, and rows in a page.
ROW = 576
PAGE_ROWS = 512
#: Bytes of an image that its directory may claim for each byte of the file, and in any case: more is taken for forged.
MOST_GROWTH, LEAST_ROOM = 4096, 1 << 20
#: Bytes of pixels that a task holds before it passes them on.
FLUSH = 4 << 20


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes as a count and the byte, all else as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    out, literal = [], 0
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if end - begin < 3:
            continue
        for at in range(literal, begin, 128):
            part = data[at : min(begin, at + 128)]
            out.append(bytes([len(part) - 1]) + part)
        at = begin
        while end - at >= 3:
            n = min(128, end - at)
            out.append(bytes([257 - n, data[at]]))
            at += n
        literal = at
    for at in range(literal, len(data), 128):
        part = data[at : at + 128]
        out.append(bytes([len(part) - 1]) + part)
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, done = [], 0, 0
    while at < len(data) and done < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        done += len(part)
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bits first, widened one code early; the table starts anew when it is full."""
    table = {bytes([k]): k for k in range(256)}
    codes, widths = [LZW_CLEAR], [9]
    width, following, held = 9, LZW_FIRST, b""
    for k in range(len(data)):
        longer = held + data[k : k + 1]
        if longer in table:
            held = longer
            continue
        codes.append(table[held])
        widths.append(width)
        table[longer] = following
        following += 1
        if following == 4095:
            codes.append(LZW_CLEAR)
            widths.append(width)
            table = {bytes([k]): k for k in range(256)}
            width, following = 9, LZW_FIRST
        elif following in (512, 1024, 2048):
            width += 1
        held = data[k : k + 1]
    if held:
        codes.append(table[held])
        widths.append(width)
        if following + 1 in (512, 1024, 2048):
            width += 1
    codes.append(LZW_END)
    widths.append(width)
    return _bits(codes, widths)


def _bits(codes: list[int], widths: list[int]) -> bytes:
    values, sizes = np.array(codes, np.uint32), np.array(widths)
    bits = (values[:, None] >> np.arange(11, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - sizes[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out: list[bytes] = []
    done = held = bits = 0
    width, last = 9, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            del table[LZW_FIRST:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} is unknown")
        out.append(entry)
        done += len(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        last = entry
        if done >= size:
            break
    return b"".join(out)[:size]


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    """One strip or tile of ``size`` bytes; what is missing at its end is zero."""
    if scheme == PLAIN:
        out = data[:size]
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size) if size else b""
    else:
        raise ValueError(f"compression {scheme} is not supported")
    return out.ljust(size, b"\0")


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    #: The type of a sample as it comes out, such as uint8 or float32.
    kind: str
    pixels: bytes


#: The bytes with their bits in reversed order.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple[int, ...]], int]:
    """The fields of a directory and where the next one is; offsets and counts have 64 bits if ``big``."""
    count_kind, entry_kind, offset_kind = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
    head, step, room = struct.calcsize("<" + count_kind), struct.calcsize("<" + entry_kind + offset_kind), struct.calcsize("<" + offset_kind)
    count = struct.unpack_from(order + count_kind, data, at)[0]
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(count):
        entry = at + head + step * k
        tag, kind, n = struct.unpack_from(order + entry_kind, data, entry)
        value = entry + step - room
        if kind in FIELDS:
            size = struct.calcsize(FIELDS[kind]) * n
            place = value if size <= room else struct.unpack_from(order + offset_kind, data, value)[0]
            if place + size > len(data):
                raise ValueError(f"field {tag} lies beyond the file's end")
            tags[tag] = struct.unpack_from(f"{order}{n}{FIELDS[kind]}", data, place)
    return tags, struct.unpack_from(order + offset_kind, data, at + head + step * count)[0]


def pages(data: bytes) -> Iterator[Page]:
    """Each page of a TIFF. Samples of fewer than 8 bits come out as a byte each, others in little-endian order."""
    if data[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        raise ValueError("not a TIFF")
    order, big = "<" if data[:1] == b"I" else ">", b"+" in data[:4]
    if big and struct.unpack_from(order + "HH", data, 4) != (8, 0):
        raise ValueError("offsets of a size that is not known")
    at, seen = struct.unpack_from(order + "Q", data, 8)[0] if big else struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        tags, at = _directory(data, at, order, big)
        yield _page(data, tags, order)


#: SampleFormat to the letter of a type: unsigned, signed, floating-point, and undefined, which is taken as unsigned.
_KINDS = {1: "u", 2: "i", 3: "f", 4: "u"}


def _undone(block: np.ndarray, kind: np.dtype, predictor: int) -> np.ndarray:
    """Rows of samples (rows, across, each) from rows of bytes, with differences added up."""
    rows, across, each = block.shape[0], *block.shape[1:3]
    if predictor == 3:  # differences of bytes, of which the highest of all a row's samples come first
        flat = np.cumsum(block.reshape(rows, -1, each), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, across * each)
        return np.ascontiguousarray(np.moveaxis(flat, 1, 2)).view(kind.newbyteorder(">")).reshape(rows, across, each)
    values = block.reshape(rows, -1).view(kind).reshape(rows, across, each)
    return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else values


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, scheme, predictor = tags[WIDTH][0], tags[LENGTH][0], one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    samples, planar, depth, form = one(SAMPLES, 1), one(PLANAR, 1), set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    if len(depth) != 1 or len(form) != 1:
        raise ValueError("samples of different kinds are not supported")
    bits, letter = depth.pop(), _KINDS.get(form.pop())
    allowed = {"u": (1, 2, 4, 8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64)}.get(letter, ())
    if bits not in allowed or predictor not in ((1,) if bits < 8 else (1, 3) if letter == "f" else (1, 2)):
        raise ValueError(f"samples of {bits} bits with predictor {predictor} are not supported")
    kind = np.dtype(f"{order}{letter}{max(1, bits // 8)}")
    turned = one(FILL_ORDER, 1) == 2
    if width * height * samples * kind.itemsize > LEAST_ROOM + MOST_GROWTH * len(data):
        raise ValueError(f"{width} x {height} pixels do not come from {len(data)} bytes")
    tiled = TILE_OFFSETS in tags
    across, down = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(height, one(STRIP_ROWS, height)) or 1)
    offsets, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES]
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if not across or not down or across * down * each * kind.itemsize > LEAST_ROOM + MOST_GROWTH * len(data):
        raise ValueError(f"blocks of {across} x {down} pixels")
    per_row, per_column = -(-width // across), -(-height // down)
    if len(offsets) > planes * per_row * per_column or len(offsets) != len(sizes):
        raise ValueError(f"{len(offsets)} offsets and {len(sizes)} sizes for {planes * per_row * per_column} blocks")
    image = np.zeros((planes, height, width, each), kind.newbyteorder("<"))
    for k, (place, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(k, per_row * per_column)
        y, x = k // per_row * down, k % per_row * across
        rows = down if tiled else min(down, height - y)
        stored = data[place : place + size]
        line = -(-across * each * bits // 8)
        raw = np.frombuffer(decompress(stored.translate(_REVERSED) if turned else stored, scheme, rows * line), np.uint8).reshape(rows, line)
        if bits < 8:  # rows begin at whole bytes, the highest bits of which come first
            parts = np.unpackbits(raw, axis=1)[:, : across * each * bits].reshape(rows, across, each, bits)
            block = (parts << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        else:
            block = _undone(raw.reshape(rows, across, each, kind.itemsize), kind, predictor)
        high, wide = min(rows, height - y), min(across, width - x)
        image[plane, y : y + high, x : x + wide] = block[:high, :wide]
    return Page(width, height, bits, samples, scheme, predictor, tiled, kind.name, np.moveaxis(image, 0, 2).tobytes())


def _scheme(payload: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and whether in tiles, by a checksum of the payload: of 16 parts LZW and PackBits have two each.

    The shares are chosen for cost, as encoders and decoders of these two are Python loops.
    """
    turn = zlib.crc32(payload) % 16
    if turn < 4:
        return (LZW, PACKBITS)[turn % 2], 1 + turn // 2, turn == 3
    return DEFLATE, 1 + turn % 2, turn % 4 >= 2


def write(payload: bytes, row: int = ROW, page_rows: int = PAGE_ROWS) -> bytes:
    """The payload, a multiple of ``row`` bytes, as grey pages of ``row`` pixels across and up to ``page_rows`` rows."""
    scheme, predictor, tiled = _scheme(payload)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        across, down = (192, 64) if tiled else (row, min(128, len(page)))
        offsets, sizes = [], []
        for y in range(0, len(page), down):
            for x in range(0, row, across):
                block = page[y : y + down, x : x + across]
                if tiled and len(block) < down:
                    block = np.pad(block, ((0, down - len(block)), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                raw = block.tobytes()
                stored = zlib.compress(raw, 6) if scheme == DEFLATE else lzw_encode(raw) if scheme == LZW else packbits_encode(raw)
                offsets.append(len(out))
                sizes.append(len(stored))
                out += stored + b"\0" * (len(stored) % 2)
        where = [(TILE_WIDTH, 4, [across]), (TILE_LENGTH, 4, [down]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (STRIP_ROWS, 4, [down]), (STRIP_BYTES, 4, sizes)]
        tags = sorted([(WIDTH, 4, [row]), (LENGTH, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), *where])
        entries = []
        for tag, kind, values in tags:
            packed = struct.pack(f"<{len(values)}{FIELDS[kind]}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed
                packed = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + 12 * len(entries)
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    return bytes(out)


def payload_of(text: bytes, row: int = ROW) -> bytes:
    """Bytes filled up with 255 to a positive multiple of a row."""
    return text.ljust(max(1, -(-len(text) // row)) * row, b"\xff")


def feature(n_pages: int, height: int, counts: np.ndarray) -> str:
    """Size, brightness and entropy of all pages' samples, as text, from the number of samples of each value."""
    n = max(1, int(counts.sum()))
    share = counts[counts > 0] / n
    mean, spread = float((counts * np.arange(256)).sum() / n), float(-(share * np.log2(share)).sum())
    return f"pages={n_pages};height={height};mean={mean:.3f};entropy={spread:.3f};values={len(share)}"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, count in portions(batch.column(1), FLUSH):
            part = batch.slice(low, count)
            texts = [t.as_py() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a TIFF that holds the whole text (null: empty) as UTF-8, filled up to whole rows.

    Texts of any length become as many pages as they need. Null ids and repeated rows are stored as they are; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_PAGE = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "bits": pa.int32(), "samples": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "kind": pa.string(), "pixels": pa.binary(), "error": pa.string()}
_PAGE_DDL = "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, kind string, pixels binary, error string"
#: What a broken file can raise on its way through the reader.
_BROKEN = (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at: list[int] = []
        rows: list[tuple] = []
        held = 0

        def flush(keys=batch.column(0), at=at, rows=rows) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAGE.values(), strict=True)]
            out = pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], names=["key", *_PAGE])
            at.clear()
            rows.clear()
            return out

        for k in range(batch.num_rows):
            if not (media := batch.column(1)[k]).is_valid:
                continue
            nth = 0
            try:
                for p in pages(media.as_py()):
                    at.append(k)
                    rows.append((nth, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.tiled, p.kind, p.pixels, None))
                    held += len(p.pixels)
                    nth += 1
                    if held >= FLUSH:
                        yield flush()
                        held = 0
            except _BROKEN as bad:
                at.append(k)
                rows.append((nth, *[None] * 9, f"{type(bad).__name__}: {bad}"))
        if rows:
            yield flush()


def read_pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per page of each TIFF in ``column``: ``key`` (of any type), page and its pixels; a file's pages follow each other.

    Null gives no row. A file that is broken or of an unsupported kind, or claims more pixels than it can hold, gives its
    good pages and a last row whose ``error`` says what is wrong. Repeated rows are read as often; an empty table gives
    an empty result.
    """
    picked = media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("media"))
    fields = StructType([picked.schema["key"], *StructType.fromDDL(_PAGE_DDL)])
    return picked.mapInArrow(_read, fields).withColumnRenamed("key", key)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file from its pages, which follow each other; page 0 begins a file."""
    names = ["key", "payload_bytes", "payload_sha256", "tail", "feature"]
    key, size, digest, tail, n_pages, height, counts = None, 0, hashlib.sha256(), b"", 0, 0, np.zeros(256, np.int64)
    keys: list[pa.Array] = []
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    for batch in batches:
        for k, (page, high, pixels, error) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)):
            if error is not None:
                raise ValueError(f"a stored image cannot be read: {error}")
            if page == 0:
                if key is not None:
                    keys.append(key)
                    rows.append((size, digest.hexdigest(), tail, feature(n_pages, height, counts)))
                key, size, digest, tail, n_pages, height, counts = batch.column(0).slice(k, 1), 0, hashlib.sha256(), b"", 0, 0, np.zeros(256, np.int64)
            size, n_pages, height = size + len(pixels), n_pages + 1, height + high
            digest.update(pixels)
            tail = (tail + pixels[-32:])[-32:]
            counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        if len(rows) >= 1000:
            yield flush()
            keys.clear()
            rows.clear()
    if key is not None:
        keys.append(key)
        rows.append((size, digest.hexdigest(), tail, feature(n_pages, height, counts)))
        yield flush()


def digest(docs: DataFrame) -> DataFrame:
    """The stored form of every document, read back page by page: sizes, checksums and features.

    A null text is empty (one row of filling), a null id stays null, texts of any length are stored whole, repeated rows
    give a row each, and an empty table an empty result.
    """
    media = stage(store(docs), "media")
    file = F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    found = read_pages(media.select(file.alias("key"), "media"), "key").select("key", "page", "height", "pixels", "error")
    fields = StructType([found.schema["key"], *StructType.fromDDL("payload_bytes long, payload_sha256 string, tail binary, feature string")])
    whole = found.mapInArrow(_fold, fields)
    return whole.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").alias("tail_crc32"), "key.media_bytes", "key.media_sha256", "feature")
