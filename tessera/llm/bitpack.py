"""Token ids in files of fixed-width bit packing.

A file holds one segment and Spark's closing newline. The segment starts with a line of ``HEADER`` ASCII bytes::

    TSRBITS1 bits=16 block=4096 docs=000000000123 ids=000000456789 blocks=000000000112

padded with blanks, then, little-endian: a byte per document (1: it has an id), the doc_ids (int64), the end of each
document among the segment's ids (uint64), the byte offset of each block in the payload and the payload's length
(uint64), and the payload. A block holds ``block`` ids of ``bits`` bits each, lowest bits first, 64 ids in ``bits``
64-bit words; the last block is filled up with zeros. ``bits`` is the least that holds the vocabulary's largest id.
Files follow each other in ascending doc_id order, by part number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, staged_path
from .tokens import END_ID, tokenizer

HEADER = 128
MAGIC = "TSRBITS1"
#: Ids in a block, a multiple of 64, and ids in a file.
BLOCK_IDS = 4096
FILE_IDS = 8_000_000
#: The part and the file within it, from Spark's file name; folders and the job's uuid may hold the same letters.
_FILE = r"/part-(\d+)-[^/]*-c(\d+)[^/-]*$"


def width(vocab_size: int) -> int:
    """Bits that hold every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as rows of ``bits`` 64-bit words, 64 ids in each row; zeros fill the last row."""
    lanes = np.zeros((-(-len(ids) // 64), 64), "<u8")
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), "<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``pack``, with the zeros of the last row."""
    lanes = np.empty((len(words), 64), "<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        lanes[:, lane] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lanes[:, lane] |= words[:, word + 1] << np.uint64(64 - shift)
    return (lanes & np.uint64((1 << bits) - 1)).reshape(-1).astype("<u4")


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """The bytes of a file."""
    blocks = -(-len(ids) // block)
    lanes = np.zeros(blocks * block, "<u4")
    lanes[: len(ids)] = ids
    payload = pack(lanes, bits).tobytes()
    offsets = np.arange(blocks + 1, dtype="<u8") * (block // 8 * bits)
    head = f"{MAGIC} bits={bits} block={block} docs={len(doc_ids):012d} ids={len(ids):012d} blocks={blocks:012d}".ljust(HEADER).encode()
    known = np.array([d is not None for d in doc_ids], "u1")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, known.tobytes(), keys.tobytes(), np.cumsum(lengths, dtype="<u8").tobytes(), offsets.tobytes(), payload])


class Segment:
    """A file's bytes, opened for reading: its documents, and any range of its ids without unpacking the rest."""

    def __init__(self, content: bytes):
        numbers = {k: int(v) for k, v in re.findall(r"(\w+)=(\d+)", content[:HEADER].decode("ascii"))}
        if not content.startswith(MAGIC.encode()):
            raise ValueError("not a file of packed ids")
        self.bits, self.block, self.n_ids, n, blocks = (numbers[k] for k in ("bits", "block", "ids", "docs", "blocks"))
        at = HEADER
        known = np.frombuffer(content, "u1", n, at)
        keys = np.frombuffer(content, "<i8", n, at := at + n)
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
        self.ends = np.frombuffer(content, "<u8", n, at := at + 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at := at + 8 * n).astype(np.int64)
        self.payload = memoryview(content)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the segment, from the blocks that hold them."""
        first, last = start // self.block, -(-end // self.block)
        words = np.frombuffer(self.payload[self.offsets[first] : self.offsets[last]], "<u8").reshape(-1, self.bits)
        return unpack(words, self.bits)[start - first * self.block : end - first * self.block]


def _files(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, block: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    words = tokenizer(path)
    bits, end = width(words.vocab_size), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    keys: list[int | None] = []
    parts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        out = segment(keys, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4"), bits, block)
        return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["value"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            parts.append(words.encode(text.as_py()) + end)
            held += len(parts[-1]) // 4
            if held >= file_ids:
                yield flush()
                keys, parts, held = [], [], 0
    if keys:
        yield flush()


def write_packed(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Encodes every whole text (null: empty) and writes the ids below ``path`` in ascending doc_id order.

    Null doc_ids come first; documents of one doc_id follow each other by the hash of their text. An empty table makes
    an empty folder. A lost task writes its file again; Spark's committer keeps one copy.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    files = ordered.mapInArrow(lambda batches: _files(batches, tokenizer_path, end_id, block, file_ids), "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            held = Segment(content.as_py())
            starts = np.concatenate([[0], held.ends[:-1]]).astype(np.int64) if len(held.ends) else held.ends
            for low in range(0, len(starts), 2000):  # bounded batches
                a, b = starts[low : low + 2000], held.ends[low : low + 2000]
                ids, base = held.ids(int(a[0]), int(b[-1])), int(a[0])
                raw = [ids[x - base : y - base].tobytes() for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids[low : low + 2000], pa.int64()), pa.array(a, pa.int64()), pa.array(b - a, pa.int64()), pa.array(raw, pa.binary()), pa.array([path.as_py()] * len(a))], names=["doc_id", "start", "n_tokens", "ids", "path"])


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids as little-endian 32-bit bytes, read from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    head = F.substring("content", 1, HEADER).cast("string")
    number = lambda group: F.regexp_extract("path", _FILE, group).cast("long")
    counts = files.select(F.col("path").alias("_path"), F.regexp_extract(head, r"ids=(\d+)", 1).cast("long").alias("_ids"), number(1).alias("_part"), number(2).alias("_nth"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(counts.select("_path", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base")), "bitpack-base")
    docs = files.select("path", "content").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary, path string")
    return docs.join(base, F.col("path") == F.col("_path")).select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from files written below the shared folder.

    Null and empty texts have the end id alone. Rows go by doc_id, a null one first, and rows of one doc_id by a hash of their text,
    so that reruns agree; repeated rows are documents of their own. Texts of any length are read whole; extra columns are
    not looked at; an empty table gives an empty result. ``common.clean`` deletes the files.
    """
    spark = docs.sparkSession
    path = staged_path(spark, "packed-ids")
    write_packed(docs, path, tokenizer_path)
    return read_packed(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
