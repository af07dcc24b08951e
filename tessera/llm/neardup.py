"""Near-duplicates by MinHash bands, odd sketches and exact confirmation on full shingle sets.

Documents with equal sets are one class, and only its smallest doc_id goes on. Each class has ``BANDS`` keys of
``ROWS`` MinHash samples: two sets of similarity 0.8 share none with a probability of (1 - 0.8**6)**56 = 4e-8. The
samples are also folded into an odd sketch, a bitmap of parities; the number of bits in which two sketches differ
tells how many samples differ. Every candidate goes through the sketches, and only texts of candidates that pass are
sent on. The first pass tries one pair for each document, with the smallest document of the bucket that it shares most
bands with, which joins large groups of near copies at once. In the second, the sketches of a bucket's documents that
are still in different components meet; documents that some sketch of another component resembles get
their texts and are compared exactly, and a pair is left out only when links already found join its two documents. So
no bucket is ever written out as its pairs, and none is capped; a large one is dealt out as pairs of blocks.

Shingles are compared as 64-bit hashes whose key comes from a digest of all texts, whole sets by two sums of these. In
the end the words themselves decide: each link is confirmed on both texts' shingles as bytes when it is found, and each
member of a class against the one that stands for it, unless a checksum of their words shows them equal already. Should
a class fail, which takes shingles of one hash, all is done again with other keys.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import corpus_seeds, drop_staged, stage
from .components import components
from .words import exact_shingles, lowered, mix, portions, shingle_sets

ROWS, BANDS = 6, 56
SKETCH_BITS = 1024
#: Six standard deviations of the samples beyond what a similarity of 0.8 differs by on average; see ``differing_bits``.
DEVIATIONS = 6.0
#: Members of a bucket, and shingles of their sets, that one block of it holds.
BLOCK, BLOCK_SHINGLES = 2048, 1_500_000
#: Most ids that go to every task to pick texts; beyond, texts are shuffled.
MOST_SENT = 200_000

_U = np.uint64
_COUNT = ROWS * BANDS
_A = (mix(np.arange(1, _COUNT + 1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, _COUNT + 1, dtype=np.uint64) + _U(1 << 40)) >> _U(32)).astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set of 64-bit hashes, as 32-bit integers."""
    x = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(_COUNT, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 1024):
        values = _A[:, None] * x[None, low : low + 1024]
        values += _B[:, None]
        values ^= values >> np.uint32(15)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = mix(total) + samples[k::ROWS]
    return mix(total)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parities of the places that the numbered samples fall on."""
    place = mix(samples.astype(np.uint64) + (np.arange(_COUNT, dtype=np.uint64) << _U(32))) % _U(SKETCH_BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def differing_bits(similarity: float) -> float:
    """Most bits in which the sketches of two sets of at least this similarity differ, short of rare accidents."""
    samples = 2 * (_COUNT * (1 - similarity) + DEVIATIONS * np.sqrt(_COUNT * similarity * (1 - similarity)))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** samples)
    return float(expected + DEVIATIONS / 2 * np.sqrt(expected / 2))


def sketch_similarity(bits: int) -> float:
    """The similarity at which two sketches are expected to differ in so many bits."""
    samples = np.log(max(1e-12, 1 - 2 * bits / SKETCH_BITS)) / np.log(1 - 2 / SKETCH_BITS)
    return float(max(0.0, 1 - samples / 2 / _COUNT))


def _signatures(batches: Iterator[pa.RecordBatch], n: int, seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, count in portions(batch.column(1)):
            part = batch.slice(low, count)
            sizes, one, two, bands, sketches = [], [], [], [], []
            told = [hashlib.sha256(b" ".join(lowered(t.as_py() or b""))).digest() for t in part.column(1)]
            for shingles in shingle_sets(part.column(1), n, seed, bits):
                sizes.append(len(shingles))
                one.append(int(shingles.sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0)
                two.append(int(mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0)
                samples = minhash(shingles) if len(shingles) else None
                bands.append(None if samples is None else band_keys(samples).view(np.int64))
                sketches.append(None if samples is None else odd_sketch(samples))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(told, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch", "told"])


def _reach(x: set[bytes], y: set[bytes], percent: int) -> bool:
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _similar(batches: Iterator[pa.RecordBatch], n: int, seed: int, bits: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose sets reach the similarity: by hashes, and those that do by the shingles themselves."""
    for batch in batches:
        for low, count in portions(batch.column("a")):
            part = batch.slice(low, count)
            a, b, keep = part.column("a"), part.column("b"), []
            for k, (x, y) in enumerate(zip(shingle_sets(a, n, seed, bits), shingle_sets(b, n, seed, bits), strict=True)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                alike = 100 * shared >= percent * (len(x) + len(y) - shared)
                keep.append(alike and _reach(exact_shingles(a[k].as_py(), n), exact_shingles(b[k].as_py(), n), percent))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Whether the shingles themselves of texts x and y reach the similarity; 100 per cent asks for equal sets."""
    for batch in batches:
        held = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            held.append(_reach(exact_shingles(x.as_py() or b"", n), exact_shingles(y.as_py() or b"", n), percent))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(held, pa.bool_())], names=["u", "v", "ok"])


def _all_confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> bool:
    """Whether each pair (u, v) of doc_ids is as similar as ``percent``; of a doc_id's rows, some one is enough."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    count = ids.count()
    if not count:
        return True
    held = texts.join(F.broadcast(ids) if count <= MOST_SENT else ids, "doc_id", "left_semi")
    side = lambda c, t: held.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    met = pairs.distinct().join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y")
    found = met.mapInArrow(lambda b: _confirmed(b, n, percent), "u long, v long, ok boolean")
    return found.groupBy("u", "v").agg(F.max("ok").alias("ok")).where("not ok").isEmpty()


def _sketches_alike(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in so few bits that the similarity may be reached."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in ("x", "y"))
            yield batch.select(["u", "v"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit))


def _candidates(bits: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray, limit: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each document those after it, on the other side if there are two, of another component whose sketch and size may reach the similarity.

    ``label`` is read anew for each document, so that links found meanwhile count.
    """
    between = bool(side.any())
    for i in range(len(label) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if between:
            rest = rest[side[rest] != side[i]]
        rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])]
        rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64) <= limit]
        if len(rest):
            yield i, rest


def _ordered(table: pa.Table) -> tuple[np.ndarray, ...]:
    """An order of a block's documents with small components first; and in it side, doc, number of the component, and sketch."""
    side, doc, comp = (table.column(k).to_numpy() for k in ("side", "doc", "comp"))
    _, label = np.unique(comp, return_inverse=True)
    order = np.lexsort((doc, label, np.bincount(label)[label]))
    sketches = table.column("sketch").to_pylist()
    return order, side[order], doc[order], label[order], np.frombuffer(b"".join(sketches[k] for k in order), np.uint64).reshape(len(doc), -1)


def _alike(table: pa.Table, limit: float, percent: int) -> pa.Table:
    """Documents of one block, or of the two blocks, of a bucket that the sketch of one of another component resembles."""
    order, side, doc, label, bits = _ordered(table)
    hit = np.zeros(len(doc), bool)
    for i, rest in _candidates(bits, table.column("size").to_numpy()[order], label, side, limit, percent):
        hit[i] = hit[rest] = True
    return table.select(["band", "_i", "_j", "side", "doc", "comp", "sketch"]).take(pa.array(order[hit]))


def _links(table: pa.Table, limit: float, n: int, seed: int, bits_kept: int, percent: int) -> pa.Table:
    """Within one block, or between the two blocks, of a bucket: links that join components which nothing joined before."""
    order, side, doc, label, bits = _ordered(table)
    texts = table.column("text").take(pa.array(order)).combine_chunks()
    held = [x for low, count in portions(texts) for x in shingle_sets(texts.slice(low, count), n, seed, bits_kept)]
    sizes = np.array([len(x) for x in held])
    universe, where = np.unique(np.concatenate(held), return_inverse=True)
    where = np.split(where.astype(np.int32), np.cumsum(sizes)[:-1])
    mark = np.zeros(len(universe), bool)
    found, exact = [], functools.lru_cache(maxsize=64)(lambda k: exact_shingles(texts[k].as_py(), n))
    for i, rest in _candidates(bits, sizes, label, side, limit, percent):
        mark[where[i]] = True
        for low in range(0, len(rest), 512):
            some = rest[low : low + 512]
            shared = np.add.reduceat(mark[np.concatenate([where[j] for j in some])], np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
            for j in some[100 * shared >= percent * (sizes[some] + sizes[i] - shared)].tolist():
                if label[j] != label[i] and _reach(exact(i), exact(j), percent):
                    found.append((max(doc[i], doc[j]), min(doc[i], doc[j])))
                    label[label == label[j]] = label[i]
        mark[where[i]] = False
    return pa.table({"u": pa.array([int(u) for u, _ in found], pa.int64()), "v": pa.array([int(v) for _, v in found], pa.int64())})


def signatures(docs: DataFrame, shingle: int, seed: int = 0, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, two sums over the set (s1, s2), band keys, odd sketch and a checksum of the words of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(lambda b: _signatures(b, shingle, seed, bits), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary, told binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents whose sets of ``shingle``-word shingles have 100 * intersection >= ``percent`` * union are linked. Words
    are parted by ASCII blanks and A-Z is lower-cased; fewer words than a shingle are one shingle. A text that is null
    or has no words is linked with nothing. Rows of one doc_id are one document, and have one component. A null doc_id
    takes no part: its row has the component null and is kept. Texts of any length are read whole; extra columns are not
    looked at. An empty table gives an empty result. ``bits`` of the shingles' hashes are used at first; where the words
    do not confirm what the hashes said, twice as many, and other keys.
    """
    seeds, _ = corpus_seeds(docs, 16)
    for seed in seeds:
        found = _by_hashes(docs, shingle, percent, seed, bits)
        if found is not None:
            return found
        bits = min(64, 2 * bits)
    raise ArithmeticError("hashes of different shingles met with every key")


def _by_hashes(docs: DataFrame, shingle: int, percent: int, seed: int, bits: int) -> DataFrame | None:
    """The result with one key of the hashes, or nothing if the words do not confirm it."""
    sig = stage(signatures(docs, shingle, seed, bits), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "told")).alias("r")).select("s1", "s2", F.col("r.doc_id").alias("rep"), F.col("r.told").alias("rep_told"))
    classes = stage(classes, "classes")
    chosen = classes.select(F.col("rep").alias("doc_id"), "s1", "s2")
    reps = sig.join(chosen, ["doc_id", "s1", "s2"], "left_semi")
    banded = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("doc").alias("pivot"), F.max("doc").alias("_last")).where("pivot <> _last").drop("_last")
    members = stage(banded.join(pivots, "band"), "members")

    limit = differing_bits(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sketches = sig.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "s1", "s2", "sketch").join(classes.select(F.col("rep").alias("doc"), "s1", "s2"), ["doc", "s1", "s2"], "left_semi").dropDuplicates(["doc"])

    held = texts.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stage(held.select(F.col("doc_id").alias("doc"), "text"), "texts")

    shared = members.where("doc <> pivot").groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("n"))
    tried = shared.groupBy(F.col("doc").alias("u")).agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("v"))
    tried = tried.join(sketches.select(F.col("doc").alias("u"), F.col("sketch").alias("x")), "u").join(sketches.select(F.col("doc").alias("v"), F.col("sketch").alias("y")), "v")
    tried = stage(tried.select("u", "v", "x", "y").mapInArrow(lambda b: _sketches_alike(b, limit), "u long, v long"), "pairs")
    paired = tried.join(sets.select(F.col("doc").alias("u"), F.col("text").alias("a")), "u").join(sets.select(F.col("doc").alias("v"), F.col("text").alias("b")), "v")
    links = stage(paired.select("u", "v", "a", "b").mapInArrow(lambda x: _similar(x, shingle, seed, bits, percent), "u long, v long"), "links")
    found = stage(components(links), "components")
    drop_staged(tried)

    # buckets that hold several components; of those with the same members one is enough
    at = members.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").join(sketches.select("doc", "size"), "doc").select("band", "doc", "size", F.coalesce("component", "doc").alias("comp"))
    at = stage(at, "placed")
    own = (F.xxhash64("doc").cast("decimal(20,0)"), F.xxhash64("doc", F.lit(1)).cast("decimal(20,0)"))
    several = at.groupBy("band").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"), F.sum(own[0]).alias("_s"), F.sum(own[1]).alias("_t")).where("_a <> _b")
    several = several.groupBy("_n", "_s", "_t").agg(F.min("band").alias("band"), F.max("_size").alias("_size"))
    blocks = F.ceil(F.greatest(F.col("_n") / BLOCK, F.col("_size") / BLOCK_SHINGLES)).cast("int")
    left = at.join(several.select("band", blocks.alias("_blocks")), "band").join(sketches.select("doc", "sketch"), "doc")
    left = left.withColumn("_own", F.pmod(F.xxhash64("doc"), F.col("_blocks")).cast("int"))
    left = left.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    left = left.select("band", "doc", "comp", "size", "sketch", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.when(F.col("_own") > F.col("_other"), 1).otherwise(0).alias("side"))
    alike = left.groupBy("band", "_i", "_j").applyInArrow(lambda t: _alike(t, limit, percent), "band long, _i int, _j int, side int, doc long, comp long, sketch binary")
    alike = stage(alike, "alike")
    more = alike.join(sets, "doc").groupBy("band", "_i", "_j").applyInArrow(lambda t: _links(t, limit, shingle, seed, bits, percent), "u long, v long")
    more = stage(more.distinct(), "more-links")
    member = sig.select("doc_id", "n_shingles", "s1", "s2", "told").join(classes, ["s1", "s2"], "left")
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    member = member.withColumn("rep", F.when(known, F.col("rep")).otherwise(F.col("doc_id")))
    apart = stage(member.where(known & (F.col("told") != F.col("rep_told"))).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "apart")
    if not _all_confirmed(apart, texts, shingle, 100):
        drop_staged(sig, classes, members, sets, links, found, at, alike, more, apart)
        return None
    # rows of one doc_id that are in several classes link these
    several = member.where(known).groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("_last")).where("v <> _last").select("doc_id", "v")
    own = stage(member.where(known).join(several, "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v").distinct(), "own-links")
    if not (more.isEmpty() and own.isEmpty()):
        before = found
        found = stage(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(own)), "components")
        drop_staged(before)
    drop_staged(members, sets, links, at, alike, more, apart, own)
    joined = member.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that repeat another one of their group; all columns stay."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(stage(gone, "dropped"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
