"""TIFF, top-k search, the ordinal classifiers and the pipeline."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import ordinal, quality, tiff, topk, toxicity

from . import samples as S


@pytest.mark.parametrize("source", ["edge", "table"])
def test_tiff_digest(spark, source):
    docs = S.edge_docs(spark) if source == "edge" else S.documents(spark)
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in tiff.digest(docs).collect())
    expect = []
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        expect.append((r.doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(expect)
    assert tiff.digest(S.empty_docs(spark)).count() == 0


def test_tiff_schemes_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 130, 2049):
        for kind in range(4):
            data = (rng.integers(0, 256 if kind else 3, n * 576) * (kind != 3)).astype(np.uint8).tobytes()
            assert tiff.lzw_decode(tiff.lzw_encode(data[:60_000]), min(60_000, len(data))) == data[:60_000]
            assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
            assert b"".join(p.pixels for p in tiff.pages(tiff.write(data))) == data


def test_tiff_big_endian_planes_of_16_bits():
    pixels = np.arange(2 * 3 * 5, dtype=np.uint16).reshape(3, 5, 2) * 999
    body = b"".join(np.diff(pixels[:, :, k], axis=1, prepend=np.uint16(0)).astype(">u2").tobytes() for k in range(2))
    half = len(body) // 2
    tags = [(256, 3, [5]), (257, 3, [3]), (258, 3, [16, 16]), (259, 3, [1]), (273, 4, [8, 8 + half]), (277, 3, [2]), (279, 4, [half, half]), (284, 3, [2]), (317, 3, [2])]
    extra, place, entries = b"", 8 + len(body), []
    for tag, kind, values in tags:
        data = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > 4:
            data, extra = struct.pack(">I", place + len(extra)), extra + data
        entries.append(struct.pack(">HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
    image = b"MM\0*" + struct.pack(">I", place + len(extra)) + body + extra + struct.pack(">H", len(entries)) + b"".join(entries) + b"\0" * 4
    (page,) = tiff.pages(image)
    assert (page.width, page.height, page.samples) == (5, 3, 2) and page.pixels == pixels.astype("<u2").tobytes()


def tiny_tiff(tags, body=b"\0" * 64):
    """A little-endian TIFF of one directory whose fields are (tag, kind, number of values, value or offset)."""
    entries = b"".join(struct.pack("<HHII", *t) for t in tags)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4


def _tiff(image, bits, letter, order="<", big=False, scheme=1, predictor=1, turned=False, rows=None, tile=None, planar=1):
    """A TIFF of one page from an array (height, width, samples), by the published layout, in plain Python."""
    import struct
    import zlib

    height, width, samples = image.shape
    code = {"u": 1, "i": 2, "f": 3}[letter]

    def coded(block):
        out = b""
        for line in block:
            if bits < 8:
                text = "".join(f"{int(v):0{bits}b}" for v in line.ravel())
                out += int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
            elif predictor == 3:
                parts = np.ascontiguousarray(line.ravel().astype(f">f{bits // 8}")).view(np.uint8).reshape(-1, bits // 8).T.reshape(-1, line.shape[1]).astype(int)
                out += np.diff(parts, axis=0, prepend=np.zeros((1, line.shape[1]), int)).astype(np.uint8).tobytes()
            else:
                values = line.astype(f"{order}{letter}{bits // 8}")
                if predictor == 2:
                    values = np.concatenate([values[:1], values[1:] - values[:-1]]).astype(values.dtype)
                out += values.tobytes()
        out = {1: lambda d: d, 5: tiff.lzw_encode, 8: zlib.compress, 32773: tiff.packbits_encode}[scheme](out)
        return bytes(int(f"{b:08b}"[::-1], 2) for b in out) if turned else out

    across, down = tile or (width, rows or height)
    planes = [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(samples)]
    blocks = []
    for plane in planes:
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = plane[y : y + down, x : x + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                blocks.append(coded(block))
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    out, offsets = bytearray(head), []
    for b in blocks:
        offsets.append(len(out))
        out += b
    wide = 16 if big else 4
    where = [(322, 3, [across]), (323, 3, [down]), (324, wide, offsets), (325, 4, [len(b) for b in blocks])] if tile else [(273, wide, offsets), (278, 3, [down]), (279, 4, [len(b) for b in blocks])]
    tags = sorted([(256, 3, [width]), (257, 3, [height]), (258, 3, [bits] * samples), (259, 3, [scheme]), (266, 3, [2 if turned else 1]), (277, 3, [samples]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [code] * samples), *where])
    entries, kinds = b"", {3: "H", 4: "I", 16: "Q"}
    room, offset = (8, "Q") if big else (4, "I")
    for tag, kind, values in tags:
        packed = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(packed) > room:
            place = len(out)
            out += packed
            packed = struct.pack(order + offset, place)
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + packed.ljust(room, b"\0")
    at = len(out)
    out[8:16] = struct.pack(order + "Q", at) if big else out[8:16]
    if not big:
        out[4:8] = struct.pack(order + "I", at)
    return bytes(out) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + offset, 0)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_of_every_kind_of_sample(order, big):
    rng = np.random.default_rng(6)
    for bits, letter in [(1, "u"), (2, "u"), (4, "u"), (8, "u"), (16, "u"), (32, "u"), (64, "u"), (8, "i"), (16, "i"), (32, "i"), (16, "f"), (32, "f"), (64, "f")]:
        for scheme in (1, 5, 8, 32773):
            for layout in ({"rows": 4}, {"tile": (16, 16)}, {"rows": 3, "planar": 2}):
                shape = (int(rng.integers(1, 20)), int(rng.integers(1, 40)), int(rng.choice([1, 3])))
                image = rng.normal(size=shape).astype(f"f{bits // 8}") if letter == "f" else rng.integers(0, 1 << min(bits, 62) - (letter == "i"), shape)
                for predictor in (1,) if bits < 8 else (1, 3) if letter == "f" else (1, 2):
                    turned = bool(rng.integers(2))
                    (page,) = tiff.pages(_tiff(image, bits, letter, order, big, scheme, predictor, turned, **layout))
                    kind = np.dtype(f"<{letter}{max(1, bits // 8)}")
                    assert (page.width, page.height, page.samples, page.bits, page.kind) == (shape[1], shape[0], shape[2], bits, kind.name)
                    assert page.pixels == image.astype(kind).tobytes(), (bits, letter, scheme, layout, predictor, turned)


def test_tiff_kinds_that_are_not_read():
    image = np.zeros((2, 3, 1))
    for bits, letter, predictor in ((16, "f", 2), (32, "u", 3), (1, "u", 2)):
        data = _tiff(image, bits, letter)
        at = data.index(bytes([0x3D, 1, 3, 0, 1, 0, 0, 0, 1]))  # the predictor's field
        with pytest.raises(ValueError):
            list(tiff.pages(data[: at + 8] + bytes([predictor]) + data[at + 9 :]))
    for cut in range(8, len(data) - 1, 7):
        with pytest.raises(tiff._BROKEN):
            for page in tiff.pages(data[:cut]):
                assert len(page.pixels) == 6
            raise ValueError("nothing was amiss")


def test_tiff_pages_of_broken_files(spark):
    good = tiff.write(b"a" * 576 * 1200)
    size, strip = [(256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 1, 8)], [(273, 4, 1, 8), (279, 4, 1, 64)]
    broken = {
        2: b"no tiff",
        4: tiny_tiff([(256, 4, 0, 8), *size[1:], *strip]),  # no width
        5: tiny_tiff([*size, (322, 4, 1, 0), (323, 4, 1, 16), (324, 4, 1, 8), (325, 4, 1, 64)]),  # tiles without width
        6: tiny_tiff([(256, 4, 1, 2_000_000_000), (257, 4, 1, 2_000_000_000), size[2], *strip]),  # forged size
        7: tiny_tiff([*size, (273, 4, 9, 8), (279, 4, 9, 8)]),  # more strips than rows
        8: good[: len(good) // 2],
        9: b"II*\0" + struct.pack("<I", 4_000_000_000),
        10: tiny_tiff([*size, (259, 3, 1, 5), *strip], b"\xff" * 64),  # bad LZW codes
    }
    rows = [(1, bytearray(good)), (3, None), *[(k, bytearray(v)) for k, v in broken.items()]]
    media = spark.createDataFrame(rows, "doc_id long, media binary")
    got = tiff.read_pages(media).collect()
    assert [(r.page, r.height, r.error) for r in got if r.doc_id == 1] == [(0, 512, None), (1, 512, None), (2, 176, None)]
    for k in broken:
        own = [r for r in got if r.doc_id == k]
        assert own[-1].error and all(r.error is None for r in own[:-1]) and own[-1].page == len(own) - 1, k
    assert not any(r.doc_id == 3 for r in got)
    named = media.selectExpr("named_struct('my id', doc_id) as `a key`", "media")
    assert {r["a key"]["my id"] for r in tiff.read_pages(named, "a key").collect()} == {1, *broken}


def test_tiff_takes_every_scheme_at_every_length():
    rng = np.random.default_rng(14)
    for n in (1, 40, 1500):
        seen = set()
        for k in range(80 if n < 1000 else 40):
            data = bytes([k]) * 576 + rng.integers(97, 103, (n - 1) * 576).astype(np.uint8).tobytes()
            scheme = tiff._scheme(data)
            if scheme not in seen:
                seen.add(scheme)
                found = list(tiff.pages(tiff.write(data)))
                assert b"".join(p.pixels for p in found) == data and {(p.compression, p.predictor, p.tiled) for p in found} == {scheme}
        assert {s for s, _, _ in seen} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE}


def brute_top(rows, k=10):
    fine = [(i, np.floor(1024 * np.array(v, np.float64)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in fine:
        if q % 100 == 0:
            scored = sorted(((-int(x @ y), i) for i, y in fine if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["table", "ties", "groups"])
def test_top_k(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    if kind == "table":
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    elif kind == "ties":
        rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(300)]
        rows += [(1000, None), (1001, [1.0, None, 1.0, 1.0]), (1100, [float("nan")] * 4), (1200, [float("inf"), 0.0, 0.0, 0.0]), (1300, [0.0] * 4), (None, [1.0] * 4)]
    else:
        monkeypatch.setattr(topk, "GROUP", 64)
        monkeypatch.setattr(topk, "SEEDS", 32)
        monkeypatch.setattr(topk, "QUERIES", 3)
        rows = [(i, (rng.normal(size=24) * rng.gamma(2) * 0.9 ** np.arange(24)).tolist()) for i in range(700)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect())
    assert got == brute_top(rows)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).count() == 0


def auc(score, truth):
    ranks = np.argsort(np.argsort(score)) + 1
    up = truth.sum()
    return (ranks[truth].sum() - up * (up + 1) / 2) / (up * (~truth).sum())


@pytest.mark.parametrize("module,grade,column,least", [(quality, "quality", "p_good", 0.9), (toxicity, "toxic", "p_toxic", 0.85)])
def test_held_out_accuracy(spark, module, grade, column, least):
    docs, labels = S.documents(spark, "sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = module.rated(docs, train).select("doc_id", column).join(held, "doc_id").select(column, grade).toPandas().dropna()
    assert auc(got[column].to_numpy(), got[grade].to_numpy() > 0) > least


def test_thresholds_are_ordered_and_learn_three_grades():
    rng = np.random.default_rng(8)
    x = rng.normal(size=4000)
    grade = np.digitize(2 * x + rng.logistic(size=4000) * 0.5, [-1.0, 1.5])
    weights, thresholds = ordinal.fit(np.arange(4000), np.zeros(4000, np.int64), x, grade, 1, 3)
    assert thresholds[0] < thresholds[1] and weights[0] > 2
    assert thresholds[1] - thresholds[0] == pytest.approx(2.5 * weights[0] / 2, rel=0.15)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_ratings_and_on_edges(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = S.edge_docs(spark)
    rated = module.rated(docs, none)
    assert rated.count() == docs.count() and rated.where("kept" if module is quality else "not toxic").count() == docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (7, 0, 1), (8, 0, 1), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert module.rated(docs, labels).count() == docs.count() and module.rated(S.empty_docs(spark), labels).count() == 0
    if module is quality:
        assert quality.select(docs, labels).columns == docs.columns


def graded_docs(spark):
    """Texts whose marked words, capitals and repeated words go with grades 0 to 2, and unrated, empty and null ones."""
    rng, rows, labels = np.random.default_rng(12), [], []
    for i in range(240):
        grade = int(rng.integers(0, 3))
        w = [f"w{x}" for x in rng.integers(0, 60, 20)]
        w += [f"Mark{grade}!"] * int(rng.random() < 0.8) + ["so", "so"] * int(grade == 0) + ["w1"] * int(rng.integers(0, 2))
        rows.append((i, " ".join(w if i % 2 else w[::-1])))
        if i % 4:
            labels.append((i, grade, 2 - grade))
    rows += [(500, None), (501, ""), (502, "so"), (503, "so"), (504, "so so"), (None, "Mark2! w1")]
    labels += [(500, 1, 1), (None, 0, 0), (7, None, None), (999, 2, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,grade", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_three_grades_equal_a_plain_version(spark, module, grade):
    docs, labels = graded_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    grades = {r.doc_id: r[grade] for r in labels.collect() if r[grade] is not None and r.doc_id is not None}
    tails = S.plain_tails(rows, grades, module.KINDS, module is toxicity)
    assert tails.shape[1] == 2 and tails.std() > 0.1
    for parts in (1, 5):
        key = lambda x: (x[0] is None, x[0] or 0)
        got = sorted((tuple(r) for r in module.rated(docs.repartition(parts), labels).collect()), key=key)
        expect = sorted(((i, t.sum(), t[0], t[0] >= module.LEAST_TAIL) for (i, _), t in zip(rows, tails)), key=key)
        for mine, plain in zip(got, expect, strict=True):
            assert mine[0] == plain[0] and mine[1:3] == pytest.approx(plain[1:3], abs=1e-6) and mine[3] == plain[3]


def check_stage(name, before, after, sf_dir, spark):
    """The rows of a stage against a plain version on the stage's own input."""
    texts = [(r.doc_id, r.text) for r in before]
    if name == "quality classifier":
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null and doc_id is not null").collect()
        tails = S.plain_tails(texts, {r.doc_id: r.quality for r in labels}, quality.KINDS, False)
        assert Counter(after) == Counter(r for r, t in zip(before, tails) if t[0] >= 0.5)
    elif name == "MinHash near-dedup":
        expect = S.brute_components(texts, 5)
        assert Counter(after) == Counter(r for r in before if expect[r.doc_id][1] == r.doc_id)
    elif name == "substring dedup":
        assert sorted((i, w) for i, _, w in S.brute_removed(texts)) == sorted((r.doc_id, S.words(r.text)) for r in after)
    elif name == "mixing":
        size = {r: len(S.words(r.text)) for r in before}
        totals, served = Counter(), Counter()
        for r in before:
            totals[r.source] += size[r]
        for r in after:
            served[r.source] += size[r]
        assert max(Counter(after).values()) <= 3
        assert all(abs(served[s] - t) <= max(size.values()) for s, t in S.brute_targets(totals).items())
    else:
        library, wanted, found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), Counter()
        for r in before:
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            for at in range(len(ids)):
                wanted[r.doc_id, at] += 1
        for r in after:
            for at in range(r.start, r.start + r.length):
                found[r.doc_id, at] += 1
        assert found == wanted
        held = Counter()
        for r in after:
            held[r.sequence_id] += r.length
        assert max(held.values()) <= 2048


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf_dir = "/root/testdata/sf0.001"
    docs = S.documents(spark)
    for k, (name, step) in enumerate(P.STAGES):
        before = docs.collect()
        out = step(spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns, name
        if k < 4:
            out = docs = P.stage(out, "test")
        after = out.collect()
        assert after
        check_stage(name, before, after, sf_dir, spark)
    assert P.run(spark, sf_dir).count() == len(after)
