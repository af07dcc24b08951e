"""Mixing, token files, packing, near-duplicates, passages and notices against plain Python."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bitpack, licenses, mixing, neardup, packing, substring
from tessera.llm.tokens import WordTokenizer, tokenizer

from . import samples as S

WORDS_49K, BYTES_50K = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_ids(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("source", ["edge", "table"])
def test_mixing(spark, source):
    docs = S.edge_docs(spark) if source == "edge" else S.documents(spark)
    got = mixing.words_taken(docs).collect()
    again = mixing.words_taken(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(S.words(t))) for i, t in pairs(docs))
    totals = Counter()
    of = {(r.doc_id, len(S.words(r.text))): r.source for r in docs.collect()}
    for (i, n), s in of.items():
        totals[s] += n * sum(1 for r in got if (r.doc_id, r.size) == (i, n))
    order = sorted([s for s in totals if s is not None]) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, live, left = {}, {s for s in order if totals[s]}, float(sum(totals.values()))
    target = {s: 0.0 for s in order}
    while live:
        share = left / sum(weight[s] for s in live)
        over = {s for s in live if share * weight[s] > 3 * totals[s]}
        for s in over or live:
            target[s] = float(3 * totals[s]) if over else share * weight[s]
            left -= target[s]
        live = live - over if over else set()
    taken = Counter()
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == totals[s] and r.target == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.QUANTUM for s in order) and sum(taken.values()) == sum(totals.values())


@pytest.mark.parametrize("whole,budget", [(True, None), (False, None), (True, 3000), (False, 3000)])
def test_mixing_serves_as_a_plain_queue(spark, whole, budget):
    """Entries by virtual finish time until the budget is spent, one after the other in Python."""
    docs = S.documents(spark).where("doc_id < 120") if budget is None else S.edge_docs(spark)
    got = mixing.schedule(docs, whole=whole, budget=budget).collect()
    by_source = defaultdict(list)
    for k, r in enumerate(got):
        by_source[r._row.source].append((r.passes[0].v_start, k, r.size))
    order = sorted([s for s in by_source if s is not None]) + [None] * (None in by_source)
    entries, total = [], sum(r.size for r in got)
    for place, s in enumerate(order):
        weight, queued = (5.0, 2.0, 1.0)[place % 3], 0
        for turn in range(3):
            for v, k, n in sorted(by_source[s]):
                for low in range(0, n, n or 1 if whole else mixing.QUANTUM):
                    words = n if whole else min(mixing.QUANTUM, n - low)
                    queued += words
                    entries.append((queued / weight, k, turn, words))
    taken, left, last = Counter(), total if budget is None else budget, None
    for v, k, turn, words in sorted(entries):
        if left <= 0:
            break
        taken[k, turn] += words if words <= left else (words * (2 * left >= words) if whole else left)
        left, last = left - words, v
    wrong = [(k, p) for k, r in enumerate(got) for p in r.passes if p.taken != taken[k, p.turn]]
    assert not wrong or sum(e[0] == last for e in entries) > 1  # entries that finish together at the cut
    assert all(p.v_finish >= last for _, p in wrong)


def test_mixed_documents_keep_columns(spark):
    docs = S.edge_docs(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 6  # one row is there twice
    assert mixing.words_taken(S.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("path", [WORDS_49K, BYTES_50K])
def test_tokenizer_equals_the_library(path):
    own, plain = WordTokenizer(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(3)
    texts = [t or "" for _, t, *_ in S.edge_rows()] + ["<|endoftext|> a", "It's 12,5% x_y don't", "a  b", " a", "a ", "A\n\nB", "Éa ßx naïve", "I'LL we've", "é́"]
    texts += ["".join(rng.choice("ab CD'é,.1 \n\tß中") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("path", [WORDS_49K, BYTES_50K])
def test_operators_tokenize_as_the_unmodified_library(spark, path):
    plain, rng = Tokenizer.from_file(path), random.Random(4)
    some = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<|endoftext", "Word,", "it's", "a", "é", "12"]
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|startoftext|>b\nc", "x y"]
    texts += [rng.choice(["", " ", "\n"]).join(rng.choice(some) for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    expect = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts, expect, strict=True):
        assert np.frombuffer(tokenizer(path).encode(t), "<u4").tolist() == ids, t
    docs = spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string")
    if path == WORDS_49K:
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.round_trip(docs, path).collect()}
        whole = [np.array([*ids, 1], "<u4") for ids in expect[:4]]
        assert got == {i: (sum(map(len, whole[:i])), len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(whole)}
    else:
        assert {r.doc_id: r.doc_tokens for r in packing.pack_documents(docs, path).collect()} == {i: len(ids) + 1 for i, ids in enumerate(expect[:4])}


@pytest.mark.parametrize("source", ["edge", "table"])
def test_bitpack(spark, source):
    docs = S.edge_docs(spark) if source == "edge" else S.documents(spark)
    got = bitpack.round_trip(docs, WORDS_49K).orderBy("start").collect()
    expect = sorted((i, np.array(plain_ids(WORDS_49K, t), "<u4").tobytes()) for i, t in pairs(docs))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(b) // 4, zlib.crc32(b)) for i, b in expect]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_bitpack_edges(spark, tmp_path):
    assert bitpack.round_trip(S.empty_docs(spark), WORDS_49K).count() == 0
    ids = np.random.default_rng(1).integers(0, 49408, 10_001).astype("<u4")
    held = bitpack.Segment(bitpack.segment([1, None], [4, 9_997], ids, 16, 128))
    assert held.doc_ids == [1, None] and (held.ids(0, 10_001) == ids).all() and (held.ids(1000, 1003) == ids[1000:1003]).all()
    for bits in (1, 7, 13, 16, 31):
        some = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype("<u4")
        assert (bitpack.unpack(bitpack.pack(some, bits), bits)[:777] == some).all()


def test_bitpack_several_files_a_part(spark, tmp_path):
    """The numbers come from the file's own name, whatever the folders are called."""
    docs = S.documents(spark)
    path = f"file://{tmp_path}/part-7-c3/packed-ids-c1"
    bitpack.write_packed(docs, path, WORDS_49K, file_ids=3000)
    names = [p.name for p in (tmp_path / "part-7-c3/packed-ids-c1").glob("part-*")]
    assert max(Counter(n.split("-")[1] for n in names).values()) > 9
    got = bitpack.read_packed(spark, path).orderBy("doc_id").collect()
    own = WordTokenizer(WORDS_49K)
    expect = sorted((i, len(own.encode(t or "")) // 4 + 1) for i, t in pairs(docs))
    assert [(r.doc_id, r.n_tokens) for r in got] == expect
    assert [r.start for r in got] == np.cumsum([0] + [n for _, n in expect])[:-1].tolist()


@pytest.mark.parametrize("source", ["edge", "table"])
def test_packing(spark, source):
    docs = S.edge_docs(spark) if source == "edge" else S.documents(spark)
    got = packing.pack_documents(docs, BYTES_50K).collect()
    ids = Counter()
    held = defaultdict(list)
    for i, t in pairs(docs):
        ids[i, np.array(plain_ids(BYTES_50K, t), "<u4").tobytes()] += 1
    whole = {i: (np.frombuffer(b, "<u4"), k) for (i, b), k in ids.items()}
    seen = Counter()
    for r in got:
        own, _ = whole[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        for at in range(r.start, r.start + r.length):
            seen[r.doc_id, at] += 1
        held[r.sequence_id].append((r.offset, r.length))
    assert all(seen[i, at] == k for i, (own, k) in whole.items() for at in range(len(own))) and sum(seen.values()) == sum(len(o) * k for o, k in whole.values())
    padding = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_sequences(spark):
    docs = S.documents(spark).limit(40)
    whole = packing.sequences(docs, BYTES_50K).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(plain_ids(BYTES_50K, t)) for _, t in pairs(docs))
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack_documents(S.empty_docs(spark), BYTES_50K).count() == 0


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_of_the_table(spark, shingle):
    docs = S.documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, shingle).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in S.brute_components(pairs(docs), shingle).items()}
    assert neardup.keep_one(docs, shingle).columns == docs.columns


def test_near_duplicates_edges(spark, monkeypatch):
    """Chains whose ends are not alike, sets just at and below the threshold, and buckets of several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    more, i = [], 100
    for _ in range(12):
        base = [f"z{rng.randrange(10**9)}" for _ in range(61)]
        for _ in range(12):
            more.append((i, " ".join(base), "en", "web", 1, 1, "x", 1))
            i += 1
            at = rng.randrange(1, 60)
            base = base[:at] + [f"z{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 5))] + base[at + 3 :]
    docs = S.edge_docs(spark, more)
    got = neardup.near_duplicates(docs, 2).collect()
    expect = S.brute_components(pairs(docs), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (n, c, k == c) for k, (n, c) in expect.items()}
    assert len(got) == docs.count()
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 2).collect()} == {(None, None, True), (1, 1, True), (2, 2, True)}
    assert neardup.near_duplicates(S.empty_docs(spark), 2).count() == 0


def test_odd_sketches_tell_similarity():
    rng = np.random.default_rng(2)
    limit = neardup.differing_bits(0.8)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        y = np.r_[x[:160], rng.integers(0, 1 << 63, 20).astype(np.uint64)]  # 160 of 200
        a, b = (neardup.odd_sketch(neardup.minhash(np.unique(s))) for s in (x, y))
        assert np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum() <= limit


@pytest.mark.parametrize("source", ["edge", "table", "crowded"])
def test_substring(spark, source, monkeypatch):
    if source != "edge":  # many groups, slices and ranges
        monkeypatch.setattr(substring, "BYTES_PER_GROUP", 20_000)
        monkeypatch.setattr(substring, "BYTES_PER_RANGE", 50_000)
        monkeypatch.setattr(substring, "SLICE_BITS_LEAST", 8)
        monkeypatch.setattr(substring, "CELLS_PER_BYTE", 0.001 if source == "crowded" else 1.0)  # crowded: every window passes the sketch
    docs = S.documents(spark) if source == "table" else S.edge_docs(spark)
    cut = substring.remove_repeats(docs, with_text=True)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in cut.select("_row.doc_id", "n_words", "n_removed", "kept_sha256").collect())
    expect = sorted((i, n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()) for i, n, left in S.brute_removed(pairs(docs)))
    assert got == expect
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for i, n, k, _ in expect if k == 0 or k < n)


def test_substring_edges(spark):
    assert substring.digest(S.empty_docs(spark)).count() == 0
    line = " ".join(S.BASE[:20])
    odd = spark.createDataFrame([(None, line), (1, line), (2, line), (2, line)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.digest(odd).collect()) == [(0, 0), (1, 0), (2, 20), (2, 20)]
    named = odd.selectExpr("doc_id", "text", "1 as `my col`", "named_struct('a b', 2) as `x.y`")
    assert substring.without_repeats(named).columns == named.columns and substring.without_repeats(named).count() == 2


def test_words_of_a_pattern_are_told_apart(spark):
    """Long words of two letters whose patterns make sums of powers agree: the Thue-Morse word and its complement."""
    tm = "a"
    for _ in range(10):
        tm += tm.translate(str.maketrans("ab", "ba"))
    other, twelve = tm.translate(str.maketrans("ab", "ba")), " ".join(S.BASE[:12])
    docs = spark.createDataFrame([(1, tm), (2, other), (3, f"{twelve} {tm}"), (4, f"{twelve} {other}"), (5, f"{twelve} {other}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.digest(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {i: c for i, (_, c) in S.brute_components(pairs(docs), 2).items()} and got[2] == 2


def _older_hash(word):
    """The hash by which words were compared before: sums of parts mixed without a key, which can be solved for a part."""
    data = np.frombuffer(word, np.uint8)
    import pyarrow as pa

    from tessera.llm.words import word_hashes

    return int(word_hashes(pa.array([data.tobytes()], pa.binary()))[0][0])


#: Words of one old hash each: two of 16 letters, and pairs with the same parts before and behind.
SAME = [(b"passagesremember", b"ftyhqusv/z512+wb"), (b"passagesrememberand", b"ftyhqusv/z512+wband"), (b"passagesremember" + b"overmuch" * 2, b"ftyhqusv/z512+wb" + b"overmuch" * 2)]


def test_words_made_to_meet_are_told_apart(spark):
    assert _older_hash(SAME[0][0]) == _older_hash(SAME[0][1])
    rows, twelve = [], " ".join(S.BASE[:12])
    for k, (a, b) in enumerate(SAME):
        rows += [(10 * k + 1, a.decode()), (10 * k + 2, b.decode()), (10 * k + 3, f"{k} {twelve} {a.decode()}"), (10 * k + 4, f"{k} {twelve} {b.decode()}"), (10 * k + 5, f"{k} {twelve} {b.decode()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.digest(docs).collect()}
    assert got == {i: (n, n - len(left)) for i, n, left in S.brute_removed(rows)}
    for shingle in (1, 2):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle).collect()}
        assert got == {i: c for i, (_, c) in S.brute_components(rows, shingle).items()}


def test_hashes_that_meet_by_accident_do_not_decide(spark):
    """With few bits of hash, sets of different shingles fall into one class and pairs look alike; the words tell them apart."""
    rng = random.Random(8)
    rows = [(k, f"a{rng.randrange(10**6)}") for k in range(120)] + [(200 + k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(2))) for k in range(80)] + [(300, "x y x y"), (301, "x y x y x"), (302, "X y x"), (303, "y x y x y x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect = {i: (n, c) for i, (n, c) in S.brute_components(rows, 2).items()}
    for bits in (6, 20, 64):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2, bits=bits).collect()} == expect


def test_rows_of_one_document_join_its_groups(spark):
    """Rows (2, A), (5, A), (5, B), (7, B) are one group by way of document 5."""
    a, b = " ".join(S.BASE[:30]), " ".join(S.BASE[50:80])
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (7, b), (8, "alone"), (5, None)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect()]
    assert {g[:2] for g in got if g[0] != 5} == {(2, 2), (7, 2), (8, 8)}
    assert sorted(got) == [(2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (7, 2, False), (8, 8, True)]


@pytest.mark.parametrize("n_bytes", [10**8, 10**9, 10**12, 10**14])
def test_the_sketch_grows_with_the_input(n_bytes):
    """Cells for each window stay as many at any size, and a slice stays within a task's memory."""
    bits = substring.cell_bits(n_bytes)
    assert n_bytes <= 1 << bits < 2 * n_bytes and substring.slice_bits(bits) <= substring.SLICE_BITS_MOST


def test_lists_of_cells_round_trip():
    rng = np.random.default_rng(5)
    for top, k in ((1 << 20, 5000), (1 << 26, 40), (300, 250), (1 << 26, 1), (5_000_000, 100_000)):
        at = np.unique(rng.integers(0, top, k))
        more = rng.random(len(at)) < 0.3
        back, flags = substring.decode_cells(substring.encode_cells(at, more))
        assert (back == at).all() and (flags == more).all()


def test_ids_of_windows_round_trip():
    top = (1 << 63) - 1
    for ids in ([], [5], [0, 1 << 31, (1 << 32) - 1], [-3, 7], [-top - 1, top, 0], [10**12, 10**12 + 5], [0, 1 << 32]):
        data = substring.encode_ids(np.array(ids, np.int64))
        back, end = substring.decode_ids(b"xx" + data + b"y", 2, len(ids))
        assert back.tolist() == ids and end == 2 + len(data)
    assert len(substring.encode_ids(np.arange(100))) == 409


def test_share_of_windows_that_pass_the_sketch(spark):
    """Hardly any window of texts without repeats passes, at any size of the table."""
    import pyspark.sql.functions as F

    for k in (200, 2000):
        docs = spark.range(k).select(F.col("id").alias("_doc"), F.expr("array_join(transform(sequence(1, 200), x -> md5(concat(id, '-', x))), ' ')").cast("binary").alias("_text"))
        n_bytes = docs.agg(F.sum(F.length("_text"))).first()[0]
        rows = docs.withColumn("grp", F.pmod(F.xxhash64("_doc"), F.lit(7)))
        answers, _ = substring.repeated_windows(rows, 13, n_bytes, [3, 5])
        count = functools.partial(_count_passed, n_bytes)
        passed = rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda a, b: count(a, b), "n long, of long").toPandas().sum()  # noqa: B023
        assert passed.of == k * 188 and passed.n < 0.02 * passed.of


def _count_passed(n_bytes, texts, answers):
    import pyarrow as pa

    h1, bits = substring._group_windows(texts, 13, [3, 5], second=False)[0], substring.cell_bits(n_bytes)
    return pa.table({"n": pa.array([int(substring._passed(h1, answers, bits, substring.slice_bits(bits)).sum())]), "of": pa.array([len(h1)])})


@pytest.mark.parametrize("source", ["edge", "table"])
def test_license_phrases(spark, source):
    import re

    docs = S.edge_docs(spark) if source == "edge" else S.documents(spark)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=str)
    expect = []
    for i, t in pairs(docs):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.encode().split()]
        places = [k for k, _ in at]
        expect.append((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(expect, key=str)


def brute_blocks(words, template, threshold=0.8):
    """Of all windows of words that reach the template, the best of each group that overlap."""
    whole = licenses.words_of(template.text.encode())
    tokens, named, reach = set(whole), {w.encode() for w in template.named}, -(-len(whole) * 10 // round(threshold * 10))
    found = []
    for a in range(len(words)):
        for b in range(a + 1, min(len(words), a + reach) + 1):
            held = tokens.intersection(words[a:b])
            if words[a] in tokens and words[b - 1] in tokens and len(held) >= threshold * len(tokens) - 1e-9 and named <= held:
                found.append((a, b, len(held)))
    out, group, end = [], [], -1
    for a, b, n in sorted(found):
        if group and a >= end:
            out.append(group)
            group = []
        group.append((-n, b - a, a))
        end = max(end, b) if len(group) > 1 else b
    return [(a, size, -n) for n, size, a in map(min, out + [group] * bool(group))]


def test_license_blocks_equal_brute_force():
    rng = random.Random(11)
    index = licenses.Index(licenses.TEMPLATES, 0.8, {b"the": 9, b"under": 5, b"license": 4})
    hits = 0
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(licenses.TEMPLATES).text.split()[: rng.choice([60, 400])]
            for _ in range(rng.randrange(0, max(1, len(w) // 3))):
                w[rng.randrange(len(w))] = rng.choice(["other", "the", "license", "under", "mit"])
            parts += [*w, *["filler"] * rng.randrange(0, 6)]
        words = licenses.words_of(" ".join(parts).encode())
        found = defaultdict(list)
        for m in index.blocks(words):
            found[m.template].append((m.first, m.n_words, m.shared))
        for k in rng.sample(range(len(licenses.TEMPLATES)), 6):
            expect = brute_blocks(words, licenses.TEMPLATES[k])
            assert found.get(k, []) == expect
            hits += len(expect)
    assert hits > 100


def brute_matches(words, templates):
    """All best blocks of all templates, but those named only within a longer name, by trying every run of words."""
    found = [(k, a, size, n) for k, t in enumerate(templates) for a, size, n in brute_blocks(words, t)]

    def runs(k, a, size):
        named = {w.encode() for w in templates[k].named}
        inside = [(x, y) for x in range(a, a + size) for y in range(x, a + size) if named and named <= set(words[x : y + 1])]
        return [(x, y) for x, y in inside if not any(u >= x and v <= y and (u, v) != (x, y) for u, v in inside)]

    out = []
    for k, a, size, n in found:
        longer = [r for o, b, s, _ in found if set(templates[o].named) > set(templates[k].named) for r in runs(o, b, s)]
        own = runs(k, a, size)
        if not own or any(not any(c <= x and y <= d for c, d in longer) for x, y in own):
            out.append((k, a, size, n))
    return sorted(out)


LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""


def test_license_labels_equal_brute_force_over_all_templates():
    """Nested names, two licenses in a line, whole notices and mixtures of short ones."""
    rng = random.Random(3)
    index = licenses.Index(licenses.TEMPLATES, 0.8, {})
    short = [t.text for t in licenses.TEMPLATES if len(t.text.split()) < 16]
    texts = [LGPL, LGPL.replace("Lesser", "Affero").replace("library", "program"), "Licensed under CC BY 4.0 or CC BY-SA 4.0.", "Licensed under CC BY-SA 4.0 or CC BY 4.0.", "Licensed under the GNU General Public License, version 3, or licensed under the GNU Lesser General Public License."]
    texts += [" or ".join(rng.sample(short, rng.randrange(1, 4))) for _ in range(60)]
    for text in texts:
        words = licenses.words_of(text.encode())
        assert sorted((m.template, m.first, m.n_words, m.shared) for m in index.matches(words)) == brute_matches(words, licenses.TEMPLATES), text


def test_license_labels_and_scores(spark):
    full = licenses.TEMPLATES[0].text
    cases = [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 1.0),
        ("Licensed under CC BY 4.0.", "cc-by", 1.0),
        ("Licensed under\nCC BY-SA 4.0.", "cc-by-sa", 1.0),
        ("Released under the GPL license.", "gpl", 1.0),
        (LGPL, "gpl,lgpl", 1.0),  # the base phrase stands in it, too
        (LGPL.replace("Lesser", "Affero").replace("library", "program"), "agpl,gpl", 1.0),
        ("Licensed under CC BY 4.0 or CC BY-SA 4.0.", "cc-by,cc-by-sa", 1.0),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa", 1.0),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by", 1.0),
        ("Licensed under the BSD License, Version 2.0.", "bsd", 1.0),
        ("Licensed under the Apache License, Version 2.0.", "apache", 1.0),
        ("Released under the MIT License.", "mit", 1.0),
        ("The film was released last year under protest, and the actor lost his license with it.", "", 0.0),
        ("Er kommt mit dem Brief, released under the old license.", "", 0.0),
        ("x " * 5000 + full.replace("MERCHANTABILITY", "sale") + " y" * 5000, "mit", None),
        ("", "", 0.0),
        (None, "", 0.0),
        ("The software is provided as is.", "", 0.0),
    ]
    docs = spark.createDataFrame([(None if i == 0 else i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id or 0: r for r in licenses.scan(docs).collect()}
    for i, (text, labels, score) in enumerate(cases):
        assert got[i].labels == labels, text
        assert got[i].score == score if score is not None else 0.9 < got[i].score < 1
    assert licenses.scan(S.empty_docs(spark)).count() == 0
