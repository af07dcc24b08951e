"""Spelling variants, repair of conversations and byte-pair encoding against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import bpe, repair, variants
from tessera.llm.queries import vocabulary

from .samples import documents, edge_docs, edge_rows, empty_docs

DATA = "/root/testdata/sf0.001"


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, near_pairs=None):
    n = brute_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def variant_rows(df):
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def crafted(seed=3):
    """Words of few letters in chains one edit apart, with repeated letters, ties and a very long word, in texts of skewed ids."""
    rng, rows = random.Random(seed), []
    bases = ["aaaaaa", "abcabc", "straße", "ÀÉÿ×÷o", "letters", "balloon"]
    pool = set(bases)
    while len(pool) < 150:
        w = rng.choice(sorted(pool))
        k = rng.randrange(len(w))
        pool.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abéß") + w[k + 1 :], w[:k] + rng.choice("abéo") + w[k:], w + "a"]))
    pool = sorted(pool)
    for i in range(60):
        rows.append((i % 7, " ".join(rng.choices(pool, [1 + 40 / (1 + k) for k in range(len(pool))], k=120))))
    long = "".join(rng.choices("abcd", k=3000))
    rows += [(90, f"{long} {long[:1500]}x{long[1501:]} {long[:700]}{long[701:]}")] * 3 + [(91, long)] * 4
    return rows


def test_variants_equal_brute_force(spark):
    rows = crafted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = variant_rows(variants.spelling_variants(df))
    want = brute_variants(rows)
    assert len(got) == len(set(got)) == len(want)
    assert set(got) == want
    assert max(r[4] for r in want) > 5 and any(r[2] != r[1] and r[1] for r in want)


def test_variants_on_edges_and_empty(spark):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(None, "Wordy wordy WORDY wordz wordz wordz")] * 2
    got = variant_rows(variants.spelling_variants(edge_docs(spark, [(None, rows[-1][1], None, None, None, None, None, None)] * 2)))
    assert sorted(got, key=str) == sorted(brute_variants(rows), key=str)
    assert variant_rows(variants.spelling_variants(empty_docs(spark))) == []


def test_variants_on_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert set(variant_rows(variants.spelling_variants(docs))) == brute_variants(rows)


def test_deletion_keys_are_those_of_the_shorter_words():
    import numpy as np
    import pyarrow as pa

    words = ["banana", "straße", "aa", "ÿ"]
    number, place, key, fresh = variants.deletion_keys(pa.array(words))
    shorter = [words[w][:p] + words[w][p + 1 :] if p >= 0 else words[w] for w, p in zip(number, place, strict=True)]
    _, _, own, _ = variants.deletion_keys(pa.array([s for s in shorter if s]))
    whole = own[-sum(bool(s) for s in shorter) :]
    assert (key[np.array([bool(s) for s in shorter])] == whole).all()


def test_keys_that_collide_are_told_apart_by_their_words(spark):
    import pyarrow as pa

    rows = [(7, 1, True, 1, "abcde", 3), (7, 1, True, 2, "axcde", 9), (7, 1, True, 3, "zzzzz", 50), (7, -1, True, 4, "acde", 5), (7, -1, True, 5, "other", 99)]
    names = ["key", "place", "fresh", "id", "word", "n"]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(names)})
    found = {(r["id"], r["n_near"], r["best"]) for r in variants._near(table).to_pylist()}
    assert found == {(1, 1, "axcde"), (2, 1, "abcde"), (4, 2, "axcde"), (1, 1, "acde"), (2, 1, "acde")}


# conversations


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


PATTERN = re.compile("(s?(ua)+)?")


def brute_audit(rows, faults):
    """Every sequence of edits within a bound on the cost, by the definition; the bound is raised until one is legal."""
    limit = 0
    while True:
        found = []

        def go(k, roles, letters, lines, cost):
            if cost > limit:
                return
            if k == len(rows) and PATTERN.fullmatch(roles):
                found.append((cost, letters, lines))
            for new in ("user", "assistant"):
                if legal(roles + new[0]):
                    go(k, roles + new[0], letters + "I", [*lines, f"{new}:"], cost + 3)
            if k < len(rows):
                _, role, text = rows[k]
                go(k + 1, roles, letters + "D", lines, cost + 4)
                if faults[k] not in ("blank", "duplicate"):
                    more = 3 * (faults[k] == "truncated")
                    if role and legal(roles + role[0]):
                        go(k + 1, roles + role[0], letters + "K", [*lines, f"{role}:{text}"], cost + more)
                    for new in ("user", "assistant"):
                        if legal(roles + new[0]):
                            go(k + 1, roles + new[0], letters + "R", [*lines, f"{new}:{text}"], cost + 3 + more)

        def legal(roles):
            return any(PATTERN.fullmatch(roles + rest) for rest in ("", "a", "ua"))

        go(0, "", "", [], 0)
        if found:
            return min(found, key=lambda f: (f[0], f[1]))
        limit += 1


def brute_repair(rows):
    out = {}
    for conv, held in brute_damage(rows).items():
        faults, seen = [], set()
        for _, role, text in held:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "fine")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        cost, letters, lines = brute_audit(held, faults)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:], strict=False)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, _conv string, cost long"


def repaired(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = repair.repair(df).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in names) for r in rows}


def some_turns(seed=5):
    rng, rows = random.Random(seed), []
    for conv in range(260):
        for k in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["A line.", "Another!", "no end", "", " \t\x0b", None, "same.", "Ünï?\n", "ends \r\n", "."])
            rows.append((conv, rng.choice([k, k, k, k + 1, None]), role, text, "x", 3))
    rows += [(None, 0, "user", "Null conversation.", None, None), (None, 1, "assistant", "Yes.", None, None)]
    return rows


def test_repair_equals_brute_force(spark):
    rows = some_turns()
    got = repaired(spark.createDataFrame(rows, TURNS).repartition(4))
    want = brute_repair([r[:4] for r in rows])
    assert {c: got[c] for c in want} == want and got.keys() == want.keys()
    assert {x for r in want.values() for x in r[6]} == set("DIKR")


def test_repair_of_conversations_cut_into_blocks(spark, monkeypatch):
    """A long conversation in many blocks, a third of whose rows are one text and a third have no turn, gives what it gives in one."""
    rng = random.Random(2)
    rows = [(1, None if k % 3 == 0 else k // 2, rng.choice(["user", "assistant", "system"]), "again." if k % 3 == 1 else f"text {k}{rng.choice(['.', ''])}", "x", 1) for k in range(900)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.", "x", 1) for c in range(2, 30) for t in range(4)]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    whole = repaired(df)
    calls = {"rows": repair.BLOCK_ROWS}
    source = repair._blocks

    def small(batches):
        repair.BLOCK_ROWS = 16
        yield from source(batches)

    monkeypatch.setattr(repair, "_blocks", small)
    assert repaired(df) == whole and calls["rows"] > 900
    held = brute_damage([r[:4] for r in rows])[1]
    assert len([x for x in whole[1][6] if x != "I"]) == len(held)


def test_distances_equal_relaxation():
    """Bucket queue against repeated relaxation of all arcs on random rows."""
    rng = random.Random(4)
    for n in (0, 1, 5, 40, 6000):
        codes = bytes(rng.randrange(4) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        dist = repair.distances(codes)
        if n <= 40:
            want = [10**9] * (4 * (n + 1))
            for q in (0, 3):
                want[4 * n + q] = 0
            for _ in range(4 * n + 8):
                for row in range(n, -1, -1):
                    for q in range(4):
                        best = want[4 * row + q]
                        best = min(best, 3 + want[4 * row + (2, 2, 3, 2)[q]])
                        if row < n:
                            kind, fault = codes[row] & 3, codes[row] >> 2
                            best = min(best, 4 + want[4 * row + 4 + q])
                            if fault not in (1, 2):
                                more = 3 * (fault == 3)
                                best = min(best, 3 + more + want[4 * row + 4 + (2, 2, 3, 2)[q]])
                                after = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((q, kind))
                                if after is not None:
                                    best = min(best, more + want[4 * row + 4 + after])
                        want[4 * row + q] = best
            assert dist.tolist() == want
        letters, starts = repair.walk(codes, dist)
        assert len(starts) == n + 1 and len(letters.replace("I", "")) == n
        price = {"D": 4, "I": 3, "K": 0, "R": 3}
        rows = iter(codes)
        spent = sum(price[x] + (3 if x != "I" and next(rows) >> 2 == 3 and x != "D" else 0) for x in letters)
        assert spent == dist[0]


def test_repair_on_empty_and_on_the_table(spark):
    assert repaired(spark.createDataFrame([], TURNS)) == {}
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    some = sorted({r[0] for r in rows})[:40]
    got = repaired(df)
    want = brute_repair([r for r in rows if r[0] in some])
    assert {c: got[c] for c in want} == want
    assert got.keys() == {r[0] for r in rows}


# byte-pair encoding

PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'LL", "É", "é", "́", "ß", "İ", "Σ", "中", "😀", "1", "23", "...", "!?", "<|endoftext|>", "<|startoftext|>", "<|end", " ", " ", "\x1c", "ﬁ", "aaaa", "AbC", "½", "</w>", "\x00", "_"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def bpe_digest(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    data = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(spark):
    rng, tokenizer = random.Random(9), library()
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(15))) for _ in range(3000)]
    texts += ["".join(rng.choices("abceinthsro", k=rng.randrange(1, 60))) for _ in range(1500)] + ["ab" * 20_000 + "a" * 30_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, vocabulary("word_bpe_49k.json")).collect()}
    assert got == {k: bpe_digest(tokenizer, t) for k, t in enumerate(texts)}


def test_bpe_on_documents_edges_and_empty(spark):
    tokenizer, path = library(), vocabulary("word_bpe_49k.json")
    more = [(None, "a null id", "en", "web", 1, 1, "r", 1)]
    for df in (documents(spark), edge_docs(spark, more)):
        rows = Counter((r.doc_id, *bpe_digest(tokenizer, r.text)) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in bpe.round_trip(df, path).collect()) == rows
    assert bpe.round_trip(empty_docs(spark), path).collect() == []


def test_bpe_encode_then_decode(spark):
    path, tokenizer = vocabulary("word_bpe_49k.json"), library()
    df = edge_docs(spark)
    rows = bpe.decode_documents(bpe.encode_documents(df, path), path).collect()
    want = Counter((r.doc_id, tokenizer.decode(tokenizer.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in df.collect())
    assert Counter((r.doc_id, r.text) for r in rows) == want


def test_pairs_are_compatible_as_merging_says():
    """Against plain merging of the lowest rank, leftmost first, over a small vocabulary with runs of one letter."""
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "a</w>"), ("aa", "ab"), ("ab", "a</w>"), ("aa", "aa"), ("b", "b")]
    letters = ["a", "b", "a</w>", "b</w>"]
    vocab = {t: i for i, t in enumerate([*letters, *[x + y for x, y in merges]])}
    encoder = bpe.PrefixEncoder(vocab, merges, "</w>")
    rank = {m: k for k, m in enumerate(merges)}
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choices("ab", [3, 1], k=rng.randrange(1, 14)))
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert encoder.encode_word(word) == [vocab[t] for t in parts]


def test_vocabularies_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(vocabulary("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        bpe.PrefixEncoder({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")], "</w>")
