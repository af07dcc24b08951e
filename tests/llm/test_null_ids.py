"""Rows without a doc_id: what each operator and stage makes of them, beside the same texts under ids."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from tessera.llm import bitpack, common, mixing, packing, tiff
from tessera.llm.queries import vocabulary

from . import samples as S

LONG = " ".join(S.BASE)
MORE = [(None, "one two three", "en", "web", 1, 1, "r", 1), (None, "one two three", "en", "web", 1, 1, "r", 1), (None, LONG, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def _ids(path, text):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 1]
    return len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_mixing(spark):
    got = mixing.words_taken(S.edge_docs(spark, MORE)).where("doc_id is null").collect()
    assert sorted(r["size"] for r in got) == [0, 3, 3, 400]
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_bit_packing(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = bitpack.round_trip(S.edge_docs(spark, MORE), path).collect()
    got = Counter((r.n_tokens, r.ids_crc32) for r in rows if r.doc_id is None)
    assert got == Counter(_ids(path, r[1]) for r in MORE)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert all(r.doc_id is None for r in sorted(rows, key=lambda r: r.start)[: len(MORE)])


def test_media(spark):
    rows = tiff.digest(S.edge_docs(spark, MORE)).collect()
    got = Counter((r.n_bytes, r.payload_sha256) for r in rows if r.doc_id is None)
    expect = Counter()
    for r in MORE:
        data = (r[1] or "").encode()
        size = max(576, -(-len(data) // 576) * 576)
        expect[len(data), hashlib.sha256(data.ljust(size, b"\xff")).hexdigest()] += 1
    assert got == expect
    same = {}
    for r in rows:  # equal texts, equal values of all other columns
        same.setdefault(r.payload_sha256 + str(r.n_bytes), set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in same.values()) and all(r.media_bytes > 0 and len(r.media_sha256) == 64 for r in rows)


def test_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(S.edge_docs(spark, MORE), path).where("doc_id is null").collect()
    assert sum(r.length for r in rows) == sum(_ids(path, r[1])[0] for r in MORE)
    assert Counter(r.doc_tokens for r in rows if r.start == 0) == Counter(_ids(path, r[1])[0] for r in MORE)


@pytest.mark.parametrize("k", range(5), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, k):
    """No stage loses rows without an id that its decisions do not touch, and none fails on them."""
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = S.edge_docs(spark, MORE).select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    rows = out.where("doc_id is null").collect()
    if k < 4:
        assert out.columns == docs.columns
    if k in (1, 2):
        assert Counter(r.text for r in rows) == Counter(r[1] if k == 1 else r[1] or "" for r in MORE)
    assert len(rows) > 0


def test_staged_folders_can_be_deleted(spark):
    mixing.words_taken(S.edge_docs(spark, MORE)).collect()
    assert common._STAGED
    common.clean(spark)
    assert not common._STAGED
