"""Byte-pair encoding by dynamic programming over prefixes, and decoding, for vocabularies whose words carry an end mark.

A word is a string of byte letters and one end mark. An automaton with suffix links finds, for each prefix, the tokens
that end there. The prefix has one encoding, so one last token: the one whose place before it is the start of the word,
or a prefix whose own last token makes a compatible pair with it. Two tokens are compatible if no merge across their
seam comes before the merges that take its two sides away: with p a piece on the seam's left as the left token grows,
and q one on its right, the merge (p, q) must be later than p's own next merge, or as late, as merges of one rank go from
left to right, and later than q's. One last token is kept for each prefix, and the ids are read off from the end.
So a word of any length takes time in proportion to its length and to the tokens that end at a place.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _byte_letters
from .words import portions

#: Stands after the last letter of a word.
END = "\n"
#: Chunks of text, and pairs of tokens, that a worker remembers.
MEMO_CHUNKS, MEMO_PAIRS = 400_000, 1_000_000
_NEVER = 1 << 62


class PrefixEncoder:
    """Ids of words by the last token of each prefix.

    ``vocab`` is token to id and ``merges`` the pairs in order of rank; a token that ends in ``suffix`` ends a word.
    Each merge must come after those that make its two parts, as in any trained vocabulary.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        import ahocorasick

        self.suffix = suffix
        mark = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) and len(t) > len(suffix) else t
        base = lambda t: len(t) == 1 and t != END or len(t) == 2 and t[1] == END
        self.ids = {mark(t): i for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, whole = self.ids[mark(a)], self.ids[mark(b)], self.ids[mark(a + b)]
            self.rank.setdefault(x << 32 | y, rank)
            if whole in self.parts or any(p not in self.parts and not base(t) for p, t in ((x, mark(a)), (y, mark(b)))):
                raise ValueError("each token must be made by one merge, after its parts")
            self.parts[whole] = (x, y, rank)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if base(t) or i in self.parts:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self._lefts: dict[int, list[tuple[int, int, int]]] = {}
        self._rights: dict[int, list[tuple[int, int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """The pieces at a token's right or left end, last first, each with the rank of the merge that takes it in and of the one that made it."""
        held = self._rights if right else self._lefts
        if (out := held.get(token)) is None:
            out, up, piece = [], _NEVER, token
            while piece is not None:
                x, y, born = self.parts.get(piece, (None, None, -1))
                out.append((piece, up, born))
                piece, up = (y if right else x), born
            held[token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' texts put together is these two tokens."""
        rank, lefts, rights, known = self.rank.get, self._edge(b, False), self._edge(a, True), True
        i, j = 0, 0  # the pieces at the seam, from the last ones back in time; of two made by one rank the left came first
        while True:
            (p, up_p, born_p), (q, up_q, born_q) = rights[i], lefts[j]
            merged = rank(p << 32 | q)
            if merged is not None and merged < up_p and merged <= up_q:
                known = False
                break
            if born_p < 0 and born_q < 0:
                break
            if born_p > born_q:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= MEMO_PAIRS:
            self._pairs.clear()
        self._pairs[a << 32 | b] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token: no other merge comes across its seams."""
        known = self._whole.get(token)
        if known is None:
            known = True
            if token in self.parts:
                x, y, rank = self.parts[token]
                seam = any(r < up_p and r <= up_q and (p, q) != (x, y) for p, up_p, _ in self._edge(x, True) for q, up_q, _ in self._edge(y, False) if (r := self.rank.get(p << 32 | q, _NEVER)) < rank)
                known = self.whole(x) and self.whole(y) and not seam
            self._whole[token] = known
        return known

    def encode_word(self, letters: str) -> list[int]:
        """The ids of a word of byte letters, without its end mark."""
        text = letters + END
        n = len(text)
        last, size_of, pairs = [-1] * (n + 1), [0] * (n + 1), self._pairs
        for at, (token, size) in self.automaton.iter(text):
            if last[at + 1] >= 0:  # a prefix has one last token
                continue
            before = last[at + 1 - size]
            if before >= 0:
                fits = pairs.get(before << 32 | token)
                if fits if fits is not None else self.compatible(before, token):
                    last[at + 1], size_of[at + 1] = token, size
            elif size == at + 1 and self.whole(token):
                last[at + 1], size_of[at + 1] = token, size
        out, place = [], n
        while place:
            if last[place] < 0:
                raise ValueError("the vocabulary has no token for a letter of this word")
            out.append(last[place])
            place -= size_of[place]
        out.reverse()
        return out


class Codec:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False).ids`` and decodes as ``Tokenizer.decode``.

    ``path`` is a tokenizers JSON file of the kind that drops white space and marks the ends of words. The library's
    normaliser and word splitter part a text; the ids are found here. Words never cross a space or a line end, so a
    text is worked on in chunks between these, which repeat and are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        model, self.tokenizer = spec["model"], Tokenizer.from_file(path)
        if not model.get("end_of_word_suffix") or spec["decoder"] or self.tokenizer.normalizer is None:
            raise ValueError("a vocabulary with end marks, a normaliser and no decoder is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = PrefixEncoder(model["vocab"], merges, model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand in the text as they are")
        self._literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self._letters = _byte_letters()
        self._memo: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids = self._memo.get(chunk)
        if ids is None:
            core = chunk.rstrip(string.punctuation)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):  # one word, and what stands behind it is no letter
                ids = self._word(core.lower().encode().decode("latin-1").translate(self._letters))
                if core != chunk:
                    ids += self._chunk(chunk[len(core) :])
            else:
                clean = self.tokenizer.normalizer.normalize_str(chunk)
                ids = b"".join([self._word(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)])
            if len(self._memo) >= MEMO_CHUNKS:
                self._memo.clear()
            if len(chunk) < 200:
                self._memo[chunk] = ids
        return ids

    def _word(self, letters: str) -> bytes:
        ids = self._words.get(letters)
        if ids is None:
            found = self.encoder.encode_word(letters)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self._words) >= MEMO_CHUNKS:
                self._words.clear()
            if len(letters) < 200:
                self._words[letters] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self._literal.split(text) if self._literal and any(t in text for t in self.added) else [text]):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out += [self._chunk(c) for line in part.split("\n") for c in line.split(" ") if c]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by spaces."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and file, kept between tasks with its memo."""
    return Codec(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row's whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(path)
        for batch in batches:
            for low, rows in portions(batch.column(1)):
                part = batch.slice(low, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([held.encode(t.as_py()) for t in part.column(1)], pa.binary())], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = [None if not i.is_valid else held.decode(i.as_py()) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Both steps run on a batch in one task, and only digests leave it. A null text is empty and has no tokens; a null
    doc_id stays null; repeated rows are encoded as often; texts and single words of any length are taken whole; other
    columns are not looked at; an empty table gives an empty result.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(path)
        for batch in batches:
            for low, rows in portions(batch.column(1)):
                part, found = batch.slice(low, rows), []
                for text in part.column(1):
                    ids = held.encode(text.as_py())
                    found.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(held.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=names)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
