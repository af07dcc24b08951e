"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

Both vocabularies split a text into words before they merge, so a word's ids do not depend on its neighbours. Words
repeat, hence each worker remembers the ids of the words it has met. A text whose blanks are of any unusual kind, or
that holds an added token such as <|endoftext|>, goes through the library as a whole.
"""

from __future__ import annotations

import functools
import string

#: One id after each document.
END_ID = 1
#: Words a worker remembers for each vocabulary, about 200 bytes each.
MEMO_WORDS = 600_000

#: Every character that either Python or the vocabularies' patterns take as blank, but for space and newline.
_OTHER_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_MARKS = string.punctuation.replace("_", "")


def _plain_blanks(text: str) -> bool:
    """Whether words are parted by exactly one space or newline each, with none at the ends."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _OTHER_BLANKS)


def _byte_letters() -> dict[int, int]:
    """The printable letter for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class _Memo(dict):
    """Piece of text -> its ids as little-endian 32-bit bytes. When full it starts anew; pieces met again move over from the last fill."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    With ``literals`` an added token that stands in a text becomes its one id, as by the library's default; without, it
    is a text like any other (the library's ``encode_special_tokens``).
    ``path`` is a tokenizers JSON file of one of two kinds: byte-level BPE whose words carry their leading space, or
    lower-casing BPE with word ends, which drops white space (``drops_blanks``).
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, literals: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not literals
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if literals else []
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.drops_blanks = self.tokenizer.normalizer is not None
        self._letters = _byte_letters()
        self._bytes = [int(i).to_bytes(4, "little") for i in range(self.vocab_size)]
        self._first = _Memo(self._piece, memo_words if self.drops_blanks else memo_words // 4)
        self._rest = self._first if self.drops_blanks else _Memo(lambda word: self._piece(" " + word), memo_words)
        self._newline = b"" if self.drops_blanks else self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return b"".join([self._bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        """Latin letters, with or without a leading space, go straight through the library's merge model.

        Letters followed by marks are two words to either vocabulary; all else is left to the whole library.
        """
        core = piece.rstrip(_MARKS)
        word = core[1:] if core[:1] == " " else core
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0100"):
            return self._whole(piece)
        if core != piece:
            return (self._first if word is core else self._rest)[word] + self._first[piece[len(core) :]]
        if self.drops_blanks and word != (low := word.lower()):
            return self._first[low]
        symbols = core.encode().decode("latin-1").translate(self._letters)
        return b"".join([self._bytes[t.id] for t in self.tokenizer.model.tokenize(symbols)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without the end id."""
        if not text:
            return b""
        if not _plain_blanks(text) or any(t in text for t in self._added):
            return self._whole(text)
        lines = []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            lines.append(self._first[head] + b"".join(map(self._rest.__getitem__, tail)))
        return self._newline.join(lines)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker and file, with its memo, kept between tasks; its ids are the unmodified library's."""
    return WordTokenizer(path, literals=True)
