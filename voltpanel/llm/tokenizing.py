"""Exact ids of public tokenizers for whole texts, through a bounded cache of pre-tokens.

A byte-pair tokenizer merges inside pre-tokens only, so a text's ids are the ids of its
pre-tokens in a row. Plain texts are cut into words here by Arrow, each distinct word is looked
up once in a batch of texts, and its pre-tokens are encoded by the tokenizers library's model
and remembered. A text with any character outside well-known
ranges, or with a marker that could be a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per generation and cache; two generations live at a time (about 200 bytes a piece).
CACHE_ENTRIES = 200_000
#: Anything outside these ranges, or what could be a special token's marker, makes a text
#: unusual. Inside them white space is blank and line end only, letters and digits are the
#: same for Python as for the library's patterns, and composition changes nothing.
UNUSUAL = re.compile(r"<\||[^ -~\n¡-¬®-±´-¸º»¿-įı-ɏЀ-҂Ҋ-ӿ–-…€぀-゘ァ-ヺ一-鿿가-힣]")
#: White space beside white space, which the library groups.
GROUPED = r"  | \n|\n\n"
#: Stands before a word that has neither blank nor line end before it; no usual text has it.
FIRST = "\x01"
#: Single punctuation that ends many words; no letter, digit or white space.
COMMON_ENDS = frozenset(".,;:!?")
#: name -> (pattern of the pre-tokens, whether the text is lower-cased first).
KINDS = {
    "byte_bpe_50k.json": (
        re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
        False,
    ),
    "word_bpe_49k.json": (re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"), True),
}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: a printable Latin-1
    character stands for itself, the others get the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCache(dict):
    """What a function gives for a piece, remembered; two generations bound its size.

    A full generation becomes the older one, which is read from but not added to, so what
    is used again survives and what is not is dropped.
    """

    def __init__(self, find, older: dict | None = None):
        super().__init__()
        self.find, self.older = find, older or {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.find(piece)
        self[piece] = value
        return value

    def turned(self, entries: int) -> PieceCache:
        """This cache, or a new generation over it once it is full."""
        if len(self) < entries:
            return self
        self.older = {}
        return PieceCache(self.find, self)


class TextEncoder:
    """Ids of texts as little-endian bytes of ``dtype``, equal to the library's own encoding."""

    EMPTY, TYPES = b"", {"<u2": "H", "<u4": "I"}

    def __init__(self, name: str, path: str | None = None, dtype: str = "<u4", entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(name))
        self.letters, self.dtype, self.entries = byte_letters(), dtype, entries
        self.pattern, self.lower = KINDS[name]
        self.own = [array(self.TYPES[dtype], [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.by_token = PieceCache(self._token)
        self.by_word = PieceCache(self._word)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def value(self, ids: list[int]):
        return array(self.TYPES[self.dtype], ids).tobytes()

    def total(self, values):
        return b"".join(values)

    def _model(self, spelled: str):
        return b"".join([self.own[t.id] for t in self.tokenizer.model.tokenize(spelled)])

    def _token(self, pre_token: str):
        """One pre-token through the library's model."""
        return self._model(pre_token.encode("utf-8").decode("latin-1").translate(self.letters))

    def _plain(self, text: str):
        return self.total(map(self.by_token.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str):
        """A word with the blank before it; one that begins with a line end or ``FIRST`` has none."""
        if self.lower or word[:1] == "\n":
            return self._plain(word)
        if word[:1] == FIRST:
            return self._plain(word[1:])
        if word.isalpha():  # one pre-token
            return self._model("Ġ" + word) if word.isascii() else self._token(" " + word)
        if word[-1:] in COMMON_ENDS and word[:-1].isalpha():
            return self.total((self.by_word[word[:-1]], self.by_token[word[-1]]))
        return self._plain(" " + word)

    def _text(self, text: str):
        if not text or UNUSUAL.search(text):
            return self.value(self._whole(text))
        if self.lower:  # white space never reaches this tokenizer
            return self.total(map(self.by_word.__getitem__, text.lower().split()))
        return self._plain(text)

    def _runs(self, values: list, words: np.ndarray, bounds: np.ndarray) -> list:
        """Totals of consecutive runs of words; ``words`` says which value each word has."""
        flat = pa.array(values, pa.large_binary()).take(pa.array(words))
        at = np.frombuffer(flat.buffers()[1], np.int64)[bounds]
        data = memoryview(flat.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]

    def _usual(self, texts: pa.Array) -> list:
        """Usual texts without grouped white space: each distinct word is looked up once."""
        # Every later word carries its blank, or the line end before it, a pre-token of its own.
        lines = pc.replace_substring(pc.binary_join_element_wise(FIRST, texts, ""), "\n", " \n")
        cut = pc.split_pattern(lines, " ")
        words = cut.flatten().dictionary_encode()
        values = list(map(self.by_word.__getitem__, words.dictionary.to_pylist()))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))])
        return self._runs(values, words.indices.to_numpy(zero_copy_only=False), bounds.astype(np.int64))

    def encode(self, texts: list[str] | pa.Array) -> list:
        self.by_token, self.by_word = self.by_token.turned(self.entries), self.by_word.turned(self.entries)
        if self.lower:
            return [self._text(t) for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, f"{GROUPED}|{UNUSUAL.pattern}|^$").to_numpy(zero_copy_only=False).astype(bool)
        out = np.empty(len(texts), object)
        out[odd] = [self._text(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        if not odd.all():
            out[~odd] = self._usual(texts.filter(pa.array(~odd)))
        return out.tolist()


class TextCounter(TextEncoder):
    """Token counts only; ``known`` is the first tier, counts of the corpus's frequent words."""

    def __init__(self, name: str, path: str | None = None, known: dict | None = None, entries: int = CACHE_ENTRIES):
        super().__init__(name, path, entries=entries)
        self.known = known or {}
        self.by_word.find = self._either

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def _model(self, spelled: str) -> int:
        return len(self.tokenizer.model.tokenize(spelled))

    def total(self, values) -> int:
        return sum(values)

    def _runs(self, values: list, words: np.ndarray, bounds: np.ndarray) -> list:
        return np.add.reduceat(np.array(values, np.int64)[words], bounds[:-1]).tolist()

    def _either(self, word: str) -> int:
        n = self.known.get(word)
        return self._word(word) if n is None else n
