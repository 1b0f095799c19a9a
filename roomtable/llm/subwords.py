"""Token ids of whole texts by a public tokenizer file, with a memory of words.

Words here are the parts between ASCII blanks. The vocabularies in use split a text at
white space before anything else, so a text's ids are the ids of its words, joined; the
tokenizers library encodes a word when a worker meets it and the worker remembers it.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np

from roomtable.llm.wordkeys import Words, mixed, pieces

VOCABULARY = "word_bpe_49k.json"
#: Words a worker remembers, in two halves: when the newer one is full, words not asked for since the last change go.
REMEMBERED = 700_000
#: Places for words that are looked up by array operations, as a power of two; their ids must be below 65,536.
SLOT_BITS = 20
#: Longer words are encoded without being remembered.
_LONGEST = 64
#: Letters that are composed, each with one lower-case form: such a word is one piece for the merges.
_LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
#: Letters and then marks, without the apostrophe and the '<' that the pattern joins otherwise.
_MARKED = re.compile("([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\\[-`{-~]+)")
#: The last mark of a word after a letter: a piece of its own, for the pattern parts letters from marks.
_LAST_MARK = re.compile(rb"[!),.:;?](?<=[a-z].)(?=[\x09-\x0D\x20]|\Z)")
_MARK = np.zeros(256, bool)
_MARK[list(b"!),.:;?")] = True
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MOVED = [b for b in range(256) if b not in _PLAIN]
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
_ALPHABET = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(_MOVED)}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Memory(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}

    def trim(self) -> None:
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        if word in self.older:
            ids = self[word] = self.older[word]
            return ids
        text = word.decode("utf-8", "surrogatepass")
        if len(word) > _LONGEST:
            return self.whole(text)
        if _LETTERS.fullmatch(text):
            piece = text if text.isascii() else text.lower().encode().decode("latin-1").translate(_ALPHABET)
            found = self.merges(piece)
            ids = pack(f"<{len(found)}I", *[x.id for x in found])
        elif marked := _MARKED.fullmatch(text):
            ids = self[marked[1].encode()] + self[marked[2].encode()]
        else:
            ids = self.whole(text)
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)


@functools.cache
def _memory(path: str) -> _Memory:
    return _Memory(path)


@functools.cache
def word_encoder(path: str) -> Callable[[str | bytes], np.ndarray]:
    """text, or its UTF-8 -> ids as unsigned 32-bit numbers, by the tokenizer file at `path`."""
    memory = _memory(path)

    def encode(text: str | bytes) -> np.ndarray:
        memory.trim()
        data = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        # The vocabulary is lower case; only the names of its special tokens tell cases apart.
        words = data.split() if b"<|" in data else _LAST_MARK.sub(rb" \g<0>", data.lower()).split()
        return np.frombuffer(b"".join(map(memory.__getitem__, words)), "<u4")

    return encode


@functools.cache
def texts_encoder(path: str) -> Callable[[list[bytes]], Iterator[np.ndarray]]:
    """UTF-8 of texts -> ids of each, as `word_encoder` gives them; frequent words are looked up many at a time."""
    memory, slots, encode = _memory(path), _Slots(SLOT_BITS), word_encoder(path)

    def encode_all(texts: list[bytes]) -> Iterator[np.ndarray]:
        for some in pieces(texts):
            memory.trim()
            # Texts that may name special tokens are encoded alone.
            plain = [b"" if b"<|" in text else text for text in some]
            made = _together(memory, slots, plain)
            for text, left, ids in zip(some, plain, made, strict=True):
                yield ids if left or not text else encode(text)

    return encode_all


class _Slots:
    """Ids of words of up to 16 bytes and 8 ids, each in the place its bytes tell; a newer word takes the place over."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.bytes = np.zeros((2, 1 << bits), np.uint64)
        self.size, self.count = np.zeros((2, 1 << bits), np.uint8)
        self.ids = np.zeros((1 << bits, 8), np.uint16)

    def place(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mixed(first ^ mixed(second.copy())) >> self.shift).view(np.int64)

    def put(self, place: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray, held: list[bytes]) -> None:
        count = np.array([len(x) for x in held]) // 4
        at, own = np.unique(place, return_index=True)
        fits = (size[own] <= 16) & (count[own] <= 8)
        at, own = at[fits], own[fits]
        self.bytes[0, at], self.bytes[1, at], self.size[at], self.count[at] = first[own], second[own], size[own], count[own]
        ids = b"".join([held[i].ljust(32, b"\0") for i in own.tolist()])
        self.ids[at] = np.frombuffer(ids, "<u4").reshape(-1, 8)


def _together(memory: _Memory, slots: _Slots, texts: list[bytes]) -> list[np.ndarray]:
    """The ids of each text: those of words found in the slots, by all their bytes, and of other words from the memory."""
    words = Words(texts)
    words.part(_last_marks(words.data, words.starts, words.ends))
    size = words.ends - words.starts
    first, second = words.eight(words.starts, size), words.eight(words.starts + 8, np.maximum(size - 8, 0))
    place = slots.place(first, second)
    found = (slots.size[place] == size) & (slots.bytes[0][place] == first) & (slots.bytes[1][place] == second)
    other = np.flatnonzero(~found)
    spans = zip(words.starts[other].tolist(), words.ends[other].tolist(), strict=True)
    held = [memory[words.text[a:b]] for a, b in spans]
    count = slots.count[place].astype(np.int64)
    count[other] = np.array([len(x) for x in held], np.int64) // 4
    ends = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(8 * place - ends[:-1], count)
    source += np.arange(ends[-1])
    stream = slots.ids.reshape(-1).take(source, mode="clip").astype("<u4")
    stream[np.repeat(~found, count)] = np.frombuffer(b"".join(held), "<u4")
    if len(other):
        slots.put(place[other], first[other], second[other], size[other], held)
    bounds = ends[words.bounds].tolist()
    return [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _last_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that end with a mark after a letter, as in _LAST_MARK."""
    before = data[np.maximum(ends - 2, 0)]
    return np.flatnonzero(_MARK[data[ends - 1]] & (ends - starts > 1) & (before >= ord("a")) & (before <= ord("z")))
