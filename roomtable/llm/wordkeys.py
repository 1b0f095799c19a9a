"""Words of many texts at a time, and 64-bit keys that tell them apart, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are cut into words together.
PIECE = 1_000_000
#: Words of more bytes get their key one by one.
LONGEST = 512
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The bytes of eight that belong to a word with so many left.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FIRST, _SECOND, _SEED = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts side by side, A-Z lower-cased: bytes `starts` to `ends` of `data`."""

    def __init__(self, texts: list[bytes]):
        self.text = b"\n".join([*texts, b" " * 16]).lower()
        self.data = np.frombuffer(self.text, np.uint8)
        # Eight bytes from each place on; words are followed by sixteen blanks at least.
        self.eights = np.ndarray((len(self.data) - 7,), "<u8", self.text, strides=(1,))
        blank = np.concatenate([[True], _BLANK[self.data]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        places = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.bounds = np.searchsorted(self.starts, places)

    def eight(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes of words with `left` bytes to come, zero beyond their ends."""
        return self.eights[starts] & _MASKS[np.minimum(left, 8)]

    def part(self, last: np.ndarray) -> None:
        """Make the last byte of the words at these places a word of its own."""
        cut = self.ends[last] - 1
        self.bounds = self.bounds + np.searchsorted(last, self.bounds)
        self.ends = self.ends.copy()
        self.ends[last] = cut
        self.starts, self.ends = np.insert(self.starts, last + 1, cut), np.insert(self.ends, last + 1, cut + 1)

    def keys(self) -> np.ndarray:
        """A key for each word; words of one length up to eight bytes never share one."""
        size = self.ends - self.starts
        key = mixed(self.eight(self.starts, size) ^ (size.astype(np.uint64) * _SEED))
        for k in range(8, min(int(size.max(initial=0)), LONGEST), 8):
            going = np.flatnonzero(size > k) if k == 8 else going[size[going] > k]
            key[going] = mixed(key[going] ^ self.eight(self.starts[going] + k, size[going] - k))
        for i in np.flatnonzero(size > LONGEST).tolist():
            key[i] = xxhash.xxh64_intdigest(self.text[self.starts[i] : self.ends[i]])
        return key


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits, in place."""
    x ^= x >> _U(33)
    x *= _FIRST
    x ^= x >> _U(33)
    x *= _SECOND
    x ^= x >> _U(33)
    return x


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about PIECE bytes; a longer text is a run of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > PIECE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, ascending by key; for each place the number of its key)."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return order[fresh], number
