"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: its model starts fresh, so any block can be read without
the others. Many blocks are coded side by side, one id of each at a time; every quantity
of the model is an array with one entry per block, and all of it is integer arithmetic,
so the reader repeats the writer exactly.

The model mixes three predictions. Order 2 and order 1 name the id that followed the same
two ids, or the same id, last time, with a confidence that rises with each hit. Order 0
is a distribution over all ids: shares of the number of bits of an id, which move towards
each id that is seen, even within one number of bits. Each order's share of the range is its hit rate so far at the
present confidence; what orders 2 and 1 leave goes to order 0.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

#: Ids of a block; ids are below LARGEST.
BLOCK = 512
LARGEST = 1 << 16
_BITS = 7
_CLASSES = 17
_U = np.uint64
_WORD = _U(32)
_LOW = _U(0xFFFFFFFF)
_FULL = _U(1 << 32)
_I = np.uint32
#: Order 0 has 2**14 parts; each number of bits keeps at least _LEAST of them.
_PARTS = 14
_LEAST = 32
_REST = (1 << _PARTS) - _CLASSES * _LEAST
#: Hit rates stay below this: what two sure orders leave still parts among all ids.
_SUREST = 61376
_INNER = np.arange(1, _CLASSES, dtype=np.int16)[:, None]
#: Odd multipliers that place contexts in a table.
_ONE, _TWO, _PAST = _I(2654435769), _I(2246822519), _I(3266489917)
_TOP = _I(32 - _BITS)
#: Lanes that are turned at a time, as one cache line holds few words.
_STRIP = 64


def _class(ids: np.ndarray) -> np.ndarray:
    """Number of bits of each id, from the exponent of its float."""
    exponent = ids.astype(np.float32).view(np.int32) >> np.int32(23)
    return np.maximum(exponent - np.int32(126), np.int32(0)).view(np.uint32)


def _reach(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first id, log2 of the number of ids) of each class."""
    return (_I(1) << classes) >> _I(1), classes - (classes > 0)


class _Model:
    """State of all blocks; row 0 of what has two rows is order 2, row 1 is order 1.

    `lane` counts the blocks still going, those of the longest first.
    """

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        both = np.arange(2 * lanes).reshape(2, lanes)
        self.base, self.slot = both << _BITS, both << 2
        self.place = np.zeros((2, lanes), np.uint32)
        self.past = np.zeros(lanes, np.uint32)
        # A cell holds (id + 1) * 4 + confidence; 0 is empty.
        self.table = np.zeros(2 * lanes << _BITS, np.uint32)
        self.rates = np.tile(np.array([0, *[1 << 14] * 3], np.int32), 2 * lanes)
        # Row k: parts of order 0 below class k, beyond the least ones, for each lane.
        even = np.arange(_CLASSES + 1) * _REST // _CLASSES
        self.beyond = np.tile(even.astype(np.int16)[:, None], (1, lanes))
        self.moves = np.empty((_CLASSES - 1, lanes), np.int16)
        self.steps = 0

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes; the blocks of the others have ended."""
        self.lane, self.past = self.lane[:lanes], self.past[:lanes]
        for name in ("base", "slot", "place", "beyond", "moves"):
            setattr(self, name, getattr(self, name)[:, :lanes].copy())

    def predict(self):
        """(guesses of orders 2 and 1, share of order 2, share of order 1), in 2**32 parts."""
        self.cell = self.base + self.place
        self.held = self.table[self.cell]
        self.rate_at = self.slot + (self.held & _I(3))
        self.rate = self.rates[self.rate_at]
        # The guess of an empty cell is no id.
        self.guess = (self.held >> _I(2)) - _I(1)
        sure, one = self.rate.view(np.uint32)
        one = one * (_I(1 << 16) - sure)
        one *= self.guess[0] != self.guess[1]
        return self.guess, sure << _I(16), one

    def parts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts of order 0 below each lane's class, parts of the class)."""
        at = classes * np.int64(len(self.lane)) + self.lane
        flat = self.beyond.reshape(-1)
        below = flat.take(at, mode="clip")
        at += len(self.lane)
        width = flat.take(at, mode="clip") - below
        width += np.int16(_LEAST)
        return below.astype(np.uint32) + classes * _I(_LEAST), width.astype(np.uint32)

    def update(self, ids: np.ndarray, classes: np.ndarray) -> None:
        hit, held, now = self.guess == ids, self.held, self.rate
        aim = hit * np.int32(_SUREST - 512)
        aim += np.int32(512)
        aim -= now
        aim >>= np.int32(4)
        aim += now
        self.rates[self.rate_at] = aim
        held += (held & _I(3)) < _I(3)
        self.table[self.cell] = np.where(hit, held, ((ids + _I(1)) << _I(2)) + _I(1))
        # Each row moves towards its place when all parts but the least ones are the class seen.
        moves, inner = self.moves, self.beyond[1:-1]
        np.subtract(classes.astype(np.int16), _INNER, out=moves)
        moves >>= np.int16(15)
        moves &= np.int16(_REST)
        moves -= inner
        moves >>= np.int16(min(6, 2 + (self.steps + 1).bit_length() // 2))
        inner += moves
        self.steps += 1
        np.right_shift(ids * _TWO + self.past, _TOP, out=self.place[0])
        np.right_shift(ids * _ONE, _TOP, out=self.place[1])
        self.past = ids * _PAST


def _turned(table: np.ndarray) -> np.ndarray:
    """Rows as columns."""
    out = np.empty(table.shape[::-1], table.dtype)
    for k in range(0, max(table.shape), _STRIP):
        if table.shape[0] > table.shape[1]:
            out[:, k : k + _STRIP] = table[k : k + _STRIP].T
        else:
            out[k : k + _STRIP] = table[:, k : k + _STRIP].T
    return out


def _grid(blocks: list[np.ndarray]) -> np.ndarray:
    grid = np.zeros((len(blocks), max(map(len, blocks))), np.uint32)
    for i, block in enumerate(blocks):
        grid[i, : len(block)] = block
    return _turned(grid)


def _longest_first(lengths: list[int]) -> tuple[list[int], np.ndarray]:
    """The order of lanes, and for each step how many blocks have not ended."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ascending = np.array([lengths[i] for i in reversed(order)])
    return order, len(order) - np.searchsorted(ascending, np.arange(int(ascending[-1])), "right")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One code for each block of ids."""
    if any(len(b) and int(b.max()) >= LARGEST for b in blocks):
        raise ValueError(f"ids must be below {LARGEST}")
    if not any(map(len, blocks)):
        return [b""] * len(blocks)
    order, going = _longest_first([len(b) for b in blocks])
    grid, lanes = _grid([blocks[i] for i in order]), len(order)
    out = np.zeros((len(grid) + 3, lanes), np.uint32)  # by place, for lanes move on at about one pace
    flat, used = out.reshape(-1), np.zeros(lanes, np.int64)
    lows, spans, model = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), _Model(lanes)
    for t, live in enumerate(going.tolist()):
        if live < len(model.lane):
            model.keep(live)
        ids, low, span = grid[t, :live], lows[:live], spans[:live]
        classes = _class(ids)
        start, size = _interval(model, ids, classes, *model.predict())
        span >>= _WORD
        moved = span * start
        moved += low
        over = np.flatnonzero(moved < low)
        span *= size
        low[:] = moved
        if len(over):
            _carry(out, used, over)
        short = np.flatnonzero(span < _FULL)
        if len(short):
            own, at = low[short], used[short]
            flat[at * lanes + short] = own >> _WORD
            used[short] = at + 1
            low[short] = own << _WORD
            span[short] <<= _WORD
        model.update(ids, classes)
    for shift in (32, 0):
        out[used, np.arange(lanes)] = lows >> _U(shift) & _LOW
        used += 1
    out, coded = _turned(out[: int(used.max())]).astype("<u4", copy=False), [b""] * len(blocks)
    for lane, i in enumerate(order):
        coded[i] = out[lane, : used[lane]].tobytes() if len(blocks[i]) else b""
    return coded


def _interval(model, ids, classes, guess, share_two, share_one):
    """(start, size) of each id in 2**32 parts: order 2, then order 1, then order 0."""
    both = share_two + share_one
    part = ~both >> _I(_PARTS)
    first, shift = _reach(classes)
    below, size = model.parts(classes)
    size *= part
    size >>= shift
    below *= part
    below += both
    below += size * (ids - first)
    by_two, by_one = guess == ids
    start, size = np.where(by_one, share_two, below), np.where(by_one, share_one, size)
    return np.where(by_two, _I(0), start), np.where(by_two, share_two, size)


def _carry(out: np.ndarray, used: np.ndarray, over: np.ndarray) -> None:
    at = used[over] - 1
    while len(over):
        # A word that was full becomes 0 and carries on.
        word = out[at, over] + _I(1)
        out[at, over] = word
        full = word == 0
        over, at = over[full], at[full] - 1


def decode_blocks(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    if not any(lengths):
        return [np.zeros(0, "<u4") for _ in codes]
    order, going = _longest_first(lengths)
    words = [np.frombuffer(codes[i], "<u4") for i in order]
    lanes = len(order)
    data = np.zeros((lanes, max(map(len, words)) + 3), np.uint32)
    for lane, x in enumerate(words):
        data[lane, : len(x)] = x
    data = _turned(data)
    flat = data.reshape(-1)
    grid = np.zeros((len(going), lanes), np.uint32)
    # `code` is the distance of the code from the low end of the range.
    distances, used = data[0].astype(np.uint64) << _WORD | data[1], np.full(lanes, 2)
    spans, model = np.full(lanes, (1 << 64) - 1, np.uint64), _Model(lanes)
    for t, live in enumerate(going.tolist()):
        if live < len(model.lane):
            model.keep(live)
        code, span = distances[:live], spans[:live]
        (two, one), share_two, share_one = model.predict()
        both = share_two + share_one
        part = ~both >> _I(_PARTS)
        span >>= _WORD
        target = np.minimum(code // span, _LOW).astype(np.uint32)
        own = np.maximum(target, both) - both
        scaled = np.minimum(own // part, _I((1 << _PARTS) - 1)).astype(np.int16)
        np.subtract(scaled, _INNER * np.int16(_LEAST), out=model.moves)
        classes = (model.beyond[1:-1] <= model.moves).view(np.uint8).sum(0, dtype=np.uint8).astype(np.uint32)
        first, shift = _reach(classes)
        below, size = model.parts(classes)
        size *= part
        size >>= shift
        below *= part
        step = np.minimum((own - below) // size, (_I(1) << shift) - _I(1))
        ids = first + step
        start = both + below + size * step
        # The writer prefers order 2, then order 1, wherever their guess is right.
        by_one, by_two = target < both, target < share_two
        ids = np.where(by_two, two, np.where(by_one, one, ids))
        start = np.where(by_two, _I(0), np.where(by_one, share_two, start))
        size = np.where(by_two, share_two, np.where(by_one, share_one, size))
        code -= span * start
        span *= size
        short = np.flatnonzero(span < _FULL)
        if len(short):
            place = used[short]
            code[short] = code[short] << _WORD | flat[place * lanes + short]
            used[short] = place + 1
            span[short] <<= _WORD
        grid[t, :live] = ids
        model.update(ids, _class(ids))
    grid, ids = _turned(grid).astype("<u4", copy=False), [np.zeros(0, "<u4")] * len(codes)
    for lane, i in enumerate(order):
        ids[i] = grid[lane, : lengths[i]]
    return ids


def checksum(ids: np.ndarray) -> int:
    return crc32(np.asarray(ids, "<u4").tobytes())
