"""Benchmark decontamination by the q-gram lemma, with verification by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from roomtable.llm.shared import pair_ranges, whole_text

Q = 8
#: Bytes of a q-gram that candidates are counted by once more.
SHORT_Q = 4
#: Bytes of a segment of a benchmark item, wherever it starts.
SEGMENT = 80
#: Bytes between the places in a text that count as segments of their own.
STRIDE = 40
#: Share of a segment that may differ.
EDIT_SHARE = 0.1
#: Half the width of a diagonal band; above any edit budget, so overlapping bands miss nothing.
BAND = 16
#: Benchmark bytes that one index holds; a larger benchmark is gone through in blocks.
INDEX_BYTES = 8 << 20
_SLICE = 1 << 20
#: Segments of an item aligned together.
_AT_ONCE = 1024
_TABLE_BITS = 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MATCHES = ArrayType(StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("segments", IntegerType()), StructField("edits", IntegerType())]))


def normalised(text: str) -> bytes:
    """Lower case, words one blank apart, UTF-8."""
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def edit_budget(length: int) -> int:
    """Edits allowed in a segment, small enough for the lemma to ask for a shared q-gram."""
    return max(0, min(int(EDIT_SHARE * length), (length - Q) // Q, BAND - 1))


def least_shared(length: int) -> int:
    """Q-grams that survive any `edit_budget` edits: each edit destroys Q of them at most."""
    return max(1, length - Q + 1 - Q * edit_budget(length))


def segments_of(item: bytes) -> list[bytes]:
    """Every piece of SEGMENT bytes of the item; a short item is one."""
    return [item[s : s + SEGMENT] for s in range(max(1, len(item) - SEGMENT + 1))]


def _grams(data: np.ndarray) -> np.ndarray:
    """Each run of eight bytes as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(data, (len(data) - Q + 1, Q), (1, 1)).copy().view("<u8").ravel()


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _FACTOR >> np.uint64(64 - _TABLE_BITS)).astype(np.intp)


@dataclass(frozen=True)
class Index:
    """Q-grams of all items: sorted keys, their postings, and a bit table in front."""

    items: np.ndarray
    texts: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    entry: np.ndarray
    place: np.ndarray
    present: np.ndarray
    lengths: np.ndarray
    segment: np.ndarray
    least: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, str]]) -> Index:
        whole = [(item_id, normalised(text)) for item_id, text in rows]
        whole = [(item_id, text) for item_id, text in whole if len(text) >= Q]
        texts = [np.frombuffer(text, np.uint8) for _, text in whole]
        grams = [_grams(text) for text in texts]
        sizes = np.array([len(g) for g in grams], np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        entry = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(every, kind="stable")
        keys, first, count = np.unique(every[order], return_index=True, return_counts=True)
        present = np.zeros(1 << _TABLE_BITS, bool)
        present[_slot(keys)] = True
        lengths = np.array([len(t) for t in texts], np.int64)
        segment = np.minimum(lengths, SEGMENT)
        least = np.array([least_shared(n) for n in segment.tolist()], np.int64)
        return Index(np.array([i for i, _ in whole], np.int64), texts, keys, first, count, entry[order], place[order], present, lengths, segment, least)

    def regions(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(entry, low, high, first diagonal): segments starting in low..high of an item that share enough q-grams in a band.

        A diagonal is the place in the text minus the place in the item. Bands are
        2 * BAND wide and start every BAND, so the diagonals of an alignment within the
        budget lie in one of them. A q-gram of the item counts once in a band.
        """
        grams = _grams(data)
        at = np.flatnonzero(self.present[_slot(grams)])
        if not len(at) or not len(self.keys):
            return []
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        true = self.keys[key] == grams[at]
        at, key = at[true], key[true]
        text_place, posting = pair_ranges(at, np.ones(len(at), np.int64), self.first[key], self.count[key])
        entry, place = self.entry[posting], self.place[posting]
        span = int(self.lengths.max()) + 1
        offset = -(-span // BAND) * BAND
        band = (text_place - place + offset) // BAND
        bands = np.concatenate([band, band - 1])
        entry, place = np.tile(entry, 2), np.tile(place, 2)
        width = int(bands.max(initial=0)) + 2
        cell, place = np.divmod(np.unique((entry * width + bands + 1) * span + place), span)
        entry = cell // width
        upto = np.arange(len(cell)) + self.least[entry] - 1
        i = np.flatnonzero(upto < len(cell))
        j = upto[i]
        i, j = (x[(cell[j] == cell[i]) & (place[j] - place[i] <= self.segment[entry[i]] - Q)] for x in (i, j))
        if not len(i):
            return []
        cell, entry = cell[i], entry[i]
        low = np.maximum(place[j] + Q - self.segment[entry], 0)
        high = np.minimum(place[i], self.lengths[entry] - self.segment[entry])
        new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (low[1:] > high[:-1] + 1)))
        last = np.append(new[1:], len(cell)) - 1
        diagonal = (cell[new] % width - 1) * BAND - offset
        return list(zip(entry[new].tolist(), low[new].tolist(), high[last].tolist(), diagonal.tolist(), strict=True))


def _letters(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """data[start:stop] as numbers, with 256 for places outside."""
    out = np.full(stop - start, 256, np.int16)
    a, b = max(start, 0), min(stop, len(data))
    if a < b:
        out[a - start : b - start] = data[a:b]
    return out


def segment_edits(item: np.ndarray, starts: np.ndarray, size: int, data: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole segment of `size` bytes against any part of the text, and where that part ends.

    Only cells whose diagonal (text place minus item place) is in [first, first + width)
    are filled; a segment may start and end anywhere in the text.
    """
    far = 2 * size + width + 2
    base = int(starts.min())
    begin, stop = base + first, int(starts.max()) + first + width + size
    # Row 0 of `letters` is the character that one text character used before row 0 would be.
    letters = np.lib.stride_tricks.sliding_window_view(_letters(data, begin - 1, stop), width)
    used = np.arange(begin, stop + 1)
    valid = np.lib.stride_tricks.sliding_window_view((used >= 0) & (used <= len(data)), width)
    rows, step = starts - base, np.arange(width, dtype=np.int16)
    row = np.where(valid[rows], 0, far).astype(np.int16)
    down = np.full_like(row, far)
    for i in range(size):
        down[:, :-1] = row[:, 1:] + 1
        row += letters[rows + i + 1] != item[starts + i, None]
        np.minimum(row, down, out=row)
        row -= step
        np.minimum.accumulate(row, axis=1, out=row)
        row += step
        row[~valid[rows + i + 1]] = far
    best = row.argmin(axis=1)
    return row[np.arange(len(row)), best].astype(np.int64), size + starts + first + best


def banded_edits(pattern: bytes, text: bytes, first: int, width: int) -> tuple[int, int]:
    """`segment_edits` of one pattern."""
    edits, end = segment_edits(np.frombuffer(pattern, np.uint8), np.zeros(1, np.int64), len(pattern), np.frombuffer(text, np.uint8), first, width)
    return int(edits[0]), int(end[0])


def verified(item: np.ndarray, size: int, data: np.ndarray, low: int, high: int, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, place in the text) of the segments starting in low..high of the item that align within the budget.

    Equal segments are read off the diagonals. Others must keep enough short q-grams by
    the same lemma before they are aligned.
    """
    budget = edit_budget(size)
    rows = high - low + size
    letters = np.lib.stride_tricks.sliding_window_view(_letters(data, low + first, low + first + rows + width - 1), width)
    same = letters == item[low : low + rows, None]
    short = (same[:-3] & same[1:-2] & same[2:-1] & same[3:]).any(axis=1)
    kept = np.append(0, np.cumsum(short))
    starts = np.flatnonzero(kept[size - SHORT_Q + 1 :] - kept[: rows - size + 1] >= size - SHORT_Q + 1 - SHORT_Q * budget)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.zeros((rows + 1, width), np.int32)
    np.cumsum(same, axis=0, out=run[1:])
    equal = run[starts + size] - run[starts] == size
    exact = equal.any(axis=1)
    edits = np.zeros(len(starts), np.int64)
    place = low + starts + first + equal.argmax(axis=1)
    rest = np.flatnonzero(~exact)
    for part in np.split(rest, range(_AT_ONCE, len(rest), _AT_ONCE)):
        if len(part):
            edits[part], end = segment_edits(item, low + starts[part], size, data, first, width)
            place[part] = end - size
    within = edits <= budget
    return edits[within], np.maximum(place[within], 0)


def matches(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item_id, start, segments, edits) of each benchmark item with a segment in the text.

    start is the byte in the normalised text where the first verified segment's region
    begins, segments the number of verified regions that begin at least STRIDE bytes
    apart, edits the fewest of any.
    """
    whole = normalised(text)
    places: dict[int, list[np.ndarray]] = {}
    fewest: dict[int, int] = {}
    for k in range(0, max(len(whole) - Q + 1, 1), _SLICE):
        data = np.frombuffer(whole[k : k + _SLICE + 2 * SEGMENT], np.uint8)
        for entry, low, high, diagonal in index.regions(data):
            size = int(index.segment[entry])
            budget = edit_budget(size)
            for begin in range(low, high + 1, _AT_ONCE):
                upto = min(high, begin + _AT_ONCE - 1)
                edits, place = verified(index.texts[entry], size, data, begin, upto, diagonal - budget, 2 * BAND + 2 * budget)
                if len(edits):
                    places.setdefault(entry, []).append(k + place)
                    fewest[entry] = min(fewest.get(entry, SEGMENT), int(edits.min()))
    found: dict[int, list[int]] = {}
    for entry, parts in places.items():
        begins = np.unique(np.concatenate(parts)).tolist()
        number, last = 0, begins[0] - STRIDE
        for begin in begins:
            if begin - last >= STRIDE:
                number, last = number + 1, begin
        best = found.setdefault(int(index.items[entry]), [begins[0], 0, fewest[entry]])
        best[0], best[1], best[2] = min(best[0], begins[0]), best[1] + number, min(best[2], fewest[entry])
    return [(item, *best) for item, best in sorted(found.items())]


def _indexes(benchmark: DataFrame, index_bytes: int) -> Iterator[Index]:
    """Indexes over blocks of the benchmark, each of about `index_bytes` at most."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), whole_text().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // index_bytes
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index.build([tuple(x) for x in rows.distinct().orderBy("item_id", "text").collect()])


def matches_column(docs: DataFrame, index: Index):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("item_id", "start", "segments", "edits"), m, strict=True)) for m in matches(t, shared.value)] for t in batch], dtype=object)

    return F.pandas_udf(search, _MATCHES)(whole_text())


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, start, segments, edits): each benchmark item that a row of `docs` holds a piece of.

    A piece is any SEGMENT bytes of the normalised item (all of it when shorter)
    that align with a region of the normalised text within `edit_budget` edits. Texts
    without a piece give no row. Items under Q bytes, null items and null item ids match
    nothing; null texts count as empty; repeated rows and items repeat or merge; a null
    doc_id stays null. The index is broadcast up to `index_bytes` of benchmark text; a
    larger benchmark is searched block by block with the same result.
    """
    parts = [
        docs.select("doc_id", F.explode(matches_column(docs, index)).alias("m")).select("doc_id", "m.*")
        for index in _indexes(benchmark, index_bytes)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    if len(parts) == 1:
        return whole
    # An item id whose texts fell into different blocks gives one row again.
    return whole.groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.sum("segments").cast("int").alias("segments"), F.min("edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of `docs` that hold no piece of the benchmark, with all of their columns."""
    for index in _indexes(benchmark, index_bytes):
        docs = docs.where(F.size(matches_column(docs, index)) == 0)
    return docs
