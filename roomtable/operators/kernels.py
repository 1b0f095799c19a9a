"""NumPy kernels over blocks of scanlines; Spark deals the blocks and adds up what they give.

A block is BLOCK_ROWS rows of an image and the rows within reach of them. It crosses to
Python once, as Arrow batches, and gives sums, counts and profiles, or the block's own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_ROWS = 64


@dataclass(frozen=True)
class Block:
    """Rows of one image, sorted by y; the own ones stand between `before` and `after` others."""

    rows: np.ndarray
    y: np.ndarray
    before: int
    after: int
    height: int

    def around(self, values: np.ndarray, reach: int) -> np.ndarray:
        """The own rows of `values` with `reach` more on all four sides; the frame mirrors, edges not repeated."""
        up, down = min(self.before, reach), min(self.after, reach)
        part = values[self.before - up : len(values) - self.after + down]
        return np.pad(part, ((reach - up, reach - down), (reach, reach)), mode="reflect")

    def own(self, values: np.ndarray) -> np.ndarray:
        return values[self.before : len(values) - self.after]


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
_KINDS |= {f"array<{name}>": pa.list_(kind) for name, kind in _KINDS.items()}


def in_arrow(lines: DataFrame, keys: Sequence[str], kinds: dict[str, str]) -> str:
    """DDL of the keys, as `lines` has them, and of more columns."""
    own = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    return ", ".join([*(f"`{k}` {own[k]}" for k in keys), *(f"{name} {kind}" for name, kind in kinds.items())])


def with_keys(keys: pa.Table, found: dict, kinds: dict[str, str]) -> pa.Table:
    """The keys' row beside each of the rows found."""
    columns = [_column(found[name], _KINDS[kind]) for name, kind in kinds.items()]
    same = keys.take(np.zeros(len(columns[0]), np.int64))
    return pa.Table.from_arrays([*same.columns, *columns], [*keys.column_names, *kinds])


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray) and values.ndim == 2:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind.value_type))
    return pa.array(values, kind)


def by_blocks(
    lines: DataFrame, keys: Sequence[str], reach: int, kernel: Callable[[Block], dict], kinds: dict[str, str], rows: int = BLOCK_ROWS
) -> DataFrame:
    """`kernel` of every block of rows: the keys, and the columns named in `kinds`.

    lines: keys (with height), y, line. The kernel gives a list or array for each column.
    """
    keys = list(keys)
    dealt = lines.selectExpr(
        *keys,
        "cast(y AS bigint) AS y",
        "cast(line AS array<double>) AS line",
        f"""explode(sequence(greatest(0L, cast(floor((y - {reach}) / {rows}) AS bigint)),
             least(cast(floor((height - 1) / {rows}) AS bigint), cast(floor((y + {reach}) / {rows}) AS bigint)))) AS block""",
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        y = table.column("y").to_numpy()
        order = np.argsort(y, kind="stable")
        values, y = table.column("line").combine_chunks().flatten().to_numpy().reshape(len(y), -1)[order], y[order]
        first = table.column("block")[0].as_py() * rows
        before, after = int((y < first).sum()), int((y >= first + rows).sum())
        block = Block(values, y[before : len(y) - after], before, after, int(table.column("height")[0].as_py()))
        return with_keys(table.select(keys).slice(0, 1), kernel(block) if len(block.y) else {name: [] for name in kinds}, kinds)

    return dealt.groupBy(*keys, "block").applyInArrow(run, in_arrow(lines, keys, kinds))


def by_image(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """For each image in a batch of scanlines: its keys as one row, and all its values there."""
    columns = [batch.column(k).to_pylist() for k in keys]
    places: dict[tuple, list[int]] = {}
    for k, image in enumerate(zip(*columns, strict=True)):
        places.setdefault(image, []).append(k)
    table = pa.Table.from_batches([batch])
    for own in places.values():
        mine = table.take(np.array(own))
        yield mine.select(list(keys)).slice(0, 1), mine.column("line").combine_chunks().flatten().to_numpy()


# --- stencils ----------------------------------------------------------------


def weighted(values: np.ndarray, weights: Sequence[float], axis: int) -> np.ndarray:
    """Sum of neighbours along an axis; the axis gets shorter by the number of weights less one."""
    size = values.shape[axis] - len(weights) + 1
    take = lambda k: values[k : k + size] if axis == 0 else values[:, k : k + size]
    out = None
    for k, w in enumerate(weights):
        if w:
            term = take(k) if w == 1 else w * take(k)
            out = term.copy() if out is None else out + term
    return np.zeros_like(take(0)) if out is None else out


def binomial(values: np.ndarray) -> np.ndarray:
    """3 x 3 binomial sums, 16 times the mean; a row and column less on each side."""
    return weighted(weighted(values, (1, 2, 1), 0), (1, 2, 1), 1)


def sobel(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both 3 x 3 Sobel responses; a row and column less on each side."""
    return weighted(weighted(values, (1, 2, 1), 0), (-1, 0, 1), 1), weighted(weighted(values, (-1, 0, 1), 0), (1, 2, 1), 1)


def as_bytes(values: np.ndarray, whole: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return whole(np.clip(values, 0.0, 1.0) * 255.0).astype(np.int32)


def median3(values: np.ndarray) -> np.ndarray:
    """3 x 3 median of bytes; edge row and column repeat. A row that lacks its neighbour repeats too."""
    padded = np.pad(values.astype(np.uint8), 1, mode="edge")
    h, w = values.shape
    nine = [padded[i : i + h, j : j + w] for i in range(3) for j in range(3)]
    column = [_sorted3(*nine[j::3]) for j in range(3)]
    lows, mids, highs = zip(*column, strict=True)
    low = np.maximum(np.maximum(lows[0], lows[1]), lows[2])
    high = np.minimum(np.minimum(highs[0], highs[1]), highs[2])
    return _sorted3(low, _sorted3(*mids)[1], high)[1].astype(np.int32)


def _sorted3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct non-negative whole values with their counts."""
    n = np.bincount(values.ravel())
    met = np.flatnonzero(n)
    return met.astype(np.int32), n[met]


# --- edge profiles -----------------------------------------------------------


def peak_widths(profiles: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height, width, count) of the peaks of each row; widths of `most` and more are left out.

    A peak tops its left neighbour and is not below its right one. Its width reaches down
    both slopes, to the first step that does not fall.
    """
    lines, size = profiles.shape
    if size < 3 or not lines:
        return (np.empty(0, np.int32),) * 3
    place = np.arange(size)
    rises = np.zeros(profiles.shape, bool)
    rises[:, 1:] = profiles[:, :-1] < profiles[:, 1:]
    falls = np.zeros(profiles.shape, bool)
    falls[:, :-1] = profiles[:, 1:] < profiles[:, :-1]
    left = np.maximum.accumulate(np.where(rises, 0, place), axis=1)
    right = np.minimum.accumulate(np.where(falls, size - 1, place)[:, ::-1], axis=1)[:, ::-1]
    peak = np.zeros(profiles.shape, bool)
    peak[:, 1:-1] = rises[:, 1:-1] & (profiles[:, 1:-1] >= profiles[:, 2:])
    at = np.nonzero(peak)
    wide = np.minimum(right[at], at[1] + most) - np.maximum(left[at], at[1] - most) + 1
    good = wide < most
    pairs, n = np.unique(profiles[at][good].astype(np.int64) * most + wide[good], return_counts=True)
    return (pairs // most).astype(np.int32), (pairs % most).astype(np.int32), n.astype(np.int32)


# --- skylines ----------------------------------------------------------------

_OPEN = np.iinfo(np.int64).max


def column_tops(x0: np.ndarray, x1: np.ndarray, top: np.ndarray) -> tuple[int, np.ndarray]:
    """First column, and for each column from there the smallest top of the intervals over it (_OPEN if none)."""
    left = int(x0.min())
    line = np.full(int(x1.max()) - left + 1, _OPEN)
    for k in np.argsort(-top, kind="stable").tolist():
        line[x0[k] - left : x1[k] - left + 1] = top[k]
    return left, line


def steps(x0: np.ndarray, x1: np.ndarray, top: np.ndarray) -> dict[str, np.ndarray]:
    """The tops of all columns as steps (x0, x1, top)."""
    left, line = column_tops(x0, x1, top)
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    end = np.append(start[1:], len(line)) - 1
    covered = line[start] != _OPEN
    return {"x0": start[covered] + left, "x1": end[covered] + left, "top": line[start][covered]}


def skyline(runs: DataFrame, keys: Sequence[str], read: Callable[[np.ndarray], dict], kinds: dict[str, str], rows: int = BLOCK_ROWS) -> DataFrame:
    """`read` of the sorted column tops of each mask.

    Runs of a block of rows become steps, the steps of all blocks become the tops; so a
    mask is never spread out in pixels, and one task holds as many steps as a mask has
    columns and blocks.
    """
    keys = list(keys)
    edges = {"x0": "long", "x1": "long", "top": "long"}

    def columns(table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in edges]

    def of_block(table: pa.Table) -> pa.Table:
        return with_keys(table.select(keys).slice(0, 1).combine_chunks(), steps(*columns(table)), edges)

    def of_mask(table: pa.Table) -> pa.Table:
        line = column_tops(*columns(table))[1]
        return with_keys(table.select(keys).slice(0, 1).combine_chunks(), read(np.sort(line[line != _OPEN])), kinds)

    plain = runs.selectExpr(*keys, "cast(x0 AS bigint) AS x0", "cast(x1 AS bigint) AS x1", "cast(y AS bigint) AS top", f"cast(floor(y / {rows}) AS bigint) AS block")
    blocks = plain.groupBy(*keys, "block").applyInArrow(of_block, in_arrow(runs, keys, edges))
    return blocks.groupBy(*keys).applyInArrow(of_mask, in_arrow(runs, keys, kinds))
