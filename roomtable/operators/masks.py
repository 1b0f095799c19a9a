"""Run algebra: masks as rows (keys..., y, x0, x1), ends included.

Runs of one mask never overlap on a row. `keys` names the mask and always includes
its `width` and `height`, which travel with every run, so no operator has to join
the frame back in. Everything here is one sweep per
image row: runs become +1/-1 steps, a running sum says which masks are open
between two steps, and a condition picks the stretches to keep. Work is linear
in runs and is split by (mask, row), so a huge mask is many small groups.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[Mapping[str, Column]], Column]


def cells_to_runs(cells: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Cell rows (keys, y, x) that are in the mask to runs."""
    kept = cells if where is None else cells.where(where)
    along = Window.partitionBy(*keys, "y").orderBy("x")
    island = (F.col("x") - F.row_number().over(along)).alias("_island")
    return (
        kept.select(*keys, "y", "x", island)
        .groupBy(*keys, "y", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
    )


def lines_to_runs(
    lines: DataFrame, keys: Sequence[str], values: str, sides: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Scanlines (keys, y, array) to runs with a `side` column, without a shuffle.

    Each side is a test on one value of the line; a run starts where the test
    turns true and ends where it turns false.
    """
    names = list(sides)
    tested = lines.select(
        *keys, "y", *[F.transform(values, sides[n]).alias(f"hit_{n}") for n in names]
    )
    return tested.select(
        *keys, "y", F.explode(F.concat(*[_line_runs(f"hit_{n}", n) for n in names])).alias("r")
    ).select(*keys, "r.side", "y", "r.x0", "r.x1")


def _line_runs(hits: str, side: str) -> Column:
    at = lambda i: F.coalesce(F.get(hits, i), F.lit(False))
    positions = F.sequence(F.lit(0), F.size(hits) - 1)
    starts = F.filter(positions, lambda i: at(i) & ~at(i - 1))
    ends = F.filter(positions, lambda i: at(i) & ~at(i + 1))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(
            F.lit(side).alias("side"), a.cast("bigint").alias("x0"), b.cast("bigint").alias("x1")
        ),
    )


def runs_to_cells(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*rest, F.explode(F.sequence("x0", "x1")).alias("x"))


def frame_runs(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-width run on every row of each frame (keys, width, height)."""
    return frames.select(
        *keys,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1)).alias("y"),
        F.lit(0).cast("bigint").alias("x0"),
        (F.col("width").cast("bigint") - 1).alias("x1"),
    )


def gather(sides: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Several masks in one table, told apart by `side`."""
    out = None
    for name, runs in sides.items():
        marked = runs.select(*keys, F.lit(name).alias("side"), "y", "x0", "x1")
        out = marked if out is None else out.unionByName(marked)
    return out


def stretches(
    tagged: DataFrame, keys: Sequence[str], names: Sequence[str], by: str = "side"
) -> DataFrame:
    """Sweep runs with a `side`: stretches (keys, y, x0, x1), one depth per side.

    Ties at one x share the running sum of all of them; only the last of a tie is
    followed by a larger x, so only it becomes a stretch. One shuffle in all.
    """
    step = lambda x, d: F.struct(x.cast("bigint").alias("x"), F.lit(d).alias("d"))
    steps = tagged.select(
        *keys, "y", by, F.explode(F.array(step(F.col("x0"), 1), step(F.col("x1") + 1, -1))).alias("s")
    )
    along = Window.partitionBy(*keys, "y").orderBy("s.x")
    upto = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    depth = lambda n: F.sum(F.when(F.col(by) == n, F.col("s.d")).otherwise(0)).over(upto)
    return steps.select(
        *keys,
        "y",
        F.col("s.x").alias("x0"),
        (F.lead("s.x").over(along) - 1).alias("x1"),
        *[depth(n).alias(n) for n in names],
    ).where(F.col("x0") <= F.col("x1"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join touching stretches of a row back into runs."""
    along = Window.partitionBy(*keys, "y").orderBy("x0")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.when(F.lag("x1").over(along) == F.col("x0") - 1, 0).otherwise(1)
    return (
        parts.withColumn("_fresh", fresh)
        .withColumn("_run", F.sum("_fresh").over(upto))
        .groupBy(*keys, "y", "_run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_run")
    )


def combine(sides: Mapping[str, DataFrame], keys: Sequence[str], keep: Keep) -> DataFrame:
    """Runs where keep(depths) holds; keep sees one depth column per side."""
    swept = stretches(gather(sides, keys), keys, list(sides))
    depths = {name: F.col(name) for name in sides}
    return merged(swept.where(keep(depths)).select(*keys, "y", "x0", "x1"), keys)


def set_op(first: DataFrame, second: DataFrame, keys: Sequence[str], op: str) -> DataFrame:
    """and, or, xor, minus of two masks."""
    tests: dict[str, Keep] = {
        "and": lambda d: (d["a"] > 0) & (d["b"] > 0),
        "or": lambda d: (d["a"] > 0) | (d["b"] > 0),
        "xor": lambda d: (d["a"] > 0) != (d["b"] > 0),
        "minus": lambda d: (d["a"] > 0) & (d["b"] <= 0),
    }
    return combine({"a": first, "b": second}, keys, tests[op])


def complement(runs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return set_op(frame_runs(frames, keys), runs, keys, "minus")


def union_of(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that may overlap to proper runs."""
    return combine({"a": runs}, keys, lambda d: d["a"] > 0)


# --- neighbourhoods --------------------------------------------------------


def disc(radius: int) -> list[tuple[int, int]]:
    """(row offset, half width) of a disc: half width round(r * sqrt(1 - dy²/r²))."""
    if radius <= 0:
        return [(0, 0)]
    return [
        (dy, round(radius * ((radius * radius - dy * dy) / (radius * radius)) ** 0.5))
        for dy in range(-radius, radius + 1)
    ]


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, radius) for dy in range(-radius, radius + 1)]


def half_width(radius: Column, dy: Column) -> Column:
    """disc() as a column, for sweeps over several tolerances."""
    r = radius.cast("double")
    return F.when(r > 0, F.rint(r * F.sqrt((r * r - dy * dy) / (r * r)))).otherwise(0).cast("bigint")


def kernel_rows(kernel: Sequence[tuple[int, int]]) -> tuple[Column, Callable[[Column], Column]]:
    """A fixed kernel as (rows to explode, half width of a row)."""
    rows = F.array(*[F.lit(dy).cast("bigint") for dy, _ in kernel])

    def width_at(dy: Column) -> Column:
        widths = {hw for _, hw in kernel}
        if len(widths) == 1:
            return F.lit(widths.pop()).cast("bigint")
        chosen = F.lit(kernel[0][1]).cast("bigint")
        for row, hw in kernel:
            chosen = F.when(dy == row, F.lit(hw).cast("bigint")).otherwise(chosen)
        return chosen

    return rows, width_at


def disc_rows(radius: Column) -> tuple[Column, Callable[[Column], Column]]:
    r = radius.cast("bigint")
    return F.sequence(-r, r), lambda dy: half_width(radius, dy)


def spread(runs: DataFrame, keys: Sequence[str], kernel) -> DataFrame:
    """Every run shifted by the kernel and cut to its frame; runs may overlap.

    kernel is what kernel_rows() or disc_rows() give.
    """
    rows, width_at = kernel
    dy = F.col("_dy")
    return (
        runs.withColumn("_dy", F.explode(rows))
        .select(
            *keys,
            (F.col("y") + dy).alias("y"),
            F.greatest(F.col("x0") - width_at(dy), F.lit(0)).alias("x0"),
            F.least(F.col("x1") + width_at(dy), F.col("width") - 1).alias("x1"),
        )
        .where((F.col("y") >= 0) & (F.col("y") < F.col("height")))
    )


def with_surroundings(
    runs: DataFrame, keys: Sequence[str], radius: Column, wanted: Column, name: Column
) -> DataFrame:
    """Each run under its side and, where wanted, its disc of that radius under name.

    One pass: the explode over kernel rows has one more entry for the run itself.
    """
    r = radius.cast("bigint")
    dy = F.col("_dy")
    moved = dy.isNotNull()
    self_ = F.array(F.lit(None).cast("bigint"))
    hw = half_width(radius, dy)
    return (
        runs.withColumn("_dy", F.explode(F.when(wanted, F.concat(F.sequence(-r, r), self_)).otherwise(self_)))
        .select(
            *keys,
            F.when(moved, name).otherwise(F.col("side")).alias("side"),
            (F.col("y") + F.coalesce(dy, F.lit(0))).alias("y"),
            F.when(moved, F.greatest(F.col("x0") - hw, F.lit(0))).otherwise(F.col("x0")).alias("x0"),
            F.when(moved, F.least(F.col("x1") + hw, F.col("width") - 1)).otherwise(F.col("x1")).alias("x1"),
        )
        .where((F.col("y") >= 0) & (F.col("y") < F.col("height")))
    )


def dilate(runs: DataFrame, keys: Sequence[str], kernel) -> DataFrame:
    return union_of(spread(runs, keys, kernel_rows(kernel)), keys)


def dilate_by(runs: DataFrame, keys: Sequence[str], radius: Column) -> DataFrame:
    """Dilation by a disc whose radius is a column of `runs` (one of its keys)."""
    return union_of(spread(runs, keys, disc_rows(radius)), keys)


def erode(runs: DataFrame, keys: Sequence[str], kernel, outside: bool = False) -> DataFrame:
    """Erosion; `outside` says whether the world beyond the frame is in the mask.

    A pixel stays when, for every kernel row, its shrunk run covers it: the
    number of covering kernel rows equals the number of rows that count.
    """
    kernel = list(kernel)
    rows, width_at = kernel_rows(kernel)
    moved = runs.withColumn("_dy", F.explode(rows))
    hw = width_at(F.col("_dy"))
    left, right = F.col("x0") + hw, F.col("x1") - hw
    if outside:
        left = F.when(F.col("x0") <= 0, F.lit(0).cast("bigint")).otherwise(left)
        right = F.when(F.col("x1") >= F.col("width") - 1, F.col("width") - 1).otherwise(right)
    shrunk = moved.select(
        *keys,
        (F.col("y") - F.col("_dy")).alias("y"),
        left.alias("x0"),
        right.alias("x1"),
    ).where((F.col("x0") <= F.col("x1")) & (F.col("y") >= 0) & (F.col("y") < F.col("height")))
    swept = stretches(shrunk.withColumn("side", F.lit("a")), keys, ["a"])
    if outside:
        needed = F.aggregate(
            F.array(*[F.lit(dy) for dy, _ in kernel]),
            F.lit(0),
            lambda n, dy: n
            + F.when((F.col("y") + dy >= 0) & (F.col("y") + dy < F.col("height")), 1).otherwise(0),
        )
    else:
        needed = F.lit(len(kernel))
    return merged(swept.where(F.col("a") == needed).select(*keys, "y", "x0", "x1"), keys)


def edged(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs cut into stretches with `edge`: the pixel touches the outside.

    The frame edge counts as outside. One sweep holds the run itself and its three
    shrunk copies of the rows around: three copies deep means not on the edge.
    """
    shift = F.explode(F.array(*[F.lit(dy).cast("bigint") for dy in (-1, 0, 1, None)]))
    inner = F.col("_dy").isNotNull()
    pieces = (
        runs.withColumn("_dy", shift)
        .select(
            *keys,
            F.when(inner, "in").otherwise("run").alias("piece"),
            (F.col("y") + F.coalesce("_dy", F.lit(0))).alias("y"),
            (F.col("x0") + inner.cast("int")).alias("x0"),
            (F.col("x1") - inner.cast("int")).alias("x1"),
        )
        .where(F.col("x0") <= F.col("x1"))
    )
    swept = stretches(pieces, keys, ["run", "in"], by="piece")
    return swept.where(F.col("run") > 0).select(
        *keys, "y", "x0", "x1", (F.col("in") < 3).alias("edge")
    )


def inner_boundary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of the mask that touch its outside, as runs."""
    return merged(edged(runs, keys).where("edge").drop("edge"), keys)


def frame_band(frames: DataFrame, keys: Sequence[str], margin: Column) -> DataFrame:
    """Band along the frame, everything when the frame is too small for a middle."""
    rows = frames.withColumn("_m", margin.cast("bigint")).select(
        *keys,
        "_m",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1)).alias("y"),
    )
    m, w, h = F.col("_m"), F.col("width").cast("bigint"), F.col("height").cast("bigint")
    whole = (m * 2 >= F.least(w, h)) | (F.col("y") < m) | (F.col("y") >= h - m)
    zero = F.lit(0).cast("bigint")
    span = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))
    parts = F.when(whole, F.array(span(zero, w - 1))).otherwise(
        F.when(m > 0, F.array(span(zero, m - 1), span(w - m, w - 1))).otherwise(
            F.array().cast("array<struct<x0:bigint,x1:bigint>>")
        )
    )
    return rows.select(*keys, "y", F.explode(parts).alias("p")).select(*keys, "y", "p.x0", "p.x1")


# --- measures and constructors ----------------------------------------------


def area() -> Column:
    return F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint")


def coverage(runs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the frame in the mask; 0 for a frame without any run."""
    sums = runs.groupBy(*keys).agg(area().alias("pixels"))
    return frames.join(sums, list(keys), "left").select(
        *keys,
        F.coalesce("pixels", F.lit(0)).alias("pixels"),
        (F.coalesce("pixels", F.lit(0)) / (F.col("width") * F.col("height"))).alias("coverage"),
    )


def baseline_masks(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trivial candidates full and bottom-third; `empty` has no run by nature."""
    rows = frame_runs(frames, keys)
    names = F.when(
        F.col("y") >= F.floor(F.col("height") * 2 / 3), F.array(F.lit("full"), F.lit("bottom-third"))
    ).otherwise(F.array(F.lit("full")))
    return rows.select(*keys, "y", "x0", "x1", F.explode(names).alias("candidate"))


def _snapped() -> Column:
    """`points` (0..1) clamped to the frame and snapped to pixels."""
    return F.expr(
        """transform(points, p -> struct(
             rint(least(greatest(p.x, 0D), 1D) * (width - 1)) AS x,
             rint(least(greatest(p.y, 0D), 1D) * (height - 1)) AS y))"""
    )


def rasterise(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polygons and holes to runs: union of polygons minus union of holes.

    shapes: keys, shape_id, hole (boolean), points array<struct<x,y>> in 0..1.
    A pixel is inside when its centre is inside or on the outline: each row takes
    the even-odd spans of both half-open rules for vertices, and level edges.
    """
    keys = list(keys)
    edges = (
        shapes.withColumn("px", _snapped())
        .where("size(px) >= 3")
        .selectExpr(
            *keys,
            "shape_id",
            "hole",
            """explode(transform(sequence(0, size(px) - 1), i -> struct(
                 px[i] AS a, px[(i + 1) % size(px)] AS b))) AS e""",
        )
        .selectExpr(
            *keys, "shape_id", "hole", "e.a.x AS ax", "e.a.y AS ay", "e.b.x AS bx", "e.b.y AS by",
            "cast(least(e.a.y, e.b.y) AS bigint) AS top", "cast(greatest(e.a.y, e.b.y) AS bigint) AS bottom",
        )
    )
    crossings = (
        edges.where("top < bottom")
        .selectExpr("*", "explode(sequence(top, bottom)) AS y")
        .selectExpr("*", "explode(array(0, 1)) AS rule")
        .where("(rule = 0 AND y < bottom) OR (rule = 1 AND y > top)")
        .groupBy(*keys, "shape_id", "hole", "rule", "y")
        .agg(F.expr("array_sort(collect_list(ax + (y - ay) * (bx - ax) / (by - ay))) AS cx"))
    )
    spans = crossings.selectExpr(
        *keys,
        "hole",
        "y",
        """explode(transform(sequence(0, size(cx) div 2 - 1), i -> struct(
             cast(ceil(cx[i * 2]) AS bigint) AS x0, cast(floor(cx[i * 2 + 1]) AS bigint) AS x1))) AS r""",
    ).selectExpr(*keys, "hole", "y", "r.x0", "r.x1")
    level = edges.where("top = bottom").selectExpr(
        *keys, "hole", "top AS y", "cast(least(ax, bx) AS bigint) AS x0", "cast(greatest(ax, bx) AS bigint) AS x1"
    )
    filled = spans.unionByName(level).where("x0 <= x1").selectExpr(
        *keys, "if(hole, 'hole', 'poly') AS side", "y", "x0", "x1"
    )
    swept = stretches(filled, keys, ["poly", "hole"])
    return merged(swept.where("poly > 0 AND hole <= 0").select(*keys, "y", "x0", "x1"), keys)


def rasterise_polyline(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polylines (keys, points) one pixel wide: cells at integer steps, then runs."""
    keys = list(keys)
    stepped = (
        lines.withColumn("px", _snapped())
        .where("size(px) >= 2")
        .selectExpr(
            *keys,
            "explode(transform(sequence(0, size(px) - 2), i -> struct(px[i] AS a, px[i + 1] AS b))) AS e",
        )
        .selectExpr(
            *keys, "e", "cast(greatest(abs(e.b.x - e.a.x), abs(e.b.y - e.a.y)) AS bigint) AS n"
        )
        .selectExpr(*keys, "e", "n", "explode(sequence(0L, n)) AS t")
    )
    at = "cast(floor(e.a.{0} + (e.b.{0} - e.a.{0}) * (t / greatest(n, 1)) + 0.5D) AS bigint) AS {0}"
    cells = stepped.selectExpr(*keys, at.format("y"), at.format("x")).distinct()
    return cells_to_runs(cells, keys)
