"""Connected components of run masks, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtable.operators import masks as M
from roomtable.session import cut_lineage

_SHIFT = 1 << 32
_STARS_PER_ROUND = 3


def run_id() -> Column:
    """Number of a run inside its mask, in raster order of its first pixel."""
    return (F.col("y") * F.lit(_SHIFT) + F.col("x0")).cast("bigint")


def _touching(runs: DataFrame, keys: Sequence[str], reach: Column) -> DataFrame:
    """(keys, hi, lo) for runs of neighbouring rows that touch, in one sweep of both rows.

    Runs of one row are apart, so of two runs that touch, the one that starts later
    touches the last run of the other row that starts before it. A run therefore looks at
    one run only, and the work is linear in runs. reach is 1 where corners count, else 0.
    """
    span = [F.col("x0"), (F.col("x1") + reach).alias("_end"), F.col("_id")]
    upper = runs.select(*keys, (F.col("y") + 1).alias("y"), *span, F.lit(0).alias("_side"))
    lower = runs.select(*keys, "y", *span, F.lit(1).alias("_side"))
    sweep = Window.partitionBy(*keys, "y").orderBy("x0", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda side: F.last(F.when(F.col("_side") == side, F.struct("_id", "_end")), ignorenulls=True).over(sweep)
    both = upper.unionByName(lower).select("*", seen(0).alias("_up"), seen(1).alias("_down"))
    below = F.col("_side") == 1
    return (
        both.withColumn("_other", F.when(below, F.col("_up")).otherwise(F.col("_down")))
        .where(F.col("_other._end") >= F.col("x0"))
        .select(
            *keys,
            F.when(below, F.col("_id")).otherwise(F.col("_other._id")).alias("hi"),
            F.when(below, F.col("_other._id")).otherwise(F.col("_id")).alias("lo"),
        )
    )


def components(runs: DataFrame, keys: Sequence[str], connectivity: int = 8, reach: Column | None = None) -> DataFrame:
    """Adds `part`, the number of the first run of the component of each run.

    `reach`, 1 or 0 by the keys, stands for the connectivity of masks that differ in it.

    Alternates two star steps on the touching graph: every node points its larger
    neighbours, then its smaller ones, at the smallest neighbour it knows. Chains
    shrink geometrically, so long winding masks take few rounds too. Only a yes or
    no per round reaches the driver.
    """
    keys = list(keys)
    nodes = cut_lineage(runs.withColumn("_id", run_id()))
    edges = _touching(nodes, keys, F.lit(1 if connectivity == 8 else 0) if reach is None else reach)
    while True:
        for _ in range(_STARS_PER_ROUND):
            edges = _small_star(_large_star(edges, keys), keys)
        edges = cut_lineage(edges)
        if _settled(edges, keys):
            break
    roots = edges.select(*keys, F.col("hi").alias("_id"), F.col("lo").alias("_root"))
    return (
        nodes.join(roots, [*keys, "_id"], "left")
        .withColumn("part", F.coalesce("_root", "_id"))
        .drop("_id", "_root")
    )


def _settled(edges: DataFrame, keys: list[str]) -> bool:
    """True when no node is both pointed at and pointing: each part is one star."""
    end = lambda n, side: F.struct(F.col(n).alias("n"), F.lit(side).alias("side"))
    ends = edges.select(*keys, F.explode(F.array(end("hi", 1), end("lo", 2))).alias("e"))
    roles = ends.groupBy(*keys, "e.n").agg(F.bit_or("e.side").alias("roles"))
    return roles.where(F.col("roles") == 3).isEmpty()


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Point every larger neighbour of a node at the smallest node it knows."""
    end = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = edges.select(*keys, F.explode(F.array(end("hi", "lo"), end("lo", "hi"))).alias("e"))
    least = F.least(F.min("e.v").over(Window.partitionBy(*keys, "e.u")), F.col("e.u"))
    return (
        both.select(*keys, "e.u", "e.v", least.alias("m"))
        .where(F.col("v") > F.col("u"))
        .select(*keys, F.col("v").alias("hi"), F.col("m").alias("lo"))
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Point the node and its smaller neighbours at the smallest of them."""
    least = F.min("lo").over(Window.partitionBy(*keys, "hi"))
    to = lambda u: F.struct(u.alias("hi"), F.col("m").alias("lo"))
    return (
        edges.select(*keys, "hi", "lo", least.alias("m"))
        .select(*keys, F.explode(F.array(to(F.col("hi")), to(F.col("lo")))).alias("e"))
        .where(F.col("e.hi") != F.col("e.lo"))
        .select(*keys, "e.hi", "e.lo")
        .distinct()
    )


def part_facts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area and box of each component."""
    return parts.groupBy(*keys, "part").agg(
        M.area().alias("pixels"),
        F.min("x0").alias("left"),
        F.min("y").alias("top"),
        F.max("x1").alias("right"),
        F.max("y").alias("bottom"),
    )


def clean_mask(runs: DataFrame, keys: Sequence[str], min_ratio: float = 0.002) -> DataFrame:
    """Drops small parts; holes stay."""
    parts = components(runs, keys, 8)
    large = (
        part_facts(parts, keys)
        .where(F.col("pixels") >= F.col("width") * F.col("height") * min_ratio)
        .select(*keys, "part")
    )
    return parts.join(large, [*keys, "part"], "left_semi").drop("part")


def refine_mask(
    runs: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    radius: int = 1,
    min_part_ratio: float = 0.002,
    max_hole_ratio: float = 0.0004,
) -> DataFrame:
    """Small opening, 3x3 closing, small parts out, small compact holes filled.

    radius is that of the opening disc; opening_radius() gives it for a frame.
    """
    keys = list(keys)
    opened = M.dilate(
        M.erode(runs, keys, M.disc(radius), outside=True), keys, M.disc(radius)
    )
    closed = M.erode(M.dilate(opened, keys, M.square(1)), keys, M.square(1), outside=True)
    clean = cut_lineage(clean_mask(closed, keys, min_part_ratio))
    holes = components(M.complement(clean, frames, keys), keys, 4)
    facts = part_facts(holes, keys)
    w = F.col("right") - F.col("left") + 1
    h = F.col("bottom") - F.col("top") + 1
    side = F.least("width", "height")
    inside = (
        (F.col("left") > 0)
        & (F.col("top") > 0)
        & (F.col("right") < F.col("width") - 1)
        & (F.col("bottom") < F.col("height") - 1)
    )
    fill = facts.where(
        inside
        & (F.col("pixels") < F.col("width") * F.col("height") * max_hole_ratio)
        & (F.col("pixels") / (w * h) > 0.45)
        & (F.greatest(w, h) < 0.03 * side)
    ).select(*keys, "part")
    filled = holes.join(fill, [*keys, "part"], "left_semi").drop("part")
    return M.union_of(clean.unionByName(filled), keys)


def opening_radius(width: int, height: int) -> int:
    size = max(3, round(min(width, height) * 0.0035))
    size += 1 - size % 2
    return (size - 1) // 2


def parts_and_gaps(runs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Runs with their 8-connected, and the background's with their 4-connected component, in one labelling."""
    keys = list(keys)
    gaps = M.complement(runs, frames, keys).select(*keys, "y", "x0", "x1", F.lit("gap").alias("kind"))
    both = runs.select(*keys, "y", "x0", "x1", F.lit("part").alias("kind")).unionByName(gaps)
    corners = F.when(F.col("kind") == "part", 1).otherwise(0)
    labelled = cut_lineage(components(both, [*keys, "kind"], reach=corners))
    return tuple(labelled.where(F.col("kind") == kind).drop("kind") for kind in ("part", "gap"))


def containment(parts: DataFrame, gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The forest of parts and gaps: what lies in what, how deep, and from which root.

    parts are runs with the number of their 8-connected component, gaps those of the
    background with the number of their 4-connected one. A component lies in the one of
    the other kind that holds the pixel left of its first pixel; gaps that touch the frame
    are no holes and have no parent, so parts in them are roots of depth 0. Rows: keys,
    kind, node, pixels, box, open (touches the frame), parent, depth, root. Depths come by
    pointer jumping, in as many rounds as the logarithm of the deepest nesting.
    """
    keys = list(keys)
    facts, ends = [], []
    for kind, runs in (("part", parts), ("gap", gaps)):
        own = part_facts(runs, keys).withColumnRenamed("part", "node")
        facts.append(own.withColumn("kind", F.lit(kind)))
        other = "gap" if kind == "part" else "part"
        ends.append(runs.select(*keys, "y", F.col("x1").alias("_end"), F.col("part").alias("parent"), F.lit(other).alias("kind")))
    nodes = facts[0].unionByName(facts[1])
    open_ = (F.col("left") == 0) | (F.col("top") == 0) | (F.col("right") == F.col("width") - 1) | (F.col("bottom") == F.col("height") - 1)
    nodes = nodes.withColumns(
        {"open": open_, "y": F.floor(F.col("node") / _SHIFT).cast("bigint"), "_end": F.col("node") % _SHIFT - 1}
    )
    linked = nodes.join(ends[0].unionByName(ends[1]), [*keys, "kind", "y", "_end"], "left").drop("y", "_end")
    outer = nodes.where("kind = 'gap' AND open").select(*keys, F.col("node").alias("parent"), F.lit("part").alias("kind"), F.lit(True).alias("_outer"))
    linked = linked.join(outer, [*keys, "kind", "parent"], "left")
    rootless = F.col("_outer") | ((F.col("kind") == "gap") & F.col("open"))
    linked = linked.withColumn("parent", F.when(~F.coalesce(rootless, F.lit(False)), F.col("parent"))).drop("_outer")
    return cut_lineage(_with_depths(cut_lineage(linked), keys))


def _with_depths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds depth and root; every jump doubles the distance a node looks up.

    A node that looks up no more knows its depth and root.
    """
    other = F.when(F.col("kind") == "part", "gap").otherwise("part")
    up = nodes.select(
        *keys, "kind", "node", F.col("parent").alias("_to"), F.when(F.col("parent").isNotNull(), other).alias("_to_kind"),
        F.col("parent").isNotNull().cast("bigint").alias("depth"), F.col("node").alias("root"),
    )
    while not (up := cut_lineage(up)).where("_to IS NOT NULL").isEmpty():
        above = up.select(
            *keys, F.col("kind").alias("_to_kind"), F.col("node").alias("_to"), F.col("_to").alias("_next"),
            F.col("_to_kind").alias("_next_kind"), F.col("depth").alias("_more"), F.col("root").alias("_top"),
        )
        up = up.join(above, [*keys, "_to", "_to_kind"], "left").select(
            *keys, "kind", "node", F.col("_next").alias("_to"), F.col("_next_kind").alias("_to_kind"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.coalesce("_top", "root").alias("root"),
        )
    return nodes.join(up.select(*keys, "kind", "node", "depth", "root"), [*keys, "kind", "node"])


def zone_forest(
    parts: DataFrame,
    gaps: DataFrame,
    keys: Sequence[str],
    max_zones: int = 3,
    min_zone_ratio: float = 0.01,
    min_hole_ratio: float = 0.0005,
) -> DataFrame:
    """One row per mask: `floor_zones`, its largest parts with the holes inside them.

    parts and gaps as for `containment`. A zone has rank, part, pixels, box and holes; a hole
    has pixels, box and the number and pixels of the parts that lie in it. Masks without a
    zone have no row. The zones of a mask are at most `max_zones`, its holes those above
    `min_hole_ratio` of the frame.
    """
    keys = list(keys)
    forest = containment(parts, gaps, keys)
    total = F.col("width") * F.col("height")
    box = F.struct("left", "top", "right", "bottom").alias("box")
    islands = forest.where("kind = 'part' AND parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("islands"), F.sum("pixels").alias("island_pixels")
    )
    holes = (
        forest.where("kind = 'gap' AND parent IS NOT NULL").where(F.col("pixels") >= total * min_hole_ratio)
        .join(islands, [*keys, "node"], "left")
        .groupBy(*keys, F.col("parent").alias("node"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("node").alias("first"), "pixels", box,
                        F.coalesce("islands", F.lit(0)).alias("islands"), F.coalesce("island_pixels", F.lit(0)).alias("island_pixels"),
                    )
                )
            ).alias("holes")
        )
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("pixels"), "node")
    zones = (
        forest.where("kind = 'part'").where(F.col("pixels") >= total * min_zone_ratio)
        .withColumn("zone", F.row_number().over(order).cast("bigint")).where(F.col("zone") <= max_zones)
        .join(holes, [*keys, "node"], "left")
    )
    empty = F.array().cast(holes.schema["holes"].dataType)
    zone = F.struct("zone", F.col("node").alias("part"), "pixels", box, F.coalesce("holes", empty).alias("holes"))
    return zones.groupBy(*keys).agg(F.sort_array(F.collect_list(zone)).alias("floor_zones"))


def floor_zones(
    runs: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    max_zones: int = 3,
    min_zone_ratio: float = 0.01,
    min_hole_ratio: float = 0.0005,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Largest parts per mask with rank, box, area, and the holes inside them.

    A hole is a 4-connected background part off the frame edge; it belongs to the
    part that holds the pixel left of its first run. parts are the 8-connected
    components of runs, when the caller has them already.
    """
    keys = list(keys)
    parts = cut_lineage(components(runs, keys, 8)) if parts is None else parts
    sized = part_facts(parts, keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("pixels"), "part")
    total = F.col("width") * F.col("height")
    zones = (
        sized.where(F.col("pixels") >= total * min_zone_ratio)
        .withColumn("zone", F.row_number().over(order).cast("bigint"))
        .where(F.col("zone") <= max_zones)
    )
    gaps = components(M.complement(runs, frames, keys), keys, 4)
    holes = (
        part_facts(gaps, keys)
        .where(
            (F.col("left") > 0)
            & (F.col("top") > 0)
            & (F.col("right") < F.col("width") - 1)
            & (F.col("bottom") < F.col("height") - 1)
            & (F.col("pixels") >= total * min_hole_ratio)
        )
        .select(
            *keys,
            F.col("pixels").alias("hole_pixels"),
            F.floor(F.col("part") / _SHIFT).cast("bigint").alias("y"),
            (F.col("part") % _SHIFT - 1).alias("x1"),
        )
    )
    owned = (
        holes.join(parts.select(*keys, "y", "x1", "part"), [*keys, "y", "x1"])
        .groupBy(*keys, "part")
        .agg(F.count(F.lit(1)).alias("holes"), F.sum("hole_pixels").alias("hole_pixels"))
    )
    return (
        zones.join(owned, [*keys, "part"], "left")
        .select(
            *keys, "zone", "part", "pixels", "left", "top", "right", "bottom",
            F.coalesce("holes", F.lit(0)).alias("holes"),
            F.coalesce("hole_pixels", F.lit(0)).alias("hole_pixels"),
        )
    )


def rug_signal(
    rugs: DataFrame, frames: DataFrame, keys: Sequence[str], min_ratio: float = 0.002
) -> DataFrame:
    """Share of rug pixels per frame, large rug parts, and the present flag."""
    keys = list(keys)
    facts = part_facts(components(rugs, keys, 8), keys)
    large = F.col("pixels") >= F.col("width") * F.col("height") * min_ratio
    summed = facts.groupBy(*keys).agg(
        F.sum("pixels").alias("pixels"), F.sum(F.when(large, 1).otherwise(0)).alias("rugs")
    )
    return frames.join(summed, keys, "left").select(
        *keys,
        F.coalesce("rugs", F.lit(0)).cast("bigint").alias("rugs"),
        (F.coalesce("pixels", F.lit(0)) / (F.col("width") * F.col("height"))).alias("area_ratio"),
        (F.coalesce("rugs", F.lit(0)) > 0).alias("present"),
    )


def thin_shapes(shapes: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Adds `thin`: nothing is left of the shape after erosion by a disc."""
    keys = list(keys)
    cores = M.erode(shapes, keys, M.disc(radius)).select(*keys).distinct()
    sizes = shapes.groupBy(*keys).agg(M.area().alias("pixels"))
    return sizes.join(cores.withColumn("_core", F.lit(True)), keys, "left").select(
        *keys, "pixels", F.col("_core").isNull().alias("thin")
    )
