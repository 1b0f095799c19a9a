"""Vanishing points, horizon, floor rails and metric scale.

Segments are rows (photo_id, seg_id, x0, y0, x1, y1) in a frame of known size;
floors are runs. Formulas are SQL text over columns, one select per step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtable.functions.draws import drawn, share
from roomtable.functions.numbers import codes, fixed
from roomtable.operators import kernels as K
from roomtable.operators.votes import REFINE_STEPS, Lines, VoteRules, photo_points
from roomtable.session import cut_lineage

#: Fixed values of the published geometry rules.
FOCAL_PRIOR = 0.7
FOCAL_MIN = 0.3
FOCAL_MAX = 1.6
CAMERA_HEIGHT_M = 1.5
PLANK_M = 0.092
DEPTH_OVER_WIDTH_MAX = 5.0
MIN_COVERAGE = 0.03
MIN_NEAR_PLANK_PX = 6.0
LIGHT_KIND = "photo-luma"
LIGHT = {"strength": 1.0, "blur_radius": 0.045, "ambient": 0.22, "tint": 0.5, "contact": 0.4, "exposure": 0.25}
BLOCKING_CHECKS = (
    "non_finite",
    "degenerate_plane",
    "horizon_below_floor",
    "horizon_out_of_frame",
    "non_positive_meters",
    "degenerate_zone",
    "zone_outside_image",
    "geometry_implausible",
    "plank_microscopic",
    "floor_touches_top",
    "fragmented_floor",
    "refiner_rewrote_mask",
)


#: Segments of a photo up to which its vote is one group; of others, about as many go to a task.
WHOLE_PHOTO = 1024


def segment_facts(segments: DataFrame) -> DataFrame:
    """Length, direction, angle from vertical and normalised line of each segment."""
    return (
        segments.selectExpr("*", "sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS length")
        .selectExpr(
            "*",
            "(x1 - x0) / if(length = 0, 1D, length) AS dx",
            "(y1 - y0) / if(length = 0, 1D, length) AS dy",
            "sqrt(pow(y0 - y1, 2) + pow(x1 - x0, 2)) AS _n",
        )
        .selectExpr(
            "*",
            "degrees(atan2(abs(dx), abs(dy))) AS vertical_deg",
            "(y0 - y1) / if(_n = 0, 1D, _n) AS la",
            "(x1 - x0) / if(_n = 0, 1D, _n) AS lb",
            "(x0 * y1 - x1 * y0) / if(_n = 0, 1D, _n) AS lc",
        )
        .drop("_n")
    )


#: SQL: angle between a segment and the ray from its middle to (vx, vy)
_TOWARDS = """degrees(asin(least(1D, if(reach < 1e-9, 0D, abs(dx * (vy - (y0 + y1) / 2) - dy * (vx - (x0 + x1) / 2))
  / if(reach < 1e-9, 1D, reach)))))"""
_REACH = "sqrt(pow(vx - (x0 + x1) / 2, 2) + pow(vy - (y0 + y1) / 2, 2)) AS reach"


def _angles(joined: DataFrame) -> DataFrame:
    return joined.selectExpr("*", _REACH).selectExpr("*", f"{_TOWARDS} AS angle").drop("reach")


def vanishing_points(
    segments: DataFrame, width: int, height: int, rules: VoteRules = VoteRules()
) -> DataFrame:
    """Up to three vanishing points per photo, strongest first.

    Each round draws `rules.draws` pairs of segments, longer ones more often and never one
    twice in a pair; adds up, for each crossing, the length of the segments that point at
    it; moves the best crossing to the point nearest to its segments' lines, if the vote
    there is about as good; and takes the segments that point at it out. One rule holds for
    any number of segments; equal (photo_id, seg_id) count as one line.

    A photo of up to WHOLE_PHOTO segments is one group: its segments are shuffled once, its
    draws and votes stay in the task. Photos with more are dealt in blocks of about as many,
    whose draws and votes are combined before each shuffle, so none is a single task.
    """
    ends = ["x0", "y0", "x1", "y1"]
    leaning = segment_facts(segments).where(f"vertical_deg > {rules.vertical_deg} AND photo_id IS NOT NULL")
    leaning = cut_lineage(leaning.select("photo_id", "seg_id", *ends))
    counts = leaning.groupBy("photo_id").agg(F.count(F.lit(1)).alias("segments"))
    crowded = cut_lineage(counts.where(f"segments > {WHOLE_PHOTO}"))
    some = not crowded.isEmpty()
    whole = leaning.join(crowded, "photo_id", "left_anti") if some else leaning
    kinds = {"rank": "long", "x": "double", "y": "double", "support": "double", "count": "long"}

    def run(table: pa.Table) -> pa.Table:
        seg = table.column("seg_id")
        lines = Lines.between(
            seg.cast(pa.int64()).fill_null(0).to_numpy(), seg.is_valid().to_numpy(), *(table.column(c).to_numpy() for c in ends)
        )
        points = photo_points(lines, int(table.column("photo_id")[0].as_py()), width, height, rules)
        found = zip(*points, strict=True) if points else [[]] * len(kinds)
        return K.with_keys(table.select(["photo_id"]).slice(0, 1), dict(zip(kinds, found, strict=True)), kinds)

    doubles = whole.selectExpr("photo_id", "seg_id", *[f"cast({c} AS double) AS {c}" for c in ends])
    found = doubles.groupBy("photo_id").applyInArrow(run, K.in_arrow(whole, ["photo_id"], kinds))
    if not some:
        return found
    block = f"pmod(hash(seg_id, x0, y0), cast(ceil(segments / {WHOLE_PHOTO}) AS int)) AS block"
    dealt = leaning.join(crowded, "photo_id").selectExpr("photo_id", "seg_id", *ends, block)
    return found.unionByName(_crowded_points(segment_facts(dealt), width, height, rules))


def _crowded_points(rest: DataFrame, width: int, height: int, rules: VoteRules) -> DataFrame:
    """The vote of `votes.photo_points` by joins; rest: the facts of leaning segments, and block."""
    found = None
    for number in range(1, rules.rounds + 1):
        rest = cut_lineage(rest.repartition("photo_id", "block"))
        best = cut_lineage(_strongest(rest, number, width, height, rules))
        point = best.withColumn("rank", F.lit(number).cast("bigint"))
        found = point if found is None else found.unionByName(point)
        near = _angles(rest.join(best.select("photo_id", "vx", "vy"), "photo_id"))
        rest = near.where(f"angle >= {2 * rules.tolerance_deg}").drop("vx", "vy", "angle")
    return found.select(
        "photo_id", "rank", F.col("vx").alias("x"), F.col("vy").alias("y"), "support", F.col("n").alias("count")
    )


def _drawn_pairs(pool: DataFrame, number: int, rules: VoteRules) -> DataFrame:
    """(photo_id, a, b, draw): distinct pairs of segments, each with its first draw.

    The two smallest of -log(uniform) / length are a draw of two without replacement whose
    chances follow the lengths. The second is the smallest of all but the first.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        mixed = rows.selectExpr("*", *drawn("h", "photo_id", number, "draw", "seg_id"))
        return mixed.selectExpr("*", f"-ln({share('h')}) / length AS key")

    some = pool.where("length > 0").select("photo_id", "seg_id", "length")
    first = (
        keyed(some.selectExpr("*", f"explode(sequence(0, {rules.draws - 1})) AS draw"))
        .groupBy("photo_id", "draw")
        .agg(F.min_by("seg_id", "key").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(f"n >= {rules.min_count}")
    )
    by_photo = first.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("draw", "a"))).alias("picks"))
    others = some.join(by_photo, "photo_id").selectExpr("photo_id", "seg_id", "length", "inline(picks)")
    pairs = (
        keyed(others.where("seg_id <> a"))
        .groupBy("photo_id", "draw", "a")
        .agg(F.min_by("seg_id", "key").alias("b"))
    )
    return pairs.groupBy("photo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min("draw").alias("draw")
    )


def _crossings(pool: DataFrame, pairs: DataFrame, width: int, height: int) -> DataFrame:
    """(photo_id, draw, vx, vy) of the pairs whose lines cross where a horizon can be."""
    line = ["la", "lb", "lc", "dx", "dy"]
    first = pool.select("photo_id", F.col("seg_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in line])
    second = pool.select("photo_id", F.col("seg_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in line])
    return (
        pairs.join(first, ["photo_id", "a"])
        .join(second, ["photo_id", "b"])
        .where("abs(a_dx * b_dy - a_dy * b_dx) >= sin(radians(1D))")
        .selectExpr(
            "photo_id",
            "draw",
            "a_lb * b_lc - a_lc * b_lb AS hx",
            "a_lc * b_la - a_la * b_lc AS hy",
            "a_la * b_lb - a_lb * b_la AS hw",
        )
        .where("abs(hw) >= 1e-12")
        .selectExpr("photo_id", "draw", "hx / hw AS vx", "hy / hw AS vy")
        .where(
            f"vy > -0.5 * {height} AND vy < 1.5 * {height} AND abs(vx - {width} / 2D) <= 12 * {width}"
        )
        .dropDuplicates(["photo_id", "draw"])
    )


def _votes(pool: DataFrame, points: DataFrame, rules: VoteRules, *moments) -> DataFrame:
    """Per point (photo_id, draw, vx, vy): total, n and `moments` over the segments that point at it."""
    near = _angles(pool.join(points, "photo_id")).where(f"angle < {rules.tolerance_deg}")
    return near.groupBy("photo_id", "draw", "vx", "vy").agg(
        F.sum(F.expr(f"length * (1 - angle / {rules.tolerance_deg})")).alias("total"),
        F.count(F.lit(1)).alias("n"),
        *moments,
    )


def _nearest_point(moments: DataFrame) -> DataFrame:
    """Adds rx, ry: the point whose homogeneous vector all lines come nearest to.

    The columns aa, ab, ... are the length-weighted moments of the lines' coefficients. The
    smallest eigenvector of their matrix comes out of inverse iteration with its adjugate;
    the first step, from (0, 0, 1), is the solution of the 2 x 2 normal equations.
    """
    found = moments.selectExpr(
        "*",
        "bb * cc - bc * bc AS _a", "ac * bc - ab * cc AS _b", "ab * bc - ac * bb AS _c",
        "aa * cc - ac * ac AS _d", "ab * ac - aa * bc AS _e", "aa * bb - ab * ab AS _f",
    )
    # one expression for all steps: as one select for each, a filter on rx would repeat them twofold a step
    step = """struct((_a * p.rx + _b * p.ry + _c) / nullif(_c * p.rx + _e * p.ry + _f, 0D) AS rx,
      (_b * p.rx + _d * p.ry + _e) / nullif(_c * p.rx + _e * p.ry + _f, 0D) AS ry)"""
    start = "struct(_c / nullif(_f, 0D) AS rx, _e / nullif(_f, 0D) AS ry)"
    moved = found.selectExpr("*", f"aggregate(sequence(1, {REFINE_STEPS}), {start}, (p, k) -> {step}) AS _p")
    return moved.selectExpr(*moments.columns, "_p.rx", "_p.ry")


def _strongest(pool: DataFrame, number: int, width: int, height: int, rules: VoteRules) -> DataFrame:
    crossings = _crossings(pool, _drawn_pairs(pool, number, rules), width, height)
    by_photo = crossings.groupBy("photo_id").agg(F.collect_list(F.struct("draw", "vx", "vy")).alias("points"))
    open_points = by_photo.selectExpr("photo_id", "inline(points)")
    top = _votes(pool, open_points, rules).groupBy("photo_id").agg(
        F.expr("min(struct(-round(total, 6) AS t, draw, vx, vy, total, n))").alias("b")
    )
    best = cut_lineage(top.selectExpr("photo_id", "b.draw", "b.vx", "b.vy", "b.total", "b.n"))
    product = lambda a, b: F.sum(F.expr(f"length * l{a} * l{b}")).alias(a + b)
    moments = [product(a, b) for a, b in ("aa", "ab", "ac", "bb", "bc", "cc")]
    own = _votes(pool, best.select("photo_id", "draw", "vx", "vy"), rules, *moments)
    moved = _nearest_point(own).where(f"ry > -0.5D * {height} AND ry < 1.5D * {height}")
    again = _votes(pool, moved.selectExpr("photo_id", "draw", "rx AS vx", "ry AS vy"), rules)
    again = again.selectExpr("photo_id", "struct(vx, vy, total, n) AS r")
    choice = best.join(again, "photo_id", "left").selectExpr(
        "photo_id", f"if(coalesce(r.total >= {rules.keep_refined}D * total, false), r, struct(vx, vy, total, n)) AS c"
    )
    return choice.selectExpr("photo_id", "c.vx", "c.vy", f"c.total / {width} AS support", "c.n").where(
        f"support >= {rules.min_support} AND n >= {rules.min_count}"
    )


def _ranked(points: DataFrame) -> DataFrame:
    """Points of a photo side by side: x1, y1, s1, x2, ... for ranks 1 to 3."""
    at = lambda c, k: F.max(F.expr(f"if(rank = {k}, {c}, NULL)"))
    return points.groupBy("photo_id").agg(
        *[at(c, k).alias(f"{a}{k}") for k in (1, 2, 3) for c, a in (("x", "x"), ("y", "y"), ("support", "s"))]
    )


def focal_estimate(
    photos: DataFrame, points: DataFrame, width: int, height: int
) -> DataFrame:
    """Focal length in pixels and its source.

    photos: photo_id, focal_35mm (nullable). EXIF wins, then the best supported
    plausible pair of vanishing points, then the prior.
    """

    def pair(i: int, j: int) -> str:
        ax, ay, bx, by = (
            f"(x{i} - {width} / 2D)", f"(y{i} - {height} / 2D)", f"(x{j} - {width} / 2D)", f"(y{j} - {height} / 2D)",
        )
        f = f"sqrt(-({ax} * {bx} + {ay} * {by}))"
        return f"""if(least(abs({ax}), abs({bx})) >= 0.04 * {width} AND greatest(abs({ax}), abs({bx})) <= 15 * {width}
          AND -({ax} * {bx} + {ay} * {by}) > 0 AND {f} BETWEEN {FOCAL_MIN} * {width} AND {FOCAL_MAX} * {width},
          struct(least(s{i}, s{j}) AS s, {-(i * 10 + j)} AS o, {f} AS f), NULL)"""

    wide = photos.join(_ranked(points), "photo_id", "left")
    best = wide.selectExpr(
        "*",
        f"array_max(array({pair(1, 2)}, {pair(1, 3)}, {pair(2, 3)})).f AS crossed",
        f"if(focal_35mm BETWEEN 3.0 AND 400.0, focal_35mm / 36.0D * greatest({width}, {height}), NULL) AS exif",
    )
    return best.selectExpr(
        "photo_id",
        f"coalesce(exif, crossed, {FOCAL_PRIOR} * {width}) AS focal_px",
        "CASE WHEN exif IS NOT NULL THEN 'exif' WHEN crossed IS NOT NULL THEN 'vanishing-points' ELSE 'prior' END AS focal_source",
    )


def horizon_estimate(photos: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """Horizon (share of the height), confidence and source from the points.

    photos: photo_id, ceiling (pixels, nullable): the horizon lies above the floor.
    """
    wide = photos.join(_ranked(points), "photo_id", "left")
    possible = lambda y: (
        f"({y} BETWEEN 0.05 * {height} AND 0.85 * {height} AND (ceiling IS NULL OR {y} <= ceiling))"
    )
    aligned = wide.selectExpr(
        "*",
        "degrees(atan2(y2 - y1, x2 - x1)) AS roll",
        f"y1 + (y2 - y1) * (({width} / 2D - x1) / nullif(x2 - x1, 0)) AS y_mid",
    ).selectExpr(
        "*",
        f"""coalesce(abs(x2 - x1) > 0.3 * {width} AND (abs(roll) <= 6 OR abs(abs(roll) - 180) <= 6)
             AND {possible('y_mid')}, false) AS two""",
        f"""CASE WHEN {possible('y1')} THEN struct(y1 AS y, s1 AS s) WHEN {possible('y2')} THEN struct(y2 AS y, s2 AS s)
             WHEN {possible('y3')} THEN struct(y3 AS y, s3 AS s) END AS one""",
    )
    return aligned.selectExpr(
        "photo_id",
        f"if(two, y_mid, one.y) / {height} AS horizon",
        "CASE WHEN two THEN 'lines-2vp' WHEN one IS NOT NULL THEN 'lines-1vp' END AS horizon_source",
        """CASE WHEN two THEN least(0.9D, 0.55D + 0.1D * least(s1, s2))
             WHEN one IS NOT NULL THEN least(0.8D, 0.45D + 0.1D * one.s) ELSE 0D END AS horizon_confidence""",
    )


# --- floor -----------------------------------------------------------------


FAR_EDGE_RANK = 0.15


def floor_extent(runs: DataFrame) -> DataFrame:
    """Coverage, far edge (15th percentile of column tops) and last row per floor."""
    keys = ["photo_id", "width", "height"]

    def read(tops: np.ndarray) -> dict:
        at = FAR_EDGE_RANK * (len(tops) - 1)
        low, high = int(tops[math.floor(at)]), int(tops[math.ceil(at)])
        return {"columns": [len(tops)], "far_edge_px": [low + (high - low) * (at - math.floor(at))]}

    tops = K.skyline(runs, keys, read, {"columns": "long", "far_edge_px": "double"})
    sums = runs.groupBy(*keys).agg(
        (F.sum(F.col("x1") - F.col("x0") + 1) / (F.col("width") * F.col("height"))).alias("coverage"),
        F.max("y").alias("bottom_px"),
    )
    return sums.join(tops, keys).select(*keys, "coverage", "columns", "far_edge_px", "bottom_px")


def floor_rails(runs: DataFrame, extent: DataFrame) -> DataFrame:
    """Crossing of the lines through the left and right floor ends, where they fit."""
    keys = ["photo_id", "width", "height"]
    rows = runs.groupBy(*keys, "y").agg(F.min("x0").alias("xl"), F.max("x1").alias("xr"))
    ends = rows.join(extent, keys).where("y >= floor(greatest(0, far_edge_px))")

    def side(name: str, x: str, test: str) -> list:
        pick = lambda e: F.expr(f"if({test}, cast({e} AS double), NULL)")
        return [
            F.count(pick(x)).alias(f"n_{name}"),
            (F.max(pick("y")) - F.min(pick("y"))).alias(f"span_{name}"),
            F.regr_slope(pick(x), pick("y")).alias(f"a_{name}"),
            F.regr_intercept(pick(x), pick("y")).alias(f"b_{name}"),
            F.var_pop(pick(x)).alias(f"vx_{name}"),
            F.covar_pop(pick(x), pick("y")).alias(f"c_{name}"),
        ]

    fits = ends.groupBy(*keys, "far_edge_px", "bottom_px").agg(
        *side("l", "xl", "xl > 1"), *side("r", "xr", "xr < width - 2")
    )
    ok = lambda s: (
        f"n_{s} >= greatest(8, floor(0.12D * (bottom_px - floor(greatest(0, far_edge_px)) + 1))) AND span_{s} >= 0.15D * height"
    )
    crossing = fits.where(f"{ok('l')} AND {ok('r')} AND abs(a_l - a_r) > 1e-6").selectExpr(
        *keys,
        "far_edge_px",
        "a_l",
        "b_l",
        "(b_r - b_l) / (a_l - a_r) AS rail_y",
        """(sqrt(greatest(vx_l - a_l * c_l, 0D)) + sqrt(greatest(vx_r - a_r * c_r, 0D))) / 2 / width AS rms""",
    )
    return crossing.where(
        "rail_y > -0.5D * height AND rail_y < far_edge_px - 0.02D * height"
    ).selectExpr(
        *keys,
        "a_l * rail_y + b_l AS rail_x",
        "rail_y",
        "least(greatest(0.85D - (rms - 0.01D) * 10, 0.5D), 0.85D) AS rail_confidence",
    )


def fuse_horizon(scenes: DataFrame) -> DataFrame:
    """Horizon from lines and rails: five outcomes, with method and confidence.

    scenes: far_edge_px, width, height, rail_x, rail_y, rail_confidence (nullable),
    horizon, horizon_confidence (nullable), line_x (x of the nearest line point).
    """
    lines = scenes.selectExpr(
        "*",
        "if(horizon * height < far_edge_px - 0.02D * height, horizon * height, NULL) AS _l",
    ).selectExpr(
        "*",
        """CASE WHEN rail_y IS NOT NULL AND _l IS NOT NULL THEN
             CASE WHEN abs(_l - rail_y) <= 0.05D * height THEN 'confirmed'
                  WHEN horizon_confidence >= 0.5 THEN 'lines' ELSE 'rails-kept' END
             WHEN _l IS NOT NULL THEN 'lines-only' WHEN rail_y IS NOT NULL THEN 'rails-only'
             ELSE 'fallback' END AS outcome""",
    )
    return lines.selectExpr(
        "*",
        """CASE outcome WHEN 'confirmed' THEN 0.5D * (_l + rail_y) WHEN 'lines' THEN _l WHEN 'rails-kept' THEN rail_y
             WHEN 'lines-only' THEN _l WHEN 'rails-only' THEN rail_y ELSE far_edge_px - 0.12D * height END AS horizon_px""",
        """CASE WHEN outcome = 'lines' THEN coalesce(line_x, rail_x)
             WHEN outcome = 'lines-only' THEN coalesce(line_x, width / 2D)
             WHEN outcome = 'fallback' THEN width / 2D ELSE rail_x END AS vx_px""",
        """CASE WHEN outcome IN ('lines', 'lines-only') THEN 'lines-vp' WHEN outcome = 'fallback' THEN 'far-edge-fallback'
             ELSE 'vanishing-point' END AS method""",
        """CASE outcome WHEN 'confirmed' THEN least(0.92D, greatest(rail_confidence, horizon_confidence) + 0.05D)
             WHEN 'lines' THEN horizon_confidence * 0.9D WHEN 'rails-kept' THEN rail_confidence - 0.1D
             WHEN 'lines-only' THEN horizon_confidence WHEN 'rails-only' THEN rail_confidence ELSE 0.45D END AS confidence""",
    ).drop("_l")


def floor_scale(scenes: DataFrame) -> DataFrame:
    """Quad, metres and plausibility from a fused horizon and a focal length.

    scenes: the columns of fuse_horizon and focal_px, focal_source.
    """
    clamped = scenes.selectExpr(
        "*", "least(greatest(horizon_px, 0.12D * height), 0.75D * height) AS h_px"
    ).selectExpr(
        "*",
        "1.08D * height AS y_near",
        "greatest(far_edge_px - 0.004D * height, h_px + 0.05D * height) AS y_far",
        "h_px <> horizon_px AS horizon_clamped",
    )
    sized = clamped.selectExpr(
        "*",
        "vx_px + (-0.08D * width - vx_px) * (y_far - h_px) / (y_near - h_px) AS x_far_left",
        "vx_px + (1.08D * width - vx_px) * (y_far - h_px) / (y_near - h_px) AS x_far_right",
        f"focal_px * {CAMERA_HEIGHT_M}D / (y_near - h_px) AS z_near",
        f"focal_px * {CAMERA_HEIGHT_M}D / (y_far - h_px) AS z_far",
    ).selectExpr(
        "*", "1.16D * width / focal_px * z_near AS w_raw", "z_far - z_near AS d_raw"
    ).selectExpr(
        "*",
        "least(greatest(w_raw, 1.5D), 14D) AS w_m",
        "least(greatest(d_raw, 0.8D), 20D) AS d_m",
    ).selectExpr(
        "*",
        "w_m <> w_raw OR d_m <> d_raw AS scale_clamped",
        f"d_m / w_m <= {DEPTH_OVER_WIDTH_MAX} AND d_m / w_m >= 0.2 AS plausible",
    )
    plank = f"{PLANK_M}D / {CAMERA_HEIGHT_M}D"
    return sized.select(
        *scenes.columns,
        (F.col("h_px") / F.col("height")).alias("horizon_share"),
        (F.col("far_edge_px") / F.col("height")).alias("far_edge"),
        *[
            F.expr(f"{x} / width").alias(f"qx{i}")
            for i, x in enumerate(("x_far_left", "x_far_right", "1.08D * width", "-0.08D * width"))
        ],
        *[F.expr(f"{y} / height").alias(f"qy{i}") for i, y in enumerate(("y_far", "y_far", "y_near", "y_near"))],
        fixed(F.col("w_m"), 2).alias("width_m"),
        fixed(F.col("d_m"), 2).alias("depth_m"),
        fixed(F.expr("d_m / w_m"), 2).alias("depth_over_width"),
        fixed(F.expr(f"{plank} * (height - h_px)"), 1).alias("plank_near_px"),
        fixed(F.expr(f"{plank} * 0.5D * (y_near + y_far - 2 * h_px)"), 1).alias("plank_mid_px"),
        fixed(F.expr(f"{plank} * (y_far - h_px)"), 1).alias("plank_far_px"),
        "plausible",
        F.expr(
            "if(focal_source = 'prior' OR scale_clamped OR NOT plausible, 'low', 'medium')"
        ).alias("metric_scale_confidence"),
        F.expr(
            """least(greatest(confidence - if(horizon_clamped, 0.1D, 0D) - if(scale_clamped, 0.05D, 0D)
                 - if(plausible, 0D, 0.1D), 0D), 1D)"""
        ).alias("perspective_confidence"),
    )


def scene_confidence(scenes: DataFrame) -> DataFrame:
    """Adds scene_confidence; scenes has large_parts (parts of 0.5 % and more)."""
    return scenes.withColumn(
        "scene_confidence",
        F.expr(
            """least(greatest(perspective_confidence
                 * CASE WHEN coverage < 0.08 THEN 0.6D WHEN coverage > 0.65 THEN 0.7D ELSE 1D END
                 * if(large_parts > 4, 0.85D, 1D)
                 * CASE WHEN far_edge <= 0.7 THEN 1D WHEN method = 'lines-vp' THEN 0.95D ELSE 0.8D END, 0D), 1D)"""
        ),
    )


def validate_scene(scenes: DataFrame) -> DataFrame:
    """Adds `checks`, the codes of the failed checks.

    scenes: floor_scale columns and zones, small_zones (below 0.5 %), box limits
    zone_left, zone_top, zone_right, zone_bottom (0..1), top_row, huge_parts (1 %
    and more), raw_pixels, changed_pixels.
    """
    q = [(f"qx{i}", f"qy{i}") for i in range(4)]
    shoelace = " + ".join(
        f"({q[i][0]} * {q[(i + 1) % 4][1]} - {q[(i + 1) % 4][0]} * {q[i][1]})" for i in range(4)
    )

    def turn(i: int) -> str:
        (ax, ay), (bx, by), (cx, cy) = q[i], q[(i + 1) % 4], q[(i + 2) % 4]
        return f"sign(({bx} - {ax}) * ({cy} - {by}) - ({by} - {ay}) * ({cx} - {bx}))"

    convex = f"abs({' + '.join(turn(i) for i in range(4))}) = 4"
    steps = scenes.selectExpr(
        "*",
        "(qx1 - qx2) * (qy3 - qy2) - (qx3 - qx2) * (qy1 - qy2) AS _d",
        "qx0 - qx1 + qx2 - qx3 AS _sx",
        "qy0 - qy1 + qy2 - qy3 AS _sy",
    ).selectExpr(
        "*",
        "(_sx * (qy3 - qy2) - (qx3 - qx2) * _sy) / nullif(_d, 0) AS _g",
        "((qx1 - qx2) * _sy - _sx * (qy1 - qy2)) / nullif(_d, 0) AS _h",
    ).selectExpr(
        "*",
        """(qx1 - qx0 + _g * qx1) * ((qy3 - qy0 + _h * qy3) - qy0 * _h)
           - (qx3 - qx0 + _h * qx3) * ((qy1 - qy0 + _g * qy1) - qy0 * _g)
           + qx0 * ((qy1 - qy0 + _g * qy1) * _h - (qy3 - qy0 + _h * qy3) * _g) AS _det""",
        " OR ".join(
            f"coalesce(isnan({c}), true) OR abs({c}) = double('infinity')"
            for c in ("qx0", "qx1", "qx2", "qx3", "qy0", "qy1", "qy2", "qy3", "horizon_share", "width_m", "depth_m")
        )
        + " AS _bad",
    )
    e = F.expr
    failed = codes(
        (e("_bad"), "non_finite"),
        (
            e(
                f"""NOT _bad AND (abs({shoelace}) / 2 < 0.001 OR NOT ({convex}) OR coalesce(abs(_det) < 1e-9, true)
                     OR NOT (qy0 < qy3 AND qy1 < qy2))"""
            ),
            "degenerate_plane",
        ),
        (e("NOT _bad AND NOT horizon_share < least(qy0, qy1)"), "horizon_below_floor"),
        (e("NOT _bad AND NOT horizon_share BETWEEN 0.05 AND 0.85"), "horizon_out_of_frame"),
        (e("NOT _bad AND (width_m <= 0 OR depth_m <= 0)"), "non_positive_meters"),
        (e("NOT _bad AND small_zones = zones"), "degenerate_zone"),
        (
            e("NOT _bad AND (zone_left < -0.01 OR zone_top < -0.01 OR zone_right > 1.01 OR zone_bottom > 1.01)"),
            "zone_outside_image",
        ),
        (e("NOT _bad AND NOT plausible"), "geometry_implausible"),
        (e(f"NOT _bad AND plank_near_px < {MIN_NEAR_PLANK_PX}"), "plank_microscopic"),
        (e("NOT _bad AND top_row < greatest(1, floor(0.04D * height))"), "floor_touches_top"),
        (e("NOT _bad AND huge_parts > 3"), "fragmented_floor"),
        (e("NOT _bad AND changed_pixels / greatest(1, raw_pixels) > 0.25"), "refiner_rewrote_mask"),
    )
    return steps.withColumn("checks", failed).drop("_d", "_sx", "_sy", "_g", "_h", "_det", "_bad")


def decide_render(scenes: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """Adds render_status and ordered reasons from scene_confidence and checks."""
    low = F.when(F.col("scene_confidence") < min_confidence, F.array(F.lit("low_confidence"))).otherwise(
        F.array().cast("array<string>")
    )
    ordered = F.array_intersect(F.array(*[F.lit(c) for c in BLOCKING_CHECKS]), F.col("checks"))
    return scenes.withColumn("reasons", F.concat(low, ordered)).withColumn(
        "render_status", F.when(F.size("reasons") == 0, "auto_render").otherwise("needs_manual_adjustment")
    )


def assemble_scene(scenes: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """Nested scene rows; without floor, zones or finite numbers there is no scene.

    scenes: the columns that scene_confidence and validate_scene read, floor_zones (the
    nested zones of regions.zone_forest) and rugs, rug_ratio (regions.rug_signal).
    """
    decided = decide_render(validate_scene(scene_confidence(scenes)), min_confidence)
    missing = F.expr(
        f"coalesce(coverage, 0) < {MIN_COVERAGE} OR coalesce(columns, 0) < width * 0.1 OR zones = 0"
    ) | F.array_contains("checks", "non_finite")
    confidence = fixed(F.col("scene_confidence"), 3)
    e = F.expr
    camera = F.struct(
        fixed(F.col("horizon_share"), 4).alias("horizon"),
        e("array(struct(vx_px / width AS x, horizon_share AS y, 1D AS weight, 'rails-sol' AS role))").alias("vanishing_points"),
        fixed(e("degrees(2 * atan(width / (2 * focal_px)))"), 1).alias("fov_deg"),
        F.lit(CAMERA_HEIGHT_M).alias("height_m"),
    )
    plane = F.struct(
        e("array(struct(qx0 AS x, qy0 AS y), struct(qx1 AS x, qy1 AS y), struct(qx2 AS x, qy2 AS y), struct(qx3 AS x, qy3 AS y))").alias("quad"),
        e("struct(width_m AS width, depth_m AS depth)").alias("meters"),
    )
    zones = F.transform(
        "floor_zones",
        lambda z: F.struct(
            F.concat(F.lit("sol-"), z["zone"]).alias("id"),
            F.lit("sol").alias("surface_id"),
            F.lit("sol").alias("plane_ref"),
            (z["zone"] - 1).alias("order"),
            confidence.alias("confidence"),
            z["pixels"].alias("pixels"),
            z["box"].alias("box"),
            z["holes"].alias("holes"),
        ),
    )
    scene = F.struct(
        F.lit("photo").alias("id"),
        F.lit("ai").alias("source"),
        confidence.alias("confidence"),
        F.struct("width", "height").alias("image"),
        camera.alias("camera"),
        e("array(struct('sol' AS id, true AS continuous))").alias("surfaces"),
        F.struct(plane.alias("sol")).alias("planes"),
        zones.alias("floor_zones"),
        F.struct(F.lit(LIGHT_KIND).alias("kind"), *[F.lit(v).alias(k) for k, v in LIGHT.items()]).alias("light"),
        F.expr(
            """array_compact(array('experimental_scene', concat('perspective_', method), 'scale_assumed',
                 if(array_contains(reasons, 'low_confidence'), 'low_confidence', NULL),
                 if(render_status = 'needs_manual_adjustment' AND NOT array_contains(reasons, 'low_confidence'),
                    'needs_manual_adjustment', NULL)))"""
        ).alias("warnings"),
    )
    return decided.select(
        "photo_id",
        F.when(missing, "no_floor").otherwise(F.col("render_status")).alias("status"),
        F.when(~missing, confidence).alias("confidence"),
        "reasons",
        F.struct((F.col("rugs") > 0).alias("present"), "rugs", fixed(F.col("rug_ratio"), 4).alias("area_ratio")).alias("rug"),
        F.struct(
            F.col("render_status").alias("status"), "reasons", confidence.alias("confidence"),
            F.lit(min_confidence).alias("min_confidence"), "checks",
        ).alias("decision"),
        F.when(~missing, scene).alias("scene"),
    )
