"""Exposure, sharpness and augmentation over scanlines.

An image is one row per scanline: (keys, y, line array<double>), keys including
width and height. Work on neighbouring rows happens in blocks of rows that carry
their halo along (`kernels`), so a tall image is many small groups and every stencil
of an image shares one shuffle. Blocks give sums, counts and profiles, not pixels.

Lines are never empty, so they are unnested with the outer form: for the inner
one the optimizer adds a size() filter on the array and pushes it down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.functions import vocabulary as V
from roomtable.functions.draws import drawn, share
from roomtable.functions.numbers import codes, fixed, ratio
from roomtable.functions.ranks import quantiles
from roomtable.functions.settings import DEFAULTS, Settings
from roomtable.operators import kernels as K
from roomtable.operators import masks as M
from roomtable.session import cut_lineage

#: Fixed values of the published measures.
STRONG_GRADIENT = 0.08
EDGE_STEP = 4
EDGE_MAX_WIDTH = 60
EDGE_STRONG_SHARE = 0.25
CLIP_HIGH = 254.0 / 255.0
CLIP_LOW = 1.0 / 255.0
SEED_MARGIN = 0.08
SEED_GAP = 0.04
SEED_OFFSET = 0.25
MAX_SEEDS = 12
GEOMETRIC_BLUR = 9
GEOMETRIC_FROM = 0.35

_BINS = 256
_STRIP = 64


def luma(df: DataFrame) -> DataFrame:
    """Rec. 709 luma of 8-bit r, g, b columns, 0..1."""
    weighted = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    return df.withColumn("luma", weighted / 255.0)


def image_info(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frames.select(
        *keys,
        fixed(F.col("width") / F.col("height"), 5).alias("aspect_ratio"),
        fixed(F.col("width") * F.col("height") / 1e6, 3).alias("megapixels"),
    )


# --- exposure --------------------------------------------------------------


def exposure_profile(
    lines: DataFrame, keys: Sequence[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """Mean, median, spread and clipping of the luma of each image.

    Scanlines become sums and a histogram where they lie; exact quantiles come from the
    values of the few bins that hold their ranks, in a second reading.
    """
    keys = list(keys)
    limits = [
        ("dark", lambda v: v < settings.dark_luma_max),
        ("bright", lambda v: v > settings.bright_luma_min),
        ("high", lambda v: v >= CLIP_HIGH),
        ("low", lambda v: v <= CLIP_LOW),
    ]
    kinds = {"n": "long", "sum": "double", "squares": "double", **{name: "long" for name, _ in limits}}
    kinds |= {"bins": "array<int>", "counts": "array<long>"}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, values in K.by_image(batch, keys):
                bins, counts = K.counted(_bin(values))
                off = values - 0.5
                found = {"n": [values.size], "sum": [values.sum()], "squares": [(off * off).sum()], "bins": [bins], "counts": [counts]}
                found |= {name: [int(test(values).sum())] for name, test in limits}
                yield from K.with_keys(image, found, kinds).to_batches()

    rows = lines.selectExpr(*keys, "cast(line AS array<double>) AS line")
    parts = cut_lineage(rows.mapInArrow(sums, K.in_arrow(rows, keys, kinds)))
    mean = F.sum("sum") / F.sum("n")
    spread = F.sum("squares") / F.sum("n") - (mean - 0.5) * (mean - 0.5)
    plain = parts.groupBy(*keys).agg(
        mean.alias("_mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("_std"),
        *[(F.sum(name) / F.sum("n")).alias(f"_{name}") for name, _ in limits],
    )
    ranked = _line_quantiles(rows, parts, keys, {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return plain.join(ranked, keys).select(
        *keys,
        fixed(F.col("_mean"), 5).alias("luma_mean"),
        fixed(F.col("p50"), 5).alias("luma_median"),
        fixed(F.col("_std"), 5).alias("contrast_std"),
        fixed(F.col("_std") / F.greatest(F.col("_mean"), F.lit(1e-6)), 5).alias("contrast_ratio"),
        fixed(F.col("p95") - F.col("p5"), 5).alias("contrast_p5_p95"),
        fixed(F.col("_dark"), 5).alias("dark_pixel_ratio"),
        fixed(F.col("_bright"), 5).alias("bright_pixel_ratio"),
        fixed(F.col("_high"), 5).alias("clipped_high_ratio"),
        fixed(F.col("_low"), 5).alias("clipped_low_ratio"),
    )


def _bin(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * _BINS), 0, _BINS - 1).astype(np.int64)


def _line_quantiles(rows: DataFrame, parts: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """Exact linear quantiles of the values of each image; `parts` has its histogram."""
    counts = parts.selectExpr(*keys, "inline(arrays_zip(bins, counts))").groupBy(*keys, "bins").agg(F.sum("counts").alias("n"))
    along = Window.partitionBy(*keys).orderBy("bins")
    held = counts.select(
        *keys, "bins", "n", F.sum("n").over(along).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total")
    )
    at = {name: F.lit(p) * (F.col("total") - 1) for name, p in wanted.items()}
    ranks = F.array(*[F.struct(F.lit(f"{k}:{s}").alias("tag"), f(x).cast("bigint").alias("rank")) for k, x in at.items() for s, f in (("lo", F.floor), ("hi", F.ceil))])
    asked = F.filter(ranks, lambda x: (x["rank"] >= F.col("upto") - F.col("n")) & (x["rank"] < F.col("upto")))
    hits = held.select(*keys, F.col("bins").alias("bin"), (F.col("upto") - F.col("n")).alias("start"), "total", asked.alias("asked")).where("size(asked) > 0")
    hits = cut_lineage(hits)
    kinds = {"bin": "int", "v": "double", "n": "long"}

    def values_in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, values in K.by_image(batch, [*keys, "open"]):
                open_ = [int(x) for x in image.column("open")[0].as_py().split(",")]
                v, n = np.unique(values[np.isin(_bin(values), open_)], return_counts=True)
                yield from K.with_keys(image.select(keys), {"bin": _bin(v), "v": v, "n": n}, kinds).to_batches()

    open_bins = hits.groupBy(*keys).agg(F.concat_ws(",", F.collect_set(F.col("bin").cast("string"))).alias("open"))
    found = rows.join(open_bins, keys).mapInArrow(values_in_bins, K.in_arrow(rows, keys, kinds)).groupBy(*keys, "bin", "v").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(*keys, "bin").orderBy("v")
    placed = found.join(hits, [*keys, "bin"]).withColumn("upto", F.col("start") + F.sum("n").over(inside)).withColumn("hit", F.explode("asked"))
    placed = placed.where("hit.rank >= upto - n AND hit.rank < upto")
    ends = placed.groupBy(*keys, "total").agg(
        *[F.max(F.when(F.col("hit.tag") == f"{k}:{s}", F.col("v"))).alias(f"{k}_{s}") for k in wanted for s in ("lo", "hi")]
    )
    return ends.select(*keys, *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (x - F.floor(x))).alias(k) for k, x in at.items()])


# --- stencils --------------------------------------------------------------


def downscale(lines: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Area mean over factor x factor blocks; never enlarges."""
    keys = list(keys)
    if factor <= 1:
        return lines
    rest = [k for k in keys if k not in ("width", "height")]
    rows = lines.groupBy(*keys, F.expr(f"y div {factor}").alias("y")).agg(
        F.collect_list("line").alias("rows")
    )
    return rows.selectExpr(
        *rest,
        f"cast(ceil(width / {factor}) AS bigint) AS width",
        f"cast(ceil(height / {factor}) AS bigint) AS height",
        "y",
        f"""transform(sequence(0, cast(ceil(width / {factor}) AS int) - 1), i ->
             aggregate(rows, 0D, (s, row) -> s + aggregate(slice(row, i * {factor} + 1, {factor}), 0D, (a, v) -> a + v))
             / (size(rows) * least({factor}, width - i * {factor}))) AS line""",
    )


def downscale_factor(width: int, height: int, target: int) -> int:
    return max(1, math.ceil(max(width, height) / target))


def _steep(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Sobel responses of the lightly smoothed luma."""
    return K.sobel(K.binomial(block.around(block.rows, 2)) / 16.0)


def _strong(block: K.Block) -> int:
    return int((np.hypot(*_steep(block)) > STRONG_GRADIENT).sum())


def _clean(block: K.Block) -> np.ndarray:
    """Denoised bytes of all rows; the outermost row is right only at the frame's edge."""
    return K.median3(K.as_bytes(block.rows, np.rint))


def _laplacian(block: K.Block) -> dict[str, list]:
    """Sums of the 4-neighbour Laplacian of the luma cut to bytes."""
    b = block.around(K.as_bytes(block.rows, np.floor), 1).astype(np.int64)
    lap = b[:-2, 1:-1] + b[2:, 1:-1] + b[1:-1, :-2] + b[1:-1, 2:] - 4 * b[1:-1, 1:-1]
    return {"n": [lap.size], "lap_sum": [int(lap.sum())], "lap_squares": [int((lap * lap).sum())]}


_LAPLACIAN_SUMS = {"n": "long", "lap_sum": "long", "lap_squares": "long"}


def _laplacian_variance():
    mean = F.sum("lap_sum") / F.sum("n")
    return fixed(F.sum("lap_squares") / F.sum("n") - mean * mean, 3).alias("laplacian_variance")


def gradient_facts(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of pixels with a strong gradient after a light smoothing."""
    counts = K.by_blocks(
        lines, keys, 2, lambda b: {"n": [b.own(b.rows).size], "strong": [_strong(b)]}, {"n": "long", "strong": "long"}
    )
    return counts.groupBy(*keys).agg(fixed(F.sum("strong") / F.sum("n"), 6).alias("strong_gradient_ratio"))


def laplacian_variance(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variance of the 4-neighbour Laplacian of the luma cut to bytes."""
    return K.by_blocks(lines, keys, 1, _laplacian, _LAPLACIAN_SUMS).groupBy(*keys).agg(_laplacian_variance())


def denoise(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """3x3 median of the luma in steps of a byte; the edge row and column repeat."""
    return K.by_blocks(
        lines, keys, 1, lambda b: {"y": b.y, "line": b.own(_clean(b)) / 255.0}, {"y": "long", "line": "array<double>"}
    )


_REBLUR_SUMS = {c: "double" for c in ("across_total", "across_left", "down_total", "down_left")}


def _reblur(block: K.Block, clean: np.ndarray) -> dict[str, list]:
    """Variation of neighbours in both directions, and how much of it a 9-tap box removes."""
    out = {}
    for name, axis in (("across", 1), ("down", 0)):
        near = block.around(clean, 5)
        boxed = K.weighted(near, (1,) * 9, axis)
        if axis:
            plain, boxed = near[5:-5, 5:-5], boxed[5:-5, 1:-1]
            a, b = np.abs(np.diff(plain, axis=1)), np.abs(np.diff(boxed, axis=1))
        else:
            last = 1 if block.y[-1] == block.height - 1 else 0
            a, b = np.abs(np.diff(near[5 : -4 - last, 5:-5], axis=0)), np.abs(np.diff(boxed[1 : len(boxed) - last, 5:-5], axis=0))
        out[f"{name}_total"] = [float(a.sum())]
        out[f"{name}_left"] = [float(np.maximum(9 * a - b, 0).sum()) / 9.0]
    return out


def _reblur_score():
    score = lambda t, l: F.when(F.sum(t) > 1e-6, (F.sum(t) - F.sum(l)) / F.sum(t))  # noqa: E731, E741
    worst = F.greatest(score("across_total", "across_left"), score("down_total", "down_left"))
    return fixed(worst, 5).alias("reblur_ratio")


def reblur_ratio(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of local variation a 9-tap box removes, the larger of both axes.

    lines is the denoised luma; it is read in steps of a byte, on which all sums are
    exact. Null where neither axis varies.
    """
    sums = K.by_blocks(lines, keys, 5, lambda b: _reblur(b, K.as_bytes(b.rows, np.rint)), _REBLUR_SUMS)
    return sums.groupBy(*keys).agg(_reblur_score())


#: Gradients of smoothed bytes are whole sixteenths.
_SIXTEENTHS = 16
_EDGES = {
    "x_mags": "array<int>", "x_counts": "array<long>", "y_mags": "array<int>", "y_counts": "array<long>",
    "mags": "array<int>", "widths": "array<int>", "counts": "array<int>", "first_y": "long", "strips": "array<binary>",
}


def _edges(block: K.Block, clean: np.ndarray) -> dict[str, list]:
    """Gradient histograms of both axes, edge widths across, and each fourth column for those down."""
    gx, gy = (np.abs(g) for g in K.sobel(K.binomial(block.around(clean, 2))))
    (x_mags, x_counts), (y_mags, y_counts) = K.counted(gx), K.counted(gy)
    mags, widths, counts = K.peak_widths(gx[block.y % EDGE_STEP == 0], EDGE_MAX_WIDTH)
    columns = gy[:, ::EDGE_STEP].astype(np.int32)
    strips = [columns[:, k : k + _STRIP].tobytes() for k in range(0, columns.shape[1], _STRIP)]
    found = (x_mags, x_counts, y_mags, y_counts, mags, widths, counts, int(block.y[0]), strips)
    return {name: [value] for name, value in zip(_EDGES, found, strict=True)}


def edge_widths(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median width of strong edges per image, the larger of both directions.

    edges: the columns `_edges` gives for each block. One line in four; a peak tops both
    neighbours (ties to its right allowed) and a quarter of the 99.9th percentile; its
    width reaches down both slopes, which end at the first step that does not fall, and
    widths of 60 and more are out. Columns meet again in strips of _STRIP for the widths
    down the frame.
    """
    keys = list(keys)
    axes = [*keys, "axis"]
    kinds = {"axis": "string", "mags": "array<int>", "widths": "array<int>", "counts": "array<int>"}

    def down(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("first_y").to_pylist(), table.column("mags").to_pylist(), table.column("rows").to_pylist(), strict=True))
        profiles = np.concatenate([np.frombuffer(m, np.int32).reshape(n, -1) for _, m, n in parts])
        found = K.peak_widths(np.ascontiguousarray(profiles.T), EDGE_MAX_WIDTH)
        return K.with_keys(table.select(keys).slice(0, 1), dict(zip(("mags", "widths", "counts"), ([x] for x in found), strict=True)), dict(list(kinds.items())[1:]))

    strips = edges.selectExpr(*keys, "first_y", "rows", "posexplode(strips) AS (strip, mags)")
    tall = strips.groupBy(*keys, "strip").applyInArrow(down, K.in_arrow(edges, keys, dict(list(kinds.items())[1:])))
    peaks = edges.selectExpr(*keys, "'x' AS axis", "inline(arrays_zip(mags, widths, counts))").unionByName(
        tall.selectExpr(*keys, "'y' AS axis", "inline(arrays_zip(mags, widths, counts))")
    )
    x, y = (edges.selectExpr(*keys, f"'{a}' AS axis", f"inline(arrays_zip({a}_mags, {a}_counts)) AS (mag, n)") for a in "xy")
    histogram = x.unionByName(y)
    histogram = histogram.groupBy(*axes, "mag").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*axes).orderBy("mag")
    placed = histogram.select("*", F.sum("n").over(along).alias("upto"), F.sum("n").over(Window.partitionBy(*axes)).alias("total"))
    rank = "0.999D * (total - 1)"
    held = lambda x: f"max(if({x} >= upto - n AND {x} < upto, mag / {_SIXTEENTHS}D, NULL))"
    limits = placed.groupBy(*axes, "total").agg(F.expr(held(f"floor({rank})")).alias("lo"), F.expr(held(f"ceil({rank})")).alias("hi"))
    limits = limits.selectExpr(*axes, f"(lo + (hi - lo) * ({rank} - floor({rank}))) * {EDGE_STRONG_SHARE}D AS limit")
    strong = peaks.join(limits, axes).where(f"limit > 1e-6 AND mags / {_SIXTEENTHS}D >= limit")
    # at most 59 different widths per group, so the plain percentile stays small
    per_axis = strong.groupBy(*axes).agg(F.expr("percentile(widths, 0.5, counts)").alias("median"), F.sum("counts").alias("n"))
    return per_axis.groupBy(*keys).agg(fixed(F.max("median"), 3).alias("edge_width_px"), F.sum("n").alias("edge_count"))


def edge_blocks(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What `edge_widths` reads, of every block of the denoised luma."""
    kinds = {**_EDGES, "rows": "long"}
    return cut_lineage(K.by_blocks(lines, keys, 3, lambda b: {**_edges(b, _clean(b)), "rows": [len(b.y)]}, kinds))


def blur_reading(
    lines: DataFrame, keys: Sequence[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """All sharpness measures of each image in one row.

    lines are at working size. One shuffle brings the rows of a block together; sums,
    histograms and the columns for the widths down the frame come out of the same pass.
    """
    keys = list(keys)

    def read(block: K.Block) -> dict:
        clean = _clean(block)
        return {"strong": [_strong(block)], "rows": [len(block.y)], **_laplacian(block), **_reblur(block, clean), **_edges(block, clean)}

    kinds = {"strong": "long", "rows": "long", **_LAPLACIAN_SUMS, **_REBLUR_SUMS, **_EDGES}
    kept = cut_lineage(K.by_blocks(lines, keys, 6, read, kinds))
    scalars = kept.groupBy(*keys).agg(
        fixed(F.sum("strong") / F.sum("n"), 6).alias("strong_gradient_ratio"), _laplacian_variance(), _reblur_score()
    )
    side = F.greatest("width", "height")
    return scalars.join(edge_widths(kept, keys), keys, "left").select(
        *keys,
        "strong_gradient_ratio",
        "laplacian_variance",
        "reblur_ratio",
        "edge_width_px",
        fixed(F.col("edge_width_px") * settings.blur_working_side / F.greatest(side, F.lit(1)), 3).alias(
            "edge_width_normalized"
        ),
        F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        side.alias("working_side"),
    )


# --- verdicts --------------------------------------------------------------


def classify_sharpness(measures: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds sharp (true, false or null) and low_texture."""
    return replay(measures, [("settings", settings)]).drop("variant")


def replay(measures: DataFrame, variants: Sequence[tuple[str, Settings]]) -> DataFrame:
    """Verdicts of stored measures under several settings, one row per variant."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.lit(s.blur_method).alias("method"),
                F.lit(float(s.blur_min_strong_gradient_ratio)).alias("texture_min"),
                F.lit(int(s.blur_working_side)).alias("side_min"),
                F.lit(float(s.blur_sharp_min)).alias("laplacian_min"),
                F.lit(float(s.blur_reblur_sharp_max)).alias("reblur_sharp"),
                F.lit(float(s.blur_reblur_blurry_min)).alias("reblur_blurry"),
                F.lit(float(s.blur_edge_width_sharp_max)).alias("width_sharp"),
                F.lit(float(s.blur_edge_width_blurry_min)).alias("width_blurry"),
            )
            for name, s in variants
        ]
    )
    c = lambda name: F.col(f"_s.{name}")
    poor = F.col("strong_gradient_ratio") < c("texture_min")
    small = F.col("working_side") < c("side_min")
    method = c("method")

    def band(value: str, low: str, high: str):
        return F.when(F.col(value) <= c(low), True).when(F.col(value) >= c(high), False)

    sharp = (
        F.when(small, F.lit(None).cast("boolean"))
        .when(method == "laplacian_variance", F.col("laplacian_variance") >= c("laplacian_min"))
        .when(poor, F.lit(None).cast("boolean"))
        .when(method == "reblur_ratio", band("reblur_ratio", "reblur_sharp", "reblur_blurry"))
        .otherwise(band("edge_width_normalized", "width_sharp", "width_blurry"))
    )
    unread = (
        ~small
        & (
            ((method == "reblur_ratio") & F.col("reblur_ratio").isNull())
            | ((method == "edge_width") & F.col("edge_width_normalized").isNull())
        )
    )
    return (
        measures.withColumn("_s", F.explode(rows))
        .select(
            "*",
            c("variant").alias("variant"),
            sharp.alias("sharp"),
            (poor | unread).alias("low_texture"),
        )
        .drop("_s")
    )


def quality_codes(metrics: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `codes`; metrics carries frame size, exposure, sharp and low_texture."""
    s = settings
    long, short = F.greatest("width", "height"), F.least("width", "height")
    return metrics.withColumn(
        "codes",
        codes(
            (long < s.min_long_side, "image_too_small"),
            (long / short > s.max_aspect_ratio, "image_extreme_aspect_ratio"),
            (~F.col("sharp"), "image_blurry"),
            (F.col("low_texture"), "image_low_texture"),
            (
                (F.col("luma_mean") < s.luma_mean_min) | (F.col("dark_pixel_ratio") > s.dark_ratio_max),
                "image_too_dark",
            ),
            (
                (F.col("luma_mean") > s.luma_mean_max) | (F.col("bright_pixel_ratio") > s.bright_ratio_max),
                "image_overexposed",
            ),
            (
                (F.col("clipped_high_ratio") > s.clipped_high_ratio_max)
                | (F.col("clipped_low_ratio") > s.clipped_low_ratio_max),
                "image_clipped",
            ),
            (F.col("contrast_ratio") < s.contrast_ratio_min, "image_low_contrast"),
        ),
    )


def truth_group(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `group` from truth_k1, truth_blur_sigma, truth_motion_length, graded."""
    return samples.withColumn(
        "group",
        F.when(F.col("strong_gradient_ratio") < settings.blur_min_strong_gradient_ratio, "no-support")
        .when(F.coalesce("truth_k1", F.lit(0.0)) != 0.0, "resampled")
        .when(F.col("truth_blur_sigma") >= 1.5, "blurred")
        .when(F.col("truth_blur_sigma").isNotNull(), "borderline")
        .when(F.col("truth_motion_length").isNotNull(), "blurred")
        .when(~F.col("graded"), "ungraded")
        .otherwise("sharp"),
    )


def candidate_margins(samples: DataFrame) -> DataFrame:
    """How well each measure separates sharp from blurred samples."""
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.lit(up).alias("higher_is_blurrier"), F.col(m).alias("v"))
            for m, up in V.CANDIDATE_MEASURES
        ]
    )
    long = samples.where(F.col("group").isin("sharp", "blurred")).select(
        "group", F.explode(entries).alias("e")
    ).select("group", "e.measure", "e.higher_is_blurrier", F.col("e.v").alias("v"))
    of = lambda g: F.when(F.col("group") == g, F.col("v"))
    up = F.col("higher_is_blurrier")
    sums = long.groupBy("measure", "higher_is_blurrier").agg(
        F.count(of("sharp")).alias("sharp_count"),
        F.count(of("blurred")).alias("blurred_count"),
        F.max(of("sharp")).alias("_s_max"),
        F.min(of("sharp")).alias("_s_min"),
        F.max(of("blurred")).alias("_b_max"),
        F.min(of("blurred")).alias("_b_min"),
        (F.max("v") - F.min("v")).alias("_span"),
    )
    edged = sums.select(
        "*",
        F.when(up, F.col("_s_max")).otherwise(F.col("_s_min")).alias("_se"),
        F.when(up, F.col("_b_min")).otherwise(F.col("_b_max")).alias("_be"),
    )
    margin = F.when(up, F.col("_be") - F.col("_se")).otherwise(F.col("_se") - F.col("_be"))
    return edged.select(
        "measure",
        "sharp_count",
        "blurred_count",
        ((F.col("sharp_count") > 0) & (F.col("blurred_count") > 0)).alias("usable"),
        fixed(F.col("_se"), 5).alias("sharp_edge"),
        fixed(F.col("_be"), 5).alias("blurred_edge"),
        fixed(margin, 5).alias("margin"),
        fixed(ratio(margin, F.col("_span")), 5).alias("separation"),
        fixed((F.col("_se") + F.col("_be")) / 2.0, 5).alias("suggested_threshold"),
        (margin > 0).alias("separable"),
    )


# --- seeds and the geometric floor ------------------------------------------


def edge_seeds(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines to follow: strongest energy far from the middle, with a minimum gap.

    Positions are taken greedily by energy times offset, at most 12 per image and
    orientation; the list per image is as long as the image is wide or tall.
    """
    keys = list(keys)

    def energies(block: K.Block) -> dict:
        gx, gy = (np.abs(g) for g in _steep(block))
        inside = lambda at, size: (at >= math.floor(size * 0.08)) & (at < math.floor(size * (1.0 - 0.08)))
        upright = gx[inside(block.y, block.height)].sum(axis=0)
        return {"first_y": [int(block.y[0])], "upright": [upright], "level": [gy[:, inside(np.arange(gy.shape[1]), gy.shape[1])].sum(axis=1)]}

    sums = K.by_blocks(lines, keys, 2, energies, {"first_y": "long", "upright": "array<double>", "level": "array<double>"})
    upright = sums.selectExpr(*keys, "'vertical' AS orientation", "width AS span", "posexplode(upright) AS (pos, e)")
    level = sums.selectExpr(*keys, "'horizontal' AS orientation", "height AS span", "first_y", "posexplode(level) AS (pos, e)")
    level = level.withColumn("pos", F.col("pos") + F.col("first_y")).drop("first_y")
    energy = upright.unionByName(level).groupBy(*keys, "orientation", "span", F.col("pos").cast("bigint").alias("pos")).agg(
        F.sum("e").alias("energy")
    )
    scored = energy.selectExpr(
        "*", "abs(pos - (span - 1) / 2D) / greatest((span - 1) / 2D, 1D) AS offset"
    ).where(f"offset >= {SEED_OFFSET}")
    lists = scored.groupBy(*keys, "orientation", "span").agg(
        F.expr("reverse(array_sort(collect_list(struct(round(energy * offset, 9) AS score, pos))))").alias("ranked")
    )
    gap = f"greatest(1, floor(span * {SEED_GAP}D))"
    return lists.selectExpr(
        *keys,
        "orientation",
        f"""posexplode(aggregate(ranked, cast(array() AS array<bigint>), (kept, c) ->
             if(size(kept) < {MAX_SEEDS} AND NOT exists(kept, k -> abs(k - c.pos) < {gap}),
                array_append(kept, c.pos), kept))) AS (rank, pos)""",
    ).selectExpr(*keys, "orientation", "cast(rank + 1 AS bigint) AS rank", "pos")


def _convolved(a: Sequence[float], b: Sequence[float]) -> list[float]:
    out = [0.0] * (len(a) + len(b) - 1)
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            out[i + j] += u * v
    return out


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-(d * d) / (2.0 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def blur_radius(sigma: float) -> int:
    """Half size of the kernel used for 8-bit images."""
    return (int(round(sigma * 6 + 1)) | 1) // 2


_LINES = {"y": "long", "line": "array<double>"}


def separable(lines: DataFrame, keys: Sequence[str], down: Sequence[float], across: Sequence[float]) -> DataFrame:
    """One vertical and one horizontal kernel of odd length, mirrored edges."""
    return K.by_blocks(lines, keys, len(down) // 2, lambda b: {"y": b.y, "line": _separated(b, down, across)}, _LINES)


def _separated(block: K.Block, down: Sequence[float], across: Sequence[float]) -> np.ndarray:
    """Both kernels have the same length."""
    return K.weighted(K.weighted(block.around(block.rows, len(down) // 2), down, 0), across, 1)


def stencil(lines: DataFrame, keys: Sequence[str], kernel: Sequence[Sequence[float]]) -> DataFrame:
    """Any square kernel of odd size, mirrored edges."""
    size = len(kernel)

    def summed(block: K.Block) -> dict:
        near = block.around(block.rows, size // 2)
        h = len(block.y)
        own = [K.weighted(near[r : r + h], [w if abs(w) > 1e-12 else 0 for w in row], 1) for r, row in enumerate(kernel)]
        return {"y": block.y, "line": sum(own)}

    return K.by_blocks(lines, keys, size // 2, summed, _LINES)


def geometric_floor(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs below the strongest vertical break of each column, smoothed.

    Blur and 5x5 derivative are one separable kernel. The moving average counts
    columns beyond the frame as 0, as the published one does.
    """
    keys = list(keys)
    soft = gaussian_kernel(0.3 * ((GEOMETRIC_BLUR - 1) * 0.5 - 1) + 0.8, GEOMETRIC_BLUR // 2)
    down, across = _convolved(soft, [-1.0, -2.0, 0.0, 2.0, 1.0]), _convolved(soft, [1.0, 4.0, 6.0, 4.0, 1.0])

    def strongest(block: K.Block) -> dict:
        steep = np.floor(np.abs(_separated(block, down, across)) * 1e9 + 0.5) / 1e9
        below = block.y >= math.floor(block.height * GEOMETRIC_FROM)
        if not below.any():
            return {"g": [], "y": []}
        at = steep[below].argmax(axis=0)
        return {"g": [steep[below][at, np.arange(steep.shape[1])]], "y": [block.y[below][at]]}

    found = K.by_blocks(lines, keys, len(down) // 2, strongest, {"g": "array<double>", "y": "array<long>"})
    breaks = found.selectExpr(*keys, "posexplode(arrays_zip(g, y)) AS (x, b)").groupBy(*keys, "x").agg(
        F.expr("min(struct(-b.g AS g, b.y AS y)).y").alias("limit")
    )
    # one entry per column of the frame
    tops = breaks.groupBy(*keys).agg(
        F.expr("transform(array_sort(collect_list(struct(x, limit))), s -> s.limit)").alias("tops")
    )
    eased = tops.selectExpr(
        *keys,
        "tops",
        "greatest(9, (width div 40) | 1) AS n",
    ).selectExpr(
        *keys,
        """transform(tops, (t, i) -> floor(aggregate(slice(tops, greatest(i - n div 2, 0) + 1,
             least(i + n div 2, size(tops) - 1) - greatest(i - n div 2, 0) + 1), 0L, (s, v) -> s + v) / n)) AS tops""",
    )
    rows = eased.selectExpr(*keys, "tops", "explode(sequence(0L, height - 1)) AS y").selectExpr(
        *keys, "y", "transform(tops, t -> y >= t) AS line"
    )
    return M.lines_to_runs(rows, keys, "line", {"floor": lambda v: v}).drop("side")


# --- augmentation ------------------------------------------------------------


def augment_tone(cells: DataFrame, variants: Sequence[tuple[str, float]]) -> DataFrame:
    """gain, contrast and half_shadow variants of each cell, with their truth.

    cells: photo_id, y, x, width, luma. Values step on the 8-bit scale. contrast
    pivots on 128.
    """
    listed = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(float(p)).alias("param")) for k, p in variants]
    )
    byte = F.expr("rint(luma * 255D)")
    gained = byte * F.col("v.param")
    value = (
        F.when(F.col("v.kind") == "gain", gained)
        .when(F.col("v.kind") == "contrast", (byte - 128.0) * F.col("v.param") + 128.0)
        .when(F.col("x") < F.floor(F.col("width") / 2), gained)
        .otherwise(byte)
    )
    cut = F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)))
    return cells.withColumn("v", F.explode(listed)).select(
        "photo_id", "y", "x", F.col("v.kind").alias("kind"), F.col("v.param").alias("param"), (cut / 255.0).alias("luma")
    )


def augment_crop(cells: DataFrame, keep: float, shift: float) -> DataFrame:
    """Cells of an off-centre crop, renumbered; width and height become the crop's."""
    size = lambda n: F.floor(F.col(n) * keep)
    start = lambda n: F.floor(
        F.least(
            F.greatest((F.col(n) - size(n)) / 2.0 + shift * F.col(n), F.lit(0.0)), F.col(n) - size(n)
        )
    )
    return (
        cells.withColumn("_l", start("width"))
        .withColumn("_t", start("height"))
        .where(
            (F.col("x") >= F.col("_l"))
            & (F.col("x") < F.col("_l") + size("width"))
            & (F.col("y") >= F.col("_t"))
            & (F.col("y") < F.col("_t") + size("height"))
        )
        .select("photo_id", (F.col("y") - F.col("_t")).alias("y"), (F.col("x") - F.col("_l")).alias("x"), "luma")
    )


def augment_blur(lines: DataFrame, keys: Sequence[str], sigma: float) -> DataFrame:
    if sigma <= 0:
        return lines
    kernel = gaussian_kernel(sigma, blur_radius(sigma))
    return separable(lines, keys, kernel, kernel)


def motion_kernel(length: int, angle_deg: float) -> list[list[float]]:
    """Weights along a line of that length through the middle, sampled bilinearly."""
    middle, row = (length - 1) / 2.0, length // 2
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    grid = []
    for y in range(length):
        line = []
        for x in range(length):
            dx, dy = x - middle, y - middle
            sx, sy = c * dx - s * dy + middle, s * dx + c * dy + middle
            near_row = max(0.0, 1.0 - abs(sy - row))
            low = math.floor(sx)
            part = sx - low
            in_row = (1 - part) * (0 <= low < length) + part * (0 <= low + 1 < length)
            line.append(near_row * in_row)
        grid.append(line)
    total = sum(map(sum, grid))
    return [[v / total for v in line] for line in grid]


def augment_motion(lines: DataFrame, keys: Sequence[str], length: int, angle_deg: float) -> DataFrame:
    """Motion blur; length is odd so that the kernel has a middle."""
    if length <= 1:
        return lines
    return stencil(lines, keys, motion_kernel(length, angle_deg))


def augment_noise(cells: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise drawn from seed and place, so partitions do not matter.

    Two uniform numbers of the counter generator make a normal one; values step on the
    8-bit scale.
    """
    place = ("photo_id", "y", "x")
    mixed = cells.selectExpr("*", *drawn("u", seed, 1, *place), *drawn("v", seed, 2, *place))
    normal = f"sqrt(-2D * ln({share('u')})) * cos({2.0 * math.pi!r}D * {share('v')})"
    return mixed.selectExpr(
        *[c for c in cells.columns if c != "luma"],
        f"cast(floor(least(greatest(rint(luma * 255D) + {sigma}D * {normal}, 0D), 255D)) AS double) / 255D AS luma",
    )


def upper_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, upper median, min, max and total per key; nulls do not count."""
    found = quantiles(df, [key], value, {"upper_median": "upper"})
    return found.select(
        key,
        F.col("counted").alias("n"),
        "upper_median",
        F.col("lowest").alias("min"),
        F.col("highest").alias("max"),
        fixed(F.col("total"), 1).alias("total"),
    )


def timing_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and max per stage; a null duration is a stage that did not run."""
    return df.groupBy(key).agg(
        F.count(value).alias("counted"),
        fixed(F.avg(value), 2).alias("mean"),
        F.max(value).alias("max"),
    )


def blocked(metrics: DataFrame) -> DataFrame:
    """Adds `blocked`: one of the codes makes the photo unusable by itself."""
    return metrics.withColumn(
        "blocked", F.arrays_overlap("codes", F.array(*[F.lit(c) for c in V.BLOCKING_CODES]))
    )
