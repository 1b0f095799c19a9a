"""Lens curvature from followed edges.

Points are rows (photo_id, track_id, orientation, scan, across, grad, width,
height). Every per-track quantity comes from one grouped pass of power sums, and
the search over distortion values works on those sums, never on points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtable.functions.numbers import count_where, fixed
from roomtable.functions.settings import DEFAULTS, Settings

#: Fixed values of the published track rules.
MIN_CONTRAST = 0.05
MIN_OFFSET = 0.25
MIN_FIT_POINTS = 8

_TRACK = ["photo_id", "track_id", "orientation", "width", "height"]


def track_fit(points: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per track: curvature facts, usable flag and the moments k1_fit needs.

    The quadratic across = a u² + b u + c is solved from power sums; u is scan
    scaled to about -1..1 over the frame, which keeps the sums well conditioned.
    """
    upright = "orientation = 'vertical'"
    placed = points.selectExpr(
        *_TRACK,
        "scan",
        "across",
        "grad",
        f"(if({upright}, height, width) - 1) / 2D AS half",
        f"if({upright}, across, scan) - (width - 1) / 2D AS px",
        f"if({upright}, scan, across) - (height - 1) / 2D AS py",
    ).selectExpr(
        "*",
        "(scan - half) / half AS u",
        "(px * px + py * py) / (pow((width - 1) / 2D, 2) + pow((height - 1) / 2D, 2)) AS r2",
    ).selectExpr("*", "px * r2 AS pu", "py * r2 AS pv")
    pairs = ("px px", "px py", "py py", "px pu", "py pu", "px pv", "py pv", "pu pu", "pu pv", "pv pv")
    sums = placed.groupBy(*_TRACK, "half").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.expr(f"pow(u, {k})")).alias(f"s{k}") for k in (1, 2, 3, 4)],
        *[F.sum(F.expr(f"pow(u, {k}) * across")).alias(f"t{k}") for k in (0, 1, 2)],
        F.sum(F.expr("across * across")).alias("q"),
        F.expr("max(scan) - min(scan)").cast("double").alias("base"),
        # a track is at most as long as its frame
        F.expr("percentile(grad, 0.5)").alias("contrast"),
        *[F.avg(c).alias(f"m_{c}") for c in ("px", "py", "pu", "pv")],
        *[F.avg(F.expr(p.replace(" ", " * "))).alias(f"m_{p.replace(' ', '_')}") for p in pairs],
    )
    solved = sums.selectExpr(
        "*",
        "s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det",
    ).selectExpr(
        "*",
        "(t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / nullif(det, 0) AS qa",
        "(s4 * (t1 * n - t0 * s1) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - s2 * t1)) / nullif(det, 0) AS qb",
        "(s4 * (s2 * t0 - s1 * t1) - s3 * (s3 * t0 - s2 * t1) + t2 * (s3 * s1 - s2 * s2)) / nullif(det, 0) AS qc",
        f"(if({upright}, width, height) - 1) / 2D AS middle",
    ).selectExpr(
        "*",
        "-(qa / (half * half)) * base * base / 4D AS bulge",
        "sqrt(greatest((q - qa * t2 - qb * t1 - qc * t0) / n, 0D)) AS rms",
        "base / greatest(2 * half, 1D) AS span",
        "abs(t0 / n - middle) / greatest(middle, 1D) AS off",
    )
    s = settings
    return solved.select(
        *_TRACK,
        F.col("n").alias("points"),
        fixed(F.abs("bulge"), 4).alias("sagitta_px"),
        fixed(F.expr("bulge * if(t0 / n >= middle, 1D, -1D)"), 4).alias("radial_bulge_px"),
        fixed(F.col("rms"), 4).alias("fit_rms_px"),
        fixed(F.col("span"), 4).alias("span_ratio"),
        fixed(F.col("off"), 4).alias("center_offset"),
        fixed(F.col("contrast"), 5).alias("contrast"),
        (
            (F.col("contrast") >= MIN_CONTRAST)
            & (F.col("rms") <= s.lens_max_fit_rms_px)
            & (F.col("n") >= s.lens_min_track_points)
            & (F.col("span") >= s.lens_min_track_height_ratio)
            & (F.col("off") >= MIN_OFFSET)
        ).alias("usable"),
        *[c for c in sums.columns if c.startswith("m_")],
    )


def lens_support(tracks: DataFrame) -> DataFrame:
    """How much evidence the usable tracks of each photo carry."""
    u = F.col("usable")
    only = lambda c: F.when(u, c)
    bulge = F.col("radial_bulge_px")
    # a photo has at most two dozen tracks
    sums = tracks.groupBy("photo_id", "width", "height").agg(
        count_where(u).alias("usable_edges"),
        count_where(u & (F.col("orientation") == "vertical")).alias("vertical_edges"),
        count_where(u & (F.col("orientation") == "horizontal")).alias("horizontal_edges"),
        F.coalesce(F.sum(only(F.col("points"))), F.lit(0)).cast("double").alias("total_track_px"),
        F.count_distinct(only(F.struct(F.col("m_px") >= 0, F.col("m_py") >= 0))).alias("_q"),
        count_where(u & (bulge > 0)).alias("_pos"),
        F.expr("percentile(if(usable, radial_bulge_px, NULL), 0.5)").alias("_bulge"),
        F.max(only(F.col("sagitta_px"))).alias("max_sagitta_px"),
    )
    n = F.col("usable_edges")
    return sums.select(
        "photo_id",
        "width",
        "height",
        "usable_edges",
        "vertical_edges",
        "horizontal_edges",
        "total_track_px",
        fixed(F.col("_q") / 4.0, 3).alias("spatial_coverage"),
        F.when(n == 0, F.lit(0.0))
        .otherwise(fixed(F.greatest(F.col("_pos"), n - F.col("_pos")) / n, 4))
        .alias("sign_agreement"),
        fixed(F.coalesce("_bulge", F.lit(0.0)), 4).alias("median_radial_bulge_px"),
        "max_sagitta_px",
    )


def k1_fit(tracks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Radial distortion that straightens the usable tracks of a photo best.

    A point moves to (x + k u, y + k v) with u = x r², v = y r², so the scatter of
    a track under any k is a quadratic in k over ten covariances.
    """
    steps = settings.lens_k1_search_steps
    low = settings.lens_k1_search_min
    step = (settings.lens_k1_search_max - low) / (steps - 1)
    fit = tracks.where(f"usable AND points >= {MIN_FIT_POINTS}")
    cov = lambda a, b: f"(m_{a}_{b} - m_{a} * m_{b})"
    covs = fit.selectExpr(
        "photo_id",
        "points",
        f"{cov('px', 'px')} AS xx", f"{cov('px', 'py')} AS xy", f"{cov('py', 'py')} AS yy",
        f"{cov('px', 'pu')} AS xu", f"{cov('py', 'pu')} AS yu", f"{cov('px', 'pv')} AS xv",
        f"{cov('py', 'pv')} AS yv", f"{cov('pu', 'pu')} AS uu", f"{cov('pu', 'pv')} AS uv",
        f"{cov('pv', 'pv')} AS vv",
    )
    # index -1 stands for no correction
    tried = covs.selectExpr("*", f"explode(sequence(-1, {steps - 1})) AS i").selectExpr(
        "*", f"if(i < 0, 0D, {low!r}D + i * {step!r}D) AS k"
    )
    scatter = tried.selectExpr(
        "photo_id", "points", "i", "k",
        "xx + 2 * k * xu + k * k * uu AS a",
        "yy + 2 * k * yv + k * k * vv AS b",
        "xy + k * (xv + yu) + k * k * uv AS c",
    ).selectExpr(
        "photo_id", "points", "i", "k",
        "(a + b) / 2 AS half", "sqrt(greatest((a + b) * (a + b) / 4 - (a * b - c * c), 0D)) AS spread",
    ).selectExpr(
        "photo_id", "points", "i", "k",
        "sqrt(greatest(half - spread, 0D) / greatest(half + spread, 1e-12D)) AS s",
    )
    pooled = scatter.groupBy("photo_id", "i", "k").agg(
        F.expr("sum(s * points) / sum(points)").alias("score")
    )
    best = pooled.groupBy("photo_id").agg(
        F.max(F.expr("if(i < 0, score, NULL)")).alias("zero"),
        F.min(F.expr("if(i < 0, NULL, struct(round(score, 12) AS r, i, k, score))")).alias("b"),
    )
    gain = F.when(F.col("zero") <= 1e-9, 0.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("b.score") / F.col("zero"))
    )
    return best.select(
        "photo_id",
        fixed(F.col("b.k"), 5).alias("k1"),
        fixed(F.col("zero"), 8).alias("straightness_at_zero"),
        fixed(F.col("b.score"), 8).alias("straightness_at_best"),
        fixed(gain, 5).alias("residual_gain"),
    )


def lens_report(tracks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Support, fit, thresholds and verdict of each photo."""
    s = settings
    joined = lens_support(tracks).join(k1_fit(tracks, s), "photo_id", "left")
    threshold = F.lit(s.lens_sagitta_suspect_px) * (F.col("width") / s.lens_reference_width)
    sized = joined.select(
        "*",
        fixed(F.col("max_sagitta_px") * s.lens_reference_width / F.col("width"), 4).alias(
            "max_sagitta_px_normalized"
        ),
        threshold.alias("_limit"),
        fixed(threshold, 4).alias("suspect_threshold_px"),
    )
    return classify_lens(sized, s).drop("_limit")


def classify_lens(report: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds lens_verdict, suspected_sign and lens_code for the chosen method."""
    s = settings
    strong = F.coalesce(F.col("max_sagitta_px") >= F.col("_limit"), F.lit(False))
    sign_of = lambda c: F.when(F.col(c) > 0, "barrel").when(F.col(c) < 0, "pincushion")
    if s.lens_method == "sagitta_magnitude":
        suspected, sign = strong, sign_of("median_radial_bulge_px")
    elif s.lens_method == "radial_consistency":
        suspected = strong & (F.col("sign_agreement") >= s.lens_min_sign_agreement)
        sign = sign_of("median_radial_bulge_px")
    else:
        suspected = (F.abs("k1") >= s.lens_k1_suspect_min) & (
            F.col("residual_gain") >= s.lens_k1_min_residual_gain
        )
        sign = sign_of("k1")
    open_ = F.col("usable_edges") < s.lens_min_usable_edges
    if s.lens_method == "k1_fit":
        open_ = open_ | F.col("k1").isNull()
    verdict = (
        F.when(open_, "undetermined")
        .when(suspected, "distortion_suspected")
        .otherwise("no_distortion_evidence")
    )
    return report.withColumn("lens_verdict", verdict).select(
        "*",
        F.when(F.col("lens_verdict") == "distortion_suspected", sign).alias("suspected_sign"),
        F.when(F.col("lens_verdict") == "distortion_suspected", "lens_distortion_suspected")
        .when(F.col("lens_verdict") == "undetermined", "lens_analysis_undetermined")
        .alias("lens_code"),
    )


def score_lens(verdicts: DataFrame) -> DataFrame:
    """Compare verdicts (lens_verdict, k1, suspected_sign) with truth_k1."""
    truth = F.col("truth_k1")
    sign = F.when(truth > 0, "barrel").when(truth < 0, "pincushion").otherwise("none")
    return verdicts.select(
        "*",
        sign.alias("truth_sign"),
        (truth != 0).alias("truth_distorted"),
        (F.col("lens_verdict") == "distortion_suspected").alias("detected"),
        fixed(F.abs(F.col("k1") - truth), 5).alias("k1_absolute_error"),
        F.when((truth != 0) & F.col("suspected_sign").isNotNull(), F.col("suspected_sign") == sign).alias(
            "sign_correct"
        ),
    )


def lens_summary(scores: DataFrame) -> DataFrame:
    """Graded cases only: detections, signs and k1 errors; one row."""
    graded = scores.where("graded")
    bent, hit = F.col("truth_distorted"), F.col("detected")
    error = F.when(bent & hit, F.col("k1_absolute_error"))
    return graded.agg(
        F.count(F.lit(1)).alias("graded_cases"),
        count_where(bent).alias("distorted_cases"),
        count_where(~bent).alias("clean_cases"),
        count_where(bent & hit).alias("detected_when_distorted"),
        count_where(~bent & hit).alias("detected_when_clean"),
        count_where(bent & F.coalesce("sign_correct", F.lit(False))).alias("sign_correct_when_detected"),
        F.max(error).alias("k1_error_max"),
        fixed(F.avg(error), 5).alias("k1_error_mean"),
    )
