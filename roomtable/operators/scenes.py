"""Analysis results, verdicts and scene contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.functions import vocabulary as V
from roomtable.functions.numbers import codes, piped
from roomtable.functions.settings import DEFAULTS, Settings
from roomtable.operators import lens as L
from roomtable.sources.reports import report_rows


#: Report column and the measured column it shows.
MEASURED = {
    "blur_method": "blur_method", "lens_method": "lens_method", "width": "width", "height": "height",
    "strong_gradient_ratio": "strong_gradient_ratio", "laplacian_variance": "laplacian_variance", "reblur_ratio": "reblur_ratio",
    "edge_width_px": "edge_width_px", "blur_sharp": "sharp", "blur_low_texture": "low_texture", "luma_mean": "luma_mean",
    "contrast_std": "contrast_std", "clipped_high_ratio": "clipped_high_ratio", "clipped_low_ratio": "clipped_low_ratio",
    "lens_verdict": "lens_verdict", "lens_suspected_sign": "suspected_sign", "lens_usable_edges": "usable_edges",
    "lens_total_track_px": "total_track_px", "lens_spatial_coverage": "spatial_coverage", "lens_sign_agreement": "sign_agreement",
    "lens_k1_estimate": "k1", "lens_k1_residual_gain": "residual_gain", "truth_k1": "truth_k1", "truth_sign": "truth_sign",
    "truth_blur_sigma": "truth_blur_sigma", "truth_exposure_gain": "truth_exposure_gain", "k1_absolute_error": "k1_absolute_error",
    "sign_correct": "sign_correct", **{stage: stage for stage in V.STAGES},
}


def measured_results(scored: DataFrame, refused: DataFrame, measures: DataFrame) -> DataFrame:
    """Report rows with everything that was measured; a refused image has measured nothing.

    measures: photo_id and the columns that MEASURED names; a column it lacks is null.
    """
    flat = flatten_results(scored, refused)
    named = measures.select(
        F.col("photo_id").cast("string").alias("id"),
        *[F.col(c).alias(name) for name, c in MEASURED.items() if c in measures.columns],
    )
    out = F.col("status").startswith("refused:")
    shown = [F.when(~out, F.col(name)).alias(name) for name in named.columns[1:]]
    return report_rows(flat.join(named, "id", "left").select(*flat.columns, *shown))


def flatten_results(scored: DataFrame, refused: DataFrame) -> DataFrame:
    """Report rows of scored images; a refused one misses all it was expected to show.

    refused: photo_id, code.
    """
    joined = scored.join(refused, "photo_id", "left")
    out = F.col("code").isNotNull()
    none = F.array().cast("array<string>")
    text = lambda c: piped(F.when(out, none).otherwise(F.col(c))).alias(c)
    return joined.select(
        F.col("photo_id").cast("string").alias("id"),
        "difficulty",
        "graded",
        F.when(out, F.concat(F.lit("refused:"), "code")).otherwise("success").alias("status"),
        piped(F.col("expected")).alias("expected"),
        text("detected"),
        text("false_positives"),
        piped(F.when(out, F.col("expected")).otherwise(F.col("false_negatives"))).alias("false_negatives"),
        text("informational"),
    )


def floor_from_classes(labels: DataFrame) -> DataFrame:
    """Cells of the floor class that no covering class claims."""
    covered = F.col("class_id").isin(list(V.COVERING_CLASSES))
    return labels.where((F.col("class_id") == V.FLOOR_CLASS) & ~covered).select("photo_id", "y", "x")


def decide_status(photos: DataFrame) -> DataFrame:
    """Adds `status` from codes and scene_present."""
    blocking = F.arrays_overlap("codes", F.array(*[F.lit(c) for c in V.BLOCKING_CODES]))
    return photos.withColumn(
        "status",
        F.when(blocking, "rejected")
        .when(~F.col("scene_present"), "analysis_incomplete")
        .when(F.size("codes") > 0, "needs_manual_adjustment")
        .otherwise("success"),
    )


def photo_report(judged: DataFrame, tracks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Lens verdicts added to measured photos; a blocked photo skips the lens stage.

    judged: photo_id, codes. tracks: points of followed edges. The semi join keeps
    the points of blocked photos out of the fit.
    """
    blocking = F.arrays_overlap("codes", F.array(*[F.lit(c) for c in V.BLOCKING_CODES]))
    open_ = judged.where(~blocking).select("photo_id")
    lens = L.lens_report(
        L.track_fit(tracks.join(open_, "photo_id", "left_semi"), settings), settings
    ).drop("width", "height")
    # a photo without any track is open too: nothing was found to judge
    joined = judged.withColumn("_open", ~blocking).join(lens, "photo_id", "left")
    code = F.when(
        F.col("_open"),
        F.when(F.col("lens_verdict").isNull(), "lens_analysis_undetermined").otherwise(F.col("lens_code")),
    )
    coded = joined.withColumn(
        "codes", F.concat("codes", F.array_compact(F.array(code, F.lit("stage_not_implemented"))))
    ).withColumn("scene_present", F.lit(False))
    return decide_status(coded).drop("_open")


# --- scene contract ---------------------------------------------------------

PLANE_DEFAULTS = {"width": 4.2, "depth": 4.0}


def resolve_planes(
    zones: DataFrame, planes: DataFrame, named_first: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(zones with a `plane`, zones whose reference leads nowhere).

    zones: scene_id, zone_id, plane_ref, inline (plane struct or null). planes:
    scene_id, plane_ref, plane. One contract lets the inline plane win, the other
    the named one; a zone with neither is dead too.
    """
    joined = zones.join(planes, ["scene_id", "plane_ref"], "left")
    order = ["plane", "inline"] if named_first else ["inline", "plane"]
    found = joined.select(
        *[c for c in zones.columns if c != "inline"],
        F.coalesce(*order).alias("plane"),
        F.col("plane").isNull().alias("_unnamed"),
    )
    dangling = F.col("plane_ref").isNotNull() & F.col("_unnamed")
    dead = F.col("plane").isNull() | (dangling if named_first else F.lit(False))
    return found.where(~dead).drop("_unnamed"), found.where(dead).drop("_unnamed", "plane")


def validate_scene_input(zones: DataFrame) -> DataFrame:
    """Adds `problems` per zone.

    zones: plane (struct quad, width, depth, or null), polygon, holes, horizon.
    Points are structs x, y; a null, NaN or infinite number is not finite. The codes are
    fixed values of the scene contract.
    """
    finite = lambda x: f"coalesce(NOT isnan({x}) AND abs({x}) < double('infinity'), false)"
    point = f"p IS NOT NULL AND {finite('p.x')} AND {finite('p.y')}"
    bad_quad = f"coalesce(plane IS NULL OR size(plane.quad) <> 4 OR NOT forall(plane.quad, p -> {point}), true)"
    area = """abs(aggregate(sequence(0, 3), 0D, (s, i) -> s
        + plane.quad[i].x * plane.quad[(i + 1) % 4].y - plane.quad[(i + 1) % 4].x * plane.quad[i].y)) / 2"""
    bad_contour = f"coalesce(polygon IS NULL OR size(polygon) < 3 OR NOT forall(polygon, p -> {point}), true)"
    marked = zones.selectExpr("*", f"{bad_quad} AS _q", f"{bad_contour} AS _c").selectExpr(
        "*", f"if(_q, CAST(NULL AS double), {area}) AS _area"
    )
    outside = "exists(polygon, p -> p.x < -0.05 OR p.x > 1.05 OR p.y < -0.05 OR p.y > 1.05)"
    e = F.expr
    return marked.withColumn(
        "problems",
        codes(
            (e("_q"), "plan_invalide"),
            (
                e(
                    "NOT _q AND NOT (coalesce(plane.width > 0 AND plane.depth > 0, false) "
                    f"AND {finite('plane.width')} AND {finite('plane.depth')})"
                ),
                "dimensions",
            ),
            (e("NOT _q AND NOT coalesce(_area > 1e-4, false)"), "plan_degenere"),
            (e("NOT _q AND _c"), "contour_invalide"),
            (e(f"NOT _q AND NOT _c AND {outside}"), "hors_image"),
            (
                e(f"NOT _q AND NOT forall(coalesce(holes, array()), h -> h IS NOT NULL AND forall(h, p -> {point}))"),
                "trous_invalides",
            ),
            (e(f"horizon IS NOT NULL AND NOT {finite('horizon')}"), "horizon_invalide"),
        ),
    ).drop("_q", "_c", "_area")


def scene_problems(scenes: DataFrame, zones: DataFrame, order: str) -> DataFrame:
    """(scene_id, problems): the codes of a scene's zones by their place, or that it has none.

    scenes: scene_id; zones: validate_scene_input rows with scene_id and `order`.
    """
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy(order)) - 1
    named = zones.withColumn("_k", place).select(
        "scene_id", "_k", F.posexplode("problems").alias("_i", "code"),
    ).select("scene_id", F.struct("_k", "_i", F.concat(F.lit("zone"), F.col("_k"), F.lit("_"), "code").alias("code")).alias("p"))
    listed = named.groupBy("scene_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    counted = zones.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_zones"))
    none = F.array().cast("array<string>")
    return (
        scenes.join(counted, "scene_id", "left").join(listed, "scene_id", "left")
        .select(
            "scene_id",
            F.when(F.col("_zones").isNull(), F.array(F.lit("aucune_zone"))).otherwise(F.coalesce(F.col("ps.code"), none)).alias("problems"),
        )
    )


def normalise_scene(scenes: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(scenes with defaults filled in, refused scenes with a reason).

    scenes: scene_id, schema, label, zones (array of struct zone_id, surface_id,
    ord, polygon, quad, width, depth), occluders (array of struct polygon, depth),
    strength, ambient. Zones come out sorted by order, surfaces once each.
    """
    known = F.col("schema").isNull() | (F.substring_index("schema", "@", 1) == family)
    judged = scenes.withColumn(
        "refusal",
        F.when(~known, "unknown_schema").when(F.coalesce(F.size("zones"), F.lit(0)) <= 0, "no_zone"),
    )
    width, depth = PLANE_DEFAULTS["width"], PLANE_DEFAULTS["depth"]
    filled = judged.where("refusal IS NULL").selectExpr(
        "scene_id",
        "coalesce(label, 'Ma pièce') AS label",
        "coalesce(strength, 1D) AS strength",
        "coalesce(ambient, 0.22D) AS ambient",
        "filter(coalesce(occluders, array()), o -> size(o.polygon) >= 3) AS occluders",
        f"""array_sort(transform(zones, (z, i) -> struct(
              coalesce(z.ord, CAST(i AS double)) AS ord,
              i AS pos,
              coalesce(z.zone_id, concat('zone-', i + 1)) AS zone_id,
              coalesce(z.surface_id, 'sol') AS surface_id,
              coalesce(z.width, {width}D) AS width,
              coalesce(z.depth, {depth}D) AS depth,
              if(size(z.polygon) >= 3, z.polygon, z.quad) AS polygon))) AS zones""",
    ).selectExpr("*", "array_distinct(transform(zones, z -> z.surface_id)) AS surfaces")
    return filled, judged.where("refusal IS NOT NULL").select("scene_id", "refusal")


def scene_publication(index: DataFrame) -> DataFrame:
    """Overall status and the three sets a scene can be in.

    index: geometry_status, visual_status, status (old single one), show (nullable).
    """
    states = ("validated", "experimental", "disabled")
    looks = ("validated", "experimental", "failed", "disabled")
    known = lambda c, allowed: F.when(F.col(c).isin(list(allowed)), F.col(c))
    geometry = F.coalesce(known("geometry_status", states), known("status", states), F.lit("experimental"))
    visual = F.coalesce(known("visual_status", looks), F.lit("experimental"))
    both = index.withColumn("_g", geometry).withColumn("_v", visual)
    g, v = F.col("_g"), F.col("_v")
    ready = (g == "validated") & (v == "validated")
    return both.select(
        *index.columns,
        F.when((g == "disabled") | (v == "disabled"), "disabled")
        .when(v == "failed", "failed")
        .when(ready, "validated")
        .otherwise("experimental")
        .alias("overall"),
        ready.alias("is_public"),
        (ready & F.coalesce("show", F.lit(True))).alias("in_library"),
        (g != "disabled").alias("can_open"),
    )
