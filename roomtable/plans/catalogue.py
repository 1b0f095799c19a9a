"""Queries over the product catalogue and the scene contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtable.functions.numbers import fixed, piped
from roomtable.functions.vocabulary import PATTERNS, TONES
from roomtable.operators import catalogue as C
from roomtable.operators import scenes as S
from roomtable.plans.registry import query, r

_KIND = """CASE WHEN lower(finish) LIKE '%brut%' OR lower(finish) LIKE '%bross%' THEN 'brut'
  WHEN lower(finish) LIKE '%satin%' THEN 'satine' WHEN lower(finish) LIKE '%vernis%' AND lower(finish) LIKE '%mat%' THEN 'mat'
  WHEN lower(finish) LIKE '%vernis%' THEN 'vernis' WHEN lower(finish) LIKE '%cir%' THEN 'cire'
  WHEN lower(finish) LIKE '%huil%' THEN 'huile' ELSE 'mat' END"""
_SURFACE = ", ".join(f"('{k}', {a}e0, {b}e0)" for k, (a, b) in C.FINISHES.items())


@query(
    "enriched_materials",
    "C1",
    f"""SELECT ref, kind AS finish_kind, rough AS roughness, clear AS clearcoat, {r('0.45e0 - clear * 0.6e0', 4)} AS relief,
    {r('coalesce(CASE WHEN ref % 5 = 0 THEN 0.25e0 END, (width_mm % 40) / 30e0)', 6)} AS variation,
    (CASE WHEN length_mm = 0 THEN width_mm * 9 ELSE length_mm END)::BIGINT AS board_length_mm
    FROM (SELECT *, {_KIND} AS kind FROM product) p JOIN (VALUES {_SURFACE}) f(kind, rough, clear) USING (kind)""",
)
def enriched_materials(fx):
    textured = fx.product.selectExpr("*", "width_mm % 40 AS texture_spread", "if(ref % 5 = 0, 0.25D, NULL) AS variation")
    return C.enrich_material(textured).select(
        "ref", "finish_kind", "roughness", "clearcoat", fixed(F.col("relief"), 4).alias("relief"),
        fixed(F.col("variation"), 6).alias("variation"),
        F.col("board_length_mm").cast("bigint").alias("board_length_mm"),
    )


_SIZES = """CASE {p} WHEN 'point-de-hongrie' THEN least(width_mm, 90) WHEN 'baton-rompu' THEN least(width_mm, 90) ELSE width_mm END::DOUBLE
  AS profile_width_mm, CASE {p} WHEN 'point-de-hongrie' THEN 600 WHEN 'baton-rompu' THEN 450 ELSE
  CASE WHEN length_mm = 0 THEN width_mm * 9 ELSE length_mm END END::DOUBLE AS profile_length_mm, 45e0 AS angle_deg"""


@query("pattern_profiles", "C2", f"SELECT ref, pattern, {_SIZES.format(p='pattern')} FROM product")
def pattern_profiles(fx):
    return C.pattern_profile(fx.product).select(
        "ref", "pattern", "profile_width_mm", "profile_length_mm", "angle_deg"
    )


@query(
    "product_variants",
    "C3",
    f"""SELECT ref, variant, {_SIZES.format(p='variant')} FROM product,
    (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) v(variant) WHERE variant <> 'baton-rompu' OR width_mm <= 120""",
)
def product_variants(fx):
    narrow = F.array(*[F.lit(p) for p in PATTERNS])
    wide = F.array(*[F.lit(p) for p in PATTERNS if p != "baton-rompu"])
    products = fx.product.withColumn("compatible", F.when(F.col("width_mm") <= 120, narrow).otherwise(wide))
    return C.expand_variants(products).select(
        "ref", "variant", "profile_width_mm", "profile_length_mm", "angle_deg"
    )


@query(
    "catalogue_facets",
    "C4",
    """SELECT 'tone' AS facet, tone AS entry, count(*) AS items FROM product WHERE pattern = 'lames' GROUP BY tone
    UNION ALL SELECT 'pattern', pattern, count(*) FROM product WHERE pattern = 'lames' GROUP BY pattern
    UNION ALL SELECT 'width_mm', CAST(width_mm AS VARCHAR), count(*) FROM product WHERE pattern = 'lames' GROUP BY width_mm""",
)
def catalogue_facets(fx):
    return C.facets(fx.product, ["tone", "pattern", "width_mm"], {"pattern": "lames"})


@query(
    "filtered_catalogue",
    "C4",
    "SELECT ref, name FROM product WHERE tone = 'chaud' AND width_mm = 150",
)
def filtered_catalogue(fx):
    return C.filter_catalogue(fx.product, {"tone": "chaud", "width_mm": "150"}).select("ref", "name")


_ATTRIBUTES = ("pattern", "tone", "width_mm", "finish")


@query(
    "product_alternatives",
    "C5",
    f"""WITH rq AS (SELECT ref, 'pattern' AS attribute, w AS wanted FROM product, (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) v(w)
      WHERE w <> pattern UNION ALL SELECT ref, 'tone', w FROM product, (VALUES {', '.join(f"('{t}')" for t in TONES)}) v(w) WHERE w <> tone),
    sc AS (SELECT q.ref, q.attribute, q.wanted, o.ref AS variant, (q.attribute <> 'pattern' AND o.pattern = p.pattern)::INT
      + (q.attribute <> 'tone' AND o.tone = p.tone)::INT + (o.width_mm = p.width_mm)::INT + (o.finish = p.finish)::INT AS kept
      FROM rq q JOIN product p USING (ref) JOIN product o ON o.ref <> p.ref
      AND CASE q.attribute WHEN 'pattern' THEN o.pattern ELSE o.tone END = q.wanted)
    SELECT ref, attribute, wanted, arg_min(variant, [-kept, variant]) AS variant, max(kept)::BIGINT AS kept FROM sc GROUP BY ALL""",
)
def product_alternatives(fx):
    ask = lambda a, values: F.transform(
        F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v != F.col(a)),
        lambda v: F.struct(F.lit(a).alias("attribute"), v.alias("wanted")),
    )
    requests = fx.product.select(
        "ref", F.explode(F.concat(ask("pattern", PATTERNS), ask("tone", TONES))).alias("q")
    ).select("ref", "q.attribute", "q.wanted")
    return C.find_variants(fx.product, requests, _ATTRIBUTES)


@query(
    "catalogue_problems",
    "P26",
    """SELECT ref, concat_ws('|', CASE WHEN width_mm <= 0 OR length_mm <= 0 THEN 'dimensions' END,
      CASE WHEN round(mw * 1000) <> width_mm THEN 'mapping_width' END,
      CASE WHEN NOT regexp_full_match(url, 'https://shop\\.example/floor/[A-Z]+[0-9]+/') THEN 'url_shape' END,
      CASE WHEN NOT contains(url, CAST(ref AS VARCHAR)) THEN 'url_without_reference' END) AS problems
    FROM (SELECT *, 'https://shop.example/floor/' || CASE WHEN tone = 'chaud' THEN 'p' ELSE 'P' END || CAST(CASE WHEN finish = 'Satiné'
      THEN width_mm ELSE ref END AS VARCHAR) || '/' AS url, CASE WHEN pattern = 'baton-rompu' AND width_mm > 100 THEN 0.09e0
      ELSE width_mm / 1000e0 END AS mw FROM product)""",
)
def catalogue_problems(fx):
    url = F.concat(
        F.lit("https://shop.example/floor/"),
        F.when(F.col("tone") == "chaud", "p").otherwise("P"),
        F.when(F.col("finish") == "Satiné", F.col("width_mm").cast("string")).otherwise(F.col("ref").cast("string")),
        F.lit("/"),
    )
    products = fx.product.withColumn("url", url).withColumn(
        "mapping_width_m",
        F.when((F.col("pattern") == "baton-rompu") & (F.col("width_mm") > 100), 0.09).otherwise(
            F.col("width_mm") / 1000.0
        ),
    )
    checked = C.catalogue_checks(products, r"^https://shop\.example/floor/[A-Z]+[0-9]+/$")
    return checked.select("ref", piped(F.col("problems")).alias("problems"))


# --- scenes ------------------------------------------------------------------


def _planes(fx):
    return fx.plane.select(
        "plane_ref", F.struct("far_y", F.col("width_m").alias("width"), F.col("depth_m").alias("depth")).alias("plane")
    )


def _zones(fx):
    """Zones with an inline plane where the zone id is a multiple of 6."""
    inline = F.when(
        F.col("zone_id") % 6 == 0,
        F.struct(F.lit(0.5).alias("far_y"), F.lit(9.0).alias("width"), F.lit(3.0).alias("depth")),
    )
    return fx.zone.withColumn("inline", inline)


@query(
    "resolved_zones",
    "J2",
    """WITH z AS (SELECT *, CASE WHEN zone_id % 6 = 0 THEN 9e0 END AS inl FROM zone),
    j AS (SELECT z.*, width_m FROM z LEFT JOIN plane p ON p.plane_ref = z.plane_ref)
    SELECT 'inline_wins' AS contract, zone_id, coalesce(inl, width_m) AS width, coalesce(inl, width_m) IS NULL AS dead FROM j
    UNION ALL SELECT 'named_wins', zone_id, CASE WHEN plane_ref IS NOT NULL AND width_m IS NULL THEN NULL ELSE coalesce(width_m, inl) END,
      coalesce(width_m, inl) IS NULL OR (plane_ref IS NOT NULL AND width_m IS NULL) FROM j""",
)
def resolved_zones(fx):
    # every scene shares the planes of the table
    refs = fx.zone.select("scene_id", "plane_ref").where("plane_ref IS NOT NULL").distinct()
    planes = refs.join(_planes(fx), "plane_ref")
    out = None
    for contract, named_first in (("inline_wins", False), ("named_wins", True)):
        live, dead = S.resolve_planes(_zones(fx), planes, named_first)
        rows = live.select(
            F.lit(contract).alias("contract"), F.col("zone_id").cast("bigint").alias("zone_id"),
            F.col("plane.width").alias("width"), F.lit(False).alias("dead"),
        ).unionByName(
            dead.select(
                F.lit(contract).alias("contract"), F.col("zone_id").cast("bigint").alias("zone_id"),
                F.lit(None).cast("double").alias("width"), F.lit(True).alias("dead"),
            )
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(
    "scene_input_problems",
    "P13",
    """SELECT zone_id, concat_ws('|', CASE WHEN f IS NOT NULL AND zone_id % 5 = 1 THEN 'contour_invalide' END,
      CASE WHEN f IS NOT NULL AND NOT (width_m > 0 AND depth_m > 0) THEN 'dimensions' END,
      CASE WHEN f IS NOT NULL AND zone_id % 5 <> 1 AND zone_id / 20 > 1.05 THEN 'hors_image' END,
      CASE WHEN f IS NOT NULL AND NOT abs((1 - f) * 0.8) > 1e-4 THEN 'plan_degenere' END,
      CASE WHEN f IS NULL THEN 'plan_invalide' END) AS problems
    FROM (SELECT z.zone_id, width_m, depth_m, CASE WHEN z.plane_ref = 4 THEN 1e0 ELSE far_y END AS f FROM zone z
      LEFT JOIN plane p ON p.plane_ref = z.plane_ref)""",
)
def scene_input_problems(fx):
    far = F.when(F.col("plane_ref") == 4, 1.0).otherwise(F.col("far_y"))
    quad = F.array(
        _point(F.lit(0.1), far), _point(F.lit(0.9), far), _point(F.lit(0.9), F.lit(1.0)), _point(F.lit(0.1), F.lit(1.0))
    )
    joined = fx.zone.join(fx.plane, "plane_ref", "left")
    edge = F.array(
        _point(F.lit(0.1), F.lit(0.5)), _point(F.col("zone_id") / 20, F.lit(0.5)), _point(F.lit(0.5), F.lit(1.0))
    )
    zones = joined.select(
        F.col("zone_id").cast("bigint").alias("zone_id"),
        F.when(
            F.col("far_y").isNotNull(),
            F.struct(quad.alias("quad"), F.col("width_m").alias("width"), F.col("depth_m").alias("depth")),
        ).alias("plane"),
        F.when(F.col("zone_id") % 5 == 1, F.slice(edge, 1, 2)).otherwise(edge).alias("polygon"),
        F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes"),
        F.lit(0.4).alias("horizon"),
    )
    return S.validate_scene_input(zones).select("zone_id", piped(F.col("problems")).alias("problems"))


@query(
    "scene_zone_problems",
    "P13",
    """SELECT scene_id::BIGINT AS scene_id, concat_ws('|', CASE WHEN count(zone_id) = 0 THEN 'aucune_zone' END, string_agg('zone' || k || '_dimensions', '|' ORDER BY k)
      FILTER (zone_id % 3 = 0)) AS problems FROM (SELECT s.scene_id, z.zone_id, row_number() OVER (PARTITION BY s.scene_id ORDER BY zone_id) - 1 AS k
      FROM range(0, 6) s(scene_id) LEFT JOIN zone z ON z.scene_id = s.scene_id) GROUP BY scene_id""",
)
def scene_zone_problems(fx):
    edge = F.array(_point(F.lit(0.1), F.lit(0.5)), _point(F.lit(0.9), F.lit(0.5)), _point(F.lit(0.5), F.lit(1.0)))
    quad = F.array(_point(F.lit(0.1), F.lit(0.2)), _point(F.lit(0.9), F.lit(0.2)), _point(F.lit(0.9), F.lit(1.0)), _point(F.lit(0.1), F.lit(1.0)))
    zones = fx.zone.select(
        "scene_id",
        "zone_id",
        F.struct(quad.alias("quad"), F.when(F.col("zone_id") % 3 == 0, 0.0).otherwise(2.0).alias("width"), F.lit(3.0).alias("depth")).alias("plane"),
        edge.alias("polygon"),
        F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes"),
        F.lit(0.4).alias("horizon"),
    )
    scenes = fx.spark.range(6).select(F.col("id").alias("scene_id"))
    found = S.scene_problems(scenes, S.validate_scene_input(zones), "zone_id")
    return found.select("scene_id", F.array_join("problems", "|").alias("problems"))


@query(
    "normalised_scenes",
    "P14",
    """SELECT scene_id::BIGINT AS scene_id, string_agg(zone_id, '|' ORDER BY ord) AS zones,
      string_agg(DISTINCT CASE WHEN zone_id % 2 = 0 THEN 'sol' ELSE 'salon' END, '|' ORDER BY CASE WHEN zone_id % 2 = 0 THEN 'sol' ELSE 'salon' END) AS surfaces,
      count(*) FILTER (zone_id % 3 <> 0) AS occluders, NULL AS refusal FROM zone WHERE scene_id <> 3 GROUP BY scene_id
    UNION ALL SELECT DISTINCT 3, NULL, NULL, NULL, 'unknown_schema' FROM zone WHERE scene_id = 3""",
)
def normalised_scenes(fx):
    polygon = F.array(_point(F.lit(0), F.lit(0)), _point(F.lit(1), F.lit(0)), _point(F.lit(1), F.lit(1)))
    short = F.slice(polygon, 1, 2)
    zone = F.struct(
        F.col("zone_id").cast("string").alias("zone_id"),
        F.when(F.col("zone_id") % 2 == 1, "salon").alias("surface_id"),
        F.col("ord").cast("double").alias("ord"),
        short.alias("polygon"),
        polygon.alias("quad"),
        F.lit(None).cast("double").alias("width"),
        F.lit(None).cast("double").alias("depth"),
    )
    occluder = F.struct(
        F.when(F.col("zone_id") % 3 == 0, short).otherwise(polygon).alias("polygon"), F.lit(0.5).alias("depth")
    )
    scenes = fx.zone.groupBy("scene_id").agg(
        F.collect_list(zone).alias("zones"), F.collect_list(occluder).alias("occluders")
    ).select(
        "*",
        F.when(F.col("scene_id") == 3, "other@1").otherwise("scene@1").alias("schema"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("double").alias("strength"),
        F.lit(None).cast("double").alias("ambient"),
    )
    good, bad = S.normalise_scene(scenes, "scene")
    return good.select(
        F.col("scene_id").cast("bigint").alias("scene_id"),
        F.expr("array_join(transform(zones, z -> z.zone_id), '|')").alias("zones"),
        piped(F.col("surfaces")).alias("surfaces"),
        F.size("occluders").cast("bigint").alias("occluders"),
    ).unionByName(
        bad.select(F.col("scene_id").cast("bigint").alias("scene_id"), "refusal"), allowMissingColumns=True
    )


@query(
    "scene_publication",
    "P15",
    """SELECT zone_id::BIGINT AS zone_id, CASE WHEN g = 'disabled' OR v = 'disabled' THEN 'disabled' WHEN v = 'failed' THEN 'failed'
      WHEN g = 'validated' AND v = 'validated' THEN 'validated' ELSE 'experimental' END AS overall,
      g = 'validated' AND v = 'validated' AS is_public, g = 'validated' AND v = 'validated' AND zone_id % 4 <> 1 AS in_library,
      g <> 'disabled' AS can_open
    FROM (SELECT zone_id, CASE zone_id % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'validated' WHEN 2 THEN 'experimental' ELSE 'disabled' END AS g,
      CASE zone_id % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'validated' WHEN 2 THEN 'failed' WHEN 3 THEN 'disabled' ELSE 'experimental' END AS v
      FROM zone)""",
)
def scene_publication(fx):
    index = fx.zone.selectExpr(
        "cast(zone_id AS bigint) AS zone_id",
        "CASE zone_id % 4 WHEN 0 THEN 'validated' WHEN 2 THEN 'unheard-of' WHEN 3 THEN 'disabled' END AS geometry_status",
        "CASE zone_id % 4 WHEN 1 THEN 'validated' END AS status",
        """CASE zone_id % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'validated' WHEN 2 THEN 'failed' WHEN 3 THEN 'disabled' END
           AS visual_status""",
        "if(zone_id % 4 = 1, false, NULL) AS show",
    )
    return S.scene_publication(index).select("zone_id", "overall", "is_public", "in_library", "can_open")
