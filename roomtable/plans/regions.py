"""Queries over runs: set operations, morphology, components, polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtable.operators import evaluation as E
from roomtable.operators import governance as G
from roomtable.operators import masks as M
from roomtable.operators import regions as R
from roomtable.plans.evaluation import EIGHT, FOUR, _components_sql
from roomtable.plans.frames import (
    KEYS,
    SHEET,
    SHEET_MASK,
    TILE,
    TILE_MASK,
    UNSURE,
    sheet_frames,
    sheet_runs,
    sized,
    tile_frames,
    tile_runs,
)
from roomtable.plans.registry import query, r

#: a mask that fills most of the sheet, so that it has holes
DENSE = "raw > -0.08"
_DENSE_SQL = "luma > 0.5e0 + (-0.08)::FLOAT::DOUBLE"


def bare(df):
    return df.drop("width", "height")


def _islands(cells: str, keys: str) -> str:
    """SQL: cells to runs."""
    return f"""SELECT {keys}, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER
      (PARTITION BY {keys}, y ORDER BY x) AS isl FROM {cells}) GROUP BY {keys}, y, isl"""


@query("mask_runs", "M1", f"WITH q AS (SELECT * FROM sheet WHERE m) {_islands('q', 'photo_id')}")
def mask_runs(fx):
    return bare(M.cells_to_runs(sized(fx.sheet, SHEET), KEYS, F.col("m")))


@query("mask_cells", "M1", "SELECT photo_id, y, x FROM sheet WHERE m")
def mask_cells(fx):
    return bare(M.runs_to_cells(sheet_runs(fx).drop("side")))


@query(
    "mask_set_operations",
    "M3",
    f"""WITH q AS (SELECT photo_id, y, x, m AS a, luma > 0.5e0 AND luma < 0.6e0 AS b FROM sheet),
    o AS (SELECT 'and' AS op, photo_id, y, x FROM q WHERE a AND b UNION ALL SELECT 'or', photo_id, y, x FROM q
      WHERE a OR b UNION ALL SELECT 'xor', photo_id, y, x FROM q WHERE a <> b UNION ALL
      SELECT 'minus', photo_id, y, x FROM q WHERE a AND NOT b UNION ALL
      SELECT 'not', photo_id, y, x FROM q WHERE NOT a) {_islands('o', 'op, photo_id')}""",
)
def mask_set_operations(fx):
    runs = sheet_runs(fx, a=SHEET_MASK)
    band = M.cells_to_runs(sized(fx.sheet, SHEET), KEYS, F.expr("luma > 0.5e0 AND luma < 0.6e0"))
    first = runs.drop("side")
    out = M.complement(first, sheet_frames(fx), KEYS).withColumn("op", F.lit("not"))
    for op in ("and", "or", "xor", "minus"):
        out = out.unionByName(M.set_op(first, band, KEYS, op).withColumn("op", F.lit(op)))
    return bare(out)


def _kernel(name: str, radius: int, disc: bool) -> str:
    test = (
        f"abs(dx) <= round({radius} * sqrt(({radius * radius} - dy * dy) / {radius * radius}e0))" if disc else "true"
    )
    return f"""{name} AS (SELECT dy, dx FROM range({-radius}, {radius + 1}) a(dy), range({-radius}, {radius + 1}) b(dx)
      WHERE {test})"""


def _dilated(cells: str, kernel: str, w: int = 64, h: int = 50) -> str:
    return f"""(SELECT DISTINCT photo_id, y + dy AS y, x + dx AS x FROM {cells}, {kernel}
      WHERE y + dy BETWEEN 0 AND {h - 1} AND x + dx BETWEEN 0 AND {w - 1})"""


def _eroded(cells: str, kernel: str, outside: bool, w: int = 64, h: int = 50) -> str:
    beyond = f"(SELECT count(*) FROM {kernel} k WHERE c.y + k.dy NOT BETWEEN 0 AND {h - 1} OR c.x + k.dx NOT BETWEEN 0 AND {w - 1})"
    need = f"(SELECT count(*) FROM {kernel})"
    inside = f"""(SELECT photo_id, y - dy AS y, x - dx AS x, count(*) AS n FROM {cells}, {kernel} GROUP BY ALL)"""
    if not outside:
        return f"(SELECT photo_id, y, x FROM {inside} c WHERE n = {need})"
    return f"""(SELECT photo_id, y, x FROM {inside} c WHERE y BETWEEN 0 AND {h - 1} AND x BETWEEN 0 AND {w - 1}
      AND n + {beyond} = {need})"""


@query(
    "mask_morphology",
    "M4 J6",
    f"""WITH q AS (SELECT photo_id, y, x FROM sheet WHERE {_DENSE_SQL}), s AS (SELECT photo_id, y, x FROM sheet WHERE m),
    {_kernel('disc2', 2, True)}, {_kernel('box1', 1, False)},
    o AS (SELECT 'dilate' AS op, * FROM {_dilated('s', 'disc2')}
      UNION ALL SELECT 'erode', * FROM {_eroded('q', 'disc2', False)}
      UNION ALL SELECT 'erode_open', * FROM {_eroded('q', 'box1', True)}
      UNION ALL SELECT 'boundary', * FROM (SELECT * FROM q EXCEPT SELECT * FROM {_eroded('q', 'box1', False)})
      UNION ALL SELECT 'band', photo_id, y, x FROM sheet WHERE y < 3 OR y >= 47 OR x < 3 OR x >= 61)
    {_islands('o', 'op, photo_id')}""",
)
def mask_morphology(fx):
    dense, runs = sheet_runs(fx, d=DENSE).drop("side"), sheet_runs(fx).drop("side")
    parts = {
        "dilate": M.dilate(runs, KEYS, M.disc(2)),
        "erode": M.erode(dense, KEYS, M.disc(2)),
        "erode_open": M.erode(dense, KEYS, M.square(1), outside=True),
        "boundary": M.inner_boundary(dense, KEYS),
        "band": M.frame_band(sheet_frames(fx), KEYS, F.lit(3)),
    }
    out = None
    for op, found in parts.items():
        marked = found.withColumn("op", F.lit(op))
        out = marked if out is None else out.unionByName(marked)
    return bare(out)


_FACTS = """count(*) AS pixels, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom"""


@query(
    "mask_components",
    "M5",
    f"""WITH RECURSIVE q AS (SELECT photo_id, y, x FROM sheet WHERE m), {_components_sql('q', 'photo_id', EIGHT)}
    SELECT photo_id, {_FACTS} FROM nd JOIN lb USING (id) GROUP BY photo_id, lab""",
)
def mask_components(fx):
    parts = R.components(sheet_runs(fx).drop("side"), KEYS, 8)
    return bare(R.part_facts(parts, KEYS)).drop("part")


@query(
    "background_components",
    "M5",
    f"""WITH RECURSIVE q AS (SELECT photo_id, y, x FROM sheet WHERE NOT ({_DENSE_SQL})),
    {_components_sql('q', 'photo_id', FOUR)}
    SELECT photo_id, {_FACTS} FROM nd JOIN lb USING (id) GROUP BY photo_id, lab""",
)
def background_components(fx):
    dense = sheet_runs(fx, d=DENSE).drop("side")
    parts = R.components(M.complement(dense, sheet_frames(fx), KEYS), KEYS, 4)
    return bare(R.part_facts(parts, KEYS)).drop("part")


@query(
    "clean_mask",
    "M6",
    f"""WITH RECURSIVE q AS (SELECT photo_id, y, x FROM sheet WHERE m), {_components_sql('q', 'photo_id', EIGHT)},
    o AS (SELECT photo_id, y, x FROM nd JOIN lb USING (id) QUALIFY count(*) OVER (PARTITION BY photo_id, lab)
      >= 3200 * 0.002e0) {_islands('o', 'photo_id')}""",
)
def clean_mask(fx):
    return bare(R.clean_mask(sheet_runs(fx).drop("side"), KEYS))


def _relabel(sql: str, suffix: str) -> str:
    return sql.replace("nd AS", f"nd{suffix} AS").replace("lb(id, lab)", f"lb{suffix}(id, lab)").replace(
        "recurring.lb ", f"recurring.lb{suffix} "
    ).replace("FROM nd ", f"FROM nd{suffix} ").replace("FROM lb ", f"FROM lb{suffix} ").replace(
        "JOIN nd ", f"JOIN nd{suffix} "
    )


_REFINED = f"""{_kernel('disc1', 1, True)}, {_kernel('box1', 1, False)},
  q AS (SELECT photo_id, y, x FROM sheet WHERE {_DENSE_SQL}),
  op1 AS {_eroded('q', 'disc1', True)}, op2 AS {_dilated('op1', 'disc1')},
  cl1 AS {_dilated('op2', 'box1')}, cl2 AS {_eroded('cl1', 'box1', True)},
  {_relabel(_components_sql('cl2', 'photo_id', EIGHT), '1')},
  cn AS (SELECT photo_id, y, x FROM nd1 JOIN lb1 USING (id) QUALIFY count(*) OVER (PARTITION BY photo_id, lab)
    >= 3200 * 0.002e0),
  bg AS (SELECT photo_id, y, x FROM sheet EXCEPT SELECT photo_id, y, x FROM cn),
  {_relabel(_components_sql('bg', 'photo_id', FOUR), '2')},
  hl AS (SELECT photo_id, lab, {_FACTS} FROM nd2 JOIN lb2 USING (id) GROUP BY ALL),
  fl AS (SELECT photo_id, lab FROM hl WHERE "left" > 0 AND top > 0 AND "right" < 63 AND bottom < 49
    AND pixels < 3200 * 0.0004e0 AND pixels / (("right" - "left" + 1) * (bottom - top + 1)) > 0.45
    AND greatest("right" - "left" + 1, bottom - top + 1) < 0.03 * 50),
  rf AS (SELECT * FROM cn UNION ALL SELECT photo_id, y, x FROM nd2 JOIN lb2 USING (id)
    WHERE (photo_id, lab) IN (SELECT photo_id, lab FROM fl))"""


def refined(fx):
    return R.refine_mask(
        sheet_runs(fx, d=DENSE).drop("side"), sheet_frames(fx), KEYS, R.opening_radius(*SHEET)
    )


@query("refined_mask", "M7", f"WITH RECURSIVE {_REFINED} {_islands('rf', 'photo_id')}")
def refined_mask(fx):
    return bare(refined(fx))


@query(
    "floor_zones",
    "M10",
    f"""WITH RECURSIVE q AS (SELECT photo_id, y, x FROM sheet WHERE {_DENSE_SQL}),
    {_relabel(_components_sql('q', 'photo_id', EIGHT), '1')},
    zz AS (SELECT photo_id, lab, {_FACTS} FROM nd1 JOIN lb1 USING (id) GROUP BY ALL),
    zr AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY pixels DESC, lab) AS zone FROM zz
      WHERE pixels >= 32 QUALIFY zone <= 3),
    bg AS (SELECT photo_id, y, x FROM sheet WHERE NOT ({_DENSE_SQL})),
    {_relabel(_components_sql('bg', 'photo_id', FOUR), '2')},
    hl AS (SELECT photo_id, lab, {_FACTS} FROM nd2 JOIN lb2 USING (id) GROUP BY ALL),
    ho AS (SELECT h.photo_id, l.lab, count(*) AS holes, sum(h.pixels) AS hole_pixels FROM hl h
      JOIN lb1 l ON l.id = h.lab - 1 WHERE h."left" > 0 AND h.top > 0 AND h."right" < 63 AND h.bottom < 49
      AND h.pixels >= 3200 * 0.0005e0 GROUP BY ALL)
    SELECT photo_id, zone, pixels, "left", top, "right", bottom, coalesce(holes, 0) AS holes,
      coalesce(hole_pixels, 0)::BIGINT AS hole_pixels FROM zr LEFT JOIN ho USING (photo_id, lab)""",
)
def floor_zones(fx):
    dense = sheet_runs(fx, d=DENSE).drop("side")
    return bare(R.floor_zones(dense, sheet_frames(fx), KEYS)).drop("part")


@query(
    "rug_signal",
    "M11",
    f"""WITH RECURSIVE q AS (SELECT photo_id, y, x FROM sheet WHERE luma > 0.6e0),
    {_components_sql('q', 'photo_id', EIGHT)},
    pr AS (SELECT photo_id, lab, count(*) AS pixels FROM nd JOIN lb USING (id) GROUP BY ALL)
    SELECT s.photo_id, coalesce(count_if(pixels >= 3200 * 0.002e0), 0) AS rugs, {r('coalesce(sum(pixels), 0) / 3200', 6)}
      AS area_ratio, coalesce(count_if(pixels >= 3200 * 0.002e0), 0) > 0 AS present
    FROM (SELECT DISTINCT photo_id FROM sheet) s LEFT JOIN pr USING (photo_id) GROUP BY s.photo_id""",
)
def rug_signal(fx):
    from roomtable.functions.numbers import fixed

    rugs = sheet_runs(fx, rug="luma > 0.6").drop("side")
    found = bare(R.rug_signal(rugs, sheet_frames(fx), KEYS))
    return found.withColumn("area_ratio", fixed(F.col("area_ratio"), 6))


@query(
    "floor_from_classes",
    "P22",
    """SELECT photo_id, y, count_if(class_id = 3) AS pixels FROM label_map GROUP BY photo_id, y
    HAVING count_if(class_id = 3) > 0""",
)
def floor_from_classes(fx):
    from roomtable.operators.scenes import floor_from_classes as pick

    return pick(fx.label_map).groupBy("photo_id", "y").agg(F.count(F.lit(1)).alias("pixels"))


@query(
    "baseline_masks",
    "M12",
    """SELECT vec_id AS photo_id, 'full' AS candidate, 64 AS pixels FROM embeddings
    UNION ALL SELECT vec_id, 'bottom-third', 24 FROM embeddings""",
)
def baseline_masks(fx):
    runs = M.baseline_masks(tile_frames(fx), KEYS)
    return runs.groupBy("photo_id", "candidate").agg(M.area().alias("pixels"))


@query(
    "mask_coverage",
    "M13",
    f"""SELECT photo_id, count_if(m) AS pixels, {r('count_if(m) / 64', 6)} AS coverage FROM cell GROUP BY photo_id""",
)
def mask_coverage(fx):
    from roomtable.functions.numbers import fixed

    covered = M.coverage(tile_runs(fx).drop("side"), tile_frames(fx), KEYS)
    return bare(covered).withColumn("coverage", fixed(F.col("coverage"), 6))


# --- polygons -----------------------------------------------------------------


def exclusion_shapes(fx, shape):
    """Exclusion rectangles with a triangle cut from one corner as a hole."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rect = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    cut = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x0", "y1"))
    both = F.array(
        F.struct(F.lit(False).alias("hole"), rect.alias("points")),
        F.struct(F.lit(True).alias("hole"), cut.alias("points")),
    )
    return (
        sized(fx.exclusion, shape)
        .select(*KEYS, F.col("k").cast("bigint").alias("shape_id"), "role", F.explode(both).alias("s"))
        .select(*KEYS, "shape_id", "role", "s.hole", "s.points")
    )


def _corners(w: int, h: int) -> str:
    at = lambda c, n: f"round_even(least(greatest({c}, 0), 1) * {n - 1}, 0)::BIGINT"
    return f"""SELECT photo_id, role, k, {at('x0', w)} AS xa, {at('x1', w)} AS xb, {at('y0', h)} AS ya,
      {at('y1', h)} AS yb FROM exclusion"""


@query(
    "rasterised_polygons",
    "M2",
    f"""WITH e AS ({_corners(64, 50)}), o AS (SELECT photo_id, y, x FROM e, range(0, 50) a(y), range(0, 64) b(x)
      WHERE y BETWEEN ya AND yb AND x BETWEEN xa AND xb
      AND (x - xa) * (yb - ya) + (y - ya) * (xb - xa) > (xb - xa) * (yb - ya)) {_islands('o', 'photo_id')}""",
)
def rasterised_polygons(fx):
    return bare(M.rasterise(exclusion_shapes(fx, SHEET), KEYS))


@query(
    "rasterised_polylines",
    "M9",
    f"""WITH e AS ({_corners(64, 50)}), st AS (SELECT *, greatest(abs(xb - xa), abs(yb - ya)) AS n FROM e),
    o AS (SELECT DISTINCT photo_id, floor(ya + (yb - ya) * (t / greatest(n, 1)) + 0.5e0)::BIGINT AS y,
      floor(xa + (xb - xa) * (t / greatest(n, 1)) + 0.5e0)::BIGINT AS x FROM (SELECT *, unnest(range(0, n + 1)) AS t
      FROM st)) {_islands('o', 'photo_id')}""",
)
def rasterised_polylines(fx):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = sized(fx.exclusion, SHEET).select(
        *KEYS, F.array(point("x0", "y0"), point("x1", "y1")).alias("points")
    )
    return bare(M.rasterise_polyline(lines, KEYS))


def rectangles(fx, shape):
    shapes = exclusion_shapes(fx, shape).where(~F.col("hole"))
    return M.rasterise(shapes, [*KEYS, "role"])


@query(
    "thin_shapes",
    "M8",
    f"""WITH e AS ({_corners(64, 50)}) SELECT photo_id, role, (xb - xa + 1) * (yb - ya + 1) AS pixels,
      xb - xa + 1 < 13 OR yb - ya + 1 < 13 AS thin FROM e""",
)
def thin_shapes(fx):
    return bare(R.thin_shapes(rectangles(fx, SHEET), [*KEYS, "role"], 6))


@query(
    "bleed_by_role",
    "A22",
    f"""WITH e AS ({_corners(8, 8)}), a AS (SELECT e.photo_id, role, (xb - xa + 1) * (yb - ya + 1) AS area,
      count_if(m AND y BETWEEN ya AND yb AND x BETWEEN xa AND xb) AS overflow,
      xb - xa + 1 < 3 OR yb - ya + 1 < 3 AS thin FROM e JOIN cell USING (photo_id) GROUP BY ALL)
    SELECT role, count(*) AS exclusions, sum(area)::BIGINT AS area, sum(overflow)::BIGINT AS overflow,
      {r('sum(overflow)::DOUBLE / sum(area)', 4)} AS bleed_ratio, count_if(thin) AS thin_total,
      count_if(thin AND overflow > area * 0.5) AS thin_lost FROM a GROUP BY role""",
)
def bleed_by_role(fx):
    keyed = [*KEYS, "role"]
    runs = rectangles(fx, TILE)
    thin = R.thin_shapes(runs, keyed, 1).select(*keyed, "thin")
    shapes = runs.join(thin, keyed).withColumn("shape_id", F.lit(0))
    return E.bleed_by_role(shapes, tile_runs(fx, m=TILE_MASK).drop("side"), KEYS)


@query(
    "review_crops",
    "P12",
    f"""WITH g AS (SELECT photo_id, role, min(x0) * 639 AS l, max(x1) * 639 AS rr, min(y0) * 479 AS t, max(y1) * 479 AS b
      FROM exclusion GROUP BY ALL),
    s AS (SELECT *, least(greatest(rr - l, b - t, 90.0e0) * 1.7e0, 480e0) AS side FROM g)
    SELECT photo_id, role, round_even(least(greatest((l + rr) / 2 - side / 2, 0), 640 - side), 0)::BIGINT AS "left",
      round_even(least(greatest((t + b) / 2 - side / 2, 0), 480 - side), 0)::BIGINT AS top,
      round_even(side, 0)::BIGINT AS side FROM s""",
)
def review_crops(fx):
    return G.crop_boxes(fx.exclusion, ["photo_id", "role"], 640, 480)


@query(
    "review_selection",
    "P12",
    """WITH o AS (SELECT photo_id AS p, k, role, x0 FROM exclusion), g AS (SELECT p % 20 AS board, *,
      row_number() OVER (PARTITION BY p % 20, role ORDER BY p) AS n FROM o)
    SELECT 'first' AS mode, board, p FROM g WHERE role = 'opening' AND n = 1
    UNION ALL SELECT 'idx:0,2', board, p FROM g WHERE role = 'opening' AND n IN (1, 3)
    UNION ALL SELECT 'thin', board, p FROM g WHERE role = 'opening' AND x0 < 0.2e0
    UNION ALL SELECT 'union', board, p FROM g WHERE role = 'opening'""",
)
def review_selection(fx):
    shapes = fx.exclusion.select(
        (F.col("photo_id") % 20).alias("board"), F.col("photo_id").alias("p"), "role", (F.col("x0") < 0.2).alias("thin")
    )
    out = None
    for mode in ("first", "idx:0,2", "thin", "union"):
        picked = G.select_shapes(shapes, "board", "role", "opening", "p", mode)
        marked = picked.select(F.lit(mode).alias("mode"), "board", "p")
        out = marked if out is None else out.unionByName(marked)
    return out


@query(
    "review_readiness",
    "P11",
    f"""WITH e AS ({_corners(8, 8)}), {_kernel('box2', 2, False)},
    ec AS (SELECT photo_id, y, x FROM e, range(0, 8) a(y), range(0, 8) b(x) WHERE y BETWEEN ya AND yb AND x BETWEEN xa AND xb),
    co AS {_eroded('ec', 'box2', True, 8, 8)},
    hit AS (SELECT DISTINCT photo_id FROM co JOIN cell USING (photo_id, y, x) WHERE m),
    ov AS (SELECT photo_id, count_if(m AND abs(luma - 0.5e0) < 0.02e0) AS shared FROM cell GROUP BY 1)
    SELECT s.photo_id, s.turn, turn % 7 <> 6 AND NOT (s.photo_id % 3 = 0 AND turn % 2 = 1) AS sizes_match, shared = 0 AS floor_and_uncertain_disjoint,
      s.vec_id NOT IN (SELECT photo_id FROM hit) AS exclusions_clear, e.role <> 'unknown' AS roles_kept,
      turn % 5 <> 4 AND NOT (s.photo_id % 3 = 0 AND s.photo_id % 4 = 0) AS mask_unchanged, status = 'draft' AS is_draft, annotator = 'assistant' AS expected_annotator,
      coalesce(pass_label = 'A', false) AS label_kept
    FROM pass s JOIN ov ON ov.photo_id = s.vec_id JOIN e ON e.photo_id = s.vec_id""",
)
def review_readiness(fx):
    runs = tile_runs(fx, f=TILE_MASK, u=UNSURE)
    swept = M.stretches(runs, KEYS, ["f", "u"]).where("f > 0 AND u > 0")
    shared = swept.groupBy(F.col("photo_id").alias("vec_id")).agg(M.area().alias("shared"))
    cores = M.erode(rectangles(fx, TILE), [*KEYS, "role"], M.square(2), outside=True)
    floor = runs.where("side = 'f'").drop("side")
    hit = M.stretches(M.gather({"c": cores, "f": floor}, KEYS), KEYS, ["c", "f"]).where("c > 0 AND f > 0")
    roles = fx.exclusion.groupBy(F.col("photo_id").alias("vec_id")).agg(
        F.sum((F.col("role") == "unknown").cast("int")).alias("unknown_roles")
    )
    digest = F.sha2(F.col("vec_id").cast("string"), 256)
    passes = fx.view("pass").join(roles, "vec_id").select(
        "*",
        F.when(F.col("turn") % 7 == 6, 9).otherwise(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit(8).alias("frame_width"),
        F.lit(8).alias("frame_height"),
        F.col("vec_id").alias("mask"),
        F.when(F.col("turn") % 5 == 4, "drifted").otherwise(digest).alias("mask_digest"),
        # a third of the photos has an uncertain mask as well
        F.when(F.col("photo_id") % 3 == 0, F.col("vec_id")).alias("uncertain_mask"),
        F.when(F.col("photo_id") % 4 == 0, "drifted").otherwise(digest).alias("uncertain_digest"),
        F.when(F.col("turn") % 2 == 1, 7).when(F.col("turn") % 7 == 6, 9).otherwise(8).alias("uncertain_width"),
        F.lit(8).alias("uncertain_height"),
    )
    by_pass = passes.select("photo_id", "turn", "vec_id")
    digests = fx.embeddings.select(F.col("vec_id").alias("mask"), digest.alias("digest"))
    return G.review_readiness(
        passes,
        by_pass.join(shared, "vec_id").select("photo_id", "turn", "shared"),
        by_pass.join(hit.select(F.col("photo_id").alias("vec_id")).distinct(), "vec_id"),
        digests,
        "assistant",
        "A",
    )
