"""Queries over pixel tables: exposure, sharpness, seeds, augmentation."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from roomtable.functions.draws import drawn, share_sql
from roomtable.functions.numbers import fixed, piped
from roomtable.functions.settings import DEFAULTS
from roomtable.operators import image as I
from roomtable.operators.scenes import decide_status
from roomtable.plans.frames import KEYS, SHEET, TILE, sheet_lines, sized, tile_frames, tile_lines
from roomtable.plans.registry import query, r

#: Thresholds for 8 x 8 tiles: only the sizes differ from the defaults.
SMALL = replace(DEFAULTS, min_long_side=8, blur_working_side=8)

_AS_LUMA = "transform(line, v -> least(1D, greatest(0D, 0.5D + cast(v AS double)))) AS line"


def tile_luma(fx):
    return tile_lines(fx).selectExpr(*KEYS, "cast(y AS bigint) AS y", _AS_LUMA)


def sheet_luma(fx):
    return sheet_lines(fx).selectExpr(*KEYS, "y", _AS_LUMA)


def plain(df):
    return df.drop("width", "height")


# --- SQL building blocks on cells -------------------------------------------


def _m(c: str, n: int) -> str:
    """SQL: mirrored coordinate."""
    return f"({n - 1} - abs({n - 1} - abs({c})))"


def _conv(source: str, value: str, kernel: str, w: int = 8, h: int = 8, mirror: bool = True) -> str:
    """SQL: weighted sum over neighbours; kernel is a table (dy, dx, k)."""
    yy = _m("c.y + dy", h) if mirror else f"least(greatest(c.y + dy, 0), {h - 1})"
    xx = _m("c.x + dx", w) if mirror else f"least(greatest(c.x + dx, 0), {w - 1})"
    return f"""(SELECT c.photo_id, c.y, c.x, sum(k * n.{value}) AS v FROM {source} c, {kernel} kk
      JOIN {source} n ON n.photo_id = c.photo_id AND n.y = {yy} AND n.x = {xx}
      GROUP BY c.photo_id, c.y, c.x)"""


def _outer(down, across) -> str:
    a, b = len(down) // 2, len(across) // 2
    return "(VALUES " + ", ".join(
        f"({i - a}, {j - b}, {u * v!r}e0)" if "e" not in repr(u * v) else f"({i - a}, {j - b}, {u * v!r})"
        for i, u in enumerate(down)
        for j, v in enumerate(across)
        if u * v != 0
    ) + ") kv(dy, dx, k)"


_BIN, _SUM, _DIF = (0.25, 0.5, 0.25), (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)


def _kernels() -> str:
    return f"""kb AS (SELECT * FROM {_outer(_BIN, _BIN)}), kx AS (SELECT * FROM {_outer(_SUM, _DIF)}),
    ky AS (SELECT * FROM {_outer(_DIF, _SUM)}), k9 AS (SELECT a.dy, b.dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
    kw AS (SELECT 0 AS dy, dx, 1e0 AS k FROM range(-4, 5) b(dx)), kt AS (SELECT dy, 0 AS dx, 1e0 AS k FROM range(-4, 5) b(dy))"""


def _pixels(source: str, w: int, h: int) -> str:
    """SQL CTEs: dn (denoised bytes), sg (raw gradient), gx/gy of the denoised."""
    return f"""{_kernels()},
    px AS MATERIALIZED (SELECT photo_id, y, x, luma, round_even(luma * 255e0, 0) AS b, floor(luma * 255e0) AS fb FROM {source}),
    dn AS MATERIALIZED (SELECT c.photo_id, c.y, c.x, quantile_disc(n.b, 0.5) AS b FROM px c, k9 JOIN px n
      ON n.photo_id = c.photo_id AND n.y = least(greatest(c.y + dy, 0), {h - 1})
      AND n.x = least(greatest(c.x + dx, 0), {w - 1}) GROUP BY c.photo_id, c.y, c.x),
    s0 AS MATERIALIZED {_conv('px', 'luma', 'kb', w, h)}, s1 AS MATERIALIZED {_conv('dn', 'b', 'kb', w, h)},
    rx AS {_conv('s0', 'v', 'kx', w, h)}, ry AS {_conv('s0', 'v', 'ky', w, h)},
    gx AS MATERIALIZED {_conv('s1', 'v', 'kx', w, h)}, gy AS MATERIALIZED {_conv('s1', 'v', 'ky', w, h)},
    st AS (SELECT photo_id, {r('count_if(hypot_ > 0.08e0) / count(*)', 6)} AS strong_gradient_ratio FROM
      (SELECT rx.photo_id, sqrt(rx.v * rx.v + ry.v * ry.v) AS hypot_ FROM rx JOIN ry USING (photo_id, y, x))
      GROUP BY photo_id),
    k5 AS (SELECT * FROM (VALUES (0, 0, -4e0), (1, 0, 1e0), (-1, 0, 1e0), (0, 1, 1e0), (0, -1, 1e0)) kv(dy, dx, k)),
    lp AS (SELECT photo_id, {r('sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*))', 3)} AS laplacian_variance FROM {_conv('px', 'fb', 'k5', w, h)} GROUP BY photo_id),
    bw AS {_conv('dn', 'b', 'kw', w, h)}, bt AS {_conv('dn', 'b', 'kt', w, h)},
    rb AS (SELECT a.photo_id, 'x' AS axis, abs(b.b - a.b) AS o, abs(wb.v - wa.v) / 9 AS q FROM dn a
        JOIN dn b ON b.photo_id = a.photo_id AND b.y = a.y AND b.x = a.x + 1
        JOIN bw wa ON wa.photo_id = a.photo_id AND wa.y = a.y AND wa.x = a.x
        JOIN bw wb ON wb.photo_id = b.photo_id AND wb.y = b.y AND wb.x = b.x
      UNION ALL SELECT a.photo_id, 'y', abs(b.b - a.b), abs(wb.v - wa.v) / 9 FROM dn a
        JOIN dn b ON b.photo_id = a.photo_id AND b.x = a.x AND b.y = a.y + 1
        JOIN bt wa ON wa.photo_id = a.photo_id AND wa.y = a.y AND wa.x = a.x
        JOIN bt wb ON wb.photo_id = b.photo_id AND wb.y = b.y AND wb.x = b.x),
    rr AS (SELECT photo_id, {r('max(score)', 5)} AS reblur_ratio FROM (SELECT photo_id, axis,
        CASE WHEN sum(o) > 1e-6 THEN (sum(o) - sum(greatest(o - q, 0))) / sum(o) END AS score FROM rb GROUP BY ALL)
      GROUP BY photo_id),
    pf AS (SELECT photo_id, 'x' AS axis, y AS line, x AS pos, abs(v) AS mag FROM gx
      UNION ALL SELECT photo_id, 'y', x, y, abs(v) FROM gy),
    lm AS (SELECT photo_id, axis, quantile_cont(mag, 0.999) * 0.25 AS lim FROM pf GROUP BY ALL),
    ln AS (SELECT photo_id, axis, line, list(mag ORDER BY pos) AS ms FROM pf WHERE line % 4 = 0 GROUP BY ALL),
    pk AS (SELECT *, unnest(range(2, len(ms))) AS p FROM ln),
    ww AS (SELECT photo_id, axis, p, ms,
      least(p - coalesce(list_max([i for i in range(1, p + 1) if i = 1 OR NOT (ms[i - 1] < ms[i])]), 1), 60) AS lw,
      least(coalesce(list_min([i for i in range(p, len(ms) + 1) if i = len(ms) OR NOT (ms[i + 1] < ms[i])]), len(ms)) - p, 60) AS rw
      FROM pk WHERE ms[p] > ms[p - 1] AND ms[p] >= ms[p + 1]),
    wl AS (SELECT photo_id, axis, lw + rw + 1 AS w FROM ww JOIN lm USING (photo_id, axis)
      WHERE lim > 1e-6 AND ms[p] >= lim AND lw + rw + 1 < 60),
    ew AS (SELECT photo_id, {r('max(md)', 3)} AS edge_width_px, sum(n)::BIGINT AS edge_count FROM
      (SELECT photo_id, axis, quantile_cont(w, 0.5) AS md, count(*) AS n FROM wl GROUP BY ALL) GROUP BY photo_id)"""


_TILE_SQL = _pixels("cell", 8, 8)
_BLUR = f"""SELECT photo_id, strong_gradient_ratio, laplacian_variance, reblur_ratio, edge_width_px,
  {r('edge_width_px * 8 / 8', 3)} AS edge_width_normalized, coalesce(edge_count, 0) AS edge_count,
  CAST(8 AS BIGINT) AS working_side FROM st JOIN lp USING (photo_id) JOIN rr USING (photo_id)
  LEFT JOIN ew USING (photo_id)"""
_EXPOSURE = f"""SELECT photo_id, {r('avg(luma)', 5)} AS luma_mean, {r('quantile_cont(luma, 0.5)', 5)} AS luma_median,
  {r('stddev_pop(luma)', 5)} AS contrast_std, {r('stddev_pop(luma) / greatest(avg(luma), 1e-6)', 5)} AS contrast_ratio,
  {r('quantile_cont(luma, 0.95) - quantile_cont(luma, 0.05)', 5)} AS contrast_p5_p95,
  {r('avg((luma < 0.06e0)::INT)', 5)} AS dark_pixel_ratio, {r('avg((luma > 0.98e0)::INT)', 5)} AS bright_pixel_ratio,
  {r('avg((luma >= 254e0 / 255e0)::INT)', 5)} AS clipped_high_ratio,
  {r('avg((luma <= 1e0 / 255e0)::INT)', 5)} AS clipped_low_ratio FROM cell GROUP BY photo_id"""


@query(
    "pixel_luma",
    "I1",
    f"""SELECT photo_id, y, x, {r('(0.2126e0 * floor(luma * 255) + 0.7152e0 * floor(luma * 128) + 0.0722e0 * floor(luma * 64)) / 255', 6)} AS luma FROM cell""",
)
def pixel_luma(fx):
    rgb = fx.cell.selectExpr(
        "photo_id", "y", "x", "floor(luma * 255) AS r", "floor(luma * 128) AS g", "floor(luma * 64) AS b"
    )
    return I.luma(rgb).select("photo_id", "y", "x", fixed(F.col("luma"), 6).alias("luma"))


@query(
    "image_info",
    "P25",
    f"""SELECT photo_id, {r('(max(x) + 1) / (max(y) + 1)', 5)} AS aspect_ratio,
    {r('count(*) / 1e6', 3)} AS megapixels FROM sheet GROUP BY photo_id""",
)
def image_info(fx):
    frames = fx.sheet.groupBy("photo_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )
    return I.image_info(frames, ["photo_id"])


@query("exposure_profile", "I2", _EXPOSURE)
def exposure_profile(fx):
    return plain(I.exposure_profile(tile_luma(fx), KEYS))


@query(
    "downscaled_luma",
    "I3",
    f"""SELECT photo_id, y // 3 AS y, x // 3 AS x, {r('avg(luma)', 6)} AS luma FROM sheet GROUP BY ALL""",
)
def downscaled_luma(fx):
    small = I.downscale(sheet_luma(fx), KEYS, 3)
    return small.selectExpr("photo_id", "y", "posexplode_outer(line) AS (x, v)").select(
        "photo_id", "y", F.col("x").cast("bigint").alias("x"), fixed(F.col("v"), 6).alias("luma")
    )


@query(
    "gradient_share",
    "I4",
    f"WITH {_pixels('sheet', 64, 50)} SELECT * FROM st",
)
def gradient_share(fx):
    return plain(I.gradient_facts(sheet_luma(fx), KEYS))


@query("laplacian_variance", "I5", f"WITH {_pixels('sheet', 64, 50)} SELECT * FROM lp")
def laplacian_variance(fx):
    return plain(I.laplacian_variance(sheet_luma(fx), KEYS))


@query(
    "denoised_luma",
    "I6",
    f"WITH {_TILE_SQL} SELECT photo_id, y, x, {r('b / 255', 6)} AS luma FROM dn",
)
def denoised_luma(fx):
    clean = I.denoise(tile_luma(fx), KEYS)
    return clean.selectExpr("photo_id", "y", "posexplode_outer(line) AS (x, v)").select(
        "photo_id", "y", F.col("x").cast("bigint").alias("x"), fixed(F.col("v"), 6).alias("luma")
    )


@query("reblur_ratio", "W3", f"WITH {_pixels('sheet', 64, 50)} SELECT * FROM rr")
def reblur_ratio(fx):
    return plain(I.reblur_ratio(I.denoise(sheet_luma(fx), KEYS), KEYS))


@query(
    "edge_width",
    "W4",
    f"WITH {_pixels('sheet', 64, 50)} SELECT * FROM ew",
)
def edge_width(fx):
    return plain(I.edge_widths(I.edge_blocks(sheet_luma(fx), KEYS), KEYS))


@query("blur_reading", "I7", f"WITH {_TILE_SQL} {_BLUR}")
def blur_reading(fx):
    return plain(I.blur_reading(tile_luma(fx), KEYS, SMALL))


def measures(fx):
    """Exposure and sharpness of every tile in one row."""
    blur = I.blur_reading(tile_luma(fx), KEYS, SMALL)
    return I.exposure_profile(tile_luma(fx), KEYS, SMALL).join(blur, KEYS)


def _sharp(method: str, s) -> str:
    if method == "laplacian_variance":
        return f"laplacian_variance >= {s.blur_sharp_min}"
    value, low, high = {
        "reblur_ratio": ("reblur_ratio", s.blur_reblur_sharp_max, s.blur_reblur_blurry_min),
        "edge_width": ("edge_width_normalized", s.blur_edge_width_sharp_max, s.blur_edge_width_blurry_min),
    }[method]
    return f"""CASE WHEN strong_gradient_ratio < {s.blur_min_strong_gradient_ratio} THEN NULL
      WHEN {value} <= {low} THEN true WHEN {value} >= {high} THEN false END"""


def _texture(method: str, s) -> str:
    low = f"strong_gradient_ratio < {s.blur_min_strong_gradient_ratio}"
    value = {"reblur_ratio": "reblur_ratio", "edge_width": "edge_width_normalized"}.get(method)
    return f"({low} OR {value} IS NULL)" if value else f"({low})"


_VARIANTS = [
    ("published", SMALL),
    ("strict", replace(SMALL, blur_reblur_sharp_max=0.2, blur_reblur_blurry_min=0.3)),
    ("laplacian", replace(SMALL, blur_method="laplacian_variance")),
    ("edges", replace(SMALL, blur_method="edge_width", blur_edge_width_sharp_max=3.0, blur_edge_width_blurry_min=4.0)),
    ("full-size", replace(SMALL, blur_working_side=1024)),
]


@query(
    "sharpness_verdicts",
    "P20 U2",
    f"WITH {_TILE_SQL}, bl AS ({_BLUR}) "
    + " UNION ALL ".join(
        f"""SELECT photo_id, '{name}' AS variant, {'NULL::BOOLEAN' if s.blur_working_side > 8 else _sharp(s.blur_method, s)}
        AS sharp, {'strong_gradient_ratio < 0.005' if s.blur_working_side > 8 else _texture(s.blur_method, s)} AS low_texture FROM bl"""
        for name, s in _VARIANTS
    ),
)
def sharpness_verdicts(fx):
    read = I.blur_reading(tile_luma(fx), KEYS, SMALL)
    return I.replay(read, _VARIANTS).select("photo_id", "variant", "sharp", "low_texture")


def judged(fx):
    return I.quality_codes(I.classify_sharpness(measures(fx), SMALL), SMALL)


_CODES = f"""WITH {_TILE_SQL}, bl AS ({_BLUR}), ex AS ({_EXPOSURE}), me AS (SELECT *, {_sharp('reblur_ratio', SMALL)} AS sharp,
    {_texture('reblur_ratio', SMALL)} AS low_texture FROM bl JOIN ex USING (photo_id)),
  cd AS (SELECT photo_id, concat_ws('|', CASE WHEN sharp = false THEN 'image_blurry' END,
    CASE WHEN clipped_high_ratio > 0.02 OR clipped_low_ratio > 0.05 THEN 'image_clipped' END,
    CASE WHEN contrast_ratio < 0.1 THEN 'image_low_contrast' END, CASE WHEN low_texture THEN 'image_low_texture' END,
    CASE WHEN luma_mean > 0.85 OR bright_pixel_ratio > 0.12 THEN 'image_overexposed' END,
    CASE WHEN luma_mean < 0.12 OR dark_pixel_ratio > 0.35 THEN 'image_too_dark' END) AS codes FROM me)"""


@query("quality_codes", "P19", f"{_CODES} SELECT * FROM cd")
def quality_codes(fx):
    return judged(fx).select("photo_id", piped(F.col("codes")).alias("codes"))


@query(
    "quality_status",
    "P16 P19",
    f"""{_CODES} SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 'analysis_incomplete' WHEN codes = '' THEN 'success'
    ELSE 'needs_manual_adjustment' END AS status FROM cd""",
)
def quality_status(fx):
    with_scene = judged(fx).withColumn("scene_present", F.col("photo_id") % 2 == 1)
    return decide_status(with_scene).select("photo_id", "status")


def samples(fx):
    """Measured tiles with a truth drawn from their label and id."""
    truth = fx.embeddings.select(
        F.col("vec_id").alias("photo_id"),
        F.when(F.col("label") == 0, 0.1).alias("truth_k1"),
        F.when(F.col("label") % 3 == 1, F.col("label") / 4).alias("truth_blur_sigma"),
        F.when(F.col("label") == 5, 9).alias("truth_motion_length"),
        (F.col("vec_id") % 9 != 0).alias("graded"),
    )
    return I.truth_group(I.blur_reading(tile_luma(fx), KEYS, SMALL).join(truth, "photo_id"), SMALL)


_GROUP = """sm AS (SELECT bl.*, CASE WHEN strong_gradient_ratio < 0.005 THEN 'no-support' WHEN label = 0 THEN 'resampled'
  WHEN label % 3 = 1 AND label / 4 >= 1.5 THEN 'blurred' WHEN label % 3 = 1 THEN 'borderline'
  WHEN label = 5 THEN 'blurred' WHEN vec_id % 9 = 0 THEN 'ungraded' ELSE 'sharp' END AS grp
  FROM bl JOIN embeddings ON vec_id = photo_id)"""


@query(
    "truth_groups",
    "A7",
    f"""WITH {_TILE_SQL}, bl AS ({_BLUR}), {_GROUP} SELECT photo_id, grp AS "group" FROM sm""",
)
def truth_groups(fx):
    return samples(fx).select("photo_id", "group")


def _margin(measure: str, up: bool) -> str:
    sharp = f"{'max' if up else 'min'}({measure}) FILTER (grp = 'sharp')"
    blurred = f"{'min' if up else 'max'}({measure}) FILTER (grp = 'blurred')"
    gap = f"({blurred} - {sharp})" if up else f"({sharp} - {blurred})"
    return f"""SELECT '{measure}' AS measure, count({measure}) FILTER (grp = 'sharp') AS sharp_count,
    count({measure}) FILTER (grp = 'blurred') AS blurred_count,
    count({measure}) FILTER (grp = 'sharp') > 0 AND count({measure}) FILTER (grp = 'blurred') > 0 AS usable,
    {r(sharp, 5)} AS sharp_edge, {r(blurred, 5)} AS blurred_edge, {r(gap, 5)} AS margin,
    {r(f'{gap} / nullif(max({measure}) - min({measure}), 0)', 5)} AS separation,
    {r(f'({sharp} + {blurred}) / 2', 5)} AS suggested_threshold, {gap} > 0 AS separable
    FROM sm WHERE grp IN ('sharp', 'blurred')"""


@query(
    "candidate_margins",
    "A6",
    f"WITH {_TILE_SQL}, bl AS ({_BLUR}), {_GROUP} "
    + " UNION ALL ".join(
        _margin(m, up)
        for m, up in (("laplacian_variance", False), ("reblur_ratio", True), ("edge_width_px", True))
    ),
)
def candidate_margins(fx):
    return I.candidate_margins(samples(fx))


_SEED_SQL = f"""en AS (SELECT photo_id, 'vertical' AS orientation, 64 AS span, x AS pos, sum(abs(v)) AS e FROM rgx
    WHERE y >= floor(50 * 0.08e0) AND y < floor(50 * (1 - 0.08e0)) GROUP BY ALL
  UNION ALL SELECT photo_id, 'horizontal', 50, y, sum(abs(v)) FROM rgy
    WHERE x >= floor(64 * 0.08e0) AND x < floor(64 * (1 - 0.08e0)) GROUP BY ALL),
  so AS (SELECT *, abs(pos - (span - 1) / 2) / greatest((span - 1) / 2, 1) AS off FROM en),
  li AS (SELECT photo_id, orientation, span, list([round(e * off, 9), pos] ORDER BY round(e * off, 9) DESC, pos DESC) AS l
    FROM so WHERE off >= 0.25 GROUP BY ALL),
  gr AS (SELECT photo_id, orientation, list_reduce(l, lambda kept, c: CASE WHEN len(kept) < 12 AND NOT
    coalesce(list_bool_or([abs(s - c[2]) < greatest(1, floor(span * 0.04e0)) for s in kept]), false)
    THEN list_append(kept, c[2]) ELSE kept END, []::DOUBLE[]) AS kept FROM li)"""


@query(
    "edge_seeds",
    "W5",
    f"""WITH {_kernels()}, sh AS (SELECT photo_id, y, x, luma FROM sheet), s0 AS MATERIALIZED {_conv('sh', 'luma', 'kb', 64, 50)},
    rgx AS {_conv('s0', 'v', 'kx', 64, 50)}, rgy AS {_conv('s0', 'v', 'ky', 64, 50)}, {_SEED_SQL}
    SELECT photo_id, orientation, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept)::BIGINT AS pos FROM gr""",
)
def edge_seeds(fx):
    return plain(I.edge_seeds(sheet_luma(fx), KEYS))


_SOFT = I.gaussian_kernel(1.7, 4)
_DOWN = I._convolved(_SOFT, [-1.0, -2.0, 0.0, 2.0, 1.0])
_ACROSS = I._convolved(_SOFT, [1.0, 4.0, 6.0, 4.0, 1.0])


@query(
    "geometric_floor",
    "W6",
    f"""WITH sh AS (SELECT photo_id, y, x, luma FROM sheet), kg AS (SELECT * FROM {_outer(_DOWN, _ACROSS)}),
    gg AS {_conv('sh', 'luma', 'kg', 64, 50)},
    br AS (SELECT photo_id, x, arg_min(y, [-round(abs(v), 9), y]) AS lim FROM gg WHERE y >= floor(50 * 0.35e0) GROUP BY ALL),
    ea AS (SELECT a.photo_id, a.x, floor(sum(b.lim) / 9) AS top FROM br a JOIN br b ON b.photo_id = a.photo_id
      AND abs(b.x - a.x) <= 4 GROUP BY ALL),
    o AS (SELECT photo_id, y, x FROM ea, range(0, 50) g(y) WHERE y >= top)
    SELECT photo_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY photo_id, y ORDER BY x)
      AS isl FROM o) GROUP BY photo_id, y, isl""",
)
def geometric_floor(fx):
    return plain(I.geometric_floor(sheet_luma(fx), KEYS))


# --- augmentation ------------------------------------------------------------

_TONES = [("gain", 1.8), ("gain", 0.4), ("contrast", 0.25), ("half_shadow", 0.3)]


@query(
    "augmented_tone",
    "I9",
    f"""SELECT photo_id, y, x, kind, param, floor(least(greatest(CASE WHEN kind = 'contrast' THEN (b - 128) * param + 128
      WHEN kind = 'gain' OR x < 4 THEN b * param ELSE b END, 0), 255)) / 255e0 AS luma
    FROM (SELECT *, round_even(luma * 255e0, 0) AS b FROM cell),
      (VALUES {', '.join(f"('{k}', {p}e0)" for k, p in _TONES)}) v(kind, param)""",
)
def augmented_tone(fx):
    return I.augment_tone(sized(fx.cell, TILE), _TONES)


@query(
    "augmented_crop",
    "I9",
    """SELECT photo_id, y - 15 AS y, x - 19 AS x, luma FROM sheet WHERE y >= 15 AND y < 50 AND x >= 19 AND x < 63""",
)
def augmented_crop(fx):
    return I.augment_crop(sized(fx.sheet, SHEET), 0.7, 0.15).select("photo_id", "y", "x", "luma")


_G1 = I.gaussian_kernel(1.0, I.blur_radius(1.0))
_MO = I.motion_kernel(5, 30.0)


def _cells_of(lines):
    return lines.selectExpr("photo_id", "y", "posexplode_outer(line) AS (x, v)").select(
        "photo_id", "y", F.col("x").cast("bigint").alias("x"), fixed(F.col("v"), 6).alias("luma")
    )


@query(
    "augmented_blur",
    "I10",
    f"""WITH ce AS (SELECT photo_id, y, x, luma FROM sheet), kg AS (SELECT * FROM {_outer(_G1, _G1)})
    SELECT photo_id, y, x, {r('v', 6)} AS luma FROM {_conv('ce', 'luma', 'kg', 64, 50)}""",
)
def augmented_blur(fx):
    return _cells_of(I.augment_blur(sheet_luma(fx), KEYS, 1.0))


@query(
    "augmented_motion",
    "I10",
    f"""WITH ce AS (SELECT photo_id, y, x, luma FROM sheet), kg AS (SELECT * FROM (VALUES
      {', '.join(f'({i - 2}, {j - 2}, {w:.17e})' for i, row in enumerate(_MO) for j, w in enumerate(row) if w > 1e-12)})
      kv(dy, dx, k)) SELECT photo_id, y, x, {r('v', 6)} AS luma FROM {_conv('ce', 'luma', 'kg', 64, 50)}""",
)
def augmented_motion(fx):
    return _cells_of(I.augment_motion(sheet_luma(fx), KEYS, 5, 30.0))


@query(
    "augmented_noise",
    "I11",
    f"""SELECT photo_id, y, x, floor(least(greatest(round_even(luma * 255e0, 0)
      + 6e0 * sqrt(-2e0 * ln({share_sql('u')})) * cos({2.0 * math.pi!r}e0 * {share_sql('v')}), 0), 255)) / 255e0 AS luma
    FROM (SELECT *, {', '.join([*drawn('u', 7, 1, 'photo_id', 'y', 'x'), *drawn('v', 7, 2, 'photo_id', 'y', 'x')])} FROM cell)""",
)
def augmented_noise(fx):
    return I.augment_noise(fx.cell, 6.0, 7).select("photo_id", "y", "x", "luma")


# --- timings -----------------------------------------------------------------


@query(
    "stage_report",
    "A24",
    f"""SELECT stage, count(ms) AS n, list_sort(list(ms))[len(list(ms)) // 2 + 1] AS upper_median, min(ms) AS min,
    max(ms) AS max, {r('sum(ms)', 1)} AS total FROM stage_timing WHERE ms IS NOT NULL GROUP BY stage""",
)
def stage_report(fx):
    return I.upper_medians(fx.stage_timing, "stage", "ms")


@query(
    "timing_summary",
    "A5",
    f"""SELECT stage, count(ms) AS counted, {r('avg(ms)', 2)} AS mean, max(ms) AS max FROM stage_timing GROUP BY stage""",
)
def timing_summary(fx):
    return I.timing_summary(fx.stage_timing, "stage", "ms")
