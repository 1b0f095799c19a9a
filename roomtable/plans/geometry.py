"""Queries over tracks, segments and floors: lens, perspective, scale."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from roomtable.functions.draws import drawn, share_sql
from roomtable.functions.numbers import fixed, piped
from roomtable.functions.settings import DEFAULTS
from roomtable.operators import image as I
from roomtable.operators import lens as L
from roomtable.operators import masks as M
from roomtable.operators import perspective as P
from roomtable.operators import regions as R
from roomtable.operators.scenes import decide_status, measured_results, photo_report
from roomtable.plans.evaluation import _PIPE, _SCORES, EIGHT, FOUR, _components_sql, _scored_images
from roomtable.plans.frames import KEYS, SHEET, sheet_frames, sheet_lines, sheet_runs, sized
from roomtable.plans.image import _CODES, SMALL, measures, tile_luma
from roomtable.plans.regions import _DENSE_SQL, _FACTS, _REFINED, _relabel
from roomtable.plans.registry import query, r
from roomtable.session import cut_lineage

# --- lens ------------------------------------------------------------------


def track_points(fx):
    """Followed edges in a 64 x 64 frame; the gradient follows the position."""
    return sized(fx.track_point, (64, 64)).selectExpr("*", "(scan % 7) / 50D AS grad")


def fitted(fx):
    return L.track_fit(track_points(fx))


_TRACKS = f"""tp AS (SELECT *, scan - avg(scan) OVER w AS u, across - avg(across) OVER w AS v, (scan % 7) / 50e0 AS grad
    FROM track_point WINDOW w AS (PARTITION BY photo_id, track_id)),
  ts AS (SELECT photo_id, track_id, orientation, count(*) AS n, sum(u * u) AS u2, sum(u ** 3) AS u3, sum(u ** 4) AS u4,
    sum(u * v) AS p1, sum(u * u * v) AS p2, avg(across) AS my, avg(scan) AS mx, (max(scan) - min(scan))::DOUBLE AS base,
    quantile_cont(grad, 0.5) AS contrast FROM tp GROUP BY ALL),
  tc AS (SELECT *, (p2 * u2 - p1 * u3) / ((u4 - u2 * u2 / n) * u2 - u3 * u3) AS a,
    ((u4 - u2 * u2 / n) * p1 - u3 * p2) / ((u4 - u2 * u2 / n) * u2 - u3 * u3) AS b FROM ts),
  te AS (SELECT photo_id, track_id, sqrt(avg((v - a * (u * u - u2 / n) - b * u) ** 2)) AS rms FROM tp
    JOIN tc USING (photo_id, track_id, orientation) GROUP BY ALL),
  tr AS (SELECT *, -a * base * base / 4 AS bulge, abs(my - 31.5e0) / 31.5e0 AS off, contrast >= 0.05 AND rms <= 2 AND n >= 40
    AND base / 63 >= 0.25 AND abs(my - 31.5e0) / 31.5e0 >= 0.25 AS usable,
    CASE WHEN orientation = 'vertical' THEN my ELSE mx END AS cx, CASE WHEN orientation = 'vertical' THEN mx ELSE my END AS cy
    FROM tc JOIN te USING (photo_id, track_id)),
  tf AS (SELECT photo_id, track_id, orientation, n AS points, {r('abs(bulge)', 4)} AS sagitta_px,
    {r('bulge * CASE WHEN my >= 31.5 THEN 1 ELSE -1 END', 4)} AS radial_bulge_px, {r('rms', 4)} AS fit_rms_px,
    {r('base / 63', 4)} AS span_ratio, {r('off', 4)} AS center_offset, {r('contrast', 5)} AS contrast, usable FROM tr)"""


@query("track_fit", "L1", f"WITH {_TRACKS} SELECT * FROM tf")
def track_fit(fx):
    return fitted(fx).select(
        "photo_id", "track_id", "orientation", "points", "sagitta_px", "radial_bulge_px",
        "fit_rms_px", "span_ratio", "center_offset", "contrast", "usable",
    )


_SUPPORT = f"""su AS (SELECT photo_id, count_if(usable) AS usable_edges,
    count_if(usable AND orientation = 'vertical') AS vertical_edges,
    count_if(usable AND orientation = 'horizontal') AS horizontal_edges,
    coalesce(sum(points) FILTER (usable), 0)::DOUBLE AS total_track_px,
    {r("count(DISTINCT CASE WHEN usable THEN (cx >= 31.5)::INT * 2 + (cy >= 31.5)::INT END) / 4", 3)} AS spatial_coverage,
    CASE WHEN count_if(usable) = 0 THEN 0e0 ELSE
      {r("greatest(count_if(usable AND radial_bulge_px > 0), count_if(usable AND NOT radial_bulge_px > 0)) / count_if(usable)", 4)}
      END AS sign_agreement,
    {r("coalesce(quantile_cont(radial_bulge_px, 0.5) FILTER (usable), 0)", 4)} AS median_radial_bulge_px,
    max(sagitta_px) FILTER (usable) AS max_sagitta_px
  FROM tf JOIN (SELECT photo_id, track_id, cx, cy FROM tr) USING (photo_id, track_id) GROUP BY photo_id)"""


@query("lens_support", "L2", f"WITH {_TRACKS}, {_SUPPORT} SELECT * FROM su")
def lens_support(fx):
    return L.lens_support(fitted(fx)).drop("width", "height")


_K1 = f"""pt AS (SELECT photo_id, track_id, CASE WHEN orientation = 'vertical' THEN across ELSE scan END - 31.5e0 AS x,
    CASE WHEN orientation = 'vertical' THEN scan ELSE across END - 31.5e0 AS y FROM track_point
    JOIN (SELECT photo_id, track_id FROM tf WHERE usable) USING (photo_id, track_id)),
  pr AS (SELECT *, (x * x + y * y) / (2 * 31.5e0 * 31.5e0) AS r2 FROM pt),
  sw AS (SELECT photo_id, track_id, i, k, count(*) AS n, var_pop(x * (1 + k * r2)) AS a, var_pop(y * (1 + k * r2)) AS b,
    covar_pop(x * (1 + k * r2), y * (1 + k * r2)) AS c FROM pr,
    (SELECT i, CASE WHEN i < 0 THEN 0e0 ELSE -0.45e0 + i * (0.9e0 / 180) END AS k FROM range(-1, 181) g(i)) GROUP BY ALL),
  sp AS (SELECT *, sqrt(greatest((a + b) * (a + b) / 4 - (a * b - c * c), 0)) AS q FROM sw),
  pl AS (SELECT photo_id, i, k, sum(n * sqrt(greatest((a + b) / 2 - q, 0) / greatest((a + b) / 2 + q, 1e-12))) / sum(n) AS score
    FROM sp GROUP BY ALL),
  be AS (SELECT photo_id, max(score) FILTER (i < 0) AS zero, arg_min(k, [round(score, 12), i]) FILTER (i >= 0) AS k,
    arg_min(score, [round(score, 12), i]) FILTER (i >= 0) AS best FROM pl GROUP BY photo_id),
  kf AS (SELECT photo_id, {r('k', 5)} AS k1, {r('zero', 8)} AS straightness_at_zero, {r('best', 8)} AS straightness_at_best,
    CASE WHEN zero <= 1e-9 THEN 0e0 ELSE {r('greatest(0, 1 - best / zero)', 5)} END AS residual_gain FROM be)"""


@query("k1_fit", "L3", f"WITH {_TRACKS}, {_K1} SELECT * FROM kf")
def k1_fit(fx):
    return L.k1_fit(fitted(fx))


def _verdict(method: str) -> str:
    strong = "coalesce(max_sagitta_px >= 3 * (64 / 1600e0), false)"
    open_ = "usable_edges < 2" + (" OR k1 IS NULL" if method == "k1_fit" else "")
    hit = {
        "k1_fit": "abs(k1) >= 0.03 AND residual_gain >= 0.25",
        "sagitta_magnitude": strong,
        "radial_consistency": f"{strong} AND sign_agreement >= 0.8",
    }[method]
    value = "k1" if method == "k1_fit" else "median_radial_bulge_px"
    return f"""SELECT photo_id, '{method}' AS method, CASE WHEN {open_} THEN 'undetermined' WHEN {hit}
      THEN 'distortion_suspected' ELSE 'no_distortion_evidence' END AS lens_verdict,
      CASE WHEN NOT ({open_}) AND {hit} THEN CASE WHEN {value} > 0 THEN 'barrel' WHEN {value} < 0 THEN 'pincushion' END END
      AS suspected_sign, CASE WHEN {open_} THEN 'lens_analysis_undetermined' WHEN {hit} THEN 'lens_distortion_suspected' END
      AS lens_code FROM su LEFT JOIN kf USING (photo_id)"""


_METHODS = ("k1_fit", "sagitta_magnitude", "radial_consistency")


@query(
    "lens_verdicts",
    "P21",
    f"WITH {_TRACKS}, {_SUPPORT}, {_K1} " + " UNION ALL ".join(_verdict(m) for m in _METHODS),
)
def lens_verdicts(fx):
    tracks = fitted(fx)
    joined = L.lens_support(tracks).join(L.k1_fit(tracks), "photo_id", "left")
    limited = joined.withColumn(
        "_limit", F.lit(DEFAULTS.lens_sagitta_suspect_px) * (F.col("width") / DEFAULTS.lens_reference_width)
    )
    out = None
    for method in _METHODS:
        found = L.classify_lens(limited, replace(DEFAULTS, lens_method=method)).select(
            "photo_id", F.lit(method).alias("method"), "lens_verdict", "suspected_sign", "lens_code"
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "lens_report",
    "L4",
    f"""WITH {_TRACKS}, {_SUPPORT}, {_K1}, vd AS ({_verdict('k1_fit')})
    SELECT su.*, k1, residual_gain, lens_verdict, {r('max_sagitta_px * 1600 / 64', 4)} AS max_sagitta_px_normalized,
    {r('3 * (64 / 1600e0)', 4)} AS suspect_threshold_px FROM su LEFT JOIN kf USING (photo_id) JOIN vd USING (photo_id)""",
)
def lens_report(fx):
    return L.lens_report(fitted(fx)).drop(
        "width", "height", "straightness_at_zero", "straightness_at_best", "suspected_sign", "lens_code"
    )


def lens_scores(fx):
    truth = fx.photo.select(
        "photo_id",
        "graded",
        F.expr("CASE photo_id % 3 WHEN 0 THEN 0.45D WHEN 1 THEN -0.45D ELSE 0D END").alias("truth_k1"),
    )
    return L.score_lens(L.lens_report(fitted(fx)).join(truth, "photo_id"))


_LENS_SCORES = f"""{_TRACKS}, {_SUPPORT}, {_K1}, vd AS ({_verdict('k1_fit')}),
  sc AS (SELECT photo_id, graded, tk, tk <> 0 AS bent, lens_verdict = 'distortion_suspected' AS hit,
    {r('abs(k1 - tk)', 5)} AS err, CASE WHEN tk <> 0 AND suspected_sign IS NOT NULL THEN
      suspected_sign = CASE WHEN tk > 0 THEN 'barrel' ELSE 'pincushion' END END AS ok
    FROM vd LEFT JOIN kf USING (photo_id) JOIN (SELECT photo_id, graded, CASE photo_id % 3 WHEN 0 THEN 0.45e0
      WHEN 1 THEN -0.45e0 ELSE 0e0 END AS tk FROM photo) USING (photo_id))"""


@query(
    "lens_scores",
    "A3",
    f"""WITH {_LENS_SCORES} SELECT photo_id, bent AS truth_distorted, hit AS detected, err AS k1_absolute_error,
    ok AS sign_correct FROM sc""",
)
def lens_scores_query(fx):
    return lens_scores(fx).select(
        "photo_id", "truth_distorted", "detected", "k1_absolute_error", "sign_correct"
    )


@query(
    "lens_summary",
    "A4",
    f"""WITH {_LENS_SCORES} SELECT count(*) AS graded_cases, count_if(bent) AS distorted_cases,
    count_if(NOT bent) AS clean_cases, count_if(bent AND hit) AS detected_when_distorted,
    count_if(NOT bent AND hit) AS detected_when_clean, count_if(bent AND coalesce(ok, false)) AS sign_correct_when_detected,
    max(err) FILTER (bent AND hit) AS k1_error_max, {r('avg(err) FILTER (bent AND hit)', 5)} AS k1_error_mean
    FROM sc WHERE graded""",
)
def lens_summary(fx):
    return L.lens_summary(lens_scores(fx))


@query(
    "photo_report",
    "I8",
    f"""{_CODES}, {_TRACKS}, {_SUPPORT}, {_K1}, vd AS ({_verdict('k1_fit')})
    SELECT cd.photo_id, luma_mean, reblur_ratio, sharp, lens_verdict, k1, array_to_string(list_sort(
      list_filter(string_split(cd.codes, '|'), lambda c: c <> '') || list_filter([CASE WHEN lens_verdict IS NULL
      THEN 'lens_analysis_undetermined' ELSE lens_code END, 'stage_not_implemented'], lambda c: c IS NOT NULL)), '|') AS codes,
      'analysis_incomplete' AS status
    FROM cd JOIN me USING (photo_id) LEFT JOIN vd USING (photo_id) LEFT JOIN kf USING (photo_id)""",
)
def photo_report_query(fx):
    read = I.exposure_profile(tile_luma(fx), KEYS, SMALL).join(
        I.blur_reading(tile_luma(fx), KEYS, SMALL), KEYS
    )
    judged = I.quality_codes(I.classify_sharpness(read, SMALL), SMALL)
    return photo_report(judged, track_points(fx), SMALL).select(
        "photo_id", "luma_mean", "reblur_ratio", "sharp", "lens_verdict", "k1",
        piped(F.col("codes")).alias("codes"), "status",
    )


# --- reports ---------------------------------------------------------------------

_MS = {"load_image_ms": "photo_id % 7 + 0.5", "quality_analysis_ms": "photo_id % 11 * 2.5", "lens_analysis_ms": "photo_id % 5 + 0.25", "total_ms": "photo_id % 13 + 30.0"}


@query(
    "measured_results",
    "S8 S9",
    f"""{_CODES}, {_LENS_SCORES.replace("tk <> 0 AS bent", "tk, suspected_sign, lens_verdict, k1, residual_gain, tk <> 0 AS bent")},
    sr AS (SELECT photo_id, p.difficulty, p.graded AS graded, n_chars < 40 AS small, {_PIPE.format('label', 'e')} AS expected, {_PIPE.format('label', 'd')} AS detected,
      {_PIPE.format('label', 'd AND NOT e')} AS extra, {_PIPE.format('label', 'e AND NOT d')} AS missed
      FROM {_SCORES} s JOIN photo p USING (photo_id) JOIN documents ON doc_id = photo_id GROUP BY photo_id, p.difficulty, p.graded, n_chars)
    SELECT CAST(photo_id AS VARCHAR) AS id, difficulty, graded, CASE WHEN small THEN 'refused:image_too_small' ELSE 'success' END AS status,
      m.* EXCLUDE (photo_id), expected, CASE WHEN small THEN '' ELSE detected END AS detected, CASE WHEN small THEN '' ELSE extra END AS false_positives,
      CASE WHEN small THEN expected ELSE missed END AS false_negatives, CASE WHEN NOT small AND photo_id % 4 = 0 THEN 'lens_analysis_undetermined' ELSE '' END AS informational
    FROM sr LEFT JOIN (SELECT me.photo_id, 'reblur_ratio' AS blur_method, 'k1_fit' AS lens_method, 8::BIGINT AS width, 8::BIGINT AS height,
      strong_gradient_ratio, laplacian_variance, reblur_ratio, edge_width_px, sharp AS blur_sharp, low_texture AS blur_low_texture, luma_mean, contrast_std,
      clipped_high_ratio, clipped_low_ratio, lens_verdict, suspected_sign AS lens_suspected_sign, usable_edges AS lens_usable_edges,
      total_track_px AS lens_total_track_px, spatial_coverage AS lens_spatial_coverage, sign_agreement AS lens_sign_agreement, k1 AS lens_k1_estimate,
      residual_gain AS lens_k1_residual_gain, tk AS truth_k1, CASE WHEN tk > 0 THEN 'barrel' WHEN tk < 0 THEN 'pincushion' WHEN tk = 0 THEN 'none' END AS truth_sign,
      CASE WHEN me.photo_id % 3 = 1 THEN me.photo_id / 100 END AS truth_blur_sigma, CASE WHEN me.photo_id % 3 = 2 THEN 0.5e0 END AS truth_exposure_gain,
      err AS k1_absolute_error, ok AS sign_correct, {', '.join(f"({v.replace('photo_id', 'me.photo_id')})::DOUBLE AS {k}" for k, v in _MS.items())}
      FROM me LEFT JOIN sc ON sc.photo_id = me.photo_id LEFT JOIN su ON su.photo_id = me.photo_id
      WHERE me.photo_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 40)) m USING (photo_id)""",
)
def measured_results_query(fx):
    """Every column of a report row; documents without a tile have measured nothing."""
    refused = fx.documents.where("n_chars < 40").select(F.col("doc_id").alias("photo_id"), F.lit("image_too_small").alias("code"))
    tiles = I.classify_sharpness(measures(fx), SMALL)
    lens = lens_scores(fx).drop("width", "height", "graded")
    shown = tiles.join(lens, "photo_id", "left").selectExpr(
        "*", "'reblur_ratio' AS blur_method", "'k1_fit' AS lens_method", "if(photo_id % 3 = 1, photo_id / 100, NULL) AS truth_blur_sigma",
        "if(photo_id % 3 = 2, 0.5D, NULL) AS truth_exposure_gain", *[f"cast({v} AS double) AS {k}" for k, v in _MS.items()],
    )
    return measured_results(_scored_images(fx), refused, shown)


# --- segments ----------------------------------------------------------------

FRAME = 1000
#: random segments rarely agree within 1.6 degrees: wider tolerance, lower support
LOOSE = P.VoteRules(tolerance_deg=6.0, min_support=0.2, min_count=3)

_SEGMENTS = """sf AS (SELECT *, (x1 - x0) / CASE WHEN length = 0 THEN 1 ELSE length END AS dx,
    (y1 - y0) / CASE WHEN length = 0 THEN 1 ELSE length END AS dy,
    (y0 - y1) / CASE WHEN length = 0 THEN 1 ELSE length END AS la, (x1 - x0) / CASE WHEN length = 0 THEN 1 ELSE length END AS lb,
    (x0 * y1 - x1 * y0) / CASE WHEN length = 0 THEN 1 ELSE length END AS lc
  FROM (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS length FROM segment)),
  sv AS (SELECT *, degrees(atan2(abs(dx), abs(dy))) AS vertical_deg FROM sf)"""


@query(
    "segment_facts",
    "L5",
    f"""WITH {_SEGMENTS} SELECT photo_id, seg_id, {r('length', 6)} AS length, {r('dx', 6)} AS dx, {r('dy', 6)} AS dy,
    {r('vertical_deg', 6)} AS vertical_deg, {r('lc', 4)} AS line_offset, vertical_deg > 12 AS leans FROM sv""",
)
def segment_facts(fx):
    facts = P.segment_facts(fx.segment)
    f6 = lambda c: fixed(F.col(c), 6).alias(c)
    return facts.select(
        "photo_id", "seg_id", f6("length"), f6("dx"), f6("dy"), f6("vertical_deg"),
        fixed(F.col("lc"), 4).alias("line_offset"), (F.col("vertical_deg") > 12).alias("leans"),
    )


def _angle(seg: str, point: str) -> str:
    vx, vy = f"({point}.vx - ({seg}.x0 + {seg}.x1) / 2)", f"({point}.vy - ({seg}.y0 + {seg}.y1) / 2)"
    reach = f"sqrt({vx} ** 2 + {vy} ** 2)"
    return f"""degrees(asin(least(1, CASE WHEN {reach} < 1e-9 THEN 0 ELSE
      abs({seg}.dx * {vy} - {seg}.dy * {vx}) / {reach} END)))"""


def _refined(k: int) -> str:
    """The moments' smallest eigenvector, by the same steps as the operator takes."""
    inner = f"""SELECT *, c_ / nullif(f_, 0) AS x0_, e_ / nullif(f_, 0) AS y0_ FROM (SELECT *, bb * cc - bc * bc AS a_, ac * bc - ab * cc AS b_,
      ab * bc - ac * bb AS c_, aa * cc - ac * ac AS d_, ab * ac - aa * bc AS e_, aa * bb - ab * ab AS f_ FROM m{k})"""
    for i in range(P.REFINE_STEPS):
        under = f"nullif(c_ * x{i}_ + e_ * y{i}_ + f_, 0)"
        inner = f"""SELECT *, (a_ * x{i}_ + b_ * y{i}_ + c_) / {under} AS x{i + 1}_, (b_ * x{i}_ + d_ * y{i}_ + e_) / {under} AS y{i + 1}_ FROM ({inner})"""
    return f"SELECT photo_id, x{P.REFINE_STEPS}_ AS vx, y{P.REFINE_STEPS}_ AS vy FROM ({inner})"


def _round(k: int, tol: float, support: float, count: int) -> str:
    moments = ", ".join(f"sum(length * l{a} * l{b}) AS {a}{b}" for a, b in ("aa", "ab", "ac", "bb", "bc", "cc"))
    return f"""s{k} AS (SELECT * FROM p{k} QUALIFY count(*) OVER (PARTITION BY photo_id) >= {count}),
    d{k} AS (SELECT photo_id, draw, arg_min(seg_id, -ln({share_sql('h')}) / length, 2) AS two FROM (SELECT photo_id, seg_id, length, draw,
      {', '.join(drawn('h', 'photo_id', k, 'draw', 'seg_id'))} FROM s{k}, range(600) AS t(draw) WHERE length > 0) GROUP BY ALL),
    q{k} AS (SELECT photo_id, least(two[1], two[2]) AS sa, greatest(two[1], two[2]) AS sb, min(draw) AS draw FROM d{k} GROUP BY ALL),
    c{k} AS (SELECT photo_id, draw, hx / hw AS vx, hy / hw AS vy FROM (SELECT q.photo_id, q.draw,
      a.lb * b.lc - a.lc * b.lb AS hx, a.lc * b.la - a.la * b.lc AS hy, a.la * b.lb - a.lb * b.la AS hw
      FROM q{k} q JOIN s{k} a ON a.photo_id = q.photo_id AND a.seg_id = q.sa JOIN s{k} b ON b.photo_id = q.photo_id AND b.seg_id = q.sb
      WHERE abs(a.dx * b.dy - a.dy * b.dx) >= sin(radians(1))) WHERE abs(hw) >= 1e-12),
    h{k} AS (SELECT * FROM c{k} WHERE vy > -500 AND vy < 1500 AND abs(vx - 500) <= 12000),
    v{k} AS (SELECT photo_id, draw, vx, vy, sum(length * (1 - angle / {tol})) AS total, count(*) AS n FROM (SELECT h.*, s.length,
      {_angle('s', 'h')} AS angle FROM h{k} h JOIN s{k} s USING (photo_id)) WHERE angle < {tol} GROUP BY ALL),
    w{k} AS (SELECT * FROM v{k} QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY -round(total, 6), draw) = 1),
    m{k} AS (SELECT photo_id, {moments} FROM w{k} w JOIN s{k} s USING (photo_id) WHERE {_angle('s', 'w')} < {tol} GROUP BY photo_id),
    r{k} AS (SELECT * FROM ({_refined(k)}) WHERE vy > -500 AND vy < 1500),
    t{k} AS (SELECT photo_id, vx, vy, sum(length * (1 - angle / {tol})) AS total, count(*) AS n FROM (SELECT r.*, s.length,
      {_angle('s', 'r')} AS angle FROM r{k} r JOIN s{k} s USING (photo_id)) WHERE angle < {tol} GROUP BY ALL),
    b{k} AS (SELECT * FROM (SELECT w.photo_id, CASE WHEN t.total >= 0.9e0 * w.total THEN t.vx ELSE w.vx END AS vx,
      CASE WHEN t.total >= 0.9e0 * w.total THEN t.vy ELSE w.vy END AS vy, CASE WHEN t.total >= 0.9e0 * w.total THEN t.total ELSE w.total END AS total,
      CASE WHEN t.total >= 0.9e0 * w.total THEN t.n ELSE w.n END AS n FROM w{k} w LEFT JOIN t{k} t USING (photo_id))
      WHERE total / 1000 >= {support} AND n >= {count})"""


def _next_pool(k: int, tol: float) -> str:
    return f"""p{k + 1} AS (SELECT s.* FROM p{k} s JOIN b{k} b USING (photo_id) WHERE {_angle('s', 'b')} >= {2 * tol})"""


def _vote(segments: str, tol: float = 6.0, support: float = 0.2, count: int = 3) -> str:
    return f"""{segments}, p1 AS (SELECT * FROM sv WHERE vertical_deg > 12), {_round(1, tol, support, count)},
  {_next_pool(1, tol)}, {_round(2, tol, support, count)}, {_next_pool(2, tol)}, {_round(3, tol, support, count)},
  vp AS (SELECT photo_id, 1 AS rank, vx AS x, vy AS y, total / 1000 AS support, n FROM b1 UNION ALL
    SELECT photo_id, 2, vx, vy, total / 1000, n FROM b2 UNION ALL SELECT photo_id, 3, vx, vy, total / 1000, n FROM b3)"""


_VOTE = _vote(_SEGMENTS)


def points(fx):
    return P.vanishing_points(fx.segment, FRAME, FRAME, LOOSE)


_POINTS = f"SELECT photo_id, rank::BIGINT AS rank, {r('x', 3)} AS x, {r('y', 3)} AS y, {r('support', 5)} AS support, n AS count FROM vp"


def _rounded(found):
    return found.select(
        "photo_id", "rank", fixed(F.col("x"), 3).alias("x"), fixed(F.col("y"), 3).alias("y"),
        fixed(F.col("support"), 5).alias("support"), "count",
    )


@query("vanishing_points", "L6", f"WITH {_VOTE} {_POINTS}")
def vanishing_points(fx):
    return _rounded(points(fx))


#: four frames side by side in one photo: 64 segments, more pairs than draws
_CROWDED = "photo_id // 4 AS photo_id, photo_id % 4 * 16 + seg_id AS seg_id, x0, y0, x1, y1"


@query(
    "crowded_vanishing_points",
    "L6",
    f"WITH {_vote(_SEGMENTS.replace('FROM segment', f'FROM (SELECT {_CROWDED} FROM segment)'), 1.6, 0.8, 4)} {_POINTS}",
)
def crowded_vanishing_points(fx):
    crowded = fx.segment.selectExpr(*_CROWDED.replace("//", "div").split(", "))
    return _rounded(P.vanishing_points(crowded, FRAME, FRAME))


_WIDE = """wd AS (SELECT e.vec_id AS photo_id, CASE WHEN label = 3 THEN 24e0 END AS f35,
    max(x) FILTER (rank = 1) AS xa, max(y) FILTER (rank = 1) AS ya, max(support) FILTER (rank = 1) AS sa,
    max(x) FILTER (rank = 2) AS xb, max(y) FILTER (rank = 2) AS yb, max(support) FILTER (rank = 2) AS sb,
    max(x) FILTER (rank = 3) AS xc, max(y) FILTER (rank = 3) AS yc, max(support) FILTER (rank = 3) AS sc
  FROM embeddings e LEFT JOIN vp ON vp.photo_id = e.vec_id GROUP BY e.vec_id, label)"""


def _focal_pair(i: str, j: str, k: int) -> str:
    return f"""SELECT photo_id, least(s{i}, s{j}) AS s, {k} AS k, sqrt(greatest(-((x{i} - 500) * (x{j} - 500) + (y{i} - 500) * (y{j} - 500)), 0)) AS f,
      least(abs(x{i} - 500), abs(x{j} - 500)) AS near, greatest(abs(x{i} - 500), abs(x{j} - 500)) AS far FROM wd"""


@query(
    "focal_estimate",
    "L7",
    f"""WITH {_VOTE}, {_WIDE}, fp AS ({_focal_pair('a', 'b', 1)} UNION ALL {_focal_pair('a', 'c', 2)} UNION ALL {_focal_pair('b', 'c', 3)}),
    fb AS (SELECT photo_id, arg_max(f, [s, -k]) AS f FROM fp WHERE f > 0 AND near >= 40 AND far <= 15000 AND f BETWEEN 300 AND 1600
      AND s IS NOT NULL GROUP BY photo_id)
    SELECT photo_id, {r('coalesce(f35 / 36 * 1000, f, 700)', 1)} AS focal_px, CASE WHEN f35 IS NOT NULL THEN 'exif'
      WHEN f IS NOT NULL THEN 'vanishing-points' ELSE 'prior' END AS focal_source FROM wd LEFT JOIN fb USING (photo_id)""",
)
def focal_estimate(fx):
    photos = fx.embeddings.select(
        F.col("vec_id").alias("photo_id"), F.when(F.col("label") == 3, 24.0).alias("focal_35mm")
    )
    found = P.focal_estimate(photos, points(fx), FRAME, FRAME)
    return found.withColumn("focal_px", fixed(F.col("focal_px"), 1))


@query(
    "horizon_estimate",
    "L8",
    f"""WITH {_VOTE}, {_WIDE}, ce AS (SELECT wd.*, CASE WHEN photo_id % 4 = 0 THEN 400e0 END AS ceil_ FROM wd),
    rl AS (SELECT *, degrees(atan2(yb - ya, xb - xa)) AS roll, ya + (yb - ya) * ((500 - xa) / nullif(xb - xa, 0)) AS ym FROM ce),
    tw AS (SELECT *, coalesce(abs(xb - xa) > 300 AND (abs(roll) <= 6 OR abs(abs(roll) - 180) <= 6) AND ym BETWEEN 50 AND 850
      AND (ceil_ IS NULL OR ym <= ceil_), false) AS two, CASE WHEN ya BETWEEN 50 AND 850 AND (ceil_ IS NULL OR ya <= ceil_) THEN 1
      WHEN yb BETWEEN 50 AND 850 AND (ceil_ IS NULL OR yb <= ceil_) THEN 2
      WHEN yc BETWEEN 50 AND 850 AND (ceil_ IS NULL OR yc <= ceil_) THEN 3 END AS k FROM rl)
    SELECT photo_id, {r('CASE WHEN two THEN ym WHEN k = 1 THEN ya WHEN k = 2 THEN yb WHEN k = 3 THEN yc END / 1000', 4)} AS horizon,
      CASE WHEN two THEN 'lines-2vp' WHEN k IS NOT NULL THEN 'lines-1vp' END AS horizon_source,
      {r("CASE WHEN two THEN least(0.9, 0.55 + 0.1 * least(sa, sb)) WHEN k IS NULL THEN 0 ELSE least(0.8, 0.45 + 0.1 * CASE k WHEN 1 THEN sa WHEN 2 THEN sb ELSE sc END) END", 4)}
      AS horizon_confidence FROM tw""",
)
def horizon_estimate(fx):
    photos = fx.embeddings.select(
        F.col("vec_id").alias("photo_id"), F.when(F.col("vec_id") % 4 == 0, 400.0).alias("ceiling")
    )
    found = P.horizon_estimate(photos, points(fx), FRAME, FRAME)
    return found.select(
        "photo_id", fixed(F.col("horizon"), 4).alias("horizon"), "horizon_source",
        fixed(F.col("horizon_confidence"), 4).alias("horizon_confidence"),
    )


# --- floors --------------------------------------------------------------------


#: Limit of a sheet's values inside its floor, by place: a trapezoid that opens towards the
#: bottom and whose edges follow the values; one sheet in five reaches the top, one is in stripes.
_FLOOR_FROM = """greatest(0.08e0 * (abs(x - 31.5e0) - 4 - 0.5e0 * y), 0.1e0 * (CASE WHEN photo_id % 5 = 4 THEN 0 ELSE 14 END - y),
  CASE WHEN photo_id % 5 = 3 AND x % 16 < 2 THEN 1e0 ELSE -1e0 END) - 0.3e0"""


def floor_runs(fx):
    """A floor per sheet, from all of its values."""
    over = f"transform(line, (v, x) -> cast(v AS double) - ({_FLOOR_FROM})) AS line"
    lines = sheet_lines(fx).selectExpr(*KEYS, "y", over)
    return M.lines_to_runs(lines, KEYS, "line", {"floor": lambda v: v > 0}).drop("side")


#: cells of the floors, before anything is cleaned
_RAW = f"""fc0 AS (SELECT photo_id, y, x FROM (SELECT vec_id // 50 AS photo_id, vec_id % 50 AS y, i - 1 AS x, embedding[i]::DOUBLE AS v
    FROM embeddings, range(1, 65) r(i)) WHERE v - ({_FLOOR_FROM}) > 0)"""
_PLAIN = f"""{_RAW}, fc AS (SELECT * FROM fc0)"""
#: of cells `fc`
_EXTENT = """fr AS (SELECT photo_id, y, min(x) AS x0, max(x) AS x1 FROM fc GROUP BY ALL),
  tops AS (SELECT photo_id, x, min(y) AS top, max(y) AS last, count(*) AS n FROM fc GROUP BY ALL),
  ex AS (SELECT photo_id, sum(n) / 3200 AS coverage, count(*) AS columns, quantile_cont(top, 0.15) AS far, max(last) AS bottom
    FROM tops GROUP BY photo_id)"""
_RAILS = f"""{_EXTENT}, ed AS (SELECT fr.*, far, bottom FROM fr JOIN ex USING (photo_id) WHERE y >= floor(far)),
  rg AS (SELECT photo_id, far, bottom, count(*) FILTER (x0 > 1) AS nl, regr_slope(x0, y) FILTER (x0 > 1) AS al,
      regr_intercept(x0, y) FILTER (x0 > 1) AS bl, count(*) FILTER (x1 < 62) AS nr, regr_slope(x1, y) FILTER (x1 < 62) AS ar,
      regr_intercept(x1, y) FILTER (x1 < 62) AS br, max(y) FILTER (x0 > 1) - min(y) FILTER (x0 > 1) AS sl,
      max(y) FILTER (x1 < 62) - min(y) FILTER (x1 < 62) AS sr FROM ed GROUP BY ALL),
  rs AS (SELECT rg.*, sqrt(avg((x0 - al * y - bl) ** 2) FILTER (x0 > 1)) AS ml, sqrt(avg((x1 - ar * y - br) ** 2) FILTER (x1 < 62)) AS mr
    FROM rg JOIN ed USING (photo_id) GROUP BY ALL),
  rx AS (SELECT *, (br - bl) / (al - ar) AS ry FROM rs WHERE nl >= greatest(8, floor(0.12e0 * (bottom - floor(far) + 1)))
    AND nr >= greatest(8, floor(0.12e0 * (bottom - floor(far) + 1))) AND sl >= 7.5 AND sr >= 7.5 AND abs(al - ar) > 1e-6),
  ra AS (SELECT photo_id, al * ry + bl AS rail_x, ry AS rail_y,
    least(greatest(0.85e0 - ((ml + mr) / 2 / 64 - 0.01e0) * 10, 0.5e0), 0.85e0) AS rail_confidence
    FROM rx WHERE ry > -25 AND ry < far - 1)"""


@query(
    "floor_rails",
    "L9",
    f"""WITH {_PLAIN}, {_RAILS} SELECT photo_id, {r('rail_x', 4)} AS rail_x, {r('rail_y', 4)} AS rail_y,
    {r('rail_confidence', 4)} AS rail_confidence FROM ra""",
)
def floor_rails(fx):
    runs = floor_runs(fx)
    found = P.floor_rails(runs, P.floor_extent(runs))
    f4 = lambda c: fixed(F.col(c), 4).alias(c)
    return found.select("photo_id", f4("rail_x"), f4("rail_y"), f4("rail_confidence"))


#: stand-in camera readings of a sheet, from its first row
def _camera(horizon: str, d: str) -> list[str]:
    return [
        f"CASE WHEN photo_id % 5 = 0 THEN NULL ELSE {horizon} END AS horizon",
        f"CASE photo_id % 3 WHEN 0 THEN 0.6{d} WHEN 1 THEN 0.4{d} ELSE 0.7{d} END AS horizon_confidence",
        f"CASE WHEN photo_id % 2 = 0 THEN 30{d} END AS line_x",
    ]


def scene_inputs(fx, runs=None):
    runs = floor_runs(fx) if runs is None else runs
    extent = P.floor_extent(runs)
    rails = P.floor_rails(runs, extent)
    first = fx.embeddings.groupBy(F.expr("cast(floor(vec_id / 50) AS bigint)").alias("photo_id")).agg(
        F.expr("min_by(least(1D, greatest(0D, 0.5D + cast(embedding[0] AS double))), vec_id)").alias("l")
    )
    camera = first.selectExpr("photo_id", *_camera("-0.5D + l", "D"))
    return extent.join(rails, KEYS, "left").join(camera, "photo_id", "left")


_INPUTS = f"""{_RAILS}, cam AS (SELECT vec_id // 50 AS photo_id, least(1, greatest(0, 0.5e0 + embedding[1]::DOUBLE)) AS l
    FROM embeddings WHERE vec_id % 50 = 0),
  inp AS (SELECT photo_id, 64 AS width, 50 AS height, coverage, columns, far AS far_edge_px, rail_x, rail_y, rail_confidence,
    {', '.join(_camera('-0.5e0 + l', '::DOUBLE'))} FROM ex LEFT JOIN ra USING (photo_id) LEFT JOIN cam USING (photo_id)),
  ou AS (SELECT *, CASE WHEN horizon * height < far_edge_px - 1 THEN horizon * height END AS lpx FROM inp),
  oc AS (SELECT *, CASE WHEN rail_y IS NOT NULL AND lpx IS NOT NULL THEN CASE WHEN abs(lpx - rail_y) <= 2.5 THEN 'confirmed'
    WHEN horizon_confidence >= 0.5 THEN 'lines' ELSE 'rails-kept' END WHEN lpx IS NOT NULL THEN 'lines-only'
    WHEN rail_y IS NOT NULL THEN 'rails-only' ELSE 'fallback' END AS outcome FROM ou),
  fu AS (SELECT *, CASE WHEN outcome = 'confirmed' THEN (lpx + rail_y) / 2 WHEN outcome LIKE 'lines%' THEN lpx
      WHEN outcome LIKE 'rails%' THEN rail_y ELSE far_edge_px - 6 END AS horizon_px,
    CASE WHEN outcome = 'lines' THEN coalesce(line_x, rail_x) WHEN outcome = 'lines-only' THEN coalesce(line_x, 32)
      WHEN outcome = 'fallback' THEN 32 ELSE rail_x END AS vx_px,
    CASE WHEN outcome LIKE 'lines%' THEN 'lines-vp' WHEN outcome = 'fallback' THEN 'far-edge-fallback' ELSE 'vanishing-point' END AS method,
    CASE outcome WHEN 'confirmed' THEN least(0.92e0, greatest(rail_confidence, horizon_confidence) + 0.05e0)
      WHEN 'lines' THEN horizon_confidence * 0.9e0 WHEN 'rails-kept' THEN rail_confidence - 0.1e0
      WHEN 'lines-only' THEN horizon_confidence WHEN 'rails-only' THEN rail_confidence ELSE 0.45e0 END AS confidence FROM oc)"""


@query(
    "fused_horizon",
    "L10",
    f"""WITH {_PLAIN}, {_INPUTS} SELECT photo_id, outcome, method, {r('horizon_px', 4)} AS horizon_px, {r('vx_px', 4)} AS vx_px,
    {r('confidence', 4)} AS confidence FROM fu""",
)
def fused_horizon(fx):
    f4 = lambda c: fixed(F.col(c), 4).alias(c)
    return P.fuse_horizon(scene_inputs(fx)).select(
        "photo_id", "outcome", "method", f4("horizon_px"), f4("vx_px"), f4("confidence")
    )


def scaled(fx, runs=None):
    fused = P.fuse_horizon(scene_inputs(fx, runs))
    return P.floor_scale(
        fused.selectExpr(
            "*",
            "if(photo_id % 4 = 1, 52D, 0.7D * width) AS focal_px",
            "if(photo_id % 4 = 1, 'vanishing-points', 'prior') AS focal_source",
        )
    )


_SCALE = f"""{_INPUTS}, hp AS (SELECT *, CASE WHEN photo_id % 4 = 1 THEN 52e0 ELSE 0.7e0 * 64 END AS f, photo_id % 4 <> 1 AS prior,
    least(greatest(horizon_px, 6), 37.5) AS h FROM fu),
  yy AS (SELECT *, 54e0 AS yn, greatest(far_edge_px - 0.2e0, h + 2.5e0) AS yf FROM hp),
  zz AS (SELECT *, 1.16e0 * 64 / f * (f * 1.5e0 / (yn - h)) AS wr, f * 1.5e0 / (yf - h) - f * 1.5e0 / (yn - h) AS dr,
    (vx_px + (-5.12e0 - vx_px) * (yf - h) / (yn - h)) / 64 AS qx0, (vx_px + (69.12e0 - vx_px) * (yf - h) / (yn - h)) / 64 AS qx1 FROM yy),
  mm AS (SELECT *, least(greatest(wr, 1.5), 14) AS wm, least(greatest(dr, 0.8), 20) AS dm FROM zz),
  sl AS (SELECT *, wm <> wr OR dm <> dr AS cut, dm / wm <= 5 AND dm / wm >= 0.2 AS plausible,
    {r('0.092e0 / 1.5e0 * (50 - h)', 1)} AS plank_near_px, least(greatest(confidence - CASE WHEN h <> horizon_px THEN 0.1e0 ELSE 0 END
    - CASE WHEN wm <> wr OR dm <> dr THEN 0.05e0 ELSE 0 END - CASE WHEN dm / wm <= 5 AND dm / wm >= 0.2 THEN 0 ELSE 0.1e0 END, 0), 1) AS pc FROM mm)"""


@query(
    "floor_scale",
    "L11",
    f"""WITH {_PLAIN}, {_SCALE} SELECT photo_id, {r('wm', 2)} AS width_m, {r('dm', 2)} AS depth_m, {r('dm / wm', 2)} AS depth_over_width,
    plank_near_px, {r('0.092e0 / 1.5e0 * 0.5e0 * (yn + yf - 2 * h)', 1)} AS plank_mid_px, {r('0.092e0 / 1.5e0 * (yf - h)', 1)} AS plank_far_px,
    plausible, CASE WHEN prior OR cut OR NOT plausible THEN 'low' ELSE 'medium' END AS metric_scale_confidence,
    {r('qx0', 5)} AS qx0, {r('qx1', 5)} AS qx1, {r('yf / 50', 5)} AS qy0, {r('pc', 4)} AS perspective_confidence FROM sl""",
)
def floor_scale(fx):
    f = lambda c, d: fixed(F.col(c), d).alias(c)
    return scaled(fx).select(
        "photo_id", "width_m", "depth_m", "depth_over_width", "plank_near_px", "plank_mid_px", "plank_far_px",
        "plausible", "metric_scale_confidence", f("qx0", 5), f("qx1", 5), f("qy0", 5), f("perspective_confidence", 4),
    )


def scene_table(fx, runs=None, raw=None):
    """floor_scale rows with parts, nested zones, rugs and mask changes, ready for validation."""
    runs = floor_runs(fx) if runs is None else runs
    raw = runs if raw is None else raw
    total = F.col("width") * F.col("height")
    sides = R.parts_and_gaps(runs, sheet_frames(fx), KEYS)
    facts = R.part_facts(sides[0], KEYS)
    parts = facts.groupBy(*KEYS).agg(
        F.sum((F.col("pixels") >= total * 0.005).cast("int")).alias("large_parts"),
        F.sum((F.col("pixels") >= total * 0.01).cast("int")).alias("huge_parts"),
        F.min("top").alias("top_row"),
    )
    zones = R.zone_forest(*sides, KEYS).select(
        "*",
        F.size("floor_zones").alias("zones"),
        F.size(F.filter("floor_zones", lambda z: z["pixels"] < total * 0.005)).alias("small_zones"),
        *[
            F.expr(f"array_{pick}(transform(floor_zones, z -> z.box.{side})) / ({size} - 1) AS zone_{side}")
            for side, size, pick in (("left", "width", "min"), ("right", "width", "max"), ("top", "height", "min"), ("bottom", "height", "max"))
        ],
    )
    swept = M.stretches(M.gather({"a": raw, "b": runs}, KEYS), KEYS, ["a", "b"])
    size = F.col("x1") - F.col("x0") + 1
    changes = swept.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("a") > 0, size).otherwise(0)).alias("raw_pixels"),
        F.sum(F.when((F.col("a") > 0) != (F.col("b") > 0), size).otherwise(0)).alias("changed_pixels"),
    )
    rugs = R.rug_signal(sheet_runs(fx, rug="luma > 0.6").drop("side"), sheet_frames(fx), KEYS)
    rugs = rugs.select(*KEYS, "rugs", F.col("area_ratio").alias("rug_ratio"))
    joined = scaled(fx, runs).join(parts, KEYS).join(changes, KEYS).join(zones, KEYS, "left").join(rugs, KEYS, "left")
    return joined.withColumn("zones", F.coalesce("zones", F.lit(0)))


#: of cells `fc`: parts (pt), how many are large (pf), background parts (gp)
_PARTS = f"""{_relabel(_components_sql('fc', 'photo_id', EIGHT), '6')},
  pt AS (SELECT photo_id, lab, {_FACTS} FROM nd6 JOIN lb6 USING (id) GROUP BY ALL),
  pf AS (SELECT photo_id, count_if(pixels >= 16) AS large_parts, count_if(pixels >= 32) AS huge_parts, min(top) AS top_row
    FROM pt GROUP BY photo_id)"""
_GAPS = f"""bg7 AS (SELECT photo_id, y, x FROM sheet EXCEPT SELECT photo_id, y, x FROM fc),
  {_relabel(_components_sql('bg7', 'photo_id', FOUR), '7')},
  gp AS (SELECT *, "left" = 0 OR top = 0 OR "right" = 63 OR bottom = 49 AS open_ FROM (SELECT photo_id, lab, {_FACTS}
    FROM nd7 JOIN lb7 USING (id) GROUP BY ALL))"""
#: parents: the component of the other kind with the pixel left of the first one
_FOREST = """fo AS (SELECT 'part' AS kind, p.photo_id, p.lab AS node, p.pixels, g.lab AS parent FROM pt p LEFT JOIN lb7 l ON l.id = p.lab - 1
      AND p.lab % 1000 > 0 LEFT JOIN gp g ON g.lab = l.lab AND NOT g.open_
    UNION ALL SELECT 'gap', g.photo_id, g.lab, g.pixels, l.lab FROM gp g LEFT JOIN lb6 l ON l.id = g.lab - 1 AND NOT g.open_)"""
_CONFIDENCE = f"""{_SCALE}, {_PARTS}, sn AS (SELECT *, least(greatest(pc * CASE WHEN coverage < 0.08 THEN 0.6e0 WHEN coverage > 0.65 THEN 0.7e0
    ELSE 1 END * CASE WHEN large_parts > 4 THEN 0.85e0 ELSE 1 END * CASE WHEN far_edge_px / 50 <= 0.7 THEN 1 WHEN method = 'lines-vp'
    THEN 0.95e0 ELSE 0.8e0 END, 0), 1) AS conf FROM sl JOIN pf USING (photo_id))"""


@query("scene_confidence", "M14", f"WITH RECURSIVE {_PLAIN}, {_CONFIDENCE} SELECT photo_id, {r('conf', 4)} AS scene_confidence FROM sn")
def scene_confidence(fx):
    return P.scene_confidence(scene_table(fx)).select(
        "photo_id", fixed(F.col("scene_confidence"), 4).alias("scene_confidence")
    )


@query(
    "containment_forest",
    "L12 M10",
    f"""WITH RECURSIVE {_PLAIN.replace("FROM fc0)", "FROM fc0 WHERE greatest(abs(x - 32), abs(y - 32)) // 3 % 2 = 0 OR photo_id % 2 = 0)")}, {_PARTS}, {_GAPS}, {_FOREST},
    up(photo_id, kind, node, parent, depth) AS (SELECT photo_id, kind, node, parent, 0 FROM fo UNION ALL
      SELECT u.photo_id, u.kind, u.node, f.parent, depth + 1 FROM up u JOIN fo f ON f.node = u.parent
        AND f.kind = CASE WHEN (depth % 2 = 0) = (u.kind = 'part') THEN 'gap' ELSE 'part' END)
    SELECT photo_id, kind, node // 1000 % 1000 AS y, node % 1000 AS x, any_value(pixels) AS pixels, max(depth)::BIGINT AS depth
    FROM up JOIN (SELECT photo_id, kind, node, pixels FROM fo) USING (photo_id, kind, node) GROUP BY ALL""",
)
def containment_forest(fx):
    cells = M.runs_to_cells(floor_runs(fx)).where("greatest(abs(x - 32), abs(y - 32)) div 3 % 2 = 0 OR photo_id % 2 = 0")
    runs = cut_lineage(M.cells_to_runs(cells, KEYS))
    found = R.containment(*R.parts_and_gaps(runs, sheet_frames(fx), KEYS), KEYS)
    return found.selectExpr("photo_id", "kind", "node div 4294967296 AS y", "node % 4294967296 AS x", "pixels", "depth")


def _checks_sql(changed: str) -> str:
    """The codes of the failed checks in their published order; `changed` is the share of rewritten pixels."""
    return f"""{_CONFIDENCE}, qd AS (SELECT *, yf / 50 AS qyt, h / 50 AS hs,
    abs((qx0 * (yf / 50) - qx1 * (yf / 50)) + (qx1 * 1.08e0 - 1.08e0 * (yf / 50)) + (1.08e0 * 1.08e0 + 0.08e0 * 1.08e0)
      + (-0.08e0 * (yf / 50) - qx0 * 1.08e0)) / 2 AS quad FROM sn),
  ck AS (SELECT *, list_filter([
    CASE WHEN quad < 0.001 OR qx1 <= qx0 OR NOT qyt < 1.08 THEN 'degenerate_plane' END,
    CASE WHEN NOT hs < qyt THEN 'horizon_below_floor' END,
    CASE WHEN NOT hs BETWEEN 0.05 AND 0.85 THEN 'horizon_out_of_frame' END,
    CASE WHEN wm <= 0 OR dm <= 0 THEN 'non_positive_meters' END,
    CASE WHEN photo_id NOT IN (SELECT photo_id FROM pt WHERE pixels >= 32) THEN 'degenerate_zone' END,
    CASE WHEN NOT plausible THEN 'geometry_implausible' END,
    CASE WHEN plank_near_px < 6 THEN 'plank_microscopic' END,
    CASE WHEN top_row < 2 THEN 'floor_touches_top' END,
    CASE WHEN huge_parts > 3 THEN 'fragmented_floor' END,
    CASE WHEN {changed} > 0.25 THEN 'refiner_rewrote_mask' END], lambda c: c IS NOT NULL) AS codes FROM qd),
  rd AS (SELECT *, list_concat(CASE WHEN conf < 0.55 THEN ['low_confidence'] ELSE [] END, codes) AS reasons FROM ck)"""


_CHECKS = f"{_PLAIN}, {_checks_sql('0')}"


@query("scene_checks", "P17", f"WITH RECURSIVE {_CHECKS} SELECT photo_id, array_to_string(list_sort(codes), '|') AS checks FROM ck")
def scene_checks(fx):
    return P.validate_scene(scene_table(fx)).select("photo_id", piped(F.col("checks")).alias("checks"))


@query(
    "render_decision",
    "P18",
    f"""WITH RECURSIVE {_CHECKS} SELECT photo_id, CASE WHEN len(reasons) = 0 THEN 'auto_render' ELSE 'needs_manual_adjustment' END
    AS render_status, array_to_string(reasons, '|') AS reasons FROM rd""",
)
def render_decision(fx):
    decided = P.decide_render(P.validate_scene(P.scene_confidence(scene_table(fx))))
    return decided.select("photo_id", "render_status", F.array_join("reasons", "|").alias("reasons"))


_SCENES = f"""{_RAW}, {_REFINED.replace(f"q AS (SELECT photo_id, y, x FROM sheet WHERE {_DENSE_SQL})", "q AS (SELECT photo_id, y, x FROM fc0)")},
  fc AS (SELECT photo_id, y, x FROM rf),
  ch AS (SELECT coalesce(a.photo_id, b.photo_id) AS photo_id, count(a.photo_id) AS raw_, count_if(a.photo_id IS NULL OR b.photo_id IS NULL) AS diff
    FROM fc0 a FULL JOIN fc b ON a.photo_id = b.photo_id AND a.y = b.y AND a.x = b.x GROUP BY ALL),
  {_checks_sql('(SELECT diff / greatest(1, raw_) FROM ch WHERE ch.photo_id = qd.photo_id)')}, {_GAPS}, {_FOREST},
  zr AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY pixels DESC, lab) AS zone FROM pt WHERE pixels >= 32 QUALIFY zone <= 3),
  isl AS (SELECT parent AS lab, count(*) AS n FROM fo WHERE kind = 'part' AND parent IS NOT NULL GROUP BY parent),
  hl8 AS (SELECT fo.parent AS lab, string_agg(g.pixels || '@' || g."left" || ',' || g.top || '+' || coalesce(isl.n, 0), ';' ORDER BY g.lab) AS holes
    FROM fo JOIN gp g ON g.lab = fo.node LEFT JOIN isl ON isl.lab = g.lab WHERE fo.kind = 'gap' AND fo.parent IS NOT NULL AND g.pixels >= 1.6 GROUP BY fo.parent),
  zo AS (SELECT photo_id, string_agg('sol-' || zone || ':' || pixels || ' ' || "left" || ',' || top || ',' || "right" || ',' || bottom || ' [' || coalesce(holes, '') || ']', '|' ORDER BY zone) AS zones
    FROM zr LEFT JOIN hl8 USING (lab) GROUP BY photo_id),
  rq AS (SELECT photo_id, y, x FROM sheet WHERE luma > 0.6e0), {_relabel(_components_sql('rq', 'photo_id', EIGHT), '9')},
  rp AS (SELECT photo_id, lab, count(*) AS pixels FROM nd9 JOIN lb9 USING (id) GROUP BY ALL),
  rg9 AS (SELECT photo_id, count_if(pixels >= 6.4) AS rugs, sum(pixels) / 3200 AS ratio FROM rp GROUP BY photo_id)"""


@query(
    "assembled_scenes",
    "L12 M7",
    f"""WITH RECURSIVE {_SCENES} SELECT photo_id, CASE WHEN len(reasons) = 0 THEN 'auto_render' ELSE 'needs_manual_adjustment' END AS status,
    {r('conf', 3)} AS confidence, array_to_string(reasons, '|') AS reasons, {r('wm', 2)} AS width, {r('dm', 2)} AS depth,
    {r('hs', 4)} AS horizon, {r('degrees(2 * atan(64 / (2 * f)))', 1)} AS fov_deg, zones, coalesce(rugs, 0) AS rugs,
    {r('coalesce(ratio, 0)', 4)} AS rug_ratio, concat_ws('|', 'experimental_scene', 'perspective_' || method, 'scale_assumed',
      CASE WHEN conf < 0.55 THEN 'low_confidence' WHEN len(reasons) > 0 THEN 'needs_manual_adjustment' END) AS warnings
    FROM rd LEFT JOIN zo USING (photo_id) LEFT JOIN rg9 USING (photo_id)""",
)
def assembled_scenes(fx):
    raw = floor_runs(fx)
    refined = cut_lineage(R.refine_mask(raw, sheet_frames(fx), KEYS, R.opening_radius(*SHEET)))
    scenes = P.assemble_scene(scene_table(fx, refined, raw))
    box = "z.box.left || ',' || z.box.top || ',' || z.box.right || ',' || z.box.bottom"
    holes = "array_join(transform(z.holes, o -> o.pixels || '@' || o.box.left || ',' || o.box.top || '+' || o.islands), ';')"
    return scenes.selectExpr(
        "photo_id", "status", "confidence", "array_join(reasons, '|') AS reasons", "scene.planes.sol.meters.width",
        "scene.planes.sol.meters.depth", "scene.camera.horizon", "scene.camera.fov_deg",
        f"array_join(transform(scene.floor_zones, z -> z.id || ':' || z.pixels || ' ' || {box} || ' [' || {holes} || ']'), '|') AS zones",
        "rug.rugs", "rug.area_ratio AS rug_ratio", "array_join(scene.warnings, '|') AS warnings",
    )
