"""Queries that compare masks, passes, candidates and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtable.functions.numbers import piped
from roomtable.functions.vocabulary import BOUNDARY_KINDS, SCORED_CODES
from roomtable.operators import evaluation as E
from roomtable.operators import governance as G
from roomtable.operators import masks as M
from roomtable.plans.frames import (
    KEYS,
    TILE,
    SHEET_MASK,
    TILE_MASK,
    UNSURE,
    reach,
    runs_of,
    sheet_frames,
    sheet_runs,
    sized,
    tile_runs,
)
from roomtable.plans.registry import query, r
from roomtable.sources.reports import report_rows

#: wide enough to give 1, 2 and 4 pixels on a 64 x 50 sheet
SHEET_TOLERANCES = (0.0125, 0.025, 0.05)

# --- confusion -------------------------------------------------------------

_LABELS = ", ".join(f"('{c}')" for c in SCORED_CODES)
_SCORES = f"""(SELECT p.photo_id, p.graded, l.label,
  p.photo_id IN (SELECT photo_id FROM emission e WHERE side = 'expected' AND e.code = l.label) AS e,
  p.photo_id IN (SELECT photo_id FROM emission d WHERE side = 'detected' AND d.code = l.label) AS d
  FROM photo p, (VALUES {_LABELS}) l(label))"""


def _scored_images(fx):
    return E.score_images(fx.emission, fx.photo.select("photo_id", "difficulty", "graded"), "photo_id")


@query(
    "image_scores",
    "A1",
    f"""SELECT photo_id, label, (e AND d)::BIGINT AS tp, (d AND NOT e)::BIGINT AS fp,
    (e AND NOT d)::BIGINT AS fn, (NOT e AND NOT d)::BIGINT AS tn FROM {_SCORES}""",
)
def image_scores(fx):
    return E.label_scores(_scored_images(fx), "photo_id")


@query(
    "confusion_totals",
    "A2",
    f"""WITH s AS (SELECT *, (e AND d)::BIGINT AS tp, (d AND NOT e)::BIGINT AS fp,
      (e AND NOT d)::BIGINT AS fn, (NOT e AND NOT d)::BIGINT AS tn FROM {_SCORES} WHERE graded),
    i AS (SELECT photo_id, sum(fp) AS fps, sum(fn) AS fns FROM s GROUP BY photo_id),
    f AS (SELECT count(*) AS images, count_if(fps = 0 AND fns = 0) AS perfect_images,
      count_if(fps > 0) AS images_with_fp, count_if(fns > 0) AS images_with_fn,
      count_if(photo_id IN (SELECT photo_id FROM emission WHERE side = 'detected'
        AND code = 'lens_analysis_undetermined')) AS undetermined_lens FROM i),
    t AS (SELECT coalesce(label, 'overall') AS label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
      sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, grouping(label) AS g FROM s GROUP BY ROLLUP(label))
    SELECT t.label, tp, fp, fn, tn, images, perfect_images, images_with_fp, images_with_fn,
      undetermined_lens, {r('tp::DOUBLE / nullif(tp + fn, 0)', 4)} AS detected_of_expected,
      {r('fp::DOUBLE / nullif(coalesce(images, NULL), 0)', 4)} AS false_alarms_per_image,
      {r('tp::DOUBLE / nullif(tp + fp, 0)', 4)} AS precision_of_detections
    FROM t LEFT JOIN f ON g = 1 WHERE g = 1 OR tp + fp + fn > 0""",
)
def confusion_totals(fx):
    return E.confusion_totals(_scored_images(fx), "photo_id")


_PIPE = "coalesce(string_agg({} , '|' ORDER BY label) FILTER ({}), '')"


@query(
    "report_rows",
    "S8",
    f"""SELECT CAST(photo_id AS VARCHAR) AS id, difficulty, graded, 'success' AS status,
      {_PIPE.format('label', 'e')} AS expected, {_PIPE.format('label', 'd')} AS detected,
      {_PIPE.format('label', 'd AND NOT e')} AS false_positives,
      {_PIPE.format('label', 'e AND NOT d')} AS false_negatives, CAST(NULL AS DOUBLE) AS total_ms
    FROM {_SCORES} s JOIN photo p USING (photo_id) GROUP BY photo_id, difficulty, p.graded""".replace(
        "p.graded, l.label", "l.label"
    ).replace("difficulty, graded,", "difficulty, p.graded AS graded,"),
)
def report_rows_query(fx):
    rows = _scored_images(fx).select(
        F.col("photo_id").cast("string").alias("id"),
        "difficulty",
        "graded",
        F.lit("success").alias("status"),
        *[
            piped(F.col(c)).alias(c)
            for c in ("expected", "detected", "false_positives", "false_negatives", "informational")
        ],
    )
    return report_rows(rows).select(
        "id", "difficulty", "graded", "status", "expected", "detected", "false_positives",
        "false_negatives", "total_ms",
    )


@query(
    "flat_results",
    "S9",
    f"""SELECT CAST(photo_id AS VARCHAR) AS id, CASE WHEN small THEN 'refused:image_too_small' ELSE
      'success' END AS status, CASE WHEN small THEN '' ELSE detected END AS detected,
      CASE WHEN small THEN expected ELSE missed END AS false_negatives,
      CASE WHEN small THEN '' ELSE extra END AS false_positives, expected
    FROM (SELECT photo_id, n_chars < 40 AS small, {_PIPE.format('label', 'e')} AS expected,
      {_PIPE.format('label', 'd')} AS detected, {_PIPE.format('label', 'd AND NOT e')} AS extra,
      {_PIPE.format('label', 'e AND NOT d')} AS missed
      FROM {_SCORES} s JOIN documents ON doc_id = photo_id GROUP BY photo_id, n_chars)""",
)
def flat_results(fx):
    from roomtable.operators.scenes import flatten_results

    scored = _scored_images(fx)
    refused = fx.documents.where("n_chars < 40").select(
        F.col("doc_id").alias("photo_id"), F.lit("image_too_small").alias("code")
    )
    return flatten_results(scored, refused).select(
        "id", "status", "detected", "false_negatives", "false_positives", "expected"
    )


# --- masks of passes ---------------------------------------------------------

_PAIR_COLUMNS = ["vec_id", "annotator", "pass_label", "independent_pass"]
_PAIRS = """k AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY coalesce(pass_label, ''))
    AS n FROM pass),
  pairs AS (SELECT a.photo_id, a.vec_id AS v1, b.vec_id AS v2, a.annotator AS an1, b.annotator AS an2,
    a.pass_label AS l1, b.pass_label AS l2, a.independent_pass AND b.independent_pass AS indep
    FROM k a JOIN k b ON a.photo_id = b.photo_id AND a.n = 1 AND b.n = 2),
  pc AS (SELECT p.photo_id, a.y, a.x, a.m AS ma, b.m AS mb, abs(a.luma - 0.5e0) < 0.02e0 AS ua,
    abs(b.luma - 0.5e0) < 0.02e0 AS ub, abs(a.luma - 0.5e0) < 0.02e0 OR abs(b.luma - 0.5e0) < 0.02e0 AS ig
    FROM pairs p JOIN cell a ON a.photo_id = p.v1
    JOIN cell b ON b.photo_id = p.v2 AND a.y = b.y AND a.x = b.x)"""
_AREA = """count_if(ma AND mb AND NOT ig) AS tp, count_if(mb AND NOT ma AND NOT ig) AS fp,
  count_if(ma AND NOT mb AND NOT ig) AS fn, count_if(NOT ma AND NOT mb AND NOT ig) AS tn,
  count_if(ig) AS ignored"""


def _ratios(total: str) -> str:
    return f"""{r(f'ignored / {total}', 6)} AS ignored_fraction,
    {r('tp::DOUBLE / nullif(tp + fp + fn, 0)', 6)} AS iou,
    {r('2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)', 6)} AS dice,
    {r('tp::DOUBLE / nullif(tp + fp, 0)', 6)} AS precision,
    {r('tp::DOUBLE / nullif(tp + fn, 0)', 6)} AS recall"""


class PassPairs:
    """First and second pass of each photo, with their masks as tagged runs."""

    def __init__(self, fx):
        self.pairs = G.pass_pairs(fx.view("pass"), _PAIR_COLUMNS)
        self.frames = sized(self.pairs.select("photo_id"), TILE)
        which = lambda n, vec: F.struct(F.lit(n).alias("which"), F.col(vec).alias("vec"))
        links = self.pairs.select(
            F.col("photo_id").alias("_p"),
            F.explode(F.array(which("a", "first_vec_id"), which("b", "second_vec_id"))).alias("l"),
        ).select("_p", "l.which", F.col("l.vec").alias("photo_id"))
        linked = tile_runs(fx, m=TILE_MASK, u=UNSURE).join(links, "photo_id")
        self.runs = linked.select(
            F.col("_p").alias("photo_id"), "width", "height", "side", "which", "y", "x0", "x1"
        )

    def tagged(self, first: str, second: str, ignored: str = "i"):
        """Runs of both masks and their uncertain zones under the given sides."""
        mask = F.when(F.col("which") == "a", first).otherwise(second)
        return self.runs.select(
            *KEYS, F.when(F.col("side") == "m", mask).otherwise(ignored).alias("side"), "y", "x0", "x1"
        )

    def unsure(self):
        return self.runs.where(F.col("side") == "u").select(
            *KEYS, F.concat(F.lit("u"), "which").alias("side"), "y", "x0", "x1"
        )

    def masks(self):
        return self.tagged("a", "b")

    def prediction(self):
        """The first pass is the reference, the second the prediction."""
        return self.tagged("t", "p")

    def differing(self):
        return E.disagreement_runs(self.masks(), KEYS, reach(0.005))


@query(
    "mask_overlap_rows",
    "J5",
    f"""WITH {_PAIRS} SELECT photo_id, y, count(*) AS shared FROM pc WHERE ma AND mb GROUP BY photo_id, y""",
)
def mask_overlap_rows(fx):
    p = PassPairs(fx)
    swept = M.stretches(p.masks(), KEYS, ["a", "b"])
    both = swept.where((F.col("a") > 0) & (F.col("b") > 0))
    return both.groupBy("photo_id", "y").agg(M.area().alias("shared"))


@query(
    "mask_metrics",
    "A8",
    f"""WITH {_PAIRS} SELECT *, {_ratios('64')} FROM (SELECT photo_id, {_AREA} FROM pc GROUP BY photo_id)""",
)
def mask_metrics(fx):
    p = PassPairs(fx)
    return E.mask_metrics(p.prediction(), p.frames, KEYS).drop("width", "height")


def _disc_near(a: str, b: str, radius: str) -> str:
    """SQL: b lies within the disc of that radius around a."""
    return (
        f"abs({b}.y - {a}.y) <= {radius} AND abs({b}.x - {a}.x) <= round({radius} * "
        f"sqrt(greatest(0, {radius} * {radius} - ({b}.y - {a}.y) * ({b}.y - {a}.y))::DOUBLE / ({radius} * {radius})))"
    )


def _edge(cells: str, key: str = "photo_id") -> str:
    """SQL: inner boundary cells of a set of mask cells."""
    return f"""(SELECT c.{key}, c.y, c.x FROM {cells} c JOIN {cells} n ON n.{key} = c.{key}
      AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 GROUP BY c.{key}, c.y, c.x HAVING count(*) < 9)"""


def _boundary(fractions, w: int, h: int, key: str = "photo_id") -> str:
    """SQL CTEs from mask cells pm, tm, ignored cells im and keys ks to `bm`."""
    values = ", ".join(f"({f}e0)" for f in fractions)
    return f"""tol AS (SELECT f AS tolerance, greatest(1, round_even(f * sqrt({w * w + h * h}), 0)::BIGINT) AS t
      FROM (VALUES {values}) v(f)),
    pb AS MATERIALIZED {_edge('pm', key)}, tb AS MATERIALIZED {_edge('tm', key)},
    ev AS (SELECT 'p' AS side, b.*, tol.* FROM pb b, tol UNION ALL SELECT 't', b.*, tol.* FROM tb b, tol),
    ok AS (SELECT e.* FROM ev e WHERE t * 2 < {min(w, h)} AND y >= t AND y < {h} - t AND x >= t
      AND x < {w} - t AND NOT EXISTS (SELECT 1 FROM im WHERE im.{key} = e.{key} AND im.y = e.y AND im.x = e.x)),
    hit AS (SELECT e.*, CASE WHEN side = 'p' THEN EXISTS (SELECT 1 FROM tb n WHERE n.{key} = e.{key}
        AND {_disc_near('e', 'n', 'e.t')})
      ELSE EXISTS (SELECT 1 FROM pb n WHERE n.{key} = e.{key} AND {_disc_near('e', 'n', 'e.t')}) END AS good
      FROM ok e),
    bc AS (SELECT k.{key}, tol.tolerance, tol.t AS tolerance_px, count_if(side = 'p') AS predicted_pixels,
      count_if(side = 't') AS truth_pixels, count_if(side = 'p' AND good) AS hp, count_if(side = 't' AND good) AS ht
      FROM ks k CROSS JOIN tol LEFT JOIN hit h ON h.{key} = k.{key} AND h.tolerance = tol.tolerance
      GROUP BY k.{key}, tol.tolerance, tol.t),
    bp AS (SELECT *, {r('hp::DOUBLE / nullif(predicted_pixels, 0)', 6)} AS precision,
      {r('ht::DOUBLE / nullif(truth_pixels, 0)', 6)} AS recall FROM bc),
    bm AS (SELECT {key}, tolerance, tolerance_px, predicted_pixels, truth_pixels, precision, recall,
      CASE WHEN precision + recall = 0 THEN 0.0e0 ELSE
        {r('2.0e0 * precision * recall / (precision + recall)', 6)} END AS f1 FROM bp)"""


_PAIR_BOUNDARY = f"""{_PAIRS}, ks AS (SELECT photo_id FROM pairs),
  pm AS (SELECT photo_id, y, x FROM pc WHERE mb), tm AS (SELECT photo_id, y, x FROM pc WHERE ma),
  im AS (SELECT photo_id, y, x FROM pc WHERE ig), {_boundary((0.0025, 0.05, 0.2), *TILE)}"""
_TILE_TOLERANCES = (0.0025, 0.05, 0.2)


@query(
    "pair_boundary",
    "A9 A11",
    f"WITH {_PAIR_BOUNDARY} SELECT * FROM bm",
)
def pair_boundary(fx):
    p = PassPairs(fx)
    return E.boundary_metrics(p.prediction(), p.frames, KEYS, _TILE_TOLERANCES).drop(
        "width", "height"
    )


_SHEET_MASKS = """pm AS (SELECT photo_id, y, x FROM sheet WHERE luma > 0.53e0),
  tm AS (SELECT photo_id, y, x FROM sheet WHERE m),
  im AS (SELECT photo_id, y, x FROM sheet WHERE abs(luma - 0.5e0) < 0.02e0),
  ks AS (SELECT DISTINCT photo_id FROM sheet)"""


def _sheet_masks(fx):
    return sheet_runs(fx, p="luma > 0.53", t=SHEET_MASK, i=UNSURE)


@query(
    "boundary_metrics",
    "A9",
    f"WITH {_SHEET_MASKS}, {_boundary(SHEET_TOLERANCES, 64, 50)} SELECT * FROM bm",
)
def boundary_metrics(fx):
    return E.boundary_metrics(_sheet_masks(fx), sheet_frames(fx), KEYS, SHEET_TOLERANCES).drop(
        "width", "height"
    )


@query(
    "tolerance_sweep",
    "A10 J7",
    """SELECT vec_id AS photo_id, 8 * (1 + label) AS width, f AS tolerance, greatest(1,
    round_even(f * sqrt(64e0 * (1 + label) * (1 + label) + 640000), 0)::BIGINT) AS tolerance_px
    FROM embeddings, (VALUES (0.0025e0), (0.005e0), (0.01e0)) v(f)""",
)
def tolerance_sweep(fx):
    frames = fx.embeddings.select(
        F.col("vec_id").alias("photo_id"),
        (F.lit(8) * (1 + F.col("label"))).cast("bigint").alias("width"),
        F.lit(800).cast("bigint").alias("height"),
    )
    return E.with_tolerances(frames).drop("height")


@query(
    "exploratory_metrics",
    "A23",
    f"""WITH {_SHEET_MASKS}, {_boundary(SHEET_TOLERANCES, 64, 50)},
    ac AS (SELECT photo_id, count_if(m AND p AND NOT i) AS tp, count_if(p AND NOT m AND NOT i) AS fp,
      count_if(m AND NOT p AND NOT i) AS fn, count_if(i) AS ignored FROM
      (SELECT photo_id, m, luma > 0.53e0 AS p, abs(luma - 0.5e0) < 0.02e0 AS i FROM sheet) GROUP BY photo_id)
    SELECT photo_id, {r('tp::DOUBLE / nullif(tp + fp + fn, 0)', 4)} AS iou,
      {r('2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)', 4)} AS dice,
      {r("max(f1) FILTER (tolerance = 0.0125e0)", 4)} AS f1_fine,
      {r("max(f1) FILTER (tolerance = 0.025e0)", 4)} AS f1_middle,
      {r("max(f1) FILTER (tolerance = 0.05e0)", 4)} AS f1_coarse
    FROM ac JOIN bm USING (photo_id) GROUP BY photo_id, tp, fp, fn""",
)
def exploratory_metrics(fx):
    from roomtable.functions.numbers import fixed, ratio

    masks = (_sheet_masks(fx), sheet_frames(fx))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counts = E.overlap_counts(*masks, KEYS).select(
        "photo_id",
        fixed(ratio(tp, tp + fp + fn), 4).alias("iou"),
        fixed(ratio(tp * 2, tp * 2 + fp + fn), 4).alias("dice"),
    )
    edges = E.boundary_metrics(*masks, KEYS, SHEET_TOLERANCES)
    at = lambda t, name: fixed(F.max(F.when(F.col("tolerance") == t, F.col("f1"))), 4).alias(name)
    wide = edges.groupBy("photo_id").agg(
        at(0.0125, "f1_fine"), at(0.025, "f1_middle"), at(0.05, "f1_coarse")
    )
    return counts.join(wide, "photo_id")


_SHARES = f"""sh AS (SELECT photo_id, {r('count_if(ua) / 64', 6)} AS ignored_fraction_first,
  {r('count_if(ub) / 64', 6)} AS ignored_fraction_second,
  {r('abs(count_if(ua) / 64 - count_if(ub) / 64)', 6)} AS ignored_fraction_delta FROM pc GROUP BY photo_id)"""


def pair_table(fx):
    """One row per pair: facts, area metrics, ignored shares, disagreement."""
    p = PassPairs(fx)
    facts = p.pairs.select("photo_id", *E.pair_facts())
    area = E.mask_metrics(p.prediction(), p.frames, KEYS).drop("width", "height")
    shares = E.ignored_shares(p.unsure(), p.frames, KEYS).drop("width", "height")
    differing = p.differing()
    profile = E.disagreement_profile(differing, p.frames, KEYS).drop("width", "height")
    return facts.join(area, "photo_id").join(shares, "photo_id").join(profile, "photo_id")


_KIND = """CASE WHEN an1 = an2 THEN 'intra_annotator_repeatability' ELSE 'inter_annotator_agreement' END"""
_PROFILE = f"""ma1 AS (SELECT photo_id, y, x FROM pc WHERE ma), mb1 AS (SELECT photo_id, y, x FROM pc WHERE mb),
  ed AS (SELECT * FROM {_edge('ma1')} UNION SELECT * FROM {_edge('mb1')}),
  df AS (SELECT photo_id, y, x, CASE WHEN y < 1 OR y >= 7 OR x < 1 OR x >= 7 THEN 'at_frame'
      WHEN EXISTS (SELECT 1 FROM ed n WHERE n.photo_id = c.photo_id AND {_disc_near('c', 'n', '2')})
      THEN 'along_junction' ELSE 'interior_region' END AS area FROM pc c WHERE ma <> mb AND NOT ig),
  pf AS (SELECT photo_id, count(df.y) AS total_pixels, count_if(area = 'along_junction') AS along_junction,
      count_if(area = 'at_frame') AS at_frame, count_if(area = 'interior_region') AS interior_region
      FROM pairs LEFT JOIN df USING (photo_id) GROUP BY photo_id)"""
_PAIR_TABLE = f"""{_PAIRS}, {_SHARES}, {_PROFILE},
  ar AS (SELECT *, {_ratios('64')} FROM (SELECT photo_id, {_AREA} FROM pc GROUP BY photo_id)),
  pt AS (SELECT pairs.photo_id, {_KIND} AS kind, coalesce(l1, an1) AS first_label,
    coalesce(l2, an2) AS second_label, indep AS both_independent, ar.* EXCLUDE (photo_id),
    sh.* EXCLUDE (photo_id), pf.* EXCLUDE (photo_id) FROM pairs JOIN ar USING (photo_id)
    JOIN sh USING (photo_id) JOIN pf USING (photo_id))"""


@query("pair_agreement", "A11", f"WITH {_PAIR_TABLE} SELECT * FROM pt")
def pair_agreement(fx):
    return pair_table(fx)


@query(
    "disagreement_profile",
    "A12",
    f"WITH {_PAIRS}, {_PROFILE} SELECT * FROM pf",
)
def disagreement_profile(fx):
    p = PassPairs(fx)
    differing = p.differing()
    return E.disagreement_profile(differing, p.frames, KEYS).drop("width", "height")


_KINDS_SQL = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(BOUNDARY_KINDS))


def boundary_lines(fx, links, shape):
    """Top edge of each exclusion as a boundary line of a kind, as runs by photo."""
    kind = F.element_at(F.array(*[F.lit(k) for k in BOUNDARY_KINDS]), (F.col("k") % 6 + 1).cast("int"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = sized(fx.exclusion, shape).select(
        *KEYS, kind.alias("kind"), F.array(point("x0", "y0"), point("x1", "y0")).alias("points")
    )
    drawn = M.rasterise_polyline(lines, [*KEYS, "kind"])
    return runs_of(drawn, links, "first_vec_id")


@query(
    "disagreement_by_boundary_kind",
    "A12 M9",
    f"""WITH {_PAIRS}, ln AS (SELECT p.photo_id, CASE e.k % 6 {_KINDS_SQL} END AS kind,
      round_even(least(greatest(e.x0, 0), 1) * 7, 0)::BIGINT AS xa, round_even(least(greatest(e.x1, 0), 1) * 7, 0)::BIGINT AS xb,
      round_even(least(greatest(e.y0, 0), 1) * 7, 0)::BIGINT AS y FROM pairs p JOIN exclusion e ON e.photo_id = p.v1),
    lc AS (SELECT photo_id, kind, y, unnest(range(xa, xb + 1)) AS x FROM ln)
    SELECT c.photo_id, l.kind, count(DISTINCT c.y * 8 + c.x) AS pixels FROM pc c JOIN lc l
      ON l.photo_id = c.photo_id AND {_disc_near('c', 'l', '2')} WHERE ma <> mb AND NOT ig
      GROUP BY c.photo_id, l.kind""",
)
def disagreement_by_boundary_kind(fx):
    p = PassPairs(fx)
    differing = p.differing()
    lines = boundary_lines(fx, p.pairs, TILE)
    return E.disagreement_by_kind(differing, lines, KEYS, reach(0.005)).drop("width", "height")


def _components_sql(cells: str, key: str, reach_sql: str) -> str:
    """SQL CTEs: label cells (key, y, x) by the smallest cell number they reach."""
    return f"""nd AS (SELECT {key}, y, x, {key} * 1000000 + y * 1000 + x AS id FROM {cells}),
    lb(id, lab) USING KEY (id) AS (SELECT id, id AS lab FROM nd UNION
      (SELECT b.id, min(l.lab) FROM lb l JOIN nd a ON a.id = l.id
       JOIN nd b ON b.{key} = a.{key} AND {reach_sql} JOIN recurring.lb o ON o.id = b.id
       WHERE l.lab < o.lab GROUP BY b.id))"""


EIGHT = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
FOUR = "abs(a.y - b.y) + abs(a.x - b.x) <= 1"


@query(
    "disagreement_hotspots",
    "A13",
    f"""WITH RECURSIVE {_PAIRS}, {_PROFILE}, {_components_sql('df', 'photo_id', EIGHT)},
    cp AS (SELECT df.*, lab FROM df JOIN nd USING (photo_id, y, x) JOIN lb USING (id)),
    fa AS (SELECT photo_id, lab, count(*) AS pixels, min(x) AS l, min(y) AS t, max(x) AS rr, max(y) AS b,
      count_if(area = 'at_frame') AS f, count_if(area = 'along_junction') AS j FROM cp GROUP BY ALL)
    SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY pixels DESC, lab) AS rank, pixels,
      {r('pixels / 64', 6)} AS fraction, {r('l / 7', 4)} AS box_left, {r('t / 7', 4)} AS box_top,
      {r('(rr + 1) / 7', 4)} AS box_right, {r('(b + 1) / 7', 4)} AS box_bottom,
      CASE WHEN f > pixels / 2 THEN 'at_frame' WHEN j > pixels / 2 THEN 'along_junction'
        ELSE 'interior_region' END AS zone
    FROM fa QUALIFY rank <= 5""",
)
def disagreement_hotspots(fx):
    p = PassPairs(fx)
    differing = p.differing()
    return E.hotspots(differing, KEYS).drop("width", "height")


_SUMMARY = ("iou", "dice", "precision", "recall", "ignored_fraction_delta")


def _describe_sql(source: str, metrics, digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, count({m}) AS counted, {r(f'avg({m})', digits)} AS mean,
        {r(f'quantile_cont({m}, 0.5)', digits)} AS median, {r(f'min({m})', digits)} AS min,
        {r(f'max({m})', digits)} AS max FROM {source}"""
        for m in metrics
    )


@query(
    "agreement_summary",
    "A14",
    f"WITH {_PAIR_TABLE} {_describe_sql('pt', _SUMMARY, 4)}",
)
def agreement_summary(fx):
    p = PassPairs(fx)
    area = E.mask_metrics(p.prediction(), p.frames, KEYS)
    shares = E.ignored_shares(p.unsure(), p.frames, KEYS)
    return E.summarise_agreement(area.join(shares, KEYS), _SUMMARY)


@query(
    "agreement_boundary_summary",
    "A14",
    f"""WITH {_PAIR_BOUNDARY} SELECT tolerance, count(f1) AS counted, {r('avg(f1)', 4)} AS mean,
    {r('quantile_cont(f1, 0.5)', 4)} AS median, {r('min(f1)', 4)} AS min, {r('max(f1)', 4)} AS max
    FROM bm GROUP BY tolerance""",
)
def agreement_boundary_summary(fx):
    p = PassPairs(fx)
    edges = E.boundary_metrics(p.prediction(), p.frames, KEYS, _TILE_TOLERANCES)
    return G.describe(edges, ["tolerance"], "f1", 4)


@query(
    "agreement_overview",
    "A14",
    f"""WITH {_PAIR_TABLE} SELECT count(*) AS pairs, CASE WHEN min(kind) = max(kind) THEN max(kind)
      ELSE 'mixed' END AS kind, bool_and(both_independent) AS all_independent,
      {r('sum(along_junction) / greatest(sum(total_pixels), 1)', 4)} AS along_junction_share,
      {r('sum(at_frame) / greatest(sum(total_pixels), 1)', 4)} AS at_frame_share,
      {r('sum(interior_region) / greatest(sum(total_pixels), 1)', 4)} AS interior_region_share,
      (SELECT photo_id FROM pt ORDER BY coalesce(iou, 2), photo_id LIMIT 1) AS least_stable,
      (SELECT iou FROM pt ORDER BY coalesce(iou, 2), photo_id LIMIT 1) AS least_iou,
      (SELECT photo_id FROM pt ORDER BY coalesce(iou, -1) DESC, photo_id LIMIT 1) AS most_stable,
      (SELECT iou FROM pt ORDER BY coalesce(iou, -1) DESC, photo_id LIMIT 1) AS most_iou FROM pt""",
)
def agreement_overview(fx):
    return E.agreement_overview(pair_table(fx), "photo_id")


@query(
    "agreement_by_difficulty",
    "A17",
    f"""WITH {_PAIRS}, ar AS (SELECT *, {_ratios('64')} FROM (SELECT photo_id, {_AREA} FROM pc
      GROUP BY photo_id))
    SELECT difficulty, count(*) AS scenes, {r('avg(iou)', 4)} AS mean_iou, {r('min(iou)', 4)} AS min_iou,
      CASE WHEN count(*) = 1 THEN 'single_pair' END AS note
    FROM ar JOIN photo USING (photo_id) WHERE iou IS NOT NULL GROUP BY difficulty""",
)
def agreement_by_difficulty(fx):
    p = PassPairs(fx)
    area = E.mask_metrics(p.prediction(), p.frames, KEYS)
    return E.agreement_by_difficulty(area.join(fx.photo.select("photo_id", "difficulty"), "photo_id"))


# --- candidates --------------------------------------------------------------

CANDIDATES = E.CandidateSet()


@CANDIDATES.register("empty")
def _empty(frames):
    return M.frame_runs(frames, KEYS).where(F.lit(False))


@CANDIDATES.register("full")
def _full(frames):
    return M.frame_runs(frames, KEYS)


@CANDIDATES.register("bottom-third")
def _bottom_third(frames):
    return M.frame_runs(frames, KEYS).where(F.col("y") >= F.floor(F.col("height") * 2 / 3))


def bench_scenes(fx):
    """Usable primary passes, one per photo."""
    from roomtable.plans.governance import scenes_with_errors

    return G.primary_pass(scenes_with_errors(fx)).where("usable")


def candidate_rows(fx):
    """Area and boundary metrics of every candidate on every usable scene."""
    names = CANDIDATES.names()
    scenes = bench_scenes(fx).select("photo_id", "vec_id", "difficulty")
    frames = sized(scenes.select("photo_id"), TILE)
    known = E.per_candidate(runs_of(tile_runs(fx, t=TILE_MASK, i=UNSURE), scenes, "vec_id"), names)
    keys = [*KEYS, "candidate"]
    tagged = known.unionByName(CANDIDATES.runs(frames).withColumn("side", F.lit("p")))
    repeated = E.per_candidate(frames, names)
    area = E.mask_metrics(tagged, repeated, keys)
    edges = E.boundary_metrics(tagged, repeated, keys, (0.005,)).select(*keys, "f1")
    rows = area.join(edges, keys)
    return rows.join(scenes.select("photo_id", "difficulty"), "photo_id")


_BENCH = f"""sc AS (SELECT s.*, p.difficulty, s.status = 'approved' AND s.vec_id IN (SELECT vec_id FROM embeddings)
    AND NOT (lower(trim(p.license)) IN ('', '?', 'tbd', 'à vérifier')) AND NOT (p.redistributable AND
    p.usage <> 'redistributable') AND NOT (p.redistributable AND starts_with(lower(trim(p.license)), 'inconnu'))
    AS usable FROM pass s JOIN photo p USING (photo_id)),
  us AS (SELECT * FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY CASE
    WHEN pass_label IS NULL THEN 0 WHEN pass_label = 'A' THEN 1 ELSE 2 END, coalesce(pass_label, '')) = 1)
    WHERE usable),
  px AS (SELECT us.photo_id * 4 + cn.c AS kk, us.photo_id, us.difficulty, cn.candidate, y, x, m AS ma,
    abs(luma - 0.5e0) < 0.02e0 AS ig, CASE cn.c WHEN 0 THEN false WHEN 1 THEN true ELSE y >= 5 END AS mb
    FROM us JOIN cell ON cell.photo_id = us.vec_id, (VALUES (0, 'empty'), (1, 'full'), (2, 'bottom-third'))
    cn(c, candidate)),
  ks AS (SELECT DISTINCT kk FROM px), pm AS (SELECT kk, y, x FROM px WHERE mb),
  tm AS (SELECT kk, y, x FROM px WHERE ma), im AS (SELECT kk, y, x FROM px WHERE ig),
  {_boundary((0.005,), 8, 8, 'kk')},
  rw AS (SELECT a.*, bm.f1 FROM (SELECT *, {_ratios('64')} FROM (SELECT kk, photo_id, difficulty, candidate,
    {_AREA} FROM px GROUP BY ALL)) a JOIN bm USING (kk))"""


@query("candidate_scores", "U1 J7 M12 A8 A9", f"WITH {_BENCH} SELECT * EXCLUDE (kk) FROM rw")
def candidate_scores(fx):
    return candidate_rows(fx).drop("width", "height")


@query(
    "candidate_summary",
    "A19",
    f"""WITH {_BENCH}, lg AS (SELECT candidate, 'overall' AS axis, 'all' AS "group", iou, f1 FROM rw
      WHERE difficulty <> 'rejected' UNION ALL SELECT candidate, 'difficulty', difficulty, iou, f1 FROM rw
      WHERE difficulty <> 'rejected' UNION ALL SELECT candidate, 'trait', trait, iou, f1 FROM rw
      JOIN photo_trait USING (photo_id) WHERE difficulty <> 'rejected')
    {" UNION ALL ".join(f'''SELECT candidate, axis, "group", '{m}' AS metric, count({m}) AS counted,
      {r(f'avg({m})', 6)} AS mean, {r(f'quantile_cont({m}, 0.5)', 6)} AS median, {r(f'min({m})', 6)} AS min,
      {r(f'max({m})', 6)} AS max FROM lg GROUP BY candidate, axis, "group"''' for m in ("iou", "f1"))}""",
)
def candidate_summary(fx):
    return E.score_candidates(candidate_rows(fx), fx.photo_trait, "photo_id")


# --- checks on mask content ----------------------------------------------------


@query(
    "mask_grid_check",
    "S6",
    """SELECT s.photo_id, s.turn, CASE WHEN max(c.x) IS NULL THEN 'missing' WHEN max(c.x) + 1 <> w
      OR max(c.y) + 1 <> 8 THEN 'wrong_dimensions' WHEN count_if(v NOT IN (0, 255)) > 0
      THEN 'forbidden_values' END AS issue
    FROM (SELECT *, CASE WHEN turn % 6 = 5 THEN 9 ELSE 8 END AS w FROM pass) s LEFT JOIN (SELECT photo_id, y, x,
      CASE WHEN luma > 0.9e0 THEN 127 WHEN m THEN 255 ELSE 0 END AS v FROM cell) c ON c.photo_id = s.vec_id
    GROUP BY s.photo_id, s.turn, w""",
)
def mask_grid_check(fx):
    stored = F.when(F.col("luma") > 0.9, 127).when(F.col("m"), 255).otherwise(0)
    cells = fx.cell.select(F.col("photo_id").alias("vec_id"), "y", "x", stored.alias("v"))
    frames = fx.view("pass").select(
        "photo_id",
        "turn",
        "vec_id",
        F.when(F.col("turn") % 6 == 5, 9).otherwise(8).alias("width"),
        F.lit(8).alias("height"),
    )
    keyed = frames.withColumn("pass_id", F.struct("photo_id", "turn"))
    linked = keyed.select("pass_id", "vec_id").join(cells, "vec_id")
    return E.check_mask_grid(linked, keyed, "pass_id").select("pass_id.photo_id", "pass_id.turn", "issue")


@query(
    "mask_content_issues",
    "P6",
    """WITH q AS (SELECT s.photo_id, s.turn, difficulty, turn % 2 = 1 AS has, 1 AS zones,
      count_if(luma > 0.7e0) AS f, count_if(turn % 2 = 1 AND abs(luma - 0.5e0) < 0.06e0) AS u,
      count_if(luma > 0.7e0 AND NOT (turn % 2 = 1 AND abs(luma - 0.5e0) < 0.06e0)) AS rest,
      count_if(luma > 0.7e0 AND turn % 2 = 1 AND abs(luma - 0.5e0) < 0.06e0) AS bth
      FROM pass s JOIN photo USING (photo_id) JOIN cell c ON c.photo_id = s.vec_id GROUP BY ALL)
    SELECT photo_id, turn, CASE WHEN difficulty = 'rejected' THEN 'warning' ELSE 'error' END AS level,
      'floor_mask_empty' AS code FROM q WHERE f = 0
    UNION ALL SELECT photo_id, turn, 'warning', 'uncertain_zone_without_mask' FROM q WHERE NOT has
    UNION ALL SELECT photo_id, turn, 'error', 'uncertain_too_large' FROM q WHERE has AND u / 64 > 0.5
    UNION ALL SELECT photo_id, turn, 'error', 'nothing_left_to_evaluate' FROM q WHERE has AND f > 0 AND rest = 0
    UNION ALL SELECT photo_id, turn, 'warning', 'floor_overlaps_uncertain' FROM q WHERE has AND bth > 0""",
)
def mask_content_issues(fx):
    keys = [*KEYS, "turn"]
    scenes, _ = G.annotated_scenes(fx.view("pass"), fx.photo)
    scenes = sized(scenes, TILE).select(
        *keys,
        "vec_id",
        "difficulty",
        (F.col("turn") % 2 == 1).alias("has_uncertain"),
        F.lit(1).alias("zones"),
    )
    links = scenes.select(F.col("photo_id").alias("_p"), "turn", F.col("vec_id").alias("photo_id"), "has_uncertain")
    tagged = (
        tile_runs(fx, f="luma > 0.7", u="unsure < 0.06")
        .join(links, "photo_id")
        .where((F.col("side") == "f") | F.col("has_uncertain"))
        .select(F.col("_p").alias("photo_id"), "width", "height", "turn", "side", "y", "x0", "x1")
    )
    return E.check_mask_content(tagged, scenes.drop("vec_id"), keys).select(
        "photo_id", "turn", "level", "code"
    )
