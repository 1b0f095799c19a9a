"""Mask metrics, boundary metrics, agreement and confusion scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtable.functions import vocabulary as V
from roomtable.functions.numbers import count_where, fixed, ratio
from roomtable.functions.ranks import describe
from roomtable.operators import masks as M
from roomtable.operators import regions as R
from roomtable.session import cut_lineage

#: Published boundary tolerances, as shares of the diagonal.
TOLERANCES = (0.0025, 0.005, 0.01)
JUNCTION_REACH = 2
MAX_HOTSPOTS = 5
MAX_UNCERTAIN = 0.5


def tolerance_px(fraction: Column) -> Column:
    diagonal = F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))
    return F.greatest(F.lit(1), F.bround(fraction * diagonal).cast("bigint")).cast("bigint")


def with_tolerances(frames: DataFrame, fractions: Sequence[float] = TOLERANCES) -> DataFrame:
    """One row per frame and tolerance fraction, with its size in pixels."""
    listed = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    return frames.withColumn("tolerance", listed).withColumn(
        "tolerance_px", tolerance_px(F.col("tolerance"))
    )


# --- area ------------------------------------------------------------------


def overlap_counts(tagged: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn and ignored pixels per frame.

    `tagged` holds runs whose `side` is p (prediction), t (truth) or i (ignored).
    """
    swept = M.stretches(tagged, keys, ["p", "t", "i"])
    size = F.col("x1") - F.col("x0") + 1
    p, t, i = F.col("p") > 0, F.col("t") > 0, F.col("i") > 0
    count = lambda test: F.sum(F.when(test, size).otherwise(0))
    sums = swept.groupBy(*keys).agg(
        count(p & t & ~i).alias("tp"),
        count(p & ~t & ~i).alias("fp"),
        count(~p & t & ~i).alias("fn"),
        count(i).alias("ignored"),
    )
    filled = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "ignored")]
    others = [c for c in frames.columns if c not in keys]
    rest = F.col("ignored") + F.col("tp") + F.col("fp") + F.col("fn")
    return (
        frames.join(sums, list(keys), "left")
        .select(*keys, *others, *filled)
        .select("*", (F.col("width") * F.col("height") - rest).alias("tn"))
    )


def area_metrics(counts: DataFrame) -> DataFrame:
    """IoU, Dice, precision, recall; null where there is nothing to measure."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    union = tp + fp + fn
    return counts.select(
        "*",
        fixed(F.col("ignored") / (F.col("width") * F.col("height")), 6).alias("ignored_fraction"),
        fixed(ratio(tp, union), 6).alias("iou"),
        fixed(ratio(tp * 2, union + tp), 6).alias("dice"),
        fixed(ratio(tp, tp + fp), 6).alias("precision"),
        fixed(ratio(tp, tp + fn), 6).alias("recall"),
    )


def mask_metrics(tagged: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return area_metrics(overlap_counts(tagged, frames, keys))


# --- boundary --------------------------------------------------------------


def boundary_metrics(
    tagged: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    fractions: Sequence[float] = TOLERANCES,
) -> DataFrame:
    """Boundary precision, recall and F1 per frame and tolerance.

    Evaluated boundary pixels leave out the ignored ones and the frame band; the
    boundary they are matched against stays whole. Tolerances that come out at
    the same number of pixels share the work. Two sweeps: one finds the boundary
    of every side, one matches them.
    """
    keys = list(keys)
    sized = [*keys, "tolerance_px"]
    radii = F.array_distinct(F.array(*[tolerance_px(F.lit(float(f))) for f in fractions]))
    outline = M.edged(tagged, [*keys, "side"]).where(F.col("edge") | (F.col("side") == "i"))
    spans = M.with_surroundings(
        outline.withColumn("tolerance_px", F.explode(radii)),
        sized,
        F.col("tolerance_px"),
        F.col("side") != "i",
        F.concat(F.lit("near_"), "side"),
    )
    swept = M.stretches(spans, sized, ["p", "t", "near_p", "near_t", "i"])
    m, w, h = F.col("tolerance_px"), F.col("width"), F.col("height")
    inside = (m * 2 < F.least(w, h)) & (F.col("y") >= m) & (F.col("y") < h - m) & (F.col("i") <= 0)
    size = F.greatest(
        F.lit(0), F.least(F.col("x1"), w - m - 1) - F.greatest(F.col("x0"), m) + 1
    )
    count = lambda test: F.sum(F.when(inside & test, size).otherwise(0))
    p, t = F.col("p") > 0, F.col("t") > 0
    sums = swept.groupBy(*sized).agg(
        count(p).alias("_p"),
        count(t).alias("_t"),
        count(p & (F.col("near_t") > 0)).alias("_hit_p"),
        count(t & (F.col("near_p") > 0)).alias("_hit_t"),
    )
    asked = with_tolerances(frames.select(*keys), fractions)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rated = asked.join(sums, sized, "left").select(
        *keys,
        "tolerance",
        "tolerance_px",
        zero("_p").alias("predicted_pixels"),
        zero("_t").alias("truth_pixels"),
        fixed(ratio(F.col("_hit_p"), F.col("_p")), 6).alias("precision"),
        fixed(ratio(F.col("_hit_t"), F.col("_t")), 6).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, F.lit(0.0)).otherwise(
        fixed(F.lit(2.0) * F.col("precision") * F.col("recall") / both, 6)
    )
    return rated.select("*", f1.alias("f1"))


# --- agreement -------------------------------------------------------------


def pair_facts() -> list[Column]:
    """Kind, labels and independence of a pair, from first_*/second_* columns."""
    return [
        F.when(
            F.col("first_annotator") == F.col("second_annotator"), "intra_annotator_repeatability"
        )
        .otherwise("inter_annotator_agreement")
        .alias("kind"),
        F.coalesce("first_pass_label", "first_annotator").alias("first_label"),
        F.coalesce("second_pass_label", "second_annotator").alias("second_label"),
        (F.col("first_independent_pass") & F.col("second_independent_pass")).alias("both_independent"),
    ]


def ignored_shares(tagged: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uncertain share of each side (ua, ub) and their absolute difference."""
    size = F.col("x1") - F.col("x0") + 1
    sums = tagged.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == "ua", size).otherwise(0)).alias("_a"),
        F.sum(F.when(F.col("side") == "ub", size).otherwise(0)).alias("_b"),
    )
    total = F.col("width") * F.col("height")
    a, b = F.coalesce("_a", F.lit(0)) / total, F.coalesce("_b", F.lit(0)) / total
    return frames.select(*keys).join(sums, list(keys), "left").select(
        *keys,
        fixed(a, 6).alias("ignored_fraction_first"),
        fixed(b, 6).alias("ignored_fraction_second"),
        fixed(F.abs(a - b), 6).alias("ignored_fraction_delta"),
    )


def disagreement_runs(tagged: DataFrame, keys: Sequence[str], margin: Column) -> DataFrame:
    """Stretches where masks a and b differ outside i, each with its zone.

    at_frame wins over along_junction, which wins over interior_region. margin is
    the tolerance in pixels.
    """
    keys = list(keys)
    outline = M.edged(tagged, [*keys, "side"])
    spans = M.with_surroundings(
        outline, keys, margin * JUNCTION_REACH, F.col("edge") & (F.col("side") != "i"), F.lit("edge")
    )
    swept = M.stretches(spans, keys, ["a", "b", "i", "edge"]).where(
        ((F.col("a") > 0) != (F.col("b") > 0)) & (F.col("i") <= 0)
    )
    m, w, h = margin, F.col("width"), F.col("height")
    whole = (m * 2 >= F.least(w, h)) | (F.col("y") < m) | (F.col("y") >= h - m)
    part = lambda band, a, b: F.struct(band.alias("band"), a.alias("x0"), b.alias("x1"))
    yes, no = F.lit(True), F.lit(False)
    x0, x1 = F.col("x0"), F.col("x1")
    parts = F.when(whole, F.array(part(yes, x0, x1))).otherwise(
        F.array(
            part(yes, x0, F.least(x1, m - 1)),
            part(no, F.greatest(x0, m), F.least(x1, w - m - 1)),
            part(yes, F.greatest(x0, w - m), x1),
        )
    )
    return (
        swept.select(*keys, "y", "edge", F.explode(parts).alias("p"))
        .where(F.col("p.x0") <= F.col("p.x1"))
        .select(
            *keys,
            "y",
            "p.x0",
            "p.x1",
            F.when(F.col("p.band"), "at_frame")
            .when(F.col("edge") > 0, "along_junction")
            .otherwise("interior_region")
            .alias("zone"),
        )
    )


def disagreement_profile(differing: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    size = F.col("x1") - F.col("x0") + 1
    at = lambda zone: F.sum(F.when(F.col("zone") == zone, size).otherwise(0))
    sums = differing.groupBy(*keys).agg(
        F.sum(size).alias("total_pixels"),
        at("along_junction").alias("along_junction"),
        at("at_frame").alias("at_frame"),
        at("interior_region").alias("interior_region"),
    )
    names = ("total_pixels", "along_junction", "at_frame", "interior_region")
    return frames.select(*keys).join(sums, list(keys), "left").select(
        *keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names]
    )


def disagreement_by_kind(
    differing: DataFrame, lines: DataFrame, keys: Sequence[str], margin: Column
) -> DataFrame:
    """Differing pixels within reach of each kind of boundary line (keys, kind, runs)."""
    by_kind = [*keys, "kind"]
    reach = M.spread(lines, by_kind, M.disc_rows(margin * JUNCTION_REACH))
    kinds = lines.select(*by_kind).distinct()
    repeated = differing.join(kinds, list(keys)).select(*by_kind, "y", "x0", "x1")
    swept = M.stretches(M.gather({"d": repeated, "k": reach}, by_kind), by_kind, ["d", "k"])
    hit = swept.where((F.col("d") > 0) & (F.col("k") > 0))
    return hit.groupBy(*by_kind).agg(M.area().alias("pixels"))


def hotspots(differing: DataFrame, keys: Sequence[str], top: int = MAX_HOTSPOTS) -> DataFrame:
    """Largest connected disagreements per pair: box, share and majority zone."""
    keys = list(keys)
    known = cut_lineage(differing)
    parts = R.components(M.merged(known.select(*keys, "y", "x0", "x1"), keys), keys, 8)
    facts = R.part_facts(parts, keys)
    # zone stretches lie inside one run each: the last one that began carries its part
    stretch = known.select(*keys, "y", F.col("x0").alias("x"), (F.col("x1") - F.col("x0") + 1).alias("_size"), "zone", F.lit(1).alias("_side"))
    begun = parts.select(*keys, "y", F.col("x0").alias("x"), "part", F.lit(0).alias("_side"))
    along = Window.partitionBy(*keys, "y").orderBy("x", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stretch.unionByName(begun, allowMissingColumns=True).withColumn("part", F.last("part", ignorenulls=True).over(along))
    zoned = carried.where("_side = 1").groupBy(*keys, "part").agg(
        F.sum(F.when(F.col("zone") == "at_frame", F.col("_size")).otherwise(0)).alias("_f"),
        F.sum(F.when(F.col("zone") == "along_junction", F.col("_size")).otherwise(0)).alias("_j"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("pixels"), "part")
    ranked = (
        facts.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= top)
        .join(zoned, [*keys, "part"])
    )
    w, h = F.col("width"), F.col("height")
    return ranked.select(
        *keys,
        "rank",
        "pixels",
        fixed(F.col("pixels") / (w * h), 6).alias("fraction"),
        fixed(F.col("left") / (w - 1), 4).alias("box_left"),
        fixed(F.col("top") / (h - 1), 4).alias("box_top"),
        fixed((F.col("right") + 1) / (w - 1), 4).alias("box_right"),
        fixed((F.col("bottom") + 1) / (h - 1), 4).alias("box_bottom"),
        F.when(F.col("_f") > F.col("pixels") / 2, "at_frame")
        .when(F.col("_j") > F.col("pixels") / 2, "along_junction")
        .otherwise("interior_region")
        .alias("zone"),
    )


def summarise_agreement(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """counted, mean, median, min, max per metric over all pairs, long form."""
    long = pairs.select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ).alias("m")
    ).select("m.metric", "m.value")
    return describe(long, ["metric"], "value", 4)


def agreement_overview(pairs: DataFrame, key: str) -> DataFrame:
    """Kind, shares of the disagreement, least and most stable pair; one row."""
    total = F.greatest(F.sum("total_pixels"), F.lit(1))
    share = lambda c: fixed(F.sum(c) / total, 4).alias(f"{c}_share")
    worst = F.min(F.struct(F.coalesce("iou", F.lit(2.0)).alias("i"), F.col(key).alias("k"), F.col("iou").alias("v")))
    best = F.min(F.struct((-F.coalesce("iou", F.lit(-1.0))).alias("i"), F.col(key).alias("k"), F.col("iou").alias("v")))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.when(F.min("kind") == F.max("kind"), F.max("kind")).otherwise("mixed").alias("kind"),
        F.min("both_independent").alias("all_independent"),
        share("along_junction"),
        share("at_frame"),
        share("interior_region"),
        worst.alias("_w"),
        best.alias("_b"),
    ).select(
        "pairs", "kind", "all_independent", "along_junction_share", "at_frame_share",
        "interior_region_share",
        F.col("_w.k").alias("least_stable"), F.col("_w.v").alias("least_iou"),
        F.col("_b.k").alias("most_stable"), F.col("_b.v").alias("most_iou"),
    )


def agreement_by_difficulty(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("iou").isNotNull())
        .groupBy("difficulty")
        .agg(
            F.count(F.lit(1)).alias("scenes"),
            fixed(F.avg("iou"), 4).alias("mean_iou"),
            fixed(F.min("iou"), 4).alias("min_iou"),
        )
        .withColumn("note", F.when(F.col("scenes") == 1, "single_pair"))
    )


# --- candidates ------------------------------------------------------------

Candidate = Callable[[DataFrame], DataFrame]


class CandidateSet:
    """Named functions from frames (or measured cells) to mask runs."""

    def __init__(self) -> None:
        self._known: dict[str, Candidate] = {}

    def register(self, name: str) -> Callable[[Candidate], Candidate]:
        def keep(build: Candidate) -> Candidate:
            if name in self._known:
                raise ValueError(f"candidate {name} is already registered")
            self._known[name] = build
            return build

        return keep

    def names(self) -> tuple[str, ...]:
        return tuple(self._known)

    def runs(self, source: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Runs of the named candidates with a `candidate` column."""
        chosen = list(names or self._known)
        unknown = [n for n in chosen if n not in self._known]
        if unknown:
            raise KeyError(f"unknown candidates: {', '.join(unknown)}")
        out = None
        for name in chosen:
            runs = self._known[name](source).withColumn("candidate", F.lit(name))
            out = runs if out is None else out.unionByName(runs)
        return out


def per_candidate(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Repeat frames or truth once per candidate name."""
    return df.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in names])))


def score_candidates(rows: DataFrame, traits: DataFrame, key: str) -> DataFrame:
    """IoU and boundary F1 of each candidate: overall, by difficulty, by trait; long form.

    rows: candidate, key, difficulty, iou, f1. Rejected scenes stay out. A scene
    counts in the group of each of its traits.
    """
    scored = rows.where(F.col("difficulty") != "rejected")
    groups = F.array(
        F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("group")),
        F.struct(F.lit("difficulty").alias("axis"), F.col("difficulty").alias("group")),
    )
    own = traits.groupBy(key).agg(
        F.collect_set(F.struct(F.lit("trait").alias("axis"), F.col("trait").alias("group"))).alias("_traits")
    )
    metric = lambda name: F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))
    long = (
        scored.join(own, key, "left")
        .select(
            "candidate",
            "iou",
            "f1",
            F.explode(F.concat(groups, F.coalesce("_traits", F.array()))).alias("g"),
        )
        .select("candidate", "g.axis", "g.group", F.explode(F.array(metric("iou"), metric("f1"))).alias("m"))
        .select("candidate", "axis", "group", "m.metric", "m.value")
    )
    return describe(cut_lineage(long), ["candidate", "axis", "group", "metric"], "value", 6)


def bleed_by_role(shapes: DataFrame, prediction: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Painted-over area per exclusion role, and thin objects lost.

    shapes: keys, shape_id, role, thin and runs; prediction: keys and runs, apart from each
    other in a row. A thin object is lost when more than half of it is painted. The painted
    length up to a column is a running sum along the row, read at both ends of each run of
    a shape; so the prediction is read once, however many shapes there are.
    """
    keys = list(keys)
    keyed = [*keys, "shape_id", "role", "thin"]
    size = F.col("x1") - F.col("x0") + 1
    ends = F.array(
        F.struct((F.col("x0") - 1).alias("x"), F.lit(-1).alias("sign"), F.lit(0).cast("bigint").alias("own")),
        F.struct(F.col("x1").alias("x"), F.lit(1).alias("sign"), size.alias("own")),
    )
    asked = shapes.select(*keyed, "y", F.explode(ends).alias("e")).select(*keyed, "y", "e.*", F.lit(1).alias("_ask"))
    painted = prediction.select(*keys, "y", F.col("x0").alias("x"), size.alias("_size"), F.col("x1").alias("_end"), F.lit(0).alias("_ask"))
    along = Window.partitionBy(*keys, "y").orderBy("x", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = F.greatest(F.coalesce(F.last("_end", ignorenulls=True).over(along) - F.col("x"), F.lit(0)), F.lit(0))
    swept = asked.unionByName(painted, allowMissingColumns=True).withColumn(
        "_before", F.coalesce(F.sum("_size").over(along), F.lit(0)) - beyond
    )
    each = swept.where("_ask = 1").groupBy(*keyed).agg(
        F.sum("own").alias("_area"), F.sum(F.col("sign") * F.col("_before")).alias("_over")
    )
    return each.groupBy("role").agg(
        F.count(F.lit(1)).alias("exclusions"),
        F.sum("_area").cast("bigint").alias("area"),
        F.sum("_over").cast("bigint").alias("overflow"),
        fixed(ratio(F.sum("_over"), F.sum("_area")), 4).alias("bleed_ratio"),
        count_where(F.col("thin")).alias("thin_total"),
        count_where(F.col("thin") & (F.col("_over") > F.col("_area") * 0.5)).alias("thin_lost"),
    )


# --- confusion -------------------------------------------------------------


def score_images(emission: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Expected and detected scored codes per image, and their differences.

    emission is long (key, side, code); every image of `images` gets a row.
    """
    sets = emission.groupBy(key).agg(
        F.collect_set(F.when(F.col("side") == "expected", F.col("code"))).alias("_e"),
        F.collect_set(F.when(F.col("side") == "detected", F.col("code"))).alias("_d"),
    )
    scored = F.array(*[F.lit(c) for c in V.SCORED_CODES])
    filled = images.join(sets, key, "left").select(
        *images.columns,
        F.array_intersect(F.coalesce("_e", F.array().cast("array<string>")), scored).alias("expected"),
        F.array_intersect(F.coalesce("_d", F.array().cast("array<string>")), scored).alias("detected"),
        F.array_except(F.coalesce("_d", F.array().cast("array<string>")), scored).alias("informational"),
    )
    return filled.withColumn(
        "false_positives", F.array_except("detected", "expected")
    ).withColumn("false_negatives", F.array_except("expected", "detected"))


def label_scores(images: DataFrame, key: str) -> DataFrame:
    """tp/fp/fn/tn per image and scored label, long form."""
    labels = F.explode(F.array(*[F.lit(c) for c in V.SCORED_CODES]))
    rows = images.withColumn("label", labels)
    e = F.array_contains("expected", F.col("label"))
    d = F.array_contains("detected", F.col("label"))
    bit = lambda test, name: test.cast("bigint").alias(name)
    return rows.select(
        key, "label", bit(e & d, "tp"), bit(d & ~e, "fp"), bit(e & ~d, "fn"), bit(~e & ~d, "tn")
    )


def confusion_totals(images: DataFrame, key: str) -> DataFrame:
    """Overall row and one row per label that was ever expected or detected.

    Only graded images count. Perfect and faulty image counts are on the overall
    row; rates are null where nothing was expected or detected.
    """
    graded = images.where("graded")
    per_label = (
        label_scores(graded, key)
        .groupBy("label")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")])
    )
    rolled = per_label.rollup("label").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.grouping("label").alias("_all"),
    )
    has = lambda c: F.size(c) > 0
    facts = graded.agg(
        F.count(F.lit(1)).alias("images"),
        count_where(~has("false_positives") & ~has("false_negatives")).alias("perfect_images"),
        count_where(has("false_positives")).alias("images_with_fp"),
        count_where(has("false_negatives")).alias("images_with_fn"),
        count_where(F.array_contains("informational", "lens_analysis_undetermined")).alias("undetermined_lens"),
    ).withColumn("_all", F.lit(1))
    shown = rolled.where((F.col("_all") == 1) | (F.col("tp") + F.col("fp") + F.col("fn") > 0))
    return shown.join(facts, "_all", "left").select(
        F.coalesce("label", F.lit("overall")).alias("label"),
        "tp", "fp", "fn", "tn",
        "images", "perfect_images", "images_with_fp", "images_with_fn", "undetermined_lens",
        fixed(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("detected_of_expected"),
        fixed(ratio(F.col("fp"), F.col("images")), 4).alias("false_alarms_per_image"),
        fixed(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision_of_detections"),
    )


# --- mask checks -----------------------------------------------------------


def check_mask_grid(cells: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Issue per mask: missing, wrong size, values other than 0 and 255, or null.

    cells: key, y, x, v (stored value); frames: key, width, height.
    """
    seen = cells.groupBy(key).agg(
        (F.max("x") + 1).alias("_w"),
        (F.max("y") + 1).alias("_h"),
        count_where(~F.col("v").isin(0, 255)).alias("_odd"),
    )
    return frames.join(seen, key, "left").select(
        key,
        F.when(F.col("_w").isNull(), "missing")
        .when((F.col("_w") != F.col("width")) | (F.col("_h") != F.col("height")), "wrong_dimensions")
        .when(F.col("_odd") > 0, "forbidden_values")
        .alias("issue"),
    )


def check_mask_content(tagged: DataFrame, scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Content issues per scene, from runs whose side is f (floor) or u (uncertain).

    scenes: keys, difficulty, has_uncertain, zones (number of described zones).
    """
    swept = M.stretches(tagged, keys, ["f", "u"])
    size = F.col("x1") - F.col("x0") + 1
    f, u = F.col("f") > 0, F.col("u") > 0
    count = lambda test: F.sum(F.when(test, size).otherwise(0))
    sums = swept.groupBy(*keys).agg(
        count(f).alias("_f"), count(u).alias("_u"), count(f & ~u).alias("_left"), count(f & u).alias("_both")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.col("width") * F.col("height")
    has = F.col("has_uncertain")
    when = lambda test, level, code: F.when(
        test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))
    )
    rejected = F.col("difficulty") == "rejected"
    others = [c for c in scenes.columns if c not in keys]
    listed = scenes.join(sums, list(keys), "left").select(
        *keys,
        *others,
        F.explode(
            F.filter(
                F.array(
                    when((n("_f") == 0) & rejected, "warning", "floor_mask_empty"),
                    when((n("_f") == 0) & ~rejected, "error", "floor_mask_empty"),
                    when(~has & (F.col("zones") > 0), "warning", "uncertain_zone_without_mask"),
                    when(has & (n("_u") / total > MAX_UNCERTAIN), "error", "uncertain_too_large"),
                    when(has & (n("_f") > 0) & (n("_left") == 0), "error", "nothing_left_to_evaluate"),
                    when(has & (n("_both") > 0), "warning", "floor_overlaps_uncertain"),
                ),
                lambda i: i.isNotNull(),
            )
        ).alias("i"),
    )
    return listed.select(*keys, "i.level", "i.code")
