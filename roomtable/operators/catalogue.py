"""Product catalogue: materials, pattern profiles, facets and variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtable.functions.numbers import codes, count_where
from roomtable.functions.vocabulary import PATTERNS
from roomtable.session import cut_lineage

#: Surface of each finish (roughness, clearcoat).
FINISHES = {
    "brut": (0.95, 0.0),
    "huile": (0.82, 0.04),
    "mat": (0.74, 0.08),
    "satine": (0.5, 0.22),
    "vernis": (0.34, 0.38),
    "cire": (0.6, 0.16),
}
#: Default size in mm of the patterns that are not plain boards.
PATTERN_SIZES = {"point-de-hongrie": (90.0, 600.0), "baton-rompu": (90.0, 450.0)}
ANGLE_DEG = 45.0
#: A texture's spread that makes a variation of 1.
SPREAD = 30.0
#: Attributes that a rich key of the alternatives keeps, and poor keys that are broadcast at most.
RICH = 2
POOR_KEYS = 100_000


def finish_kind(label: Column) -> Column:
    """Finish guessed from its label."""
    text = F.lower(F.coalesce(label, F.lit("")))
    has = lambda part: text.contains(part)
    return (
        F.when(has("brut") | has("bross"), "brut")
        .when(has("satin"), "satine")
        .when(has("vernis") & has("mat"), "mat")
        .when(has("vernis"), "vernis")
        .when(has("cir"), "cire")
        .when(has("huil"), "huile")
        .otherwise("mat")
    )


def enrich_material(products: DataFrame) -> DataFrame:
    """Adds finish_kind, roughness, clearcoat, relief, variation and a board length.

    Declared values in columns declared_finish, roughness, clearcoat, relief or variation
    win; else the variation comes from texture_spread.
    """
    has = lambda name: F.col(name) if name in products.columns else F.lit(None)
    declared = F.when(has("declared_finish").isin(list(FINISHES)), has("declared_finish"))
    kinded = products.withColumn("finish_kind", F.coalesce(declared, finish_kind(F.col("finish"))))

    def of(index: int) -> Column:
        chosen = F.lit(None).cast("double")
        for kind, values in FINISHES.items():
            chosen = F.when(F.col("finish_kind") == kind, F.lit(values[index])).otherwise(chosen)
        return chosen

    shiny = of(1)
    made = {
        "roughness": F.coalesce(has("roughness").cast("double"), of(0)),
        "clearcoat": F.coalesce(has("clearcoat").cast("double"), shiny),
        "relief": F.coalesce(has("relief").cast("double"), 0.45 - shiny * 0.6),
        "variation": F.coalesce(has("variation").cast("double"), has("texture_spread").cast("double") / SPREAD),
        "board_length_mm": F.coalesce(F.nullif(F.col("length_mm"), F.lit(0)), F.col("width_mm") * 9),
    }
    return kinded.select(
        *[c for c in kinded.columns if c not in made], *[v.alias(k) for k, v in made.items()]
    )


def pattern_profile(products: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Adds profile_width_mm, profile_length_mm and angle_deg for a pattern column.

    A declared profile (column profiles: map of pattern to struct width, length,
    angle_deg) wins, then the default of the pattern, then the board itself.
    """
    declared = (
        F.try_element_at("profiles", F.col(pattern)) if "profiles" in products.columns else None
    )
    given = lambda f: declared[f] if declared is not None else F.lit(None).cast("double")
    plain = ~F.col(pattern).isin(list(PATTERN_SIZES))

    def default(index: int) -> Column:
        chosen = F.lit(None).cast("double")
        for name, sizes in PATTERN_SIZES.items():
            chosen = F.when(F.col(pattern) == name, F.lit(sizes[index])).otherwise(chosen)
        return chosen

    board = F.col("width_mm").cast("double")
    sized = products.withColumn(
        "profile_width_mm",
        F.coalesce(given("width"), F.when(plain, board).otherwise(F.least(board, default(0)))),
    )
    length = F.when(
        plain, F.coalesce(F.nullif(F.col("length_mm").cast("double"), F.lit(0.0)), F.col("profile_width_mm") * 9)
    ).otherwise(default(1))
    return sized.withColumn("profile_length_mm", F.coalesce(given("length"), length)).withColumn(
        "angle_deg", F.coalesce(given("angle_deg"), F.lit(ANGLE_DEG))
    )


def expand_variants(products: DataFrame, compatible: str = "compatible") -> DataFrame:
    """One row per product and compatible pattern, sizes in mm."""
    spread = products.withColumn("variant", F.explode(compatible))
    return pattern_profile(spread, "variant")


def facets(products: DataFrame, columns: Sequence[str], chosen: dict[str, str] | None = None) -> DataFrame:
    """Values present after a filter, with their counts; absent values do not show."""
    kept = filter_catalogue(products, chosen or {})
    entries = F.array(
        *[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("entry")) for c in columns]
    )
    return (
        kept.select(F.explode(entries).alias("e"))
        .select("e.facet", "e.entry")
        .where(F.col("entry").isNotNull())
        .groupBy("facet", "entry")
        .agg(F.count(F.lit(1)).alias("items"))
    )


def filter_catalogue(products: DataFrame, chosen: dict[str, str]) -> DataFrame:
    for column, value in chosen.items():
        products = products.where(F.col(column).cast("string") == value)
    return products


def find_variants(products: DataFrame, requests: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Another product with the requested value that keeps most other attributes.

    requests: ref, attribute, wanted. Products are indexed by the wanted value and
    every subset of the other attributes, smallest reference per key, so that a
    request looks up at most 2^(n-1) keys instead of scanning the catalogue.

    Keys that keep RICH attributes or more are dealt out on both sides. The poor ones, which
    many requests share, are as few as pairs of attribute values: requests that found
    nothing richer meet them as a broadcast of at most POOR_KEYS rows, and by a join only
    where a vocabulary is larger. Requests and products meet by merge joins: both may be
    large, and files of theirs that look small enough to broadcast hold many rows.
    """
    attributes = list(attributes)
    n = len(attributes)

    def keys(own: DataFrame, attribute: Column, value: Column) -> DataFrame:
        marks = []
        for mask in range(1 << n):
            kept = [a for i, a in enumerate(attributes) if mask >> i & 1]
            parts = [F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in kept]
            marks.append(
                F.when(
                    # the changed attribute itself is never one of those kept
                    F.lit(True) if not kept else ~attribute.isin(kept),
                    F.struct(
                        F.lit(len(kept)).alias("kept"),
                        F.concat_ws("|", F.lit(str(mask)), *parts).alias("rest"),
                    ),
                )
            )
        return own.select(
            "*", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("_k"), value.alias("_value")
        )

    offered = products.withColumn("attribute", F.explode(F.array(*[F.lit(a) for a in attributes])))
    chosen = F.lit(None).cast("string")
    for a in attributes:
        chosen = F.when(F.col("attribute") == a, F.col(a).cast("string")).otherwise(chosen)
    index = (
        keys(offered, F.col("attribute"), chosen)
        .groupBy("attribute", "_value", F.col("_k.rest").alias("rest"), F.col("_k.kept").alias("kept"))
        .agg(F.min("ref").alias("variant"))
    )
    asked = keys(requests.hint("merge").join(products, "ref"), F.col("attribute"), F.col("wanted").cast("string"))
    own = ["ref", "attribute", "wanted"]
    looked = asked.where(F.col("_value") != chosen).select(*own, "_value", F.col("_k.kept").alias("kept"), F.col("_k.rest").alias("rest"))
    best = F.min(F.struct((-F.col("kept")).alias("k"), F.col("variant").alias("v"))).alias("b")

    def found(part: DataFrame, among: DataFrame) -> DataFrame:
        return part.join(among, ["attribute", "_value", "rest"]).groupBy(*own).agg(best)

    rich = found(looked.where(F.col("kept") >= RICH), index.where(F.col("kept") >= RICH).drop("kept"))
    rich = cut_lineage(rich)
    poor = cut_lineage(index.where(F.col("kept") < RICH).drop("kept"))
    few = poor.limit(POOR_KEYS + 1).count() <= POOR_KEYS
    left = looked.where(F.col("kept") < RICH).join(rich.hint("merge"), own, "left_anti")
    hits = rich.unionByName(found(left, F.broadcast(poor) if few else poor))
    return hits.select(*own, F.col("b.v").alias("variant"), (-F.col("b.k")).cast("bigint").alias("kept"))


def catalogue_checks(products: DataFrame, url_pattern: str) -> DataFrame:
    """Problem codes per product; duplicates show on every copy of a reference.

    products: ref, url, width_mm, length_mm, mapping_width_m, pattern.
    """
    copies = products.groupBy("ref").agg(F.count(F.lit(1)).alias("_copies"))
    return products.join(copies, "ref").withColumn(
        "problems",
        codes(
            (F.col("_copies") > 1, "duplicate_reference"),
            (~F.col("url").rlike(url_pattern), "url_shape"),
            (~F.contains(F.col("url"), F.col("ref").cast("string")), "url_without_reference"),
            ((F.col("width_mm") <= 0) | (F.col("length_mm") <= 0), "dimensions"),
            (F.round(F.col("mapping_width_m") * 1000) != F.col("width_mm"), "mapping_width"),
            (~F.col("pattern").isin(list(PATTERNS)), "unknown_pattern"),
        ),
    ).drop("_copies")


def check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("products"), count_where(F.size("problems") > 0).alias("with_problems")
    )
