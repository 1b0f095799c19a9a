"""Checks on manifests and annotations, pass selection and campaign progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtable.functions import vocabulary as V
from roomtable.functions.numbers import clip, codes, count_where, fixed, one_of
from roomtable.functions.ranks import describe, previous_in_group

# --- photos ---------------------------------------------------------------


def validate_photo(photos: DataFrame) -> DataFrame:
    golden = F.col("split") == "golden_holdout"
    return photos.withColumn(
        "issues",
        codes(
            (~one_of(F.col("difficulty"), V.DIFFICULTIES), "unknown_difficulty"),
            (~one_of(F.col("split"), V.SPLITS), "unknown_split"),
            (
                F.col("golden_case").isNotNull() & ~one_of(F.col("golden_case"), V.GOLDEN_CASES),
                "unknown_golden_case",
            ),
            (golden & F.col("golden_case").isNull(), "golden_without_case"),
            (~golden & F.col("golden_case").isNotNull(), "case_outside_golden"),
            (golden & (F.col("difficulty") == "rejected"), "golden_rejected"),
        ),
    )


def provenance_issues() -> Column:
    """Codes of the licence rules; two rules share a code, so it can come twice."""
    license_ = F.lower(F.trim("license"))
    shared = F.col("redistributable")
    return codes(
        (one_of(license_, V.UNSET_LICENSES), "provenance_incomplete"),
        (shared & (F.col("usage") != "redistributable"), "provenance_incomplete"),
        (license_.startswith("inconnu") & shared, "license_unverified"),
    )


def check_provenance(photos: DataFrame) -> DataFrame:
    return photos.withColumn("issues", provenance_issues())


def check_image_file(photos: DataFrame, files: DataFrame) -> DataFrame:
    """`files` has (file, digest); adds level and code, null when all is well."""
    found = files.select("file", F.col("digest").alias("actual_digest"))
    out = photos.join(found, "file", "left")
    missing = F.col("actual_digest").isNull()
    unhashed = F.col("expected_digest").isNull()
    drifted = F.col("actual_digest") != F.col("expected_digest")
    return out.withColumn(
        "code",
        F.when(missing, "image_file_missing")
        .when(unhashed, "image_hash_missing")
        .when(drifted, "image_hash_mismatch"),
    ).withColumn(
        "level", F.when(missing, "error").when(unhashed, "warning").when(drifted, "error")
    )


def check_manifest_files(photos: DataFrame, files: DataFrame, position: str = "photo_id") -> DataFrame:
    """File, hash, duplicate and folder problems, one row per problem.

    A duplicate names the photo that last held the same bytes in manifest order.
    """
    found = files.select("file", F.col("digest").alias("actual_digest"))
    joined = photos.join(found, "file", "left")
    present = joined.where(F.col("actual_digest").isNotNull())
    ranked = previous_in_group(present, "actual_digest", position, "photo_id", "holder")
    shared, file = F.col("redistributable"), F.col("file")
    none = F.lit(None).cast("string")
    problem = lambda code, when, other=none: F.when(
        when, F.struct(F.lit(code).alias("code"), other.cast("string").alias("other"))
    )
    listed = ranked.select(
        "photo_id",
        F.array(
            problem(
                "hash_drift",
                F.col("expected_digest").isNotNull()
                & (F.col("expected_digest") != F.col("actual_digest")),
            ),
            problem(
                "duplicate_bytes",
                F.col("holder").isNotNull() & (F.col("holder") != F.col("photo_id")),
                F.col("holder"),
            ),
            problem("shared_in_private_folder", shared & file.startswith("private-real/")),
            problem("private_in_public_folder", ~shared & file.startswith("public/")),
        ).alias("found"),
    )
    lines = listed.select("photo_id", F.explode(F.filter("found", lambda p: p.isNotNull())).alias("p"))
    absent = joined.where(F.col("actual_digest").isNull()).select(
        "photo_id", F.lit("file_missing").alias("code"), none.alias("other")
    )
    return lines.select("photo_id", "p.code", "p.other").unionByName(absent)


def register_photo(manifest: DataFrame, incoming: DataFrame, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(manifest with the newest entry per id, refused rows with a reason).

    `incoming` and `manifest` carry `sequence`; the highest one wins, of equal ones the
    last by file, then by licence.
    """
    shared, file = F.col("redistributable"), F.col("file")
    judged = incoming.withColumn(
        "refusal",
        F.when(shared & file.startswith("private-real/"), "shared_in_private_folder")
        .when(~shared & file.startswith("public/"), "private_in_public_folder")
        .when(F.col("license").isNull(), "license_missing"),
    )
    taken = judged.where(F.col("refusal").isNull()).drop("refusal")
    newest = Window.partitionBy("photo_id").orderBy(F.desc(sequence), F.desc("file"), F.desc("license"))
    merged = (
        manifest.unionByName(taken, allowMissingColumns=True)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
    return merged, judged.where(F.col("refusal").isNotNull())


def golden_coverage(photos: DataFrame) -> DataFrame:
    """One row per required case: scenes, easy ones, and whether it is covered."""
    spark = photos.sparkSession
    required = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in V.GOLDEN_CASES])).alias("golden_case")
    )
    golden = (
        photos.where(F.col("split") == "golden_holdout")
        .groupBy("golden_case")
        .agg(
            F.count(F.lit(1)).alias("scenes"),
            count_where(F.col("difficulty") == "easy").alias("easy_scenes"),
        )
    )
    return (
        required.join(golden, "golden_case", "left")
        .select(
            "golden_case",
            F.coalesce("scenes", F.lit(0)).alias("scenes"),
            F.coalesce("easy_scenes", F.lit(0)).alias("easy_scenes"),
        )
        .withColumn("missing", F.col("scenes") == 0)
    )


def golden_balance(photos: DataFrame) -> DataFrame:
    """Size of the golden set and whether most of it is not easy."""
    golden = photos.where(F.col("split") == "golden_holdout")
    counted = golden.agg(
        F.count(F.lit(1)).alias("scenes"),
        F.coalesce(count_where(F.col("difficulty") == "easy"), F.lit(0)).alias("easy_scenes"),
    )
    return counted.withColumn(
        "majority_hard", (F.col("scenes") > 0) & (F.col("easy_scenes") * 2 < F.col("scenes"))
    )


def golden_members(photos: DataFrame) -> DataFrame:
    """The scenes behind golden_coverage, as rows rather than one list per case."""
    return photos.where(
        (F.col("split") == "golden_holdout") & one_of(F.col("golden_case"), V.GOLDEN_CASES)
    ).select("golden_case", "photo_id")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("items"))


def unify_cases(generated: DataFrame, photos: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases of both origins in one schema, manifest rows whose file is absent)."""
    present = photos.join(files.select("file"), "file", "left_semi")
    skipped = photos.join(files.select("file"), "file", "left_anti")
    real = present.select("photo_id", "difficulty", "graded", F.lit("manifest").alias("origin"), "file")
    return generated.withColumn("origin", F.lit("generated")).unionByName(
        real, allowMissingColumns=True
    ), skipped


# --- annotations ----------------------------------------------------------


def validate_annotation(passes: DataFrame) -> DataFrame:
    """Adds `issues`: codes of the broken rules, each once.

    Besides status, reviewer and durations, the columns width, height, revision,
    corrections_seconds, correction_count, annotator, boundary, uncertain_zones and
    exclusions are checked where `passes` has them: sizes and numbers have lower bounds,
    outlines a least number of points with finite coordinates, kinds, reasons and roles
    come from their vocabularies.
    """
    draft = F.col("status") == "draft"
    found = [
        (~one_of(F.col("status"), V.STATUSES), "unknown_status"),
        (~draft & F.col("reviewer").isNull(), "review_missing"),
        (draft & F.col("reviewer").isNotNull(), "draft_with_review"),
    ]
    for column in ("first_pass_seconds", "review_seconds", "corrections_seconds"):
        if column in passes.columns:
            found.append((F.col(column) < 0, "negative_duration"))
    for column, least, code in (("width", 1, "size_below_one"), ("height", 1, "size_below_one"), ("revision", 1, "revision_below_one"), ("correction_count", 0, "negative_correction_count")):
        if column in passes.columns:
            found.append((F.col(column) < least, code))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    for column, outline, least, kind, allowed in (
        ("boundary", "points", 2, "kind", V.BOUNDARY_KINDS),
        ("uncertain_zones", "polygon", 3, "reason", V.UNCERTAIN_REASONS),
        ("exclusions", "polygon", 3, "role", V.EXCLUSION_ROLES),
    ):
        if column in passes.columns:
            items = F.coalesce(F.col(column), F.array())
            found += _outline_rules(items, column, outline, least, kind, allowed, finite)
    if "annotator" in passes.columns:
        found.append((F.coalesce(F.trim("annotator"), F.lit("")) == "", "annotator_missing"))
    return passes.withColumn("issues", F.array_distinct(codes(*found)))


def _outline_rules(items, column: str, outline: str, least: int, kind: str, allowed, finite) -> list:
    def short(x):
        return F.coalesce(F.size(x[outline]) < least, F.lit(True))

    def infinite(x):
        return F.exists(F.coalesce(x[outline], F.array()), lambda p: ~(finite(p["x"]) & finite(p["y"])))

    def unknown(x):
        return F.coalesce(~x[kind].isin(list(allowed)), F.lit(True))

    return [
        (F.exists(items, short), f"{column}_too_short"),
        (F.exists(items, infinite), f"{column}_not_finite"),
        (F.exists(items, unknown), f"{column}_unknown_{kind}"),
    ]


def check_status(passes: DataFrame) -> DataFrame:
    return passes.withColumn(
        "code",
        F.when(F.col("status") != "approved", "not_approved").when(
            F.col("reviewer") == F.col("annotator"), "self_approved"
        ),
    )


def check_mask_hash(passes: DataFrame, digests: DataFrame) -> DataFrame:
    """One row per (pass, role) of the `masks` map; digests has (mask, digest)."""
    roles = passes.select(
        "photo_id", "turn", "mask_sha256", F.explode("masks").alias("role", "mask")
    )
    joined = roles.join(digests, "mask", "left")
    expected = F.try_element_at("mask_sha256", F.col("role"))
    return joined.select(
        "photo_id",
        "turn",
        "role",
        F.when(F.col("digest").isNull(), "mask_unreadable")
        .when(expected.isNull(), "mask_hash_missing")
        .when(expected != F.col("digest"), "mask_hash_mismatch")
        .alias("code"),
    )


def with_usable(scenes: DataFrame) -> DataFrame:
    """Adds `usable`: no error, a readable mask, and approved."""
    return scenes.withColumn(
        "usable",
        (F.col("errors") == 0) & F.col("mask_readable") & (F.col("status") == "approved"),
    )


def annotated_scenes(passes: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations with their photo, annotations without one)."""
    return (
        passes.join(photos, "photo_id"),
        passes.join(photos.select("photo_id"), "photo_id", "left_anti"),
    )


def pass_rank() -> list[Column]:
    """Unlabelled first, then A, then by label."""
    label = F.col("pass_label")
    return [
        F.when(label.isNull(), 0).when(label == "A", 1).otherwise(2),
        F.coalesce(label, F.lit("")),
    ]


def primary_pass(passes: DataFrame) -> DataFrame:
    """One pass per photo. Spark limits each task to one row per photo first."""
    order = Window.partitionBy("photo_id").orderBy(*pass_rank())
    return passes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def pass_pairs(passes: DataFrame, payload: list[str]) -> DataFrame:
    """First two passes by label of every photo that has two.

    Gives photo_id and each payload column as first_* and second_*.
    """
    order = Window.partitionBy("photo_id").orderBy(F.coalesce("pass_label", F.lit("")))
    top = passes.withColumn("_k", F.row_number().over(order)).where("_k <= 2")

    def at(k: int, column: str, alias: str) -> Column:
        return F.max(F.when(F.col("_k") == k, F.col(column))).alias(alias)

    picks = [at(1, c, f"first_{c}") for c in payload] + [at(2, c, f"second_{c}") for c in payload]
    return (
        top.groupBy("photo_id")
        .agg(F.max("_k").alias("_seen"), *picks)
        .where("_seen = 2")
        .drop("_seen")
    )


def promote_status(
    passes: DataFrame, decisions: DataFrame, digests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(promoted passes with before/after, refusals).

    decisions: photo_id, turn, new_status, new_reviewer. digests: mask, digest.
    Only the status and the review change.
    """
    asked = passes.join(decisions, ["photo_id", "turn"]).join(digests, "mask", "left")
    judged = asked.withColumn(
        "refusal",
        F.when(F.col("new_status") == "draft", "demotion")
        .when(~F.col("digest").eqNullSafe(F.col("mask_digest")), "mask_hash_mismatch")
        .when(F.col("new_reviewer").isNull(), "review_missing"),
    )
    done = judged.where(F.col("refusal").isNull()).select(
        "photo_id",
        "turn",
        "annotator",
        "pass_label",
        F.concat_ws(" -> ", "status", "new_status").alias("change"),
        F.col("new_status").alias("status"),
        F.col("new_reviewer").alias("reviewer"),
        (F.col("annotator") != F.col("new_reviewer")).alias("independent"),
    )
    return done, judged.where(F.col("refusal").isNotNull()).select("photo_id", "turn", "refusal")


def campaign_progress(passes: DataFrame, expected: DataFrame, labels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(one summary row, the missing photo/pass couples)."""
    wanted = expected.select(
        "photo_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("pass_label")
    )
    present = passes.select("photo_id", "pass_label").where(F.col("pass_label").isNotNull()).distinct()
    marked = wanted.join(present.withColumn("_here", F.lit(1)), ["photo_id", "pass_label"], "left")
    summary = marked.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_here").alias("collected"),
    ).withColumn("missing", F.col("expected") - F.col("collected")).withColumn(
        "complete", F.col("missing") == 0
    )
    return summary, missing_passes(expected, passes, labels)


def missing_passes(expected: DataFrame, passes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    wanted = expected.select(
        "photo_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("pass_label")
    )
    present = passes.select("photo_id", "pass_label")
    return wanted.join(present, ["photo_id", "pass_label"], "left_anti")


# --- reports --------------------------------------------------------------


def corpus_counts(scenes: DataFrame) -> DataFrame:
    """Scenes, photos, findings and review counts of a corpus, one row.

    scenes: photo_id, status, annotator, reviewer, usable, errors, warnings (numbers of
    findings) and exclusions (array of structs with thin).
    """
    named = F.col("reviewer").isNotNull()
    own = F.col("reviewer") == F.col("annotator")
    thin = F.size(F.filter(F.coalesce("exclusions", F.array()), lambda e: e["thin"]))
    per_photo = scenes.groupBy("photo_id").agg(
        F.count(F.lit(1)).alias("passes"),
        count_where(F.coalesce("usable", F.lit(False))).alias("usable"),
        count_where(F.coalesce("errors", F.lit(0)) > 0).alias("with_errors"),
        count_where(F.coalesce("warnings", F.lit(0)) > 0).alias("with_warnings"),
        F.sum(thin).cast("bigint").alias("thin_exclusions"),
        count_where((F.col("status") == "approved") & own).alias("self_approved"),
        count_where(named & ~own).alias("independently_reviewed"),
    )
    sums = ("usable", "with_errors", "with_warnings", "thin_exclusions", "self_approved", "independently_reviewed")
    return per_photo.agg(
        F.sum("passes").alias("scenes"),
        F.count(F.lit(1)).alias("photos"),
        *[F.sum(c).alias(c) for c in sums],
        count_where(F.col("passes") > 1).alias("doubly_annotated"),
    )


def counts_over(df: DataFrame, column: str, vocabulary: tuple[str, ...], alias: str) -> DataFrame:
    """Count per vocabulary entry, zero rows kept."""
    spark = df.sparkSession
    entries = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in vocabulary])).alias(alias))
    seen = df.groupBy(F.col(column).alias(alias)).agg(F.count(F.lit(1)).alias("_n"))
    return entries.join(seen, alias, "left").select(alias, F.coalesce("_n", F.lit(0)).alias("items"))


def with_total_seconds(passes: DataFrame) -> DataFrame:
    """total_seconds; null where the annotation carries no timing."""
    corrections = F.col("corrections_seconds") if "corrections_seconds" in passes.columns else F.lit(0.0)
    return passes.withColumn(
        "total_seconds",
        F.when(
            F.col("first_pass_seconds").isNotNull(),
            F.col("first_pass_seconds") + corrections + F.coalesce("review_seconds", F.lit(0.0)),
        ),
    )


def duration_stats(passes: DataFrame) -> DataFrame:
    """counted/mean/median/min/max of the three durations of timed passes."""
    timed = with_total_seconds(passes).where(F.col("total_seconds").isNotNull())
    long = timed.select(
        F.explode(
            F.array(
                _named("total_seconds", F.col("total_seconds")),
                _named("first_pass_seconds", F.col("first_pass_seconds")),
                _named("review_seconds", F.when(F.col("review_seconds") > 0, F.col("review_seconds"))),
            )
        ).alias("m")
    ).select("m.metric", "m.value")
    return describe(long, ["metric"], "value", 1)


def durations_by_difficulty(scenes: DataFrame) -> DataFrame:
    timed = with_total_seconds(scenes).where(F.col("total_seconds").isNotNull())
    return timed.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("scenes"),
        fixed(F.avg("total_seconds"), 1).alias("mean_total_seconds"),
    )


def _named(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))


# --- crops over described geometry -----------------------------------------


def crop_boxes(
    shapes: DataFrame, keys: list[str], width: int, height: int, margin: float = 0.35,
    smallest: float = 90.0,
) -> DataFrame:
    """Square box around x0..x1, y0..y1 (normalised) of each group, kept in frame."""
    spread = shapes.groupBy(*keys).agg(
        (F.min("x0") * (width - 1)).alias("l"),
        (F.max("x1") * (width - 1)).alias("r"),
        (F.min("y0") * (height - 1)).alias("t"),
        (F.max("y1") * (height - 1)).alias("b"),
    )
    wide = F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t"), F.lit(smallest))
    side = F.least(wide * (1 + 2 * margin), F.lit(float(min(width, height))))
    left = clip((F.col("l") + F.col("r")) / 2 - side / 2, 0.0, F.lit(float(width)) - side)
    top = clip((F.col("t") + F.col("b")) / 2 - side / 2, 0.0, F.lit(float(height)) - side)
    return spread.select(
        *keys,
        F.rint(left).cast("bigint").alias("left"),
        F.rint(top).cast("bigint").alias("top"),
        F.rint(side).cast("bigint").alias("side"),
    )


def select_shapes(shapes: DataFrame, group: str, kind: str, key: str, order: str, mode: str) -> DataFrame:
    """Shapes of one kind per group: first, union, thin, or idx:0,2."""
    picked = shapes.where(F.col(kind) == key)
    if mode == "union":
        return picked
    if mode == "thin":
        return picked.where(F.col("thin"))
    along = Window.partitionBy(group).orderBy(order)
    if mode.startswith("idx:"):
        wanted = [int(i) for i in mode[4:].split(",")]
        rank = F.row_number().over(along) - 1
        limited = picked.withColumn("_i", rank).where(F.col("_i") <= max(wanted))
        return limited.where(F.col("_i").isin(wanted)).drop("_i")
    return picked.withColumn("_i", F.row_number().over(along)).where("_i = 1").drop("_i")


# --- draw files to annotations ---------------------------------------------


def import_exclusions(draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holes with their role and note; unknown when not given, quarantine when invalid."""
    d = F.col("draw")
    holes = F.coalesce(d["floorHoles"], F.array())
    listed = draws.select(
        *[c for c in draws.columns if c != "draw"],
        F.posexplode(F.arrays_zip(holes.alias("polygon"))).alias("k", "hole"),
        d["floorHoleRoles"].alias("roles"),
        d["floorHoleNotes"].alias("notes"),
    )
    given = F.nullif(F.get("roles", F.col("k")), F.lit(""))
    out = listed.select(
        *[c for c in draws.columns if c != "draw"],
        F.col("k").cast("bigint").alias("k"),
        F.coalesce(given, F.lit("unknown")).alias("role"),
        F.nullif(F.get("notes", F.col("k")), F.lit("")).alias("note"),
        F.col("hole.polygon").alias("polygon"),
    )
    known = one_of(F.col("role"), V.EXCLUSION_ROLES)
    return out.where(known), out.where(~known)


def assemble_annotation(
    draws: DataFrame,
    photos: DataFrame,
    annotator: str,
    status: str = "draft",
    reviewer: str | None = None,
    pass_label: str | None = None,
    independent: bool = False,
    revision: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Draws joined to their photo; unknown photos and wrong sizes are set aside.

    photos: photo_id, frame_width, frame_height. The annotation keeps the drawn outlines,
    its holes as exclusions with role and note, boundary and uncertain zones, and names the
    masks that are rasterised from them; there is an uncertain mask only with such zones.
    """
    flat = draws.select(
        *[c for c in draws.columns if c != "draw"],
        F.col("draw.photoId").alias("photo_id"),
        F.col("draw.width").alias("width"),
        F.col("draw.height").alias("height"),
        F.coalesce(
            F.lit(pass_label).cast("string"), F.nullif(F.trim("draw.passLabel"), F.lit(""))
        ).alias("pass_label"),
        F.col("draw.drawSeconds").alias("first_pass_seconds"),
        F.col("draw.notes").alias("notes"),
        F.col("draw.floorPolygons").alias("floor_polygons"),
        F.coalesce("draw.floorHoles", F.array()).alias("floor_holes"),
        _drawn_exclusions().alias("exclusions"),
        F.coalesce("draw.boundary", F.array()).alias("boundary"),
        F.coalesce("draw.uncertainZones", F.array()).alias("uncertain_zones"),
    )
    joined = flat.join(photos, "photo_id", "left").withColumn(
        "refusal",
        F.when(F.col("frame_width").isNull(), "photo_not_in_manifest").when(
            (F.col("frame_width") != F.col("width")) | (F.col("frame_height") != F.col("height")),
            "dimensions_mismatch",
        ),
    )
    review = None if status == "draft" else (reviewer or annotator)
    kept = joined.where(F.col("refusal").isNull()).drop("refusal", "frame_width", "frame_height")
    done = (
        kept.withColumn("annotator", F.lit(annotator))
        .withColumn("status", F.lit(status))
        .withColumn("reviewer", F.lit(review).cast("string"))
        .withColumn("independent_pass", F.lit(independent))
        .withColumn("revision", F.lit(revision).cast("bigint"))
        .withColumn("masks", _mask_names())
    )
    return done, joined.where(F.col("refusal").isNotNull())


def _drawn_exclusions() -> Column:
    """The holes of a draw with their role (unknown if not given) and note."""
    given = lambda names, k: F.nullif(F.get(F.coalesce(names, F.array()), k), F.lit(""))
    roles, notes = F.col("draw.floorHoleRoles"), F.col("draw.floorHoleNotes")
    return F.transform(
        F.coalesce("draw.floorHoles", F.array()),
        lambda hole, k: F.struct(
            F.coalesce(given(roles, k), F.lit("unknown")).alias("role"), hole.alias("polygon"), given(notes, k).alias("note")
        ),
    )


def _mask_names() -> Column:
    stem = F.concat(F.lit("masks/"), "photo_id", F.coalesce(F.concat(F.lit("."), "pass_label"), F.lit("")))
    floor = F.create_map(F.lit("floorVisible"), F.concat(stem, F.lit(".floor-visible.png")))
    unsure = F.create_map(F.lit("uncertain"), F.concat(stem, F.lit(".uncertain.png")))
    return F.when(F.size("uncertain_zones") > 0, F.map_concat(floor, unsure)).otherwise(floor)


def review_readiness(
    passes: DataFrame, overlaps: DataFrame, painted: DataFrame, digests: DataFrame, annotator: str, label: str
) -> DataFrame:
    """Eight booleans per pass that have to hold before a person looks at it.

    passes: photo_id, turn, width, height, frame_width, frame_height, status,
    annotator, pass_label, unknown_roles, mask, mask_digest, and of an uncertain mask, where
    there is one, uncertain_mask, uncertain_digest, uncertain_width and uncertain_height,
    which have to hold as those of the floor. overlaps: photo_id, turn, shared (floor and
    uncertain pixels). painted: photo_id, turn of passes
    whose floor reaches the core of an exclusion.
    """
    hit = painted.select("photo_id", "turn").distinct().withColumn("_hit", F.lit(True))
    joined = (
        passes.join(overlaps, ["photo_id", "turn"], "left")
        .join(hit, ["photo_id", "turn"], "left")
        .join(digests, "mask", "left")
    )
    sizes = (F.col("width") == F.col("frame_width")) & (F.col("height") == F.col("frame_height"))
    unchanged = F.col("digest").eqNullSafe(F.col("mask_digest"))
    if "uncertain_mask" in passes.columns:
        theirs = digests.select(F.col("mask").alias("uncertain_mask"), F.col("digest").alias("_uncertain"))
        joined = joined.join(theirs, "uncertain_mask", "left")
        none = F.col("uncertain_mask").isNull()
        same = (F.col("uncertain_width") == F.col("width")) & (F.col("uncertain_height") == F.col("height"))
        sizes = sizes & (none | F.coalesce(same, F.lit(False)))
        unchanged = unchanged & (none | F.col("_uncertain").eqNullSafe(F.col("uncertain_digest")))
    return joined.select(
        "photo_id",
        "turn",
        sizes.alias("sizes_match"),
        (F.coalesce("shared", F.lit(0)) == 0).alias("floor_and_uncertain_disjoint"),
        F.col("_hit").isNull().alias("exclusions_clear"),
        (F.col("unknown_roles") == 0).alias("roles_kept"),
        unchanged.alias("mask_unchanged"),
        (F.col("status") == "draft").alias("is_draft"),
        (F.col("annotator") == annotator).alias("expected_annotator"),
        F.col("pass_label").eqNullSafe(F.lit(label)).alias("label_kept"),
    )
