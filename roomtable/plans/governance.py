"""Queries over manifests, annotations and campaigns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roomtable.functions.numbers import piped
from roomtable.functions.settings import DEFAULTS
from roomtable.functions.vocabulary import EXCLUSION_ROLES, GOLDEN_CASES, STATUSES
from roomtable.operators import changes as C
from roomtable.operators import governance as G
from roomtable.plans.registry import query, r
from roomtable.sources.annotations import (
    annotation_lines,
    parse_annotation_lines,
    parse_draws,
    text_hash,
)
from roomtable.sources.manifest import manifest_lines, parse_photo_lines, photo_struct, read_manifest
from roomtable.sources.reports import stamp_config
from roomtable.session import shared_folder

DRAW_TAG = "draw@1"


def files_on_disk(fx):
    """Stand-in for the file listing: unlicensed photos were never fetched."""
    return fx.photo.where(F.col("license") != "").select("file", "digest")


_FILES = "(SELECT file, digest FROM photo WHERE license <> '')"


#: every member of a photo, from the columns of the view
_FULL = """photo_id, file, difficulty, source, 'https://example.org/' || photo_id AS source_url, CASE WHEN photo_id % 3 = 0 THEN NULL ELSE 'author ' || source END AS author,
  license, CASE WHEN photo_id % 2 = 0 THEN CAST('2024-01-31' AS DATE) END AS verified_on, redistributable, usage, expected_digest,
  'a "quoted" }] note\\\\' AS provenance_note, graded, photo_id % 7 = 0 AS truth_available, split, golden_case, CASE WHEN photo_id % 5 = 0 THEN '{[' || source END AS notes"""
_SHOWN = (
    "photo_id", "file", "difficulty", "source", "source_url", "author", "license", "verified_on", "redistributable", "usage",
    "expected_digest", "provenance_note", "graded", "truth_available", "split", "golden_case", "notes",
)


def full_photos(fx):
    shown = fx.photo.selectExpr(*[f"{x}" for x in _split_list(_FULL)])
    traits = F.expr("filter(array(if(photo_id % 2 = 0, 'rug', NULL), if(photo_id % 3 = 0, 'tiles', NULL)), x -> x IS NOT NULL)")
    lens = F.expr("if(photo_id % 4 = 0, map('k1', cast(photo_id / 100 AS string), 'provenance', 'measured'), NULL)")
    return shown.withColumns({"traits": traits, "expected_issues": F.array(F.lit("image_blurry")), "truth_lens": lens})


def _split_list(text):
    """Items of a select list; commas inside brackets or quotes do not part."""
    out, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[start:k].strip())
                start = k + 1
    return [*out, text[start:].strip()]


_PHOTO_SQL = f"""SELECT CAST(photo_id AS VARCHAR) AS photo_id, * EXCLUDE (photo_id, verified_on), CAST(verified_on AS VARCHAR) AS verified_on,
    concat_ws('|', CASE WHEN photo_id % 2 = 0 THEN 'rug' END, CASE WHEN photo_id % 3 = 0 THEN 'tiles' END) AS traits,
    'image_blurry' AS expected_issues, CASE WHEN photo_id % 4 = 0 THEN photo_id / 100 END AS truth_k1
    FROM (SELECT {_FULL.replace(chr(92) * 2, chr(92))} FROM photo)"""


def _photo_rows(photos):
    return photos.select(
        *[c for c in _SHOWN if c != "verified_on"], F.col("verified_on").cast("string").alias("verified_on"),
        F.array_join("traits", "|").alias("traits"), F.array_join("expected_issues", "|").alias("expected_issues"), "truth_k1",
    )


@query("manifest_photos", "S1", _PHOTO_SQL)
def manifest_photos(fx):
    """The photos as documents of up to 500 each, read in splits."""
    path = f"{shared_folder(fx.spark)}/manifest-{uuid.uuid4().hex}"
    lines = full_photos(fx).select(F.expr("cast(photo_id div 500 AS int)").alias("part"), F.to_json(photo_struct([*_SHOWN, "traits", "expected_issues", "truth_lens"])).alias("value"))
    head = '{"schema": "dataset@1", "history": [{"photos": [{"id": "not one"}]}, {}], "note": "a } in \\"text\\"", "photos": ['
    documents = lines.groupBy("part").agg(F.concat(F.lit(head), F.array_join(F.collect_list("value"), ",\n"), F.lit("]}")).alias("value"))
    documents.repartition("part").write.partitionBy("part").text(path)
    return _photo_rows(read_manifest(fx.spark, path))


@query(
    "annotation_records",
    "S2",
    """SELECT CAST(photo_id AS VARCHAR) AS photo_id, CAST(64 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, annotator, '2024-03-01' AS annotated_on,
    status, reviewer, CASE WHEN reviewer IS NOT NULL THEN turn % 2 = 0 END AS corrected, CASE WHEN reviewer IS NOT NULL THEN 'seen' END AS review_note,
    pass_label, independent_pass, turn + 1 AS revision, first_pass_seconds, CASE WHEN first_pass_seconds IS NULL THEN NULL ELSE review_seconds END AS review_seconds,
    CASE WHEN first_pass_seconds IS NOT NULL THEN turn END AS correction_count, 'masks/' || vec_id || '.png' AS floor_mask,
    CASE WHEN turn % 3 = 0 THEN 'masks/' || vec_id || '.u.png' END AS uncertain_mask, sha256(vec_id::VARCHAR) AS floor_sha256,
    'wall_floor:2' AS boundary, CASE WHEN turn % 2 = 1 THEN 'occluder:3' ELSE '' END AS exclusions FROM pass""",
)
def annotation_records(fx):
    """Written as JSON lines, read, written and read again."""
    once = parse_annotation_lines(annotation_lines(full_annotations(fx)))
    rows = parse_annotation_lines(annotation_lines(once))
    listed = lambda c, kind, outline: F.expr(f"array_join(transform({c}, x -> x.{kind} || ':' || size(x.{outline})), '|') AS {c}")
    return rows.select(
        "photo_id", "width", "height", "annotator", F.col("annotated_on").cast("string").alias("annotated_on"), "status", "reviewer",
        "corrected", "review_note", "pass_label", "independent_pass", "revision", "first_pass_seconds", "review_seconds", "correction_count",
        F.col("masks.floorVisible").alias("floor_mask"), F.col("masks.uncertain").alias("uncertain_mask"),
        F.col("mask_sha256.floorVisible").alias("floor_sha256"), listed("boundary", "kind", "points"), listed("exclusions", "role", "polygon"),
    )


def full_annotations(fx):
    """The passes as annotations with all of their members."""
    point = "named_struct('x', 0.1D, 'y', 0.2D)"
    named = "first_pass_seconds IS NOT NULL"
    return fx.view("pass").selectExpr(
        "'annotation@1' AS schema", "cast(photo_id AS string) AS photo_id", "64L AS width", "8L AS height",
        "map_filter(map('floorVisible', 'masks/' || vec_id || '.png', 'uncertain', if(turn % 3 = 0, 'masks/' || vec_id || '.u.png', NULL)), (k, v) -> v IS NOT NULL) AS masks",
        f"array(named_struct('kind', 'wall_floor', 'points', array({point}, {point}), 'note', cast(NULL AS string))) AS boundary",
        f"cast(array() AS array<struct<reason: string, polygon: array<struct<x: double, y: double>>, note: string>>) AS uncertain_zones",
        f"if(turn % 2 = 1, array(named_struct('role', 'occluder', 'polygon', array({point}, {point}, {point}), 'thin', true, 'note', 'a note')), array()) AS exclusions",
        "annotator", "date'2024-03-01' AS annotated_on", "cast(turn AS bigint) + 1 AS revision", "status", "reviewer",
        "if(reviewer IS NOT NULL, date'2024-03-02', NULL) AS reviewed_on", "if(reviewer IS NOT NULL, turn % 2 = 0, NULL) AS corrected",
        "if(reviewer IS NOT NULL, 'seen', NULL) AS review_note", "pass_label", "independent_pass", "first_pass_seconds",
        f"if({named}, 0D, NULL) AS corrections_seconds", f"if({named}, review_seconds, NULL) AS review_seconds",
        f"if({named}, cast(turn AS bigint), NULL) AS correction_count", "map('floorVisible', sha2(cast(vec_id AS string), 256)) AS mask_sha256",
        "cast(NULL AS string) AS notes",
    )


_DRAW_PROBLEMS = """concat_ws('|',
    CASE WHEN json_extract_string(body, '$.schema') IS DISTINCT FROM 'draw@1' THEN 'wrong_schema' END,
    CASE WHEN json_extract(body, '$.photoId') IS NULL THEN 'missing_photoId' END,
    CASE WHEN json_extract(body, '$.width') IS NULL THEN 'missing_width' END,
    CASE WHEN json_extract(body, '$.height') IS NULL THEN 'missing_height' END,
    CASE WHEN json_extract(body, '$.floorPolygons') IS NULL THEN 'missing_floorPolygons' END,
    CASE WHEN json_array_length(body, '$.floorPolygons') = 0 THEN 'no_floor_polygon' END)"""


@query(
    "draw_files",
    "S3",
    f"""SELECT draw_id, {_DRAW_PROBLEMS} AS problems,
    CASE WHEN {_DRAW_PROBLEMS} = '' THEN json_extract_string(body, '$.photoId') END AS photo_id,
    CASE WHEN {_DRAW_PROBLEMS} = '' THEN CAST(json_extract(body, '$.drawSeconds') AS DOUBLE) END
    AS draw_seconds, CASE WHEN {_DRAW_PROBLEMS} = '' THEN CASE WHEN draw_id % 3 = 0 THEN 'reflection' ELSE '' END END AS reasons,
    CASE WHEN {_DRAW_PROBLEMS} = '' THEN 'wall_floor' END AS boundary FROM draw""",
)
def draw_files(fx):
    good, bad = parse_draws(fx.draw, DRAW_TAG)
    return good.select(
        "draw_id",
        F.lit("").alias("problems"),
        F.col("draw.photoId").alias("photo_id"),
        F.col("draw.drawSeconds").alias("draw_seconds"),
        F.array_join("draw.uncertainZones.reason", "|").alias("reasons"),
        F.array_join("draw.boundary.kind", "|").alias("boundary"),
    ).unionByName(
        bad.select("draw_id", F.array_join("problems", "|").alias("problems")),
        allowMissingColumns=True,
    )


@query(
    "content_digests",
    "S4",
    "SELECT doc_id AS photo_id, sha256(text) AS digest FROM documents",
)
def content_digests(fx):
    return text_hash(fx.documents, "text").select(F.col("doc_id").alias("photo_id"), "digest")


@query(
    "bench_cases",
    "S5",
    f"""SELECT CAST(photo_id AS VARCHAR) AS case_id, difficulty, graded, 'manifest' AS origin
    FROM photo WHERE file IN (SELECT file FROM {_FILES})
    UNION ALL SELECT 'generated-' || CAST(item_id AS VARCHAR), 'easy', true, 'generated' FROM benchmark
    UNION ALL SELECT CAST(photo_id AS VARCHAR), difficulty, graded, 'skipped' FROM photo
    WHERE file NOT IN (SELECT file FROM {_FILES})""",
)
def bench_cases(fx):
    generated = fx.benchmark.select(
        F.concat(F.lit("generated-"), F.col("item_id")).alias("photo_id"),
        F.lit("easy").alias("difficulty"),
        F.lit(True).alias("graded"),
    )
    photos = fx.photo.withColumn("photo_id", F.col("photo_id").cast("string"))
    cases, skipped = G.unify_cases(generated, photos, files_on_disk(fx))
    columns = [F.col("photo_id").alias("case_id"), "difficulty", "graded", "origin"]
    return cases.select(*columns).unionByName(
        skipped.withColumn("origin", F.lit("skipped")).select(*columns)
    )


@query(
    "photo_registration",
    "S7",
    """WITH incoming AS (SELECT photo_id, file, license, redistributable, difficulty, split,
      2 AS seq FROM photo WHERE graded),
    judged AS (SELECT *, CASE WHEN redistributable AND starts_with(file, 'private-real/')
      THEN 'shared_in_private_folder' WHEN NOT redistributable AND starts_with(file, 'public/')
      THEN 'private_in_public_folder' WHEN license IS NULL THEN 'license_missing' END AS refusal
      FROM incoming),
    merged AS (SELECT photo_id, file, 'medium' AS difficulty, 1 AS seq FROM photo
      UNION ALL SELECT photo_id, file, difficulty, seq FROM judged WHERE refusal IS NULL)
    SELECT photo_id, file, arg_max(difficulty, seq) AS difficulty, CAST(max(seq) AS BIGINT) AS seq,
      NULL AS refusal FROM merged GROUP BY photo_id, file
    UNION ALL SELECT photo_id, file, difficulty, CAST(seq AS BIGINT), refusal FROM judged
      WHERE refusal IS NOT NULL""",
)
def photo_registration(fx):
    current = fx.photo.withColumn("seq", F.lit(1)).withColumn("difficulty", F.lit("medium"))
    incoming = fx.photo.where("graded").withColumn("seq", F.lit(2))
    merged, refused = G.register_photo(current, incoming, "seq")
    columns = ["photo_id", "file", "difficulty", F.col("seq").cast("bigint").alias("seq")]
    return merged.select(*columns, F.lit(None).cast("string").alias("refusal")).unionByName(
        refused.select(*columns, "refusal")
    )


@query("manifest_export", "S10", _PHOTO_SQL)
def manifest_export(fx):
    """Exported and read twice: nothing is lost on the way."""
    once = parse_photo_lines(manifest_lines(full_photos(fx)))
    return _photo_rows(parse_photo_lines(manifest_lines(once)))


def _sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


@query(
    "photo_rules",
    "P1",
    f"""SELECT photo_id, concat_ws('|',
    CASE WHEN split <> 'golden_holdout' AND golden_case IS NOT NULL THEN 'case_outside_golden' END,
    CASE WHEN split = 'golden_holdout' AND difficulty = 'rejected' THEN 'golden_rejected' END,
    CASE WHEN split = 'golden_holdout' AND golden_case IS NULL THEN 'golden_without_case' END,
    CASE WHEN golden_case NOT IN ({_sql_list(GOLDEN_CASES)}) THEN 'unknown_golden_case' END) AS issues
    FROM photo""",
)
def photo_rules(fx):
    return G.validate_photo(fx.photo).select("photo_id", piped(F.col("issues")).alias("issues"))


@query(
    "annotation_rules",
    "P2",
    f"""SELECT photo_id, turn, concat_ws('|',
    CASE WHEN turn % 4 = 3 THEN 'boundary_too_short' END,
    CASE WHEN turn % 6 = 5 THEN 'boundary_unknown_kind' END,
    CASE WHEN status = 'draft' AND reviewer IS NOT NULL THEN 'draft_with_review' END,
    CASE WHEN photo_id % 11 = 0 THEN 'exclusions_not_finite' END,
    CASE WHEN photo_id % 9 = 4 THEN 'exclusions_unknown_role' END,
    CASE WHEN first_pass_seconds < 0 OR review_seconds < 0 THEN 'negative_duration' END,
    CASE WHEN status <> 'draft' AND reviewer IS NULL THEN 'review_missing' END,
    CASE WHEN turn % 5 = 0 THEN 'revision_below_one' END,
    CASE WHEN photo_id % 13 = 0 THEN 'uncertain_zones_unknown_reason' END,
    CASE WHEN status NOT IN ({_sql_list(STATUSES)}) THEN 'unknown_status' END) AS issues FROM pass""",
)
def annotation_rules(fx):
    point = "named_struct('x', {x}, 'y', 0.2D)"
    inside = point.format(x="0.1D")
    far = point.format(x="if(photo_id % 11 = 0, double('infinity'), 0.4D)")
    passes = fx.view("pass").selectExpr(
        "*",
        "cast(turn % 5 AS bigint) AS revision",
        f"array(named_struct('kind', if(turn % 6 = 5, 'unheard', 'wall_floor'), 'points', if(turn % 4 = 3, array({inside}), array({inside}, {inside})))) AS boundary",
        f"array(named_struct('role', if(photo_id % 9 = 4, 'unheard', 'occluder'), 'polygon', array({inside}, {inside}, {far}))) AS exclusions",
        f"if(photo_id % 13 = 0, array(named_struct('reason', cast(NULL AS string), 'polygon', array({inside}, {inside}, {inside}))), array()) AS uncertain_zones",
    )
    return G.validate_annotation(passes).select(
        "photo_id", "turn", piped(F.col("issues")).alias("issues")
    )


#: two revisions of each photo's exclusion: corners move, a corner goes, or nothing changes
_REVISED = "CASE WHEN photo_id % 7 = 3 THEN 3 ELSE 2 END"


def revisions(fx):
    corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    outline = f"array({corner('x0', 'y0')}, {corner('x1', 'y0')}, {corner('x1', 'y1')}, {corner('x0', 'y1')})"
    moved = f"array({corner('x0', 'y0')}, {corner('x1 + 0.25D', 'y0')}, {corner('x1 + 0.25D', 'y1')}, {corner('x0', 'y1')})"
    base = "photo_id, role, {0} AS outline, {1} AS revision, photo_id % 2 = 0 AS corrected, if(photo_id % 5 = 0, NULL, 'reader') AS reviewer"
    first = fx.exclusion.selectExpr(*_split_list(base.format(outline, "1L")))
    later = f"CASE photo_id % 3 WHEN 0 THEN {moved} WHEN 1 THEN slice({outline}, 1, 3) ELSE {outline} END"
    second = fx.exclusion.selectExpr(*_split_list(base.format(later, f"cast({_REVISED} AS bigint)")))
    none = "cast(array() AS array<struct<kind: string>>)"
    return first.unionByName(second).selectExpr(
        "photo_id", "revision", "corrected", "reviewer", f"{none} AS boundary", f"{none} AS uncertain_zones",
        "array(named_struct('role', role, 'polygon', outline)) AS exclusions", "map('floorVisible', 'same') AS mask_sha256",
    )


@query(
    "revision_changes",
    "P2 P24",
    f"""SELECT photo_id, {_REVISED}::BIGINT AS revision, 'exclusions[0].polygon[' || i || '].x' AS path, 'changed' AS kind FROM exclusion, range(1, 3) t(i) WHERE photo_id % 3 = 0
    UNION ALL SELECT photo_id, {_REVISED}, 'exclusions[0].polygon[3].' || c, 'removed' FROM exclusion, (VALUES ('x'), ('y')) t(c) WHERE photo_id % 3 = 1""",
)
def revision_changes(fx):
    return C.revision_changes(revisions(fx), ["photo_id"]).select("photo_id", "revision", "path", "kind")


@query(
    "correction_checks",
    "P2 P24",
    f"""SELECT photo_id, 1::BIGINT AS revision, 0::BIGINT AS changed, '' AS issues FROM exclusion
    UNION ALL SELECT photo_id, {_REVISED}, n, concat_ws('|', CASE WHEN photo_id % 7 = 3 THEN 'revision_skipped' END,
      CASE WHEN photo_id % 2 = 0 AND n = 0 THEN 'corrected_without_change' END,
      CASE WHEN photo_id % 5 <> 0 AND photo_id % 2 = 1 AND n > 0 THEN 'change_without_correction' END)
    FROM (SELECT photo_id, CASE WHEN photo_id % 3 = 2 THEN 0 ELSE 2 END AS n FROM exclusion)""",
)
def correction_checks(fx):
    checked = C.check_corrections(revisions(fx), ["photo_id"])
    return checked.select("photo_id", "revision", "changed", F.array_join("issues", "|").alias("issues"))


@query(
    "provenance_issues",
    "P3",
    """SELECT photo_id, concat_ws('|',
    CASE WHEN redistributable AND starts_with(lower(trim(license)), 'inconnu') THEN 'license_unverified' END,
    CASE WHEN lower(trim(license)) IN ('', '?', 'tbd', 'à vérifier') THEN 'provenance_incomplete' END,
    CASE WHEN redistributable AND usage <> 'redistributable' THEN 'provenance_incomplete' END) AS issues
    FROM photo""",
)
def provenance_issues(fx):
    return G.check_provenance(fx.photo).select("photo_id", piped(F.col("issues")).alias("issues"))


@query(
    "image_file_check",
    "P4",
    f"""SELECT p.photo_id, CASE WHEN f.file IS NULL THEN 'image_file_missing'
    WHEN p.expected_digest IS NULL THEN 'image_hash_missing'
    WHEN p.expected_digest <> f.digest THEN 'image_hash_mismatch' END AS code,
    CASE WHEN f.file IS NULL THEN 'error' WHEN p.expected_digest IS NULL THEN 'warning'
    WHEN p.expected_digest <> f.digest THEN 'error' END AS level
    FROM photo p LEFT JOIN {_FILES} f ON p.file = f.file""",
)
def image_file_check(fx):
    return G.check_image_file(fx.photo, files_on_disk(fx)).select("photo_id", "code", "level")


@query(
    "manifest_file_problems",
    "P9",
    f"""WITH present AS (SELECT p.*, f.digest AS actual,
      lag(p.photo_id) OVER (PARTITION BY f.digest ORDER BY p.photo_id) AS holder
      FROM photo p JOIN {_FILES} f ON p.file = f.file)
    SELECT photo_id, 'hash_drift' AS code, NULL AS other FROM present WHERE expected_digest <> actual
    UNION ALL SELECT photo_id, 'duplicate_bytes', CAST(holder AS VARCHAR) FROM present
      WHERE holder <> photo_id
    UNION ALL SELECT photo_id, 'shared_in_private_folder', NULL FROM present
      WHERE redistributable AND starts_with(file, 'private-real/')
    UNION ALL SELECT photo_id, 'private_in_public_folder', NULL FROM present
      WHERE NOT redistributable AND starts_with(file, 'public/')
    UNION ALL SELECT photo_id, 'file_missing', NULL FROM photo
      WHERE file NOT IN (SELECT file FROM {_FILES})""",
)
def manifest_file_problems(fx):
    return G.check_manifest_files(fx.photo, files_on_disk(fx))


def _mask_digests(fx):
    """Digest of every stored mask: the text of the embedding it is made from."""
    return fx.embeddings.select(
        F.col("vec_id").alias("mask"), F.sha2(F.col("vec_id").cast("string"), 256).alias("digest")
    )


@query(
    "mask_hash_check",
    "P5",
    """SELECT photo_id, turn, role, CASE WHEN e.vec_id IS NULL THEN 'mask_unreadable'
      WHEN expected IS NULL THEN 'mask_hash_missing'
      WHEN expected <> sha256(CAST(e.vec_id AS VARCHAR)) THEN 'mask_hash_mismatch' END AS code
    FROM (SELECT photo_id, turn, 'floorVisible' AS role, vec_id AS mask,
        CASE WHEN status = 'draft' THEN NULL ELSE sha256(CAST(vec_id AS VARCHAR)) END AS expected
        FROM pass
      UNION ALL SELECT photo_id, turn, 'uncertain', vec_id + turn * 100,
        sha256(CAST(vec_id AS VARCHAR)) FROM pass WHERE turn > 0) q
    LEFT JOIN embeddings e ON e.vec_id = q.mask""",
)
def mask_hash_check(fx):
    digest = F.sha2(F.col("vec_id").cast("string"), 256)
    masks = F.when(
        F.col("turn") > 0,
        F.create_map(
            F.lit("floorVisible"), F.col("vec_id"), F.lit("uncertain"), F.col("vec_id") + F.col("turn") * 100
        ),
    ).otherwise(F.create_map(F.lit("floorVisible"), F.col("vec_id")))
    hashes = F.when(
        F.col("status") == "draft", F.create_map(F.lit("uncertain"), digest)
    ).otherwise(F.create_map(F.lit("floorVisible"), digest, F.lit("uncertain"), digest))
    passes = fx.view("pass").withColumn("masks", masks).withColumn("mask_sha256", hashes)
    return G.check_mask_hash(passes, _mask_digests(fx))


@query(
    "status_check",
    "P7",
    """SELECT photo_id, turn, CASE WHEN status <> 'approved' THEN 'not_approved'
    WHEN reviewer = annotator THEN 'self_approved' END AS code FROM pass""",
)
def status_check(fx):
    return G.check_status(fx.view("pass")).select("photo_id", "turn", "code")


def scenes_with_errors(fx):
    """pass joined to photo, with the number of provenance errors and mask_readable."""
    scenes, _ = G.annotated_scenes(fx.view("pass"), fx.photo)
    checked = G.check_provenance(scenes).withColumn("errors", F.size("issues"))
    masks = fx.embeddings.select("vec_id", F.lit(True).alias("mask_readable"))
    joined = checked.join(masks, "vec_id", "left")
    return G.with_usable(joined.withColumn("mask_readable", F.coalesce("mask_readable", F.lit(False))))


_SCENES = """(SELECT s.*, p.difficulty, p.license, p.redistributable, p.usage,
  (lower(trim(p.license)) IN ('', '?', 'tbd', 'à vérifier'))::INT
  + (p.redistributable AND p.usage <> 'redistributable')::INT
  + (p.redistributable AND starts_with(lower(trim(p.license)), 'inconnu'))::INT AS errors,
  s.vec_id IN (SELECT vec_id FROM embeddings) AS mask_readable
  FROM pass s JOIN photo p USING (photo_id))"""


@query(
    "usable_scenes",
    "P8",
    f"""SELECT photo_id, turn, CAST(errors AS BIGINT) AS errors,
    errors = 0 AND mask_readable AND status = 'approved' AS usable FROM {_SCENES}""",
)
def usable_scenes(fx):
    return scenes_with_errors(fx).select(
        "photo_id", "turn", F.col("errors").cast("bigint").alias("errors"), "usable"
    )


@query(
    "status_promotions",
    "P10",
    """SELECT photo_id, turn, status || ' -> approved' AS change, annotator <> 'reviewer' AS independent,
      NULL AS refusal FROM pass WHERE status <> 'draft' AND vec_id IN (SELECT vec_id FROM embeddings)
      AND turn % 5 <> 4
    UNION ALL SELECT photo_id, turn, NULL, NULL, CASE WHEN status = 'draft' THEN 'demotion'
      ELSE 'mask_hash_mismatch' END FROM pass
      WHERE status = 'draft' OR turn % 5 = 4 OR vec_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def status_promotions(fx):
    drifted = F.when(F.col("turn") % 5 == 4, F.lit("drifted"))
    passes = fx.view("pass").withColumn("mask", F.col("vec_id")).withColumn(
        "mask_digest", F.coalesce(drifted, F.sha2(F.col("vec_id").cast("string"), 256))
    )
    decisions = fx.view("pass").select(
        "photo_id",
        "turn",
        F.when(F.col("status") == "draft", "draft").otherwise("approved").alias("new_status"),
        F.lit("reviewer").alias("new_reviewer"),
    )
    done, refused = G.promote_status(passes, decisions, _mask_digests(fx))
    return done.select("photo_id", "turn", "change", "independent").unionByName(
        refused, allowMissingColumns=True
    )


@query(
    "annotated_scenes",
    "J1",
    """SELECT a.photo_id, turn, difficulty, 'scene' AS kind FROM pass a JOIN photo p USING (photo_id)
    UNION ALL SELECT photo_id, turn, NULL, 'orphan' FROM pass
    WHERE photo_id NOT IN (SELECT photo_id FROM photo)""",
)
def annotated_scenes(fx):
    scenes, orphans = G.annotated_scenes(fx.view("pass"), fx.photo)
    return scenes.select("photo_id", "turn", "difficulty", F.lit("scene").alias("kind")).unionByName(
        orphans.select("photo_id", "turn", F.lit("orphan").alias("kind")), allowMissingColumns=True
    )


@query(
    "campaign_missing",
    "J3",
    """SELECT p.photo_id, l.pass_label FROM photo p, (VALUES ('A'), ('B')) l(pass_label)
    WHERE p.split = 'golden_holdout' AND NOT EXISTS (SELECT 1 FROM pass a
      WHERE a.photo_id = p.photo_id AND a.pass_label = l.pass_label)""",
)
def campaign_missing(fx):
    golden = fx.photo.where("split = 'golden_holdout'")
    return G.missing_passes(golden, fx.view("pass"), ("A", "B"))


@query(
    "campaign_progress",
    "A21",
    """WITH wanted AS (SELECT p.photo_id, l.pass_label FROM photo p, (VALUES ('A'), ('B')) l(pass_label)
      WHERE p.split = 'golden_holdout'),
    have AS (SELECT DISTINCT photo_id, pass_label FROM pass WHERE pass_label IS NOT NULL)
    SELECT count(*) AS expected, count(have.photo_id) AS collected,
    count(*) - count(have.photo_id) AS missing, count(*) = count(have.photo_id) AS complete
    FROM wanted LEFT JOIN have USING (photo_id, pass_label)""",
)
def campaign_progress(fx):
    golden = fx.photo.where("split = 'golden_holdout'")
    return G.campaign_progress(fx.view("pass"), golden, ("A", "B"))[0]


@query(
    "golden_case_coverage",
    "J4",
    f"""SELECT c.golden_case, count(photo_id) AS scenes,
    CAST(coalesce(sum((difficulty = 'easy')::INT), 0) AS BIGINT) AS easy_scenes, count(photo_id) = 0 AS missing
    FROM (VALUES {', '.join(f"('{c}')" for c in GOLDEN_CASES)}) c(golden_case)
    LEFT JOIN (SELECT * FROM photo WHERE split = 'golden_holdout') p USING (golden_case)
    GROUP BY c.golden_case""",
)
def golden_case_coverage(fx):
    return G.golden_coverage(fx.photo)


@query(
    "golden_balance",
    "A20",
    """SELECT count(*) AS scenes, CAST(coalesce(sum((difficulty = 'easy')::INT), 0) AS BIGINT) AS easy_scenes,
    count(*) > 0 AND coalesce(sum((difficulty = 'easy')::INT), 0) * 2 < count(*) AS majority_hard
    FROM photo WHERE split = 'golden_holdout'""",
)
def golden_balance(fx):
    return G.golden_balance(fx.photo)


@query(
    "golden_members",
    "A20 J4",
    """SELECT golden_case, photo_id FROM photo WHERE split = 'golden_holdout' AND golden_case IS NOT NULL""",
)
def golden_members(fx):
    return G.golden_members(fx.photo)


@query(
    "difficulty_histogram",
    "A25",
    "SELECT difficulty, count(*) AS items FROM photo GROUP BY difficulty",
)
def difficulty_histogram(fx):
    return G.count_by(fx.photo, "difficulty")


@query(
    "corpus_counts",
    "A15",
    """WITH p AS (SELECT *, (status = 'draft' AND reviewer IS NOT NULL) OR (status <> 'draft' AND reviewer IS NULL) AS wrong,
      reviewer = annotator AS own, turn % 4 = 1 AS thin FROM pass)
    SELECT count(*) AS scenes, count(DISTINCT photo_id) AS photos, count_if(NOT wrong AND status = 'approved' AND turn % 9 <> 8) AS usable,
    count_if(wrong) AS with_errors, count_if(coalesce(status = 'approved' AND own, false)) AS with_warnings,
    2 * count_if(thin) AS thin_exclusions, CAST(sum((status = 'approved' AND own)::INT) AS BIGINT) AS self_approved,
    CAST(sum((reviewer <> annotator)::INT) AS BIGINT) AS independently_reviewed,
    (SELECT count(*) FROM (SELECT photo_id FROM pass GROUP BY 1 HAVING count(*) > 1)) AS doubly_annotated
    FROM p""",
)
def corpus_counts(fx):
    checked = G.check_status(G.validate_annotation(fx.view("pass")))
    exclusion = F.struct(F.lit("occluder").alias("role"), (F.col("turn") % 4 == 1).alias("thin"))
    scenes = checked.select(
        "*",
        F.size("issues").alias("errors"),
        (F.col("code") == "self_approved").cast("int").alias("warnings"),
        (F.col("turn") % 9 != 8).alias("mask_readable"),
        F.array(exclusion, exclusion).alias("exclusions"),
    )
    return G.corpus_counts(G.with_usable(scenes))


@query(
    "corpus_vocabulary_counts",
    "A15",
    f"""SELECT 'status' AS facet, v AS entry, count(status) AS items FROM
      (VALUES {', '.join(f"('{s}')" for s in STATUSES)}) t(v) LEFT JOIN pass ON status = v GROUP BY v
    UNION ALL SELECT 'role', v, count(role) FROM
      (VALUES {', '.join(f"('{s}')" for s in EXCLUSION_ROLES)}) t(v) LEFT JOIN exclusion ON role = v
      GROUP BY v""",
)
def corpus_vocabulary_counts(fx):
    status = G.counts_over(fx.view("pass"), "status", STATUSES, "entry")
    role = G.counts_over(fx.exclusion, "role", EXCLUSION_ROLES, "entry")
    return status.withColumn("facet", F.lit("status")).unionByName(
        role.withColumn("facet", F.lit("role"))
    )


@query(
    "corpus_issue_list",
    "A15 P7 P3",
    """SELECT photo_id, turn, 'warning' AS level, CASE WHEN status <> 'approved' THEN 'not_approved'
      ELSE 'self_approved' END AS code FROM pass JOIN photo USING (photo_id)
      WHERE status <> 'approved' OR reviewer = annotator
    UNION ALL SELECT photo_id, turn, 'error', 'provenance_incomplete' FROM pass JOIN photo USING (photo_id)
      WHERE lower(trim(license)) IN ('', '?', 'tbd', 'à vérifier')
    UNION ALL SELECT photo_id, turn, 'error', 'provenance_incomplete' FROM pass JOIN photo USING (photo_id)
      WHERE redistributable AND usage <> 'redistributable'
    UNION ALL SELECT photo_id, turn, 'error', 'license_unverified' FROM pass JOIN photo USING (photo_id)
      WHERE redistributable AND starts_with(lower(trim(license)), 'inconnu')""",
)
def corpus_issue_list(fx):
    scenes, _ = G.annotated_scenes(fx.view("pass"), fx.photo)
    checked = G.check_status(G.check_provenance(scenes))
    lines = F.concat(
        F.transform("issues", lambda c: F.struct(F.lit("error").alias("level"), c.alias("code"))),
        F.when(
            F.col("code").isNotNull(),
            F.array(F.struct(F.lit("warning").alias("level"), F.col("code").alias("code"))),
        ).otherwise(F.array()),
    )
    return checked.select("photo_id", "turn", F.explode(lines).alias("i")).select(
        "photo_id", "turn", "i.level", "i.code"
    )


_TIMED = """(SELECT *, first_pass_seconds + review_seconds AS total_seconds FROM pass
  WHERE first_pass_seconds IS NOT NULL)"""


def _stats(value: str, name: str) -> str:
    return f"""SELECT '{name}' AS metric, count({value}) AS counted, {r(f'avg({value})', 1)} AS mean,
    {r(f'quantile_cont({value}, 0.5)', 1)} AS median, {r(f'min({value})', 1)} AS min,
    {r(f'max({value})', 1)} AS max FROM {_TIMED}"""


@query(
    "duration_stats",
    "A16",
    " UNION ALL ".join(
        [
            _stats("total_seconds", "total_seconds"),
            _stats("first_pass_seconds", "first_pass_seconds"),
            _stats("CASE WHEN review_seconds > 0 THEN review_seconds END", "review_seconds"),
        ]
    ),
)
def duration_stats(fx):
    return G.duration_stats(fx.view("pass"))


@query(
    "durations_by_difficulty",
    "A16",
    f"""SELECT difficulty, count(*) AS scenes, {r('avg(total_seconds)', 1)} AS mean_total_seconds
    FROM {_TIMED} t JOIN photo USING (photo_id) GROUP BY difficulty""",
)
def durations_by_difficulty(fx):
    scenes, _ = G.annotated_scenes(fx.view("pass"), fx.photo)
    return G.durations_by_difficulty(scenes)


@query(
    "primary_pass",
    "W1",
    """SELECT photo_id, turn, pass_label FROM pass QUALIFY row_number() OVER (PARTITION BY photo_id
    ORDER BY CASE WHEN pass_label IS NULL THEN 0 WHEN pass_label = 'A' THEN 1 ELSE 2 END,
    coalesce(pass_label, '')) = 1""",
)
def primary_pass(fx):
    return G.primary_pass(fx.view("pass")).select("photo_id", "turn", "pass_label")


@query(
    "pass_pairs",
    "W2",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY coalesce(pass_label, ''))
      AS n FROM pass)
    SELECT a.photo_id, a.vec_id AS first_vec_id, b.vec_id AS second_vec_id, a.annotator AS first_annotator,
      b.annotator AS second_annotator FROM k a JOIN k b ON a.photo_id = b.photo_id
      AND a.n = 1 AND b.n = 2""",
)
def pass_pairs(fx):
    return G.pass_pairs(fx.view("pass"), ["vec_id", "annotator"])


@query(
    "scene_rows",
    "A18",
    """SELECT s.photo_id, s.turn, p.difficulty, coalesce(t.traits, '') AS traits, s.status,
    s.first_pass_seconds + s.review_seconds AS total_seconds, coalesce(u.reasons, '') AS exclusion_roles
    FROM pass s JOIN photo p USING (photo_id)
    LEFT JOIN (SELECT photo_id, string_agg(DISTINCT trait, '|' ORDER BY trait) AS traits FROM photo_trait
      GROUP BY photo_id) t USING (photo_id)
    LEFT JOIN (SELECT photo_id, string_agg(role || '=' || n, '|' ORDER BY role) AS reasons FROM
      (SELECT photo_id, role, count(*) AS n FROM exclusion GROUP BY 1, 2) GROUP BY photo_id) u
      ON u.photo_id = s.vec_id""",
)
def scene_rows(fx):
    scenes, _ = G.annotated_scenes(fx.view("pass"), fx.photo)
    traits = fx.photo_trait.groupBy("photo_id").agg(
        piped(F.collect_set("trait")).alias("traits")
    )
    counts = fx.exclusion.groupBy(F.col("photo_id").alias("vec_id"), "role").agg(
        F.count(F.lit(1)).alias("n")
    )
    roles = counts.groupBy("vec_id").agg(
        piped(F.collect_list(F.concat_ws("=", "role", F.col("n").cast("string")))).alias("exclusion_roles")
    )
    rows = G.with_total_seconds(scenes).join(traits, "photo_id", "left").join(roles, "vec_id", "left")
    return rows.select(
        "photo_id",
        "turn",
        "difficulty",
        F.coalesce("traits", F.lit("")).alias("traits"),
        "status",
        "total_seconds",
        F.coalesce("exclusion_roles", F.lit("")).alias("exclusion_roles"),
    )


@query(
    "pair_rows",
    "A18",
    """WITH k AS (SELECT *, first_pass_seconds + review_seconds AS total_seconds,
      row_number() OVER (PARTITION BY photo_id ORDER BY coalesce(pass_label, '')) AS n FROM pass)
    SELECT a.photo_id, p.difficulty, a.total_seconds AS first_total_seconds,
      b.total_seconds AS second_total_seconds, a.independent_pass AS first_independent_pass,
      b.independent_pass AS second_independent_pass
      FROM k a JOIN k b ON a.photo_id = b.photo_id AND a.n = 1 AND b.n = 2
      JOIN photo p ON p.photo_id = a.photo_id""",
)
def pair_rows(fx):
    passes = G.with_total_seconds(fx.view("pass"))
    pairs = G.pass_pairs(passes, ["total_seconds", "independent_pass"])
    return pairs.join(fx.photo.select("photo_id", "difficulty"), "photo_id")


@query(
    "exclusion_import",
    "P23",
    """SELECT draw_id, CAST(k AS BIGINT) AS k, role, role NOT IN ('occluder', 'floor_covering', 'structural',
      'opening', 'other', 'unknown') AS quarantined FROM (
      SELECT event_id AS draw_id, i - 1 AS k, CASE WHEN i = 1 THEN CASE WHEN event_type = 'click'
        THEN 'occluder' WHEN event_type = 'view' THEN 'opening' ELSE event_type END ELSE 'unknown' END AS role
      FROM events, range(1, 3) g(i))""",
)
def exclusion_import(fx):
    hole = F.array(F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y")))
    role = (
        F.when(F.col("event_type") == "click", "occluder")
        .when(F.col("event_type") == "view", "opening")
        .otherwise(F.col("event_type"))
    )
    draws = fx.events.select(
        F.col("event_id").alias("draw_id"),
        F.struct(
            F.array(hole, hole).alias("floorHoles"),
            F.array(role).alias("floorHoleRoles"),
            F.lit(None).cast("array<string>").alias("floorHoleNotes"),
        ).alias("draw"),
    )
    good, bad = G.import_exclusions(draws)
    columns = ["draw_id", "k", "role"]
    return good.select(*columns, F.lit(False).alias("quarantined")).unionByName(
        bad.select(*columns, F.lit(True).alias("quarantined"))
    )


@query(
    "assembled_annotations",
    "P24",
    f"""WITH good AS (SELECT draw_id, json_extract_string(body, '$.photoId') AS photo_id,
      CAST(json_extract(body, '$.width') AS BIGINT) AS width,
      CAST(json_extract(body, '$.drawSeconds') AS DOUBLE) AS first_pass_seconds
      FROM draw WHERE {_DRAW_PROBLEMS} = ''),
    frames AS (SELECT CAST(doc_id AS VARCHAR) AS photo_id,
      CASE WHEN lang = 'de' THEN 800 ELSE 640 END AS frame_width FROM documents)
    SELECT g.draw_id, g.photo_id, g.first_pass_seconds, CASE WHEN f.photo_id IS NULL
      THEN 'photo_not_in_manifest' WHEN f.frame_width <> g.width THEN 'dimensions_mismatch' END AS refusal,
      CASE WHEN f.frame_width = g.width THEN 'drawer' END AS reviewer,
      CASE WHEN f.frame_width = g.width THEN 'masks/' || g.photo_id || '.floor-visible.png' END AS floor_mask,
      CASE WHEN f.frame_width = g.width AND draw_id % 3 = 0 THEN 'masks/' || g.photo_id || '.uncertain.png' END AS uncertain_mask,
      CASE WHEN f.frame_width = g.width THEN 4 END::BIGINT AS revision, CASE WHEN f.frame_width = g.width THEN 'occluder:3' END AS exclusions,
      CASE WHEN f.frame_width = g.width THEN 3 END::BIGINT AS floor_points, CASE WHEN f.frame_width = g.width THEN 'wall_floor' END AS boundary
    FROM good g LEFT JOIN frames f USING (photo_id)""",
)
def assembled_annotations(fx):
    good, _ = parse_draws(fx.draw, DRAW_TAG)
    frames = fx.documents.select(
        F.col("doc_id").cast("string").alias("photo_id"),
        F.when(F.col("lang") == "de", 800).otherwise(640).alias("frame_width"),
        F.lit(480).alias("frame_height"),
    )
    done, refused = G.assemble_annotation(good, frames, "drawer", status="reviewed", revision=4)
    columns = ["draw_id", "photo_id", "first_pass_seconds"]
    return done.select(
        *columns, "reviewer", F.col("masks.floorVisible").alias("floor_mask"), F.try_element_at("masks", F.lit("uncertain")).alias("uncertain_mask"), "revision",
        F.expr("array_join(transform(exclusions, x -> x.role || ':' || size(x.polygon)), '|') AS exclusions"),
        F.size(F.flatten("floor_polygons")).cast("bigint").alias("floor_points"), F.array_join("boundary.kind", "|").alias("boundary"),
    ).unionByName(
        refused.select(*columns, "refusal"), allowMissingColumns=True
    )


#: Published settings that decide a result.
_SETTINGS = {
    "min_long_side": 640, "max_aspect_ratio": 3.0, "blur_working_side": 1024, "blur_method": "reblur_ratio", "blur_sharp_min": 120.0,
    "blur_reblur_sharp_max": 0.3583, "blur_edge_width_sharp_max": 9.0, "blur_min_strong_gradient_ratio": 0.005, "dark_luma_max": 0.06,
    "bright_luma_min": 0.98, "dark_ratio_max": 0.35, "bright_ratio_max": 0.12, "luma_mean_min": 0.12, "luma_mean_max": 0.85,
    "contrast_min": 0.05, "contrast_ratio_min": 0.1, "blur_reblur_blurry_min": 0.4778, "blur_edge_width_blurry_min": 12.0,
    "clipped_high_ratio_max": 0.02, "clipped_low_ratio_max": 0.05, "lens_method": "k1_fit", "lens_sagitta_suspect_px": 3.0,
    "lens_reference_width": 1600, "lens_max_fit_rms_px": 2.0, "lens_min_track_points": 40, "lens_min_track_height_ratio": 0.25,
    "lens_min_usable_edges": 2, "lens_min_sign_agreement": 0.8, "lens_k1_search_min": -0.45, "lens_k1_search_max": 0.45,
    "lens_k1_search_steps": 181, "lens_k1_suspect_min": 0.03, "lens_k1_min_residual_gain": 0.25,
}


@query(
    "settings_stamp",
    "S11",
    f"""SELECT photo_id, difficulty, '{", ".join(f'{k}={v}' for k, v in sorted(_SETTINGS.items()))}' AS config FROM photo""",
)
def settings_stamp(fx):
    stamped = stamp_config(fx.photo, DEFAULTS)
    members = F.array_sort(F.json_object_keys("config"))
    entries = F.map_entries(F.from_json("config", "map<string,string>"))
    return stamped.select(
        "photo_id",
        "difficulty",
        F.when(
            F.size(members) == F.size(entries),
            F.array_join(F.transform(F.sort_array(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "),
        ).alias("config"),
    )
