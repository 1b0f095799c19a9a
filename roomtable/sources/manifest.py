"""Manifest of a corpus: one JSON document, or one JSON object per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtable.sources.documents import array_items

_text, _flag = T.StringType(), T.BooleanType()

PROVENANCE = T.StructType(
    [
        T.StructField("source", _text),
        T.StructField("sourceUrl", _text),
        T.StructField("author", _text),
        T.StructField("license", _text),
        T.StructField("verifiedOn", T.DateType()),
        T.StructField("redistributable", _flag),
        T.StructField("usage", _text),
        T.StructField("sha256", _text),
        T.StructField("note", _text),
    ]
)
GROUND_TRUTH = T.StructType(
    [
        T.StructField("available", _flag),
        T.StructField("vanishingPoints", T.ArrayType(T.MapType(_text, T.DoubleType()))),
        T.StructField("camera", T.MapType(_text, T.DoubleType())),
        T.StructField("lens", T.MapType(_text, _text)),
    ]
)
PHOTO = T.StructType(
    [
        T.StructField("id", _text),
        T.StructField("file", _text),
        T.StructField("difficulty", _text),
        T.StructField("provenance", PROVENANCE),
        T.StructField("traits", T.ArrayType(_text)),
        T.StructField("expectedIssues", T.ArrayType(_text)),
        T.StructField("graded", _flag),
        T.StructField("groundTruth", GROUND_TRUTH),
        T.StructField("split", _text),
        T.StructField("goldenCase", _text),
        T.StructField("notes", _text),
    ]
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Photos of a manifest document, in as many tasks as it has splits. A missing path raises."""
    items = array_items(spark, path, "photos")
    return flat_photos(items.select("position", F.from_json("value", PHOTO).alias("photo")))


def parse_photo_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Photos from JSON lines; the form for manifests too big for one document."""
    return flat_photos(lines.withColumn("photo", F.from_json(column, PHOTO)))


def flat_photos(df: DataFrame) -> DataFrame:
    """`photo` struct column to flat columns, with the defaults of the format."""
    photo = F.col("photo")
    provenance, truth = photo["provenance"], photo["groundTruth"]
    rest = [c for c in df.columns if c not in ("photo", "value")]
    return df.select(
        *rest,
        photo["id"].alias("photo_id"),
        photo["file"].alias("file"),
        photo["difficulty"].alias("difficulty"),
        provenance["source"].alias("source"),
        provenance["sourceUrl"].alias("source_url"),
        provenance["author"].alias("author"),
        provenance["license"].alias("license"),
        provenance["verifiedOn"].alias("verified_on"),
        F.coalesce(provenance["redistributable"], F.lit(False)).alias("redistributable"),
        F.coalesce(provenance["usage"], F.lit("local_evaluation_only")).alias("usage"),
        provenance["sha256"].alias("expected_digest"),
        provenance["note"].alias("provenance_note"),
        F.coalesce(photo["traits"], F.array()).alias("traits"),
        F.coalesce(photo["expectedIssues"], F.array()).alias("expected_issues"),
        F.coalesce(photo["graded"], F.lit(True)).alias("graded"),
        F.coalesce(truth["available"], F.lit(False)).alias("truth_available"),
        truth["vanishingPoints"].alias("truth_vanishing_points"),
        truth["camera"].alias("truth_camera"),
        truth["lens"].alias("truth_lens"),
        F.coalesce(photo["split"], F.lit("pilot_development")).alias("split"),
        photo["goldenCase"].alias("golden_case"),
        photo["notes"].alias("notes"),
        _lens_number(truth["lens"], "k1").alias("truth_k1"),
    )


def _lens_number(lens: Column, key: str) -> Column:
    return lens[key].try_cast("double")


#: Column of each member of a photo, its provenance and its ground truth.
_MEMBERS = {
    "id": "photo_id", "file": "file", "difficulty": "difficulty", "traits": "traits", "expectedIssues": "expected_issues",
    "graded": "graded", "split": "split", "goldenCase": "golden_case", "notes": "notes",
}
_PROVENANCE = {
    "source": "source", "sourceUrl": "source_url", "author": "author", "license": "license", "verifiedOn": "verified_on",
    "redistributable": "redistributable", "usage": "usage", "sha256": "expected_digest", "note": "provenance_note",
}
_TRUTH = {"available": "truth_available", "vanishingPoints": "truth_vanishing_points", "camera": "truth_camera", "lens": "truth_lens"}


def photo_struct(columns: Sequence[str]) -> Column:
    """Flat photo columns back to the nested form; members without a column are null."""

    def nested(kind: T.StructType, names: dict[str, str], more: dict[str, Column]) -> Column:
        own = lambda f: F.col(names[f.name]) if names.get(f.name) in columns else F.lit(None)
        return F.struct(*[more.get(f.name, own(f).cast(f.dataType)).alias(f.name) for f in kind.fields])

    inner = {"provenance": nested(PROVENANCE, _PROVENANCE, {}), "groundTruth": nested(GROUND_TRUTH, _TRUTH, {})}
    return nested(PHOTO, _MEMBERS, inner)


def manifest_lines(photos: DataFrame) -> DataFrame:
    """One JSON line per photo; keeps every task's share of the rows with it."""
    return photos.select(F.to_json(photo_struct(photos.columns)).alias("value"))


def export_manifest(photos: DataFrame, folder: str) -> None:
    manifest_lines(photos).write.mode("overwrite").text(folder)
