"""Annotation records, raw draw files and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtable.functions.numbers import codes

_text, _flag, _num = T.StringType(), T.BooleanType(), T.DoubleType()
POINT = T.StructType([T.StructField("x", _num), T.StructField("y", _num)])
POLYGON = T.ArrayType(POINT)
MASK_ROLES = ("floorVisible", "uncertain", "floorExtent")

BOUNDARY = T.StructField(
    "boundary",
    T.ArrayType(T.StructType([T.StructField("kind", _text), T.StructField("points", POLYGON), T.StructField("note", _text)])),
)
UNCERTAIN_ZONES = T.StructField(
    "uncertainZones",
    T.ArrayType(T.StructType([T.StructField("reason", _text), T.StructField("polygon", POLYGON), T.StructField("note", _text)])),
)

ANNOTATION = T.StructType(
    [
        T.StructField("schema", _text),
        T.StructField("photoId", _text),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField(
            "masks",
            T.StructType(
                [
                    T.StructField("floorVisible", _text),
                    T.StructField("uncertain", _text),
                    T.StructField("floorExtent", _text),
                ]
            ),
        ),
        BOUNDARY,
        UNCERTAIN_ZONES,
        T.StructField(
            "exclusions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("role", _text),
                        T.StructField("polygon", POLYGON),
                        T.StructField("thin", _flag),
                        T.StructField("note", _text),
                    ]
                )
            ),
        ),
        T.StructField("annotator", _text),
        T.StructField("annotatedOn", T.DateType()),
        T.StructField("revision", T.LongType()),
        T.StructField("status", _text),
        T.StructField(
            "review",
            T.StructType(
                [
                    T.StructField("reviewer", _text),
                    T.StructField("reviewedOn", T.DateType()),
                    T.StructField("corrected", _flag),
                    T.StructField("note", _text),
                ]
            ),
        ),
        T.StructField("passLabel", _text),
        T.StructField("independentPass", _flag),
        T.StructField(
            "timing",
            T.StructType(
                [
                    T.StructField("firstPassSeconds", _num),
                    T.StructField("correctionsSeconds", _num),
                    T.StructField("reviewSeconds", _num),
                    T.StructField("correctionCount", T.LongType()),
                ]
            ),
        ),
        T.StructField("maskSha256", T.MapType(_text, _text)),
        T.StructField("notes", _text),
    ]
)

DRAW = T.StructType(
    [
        T.StructField("schema", _text),
        T.StructField("photoId", _text),
        T.StructField("passLabel", _text),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("floorPolygons", T.ArrayType(POLYGON)),
        T.StructField("floorHoles", T.ArrayType(POLYGON)),
        T.StructField("floorHoleRoles", T.ArrayType(_text)),
        T.StructField("floorHoleNotes", T.ArrayType(_text)),
        UNCERTAIN_ZONES,
        BOUNDARY,
        T.StructField("drawSeconds", _num),
        T.StructField("notes", _text),
    ]
)


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per annotation file, in the order of the file names."""
    files = (
        spark.read.schema(ANNOTATION)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select(F.struct(*ANNOTATION.names).alias("annotation"), F.col("_metadata.file_path").alias("file"))
    )
    return flat_annotations(files).orderBy("file")


def parse_annotation_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    parsed = lines.withColumn("annotation", F.from_json(column, ANNOTATION))
    return flat_annotations(parsed.drop(column))


def flat_annotations(df: DataFrame) -> DataFrame:
    """`annotation` struct to the flat columns the governance operators read."""
    a = F.col("annotation")
    rest = [c for c in df.columns if c != "annotation"]
    return df.select(
        *rest,
        a["schema"].alias("schema"),
        a["photoId"].alias("photo_id"),
        a["width"].alias("width"),
        a["height"].alias("height"),
        F.map_filter(
            F.create_map(*[x for role in MASK_ROLES for x in (F.lit(role), a["masks"][role])]), lambda _, mask: mask.isNotNull()
        ).alias("masks"),
        a["annotator"].alias("annotator"),
        a["annotatedOn"].alias("annotated_on"),
        a["status"].alias("status"),
        a["review"]["reviewer"].alias("reviewer"),
        a["review"]["reviewedOn"].alias("reviewed_on"),
        F.when(a["review"].isNotNull(), F.coalesce(a["review"]["corrected"], F.lit(False))).alias("corrected"),
        a["review"]["note"].alias("review_note"),
        a["passLabel"].alias("pass_label"),
        F.coalesce(a["independentPass"], F.lit(False)).alias("independent_pass"),
        F.coalesce(a["revision"], F.lit(1)).alias("revision"),
        a["timing"]["firstPassSeconds"].alias("first_pass_seconds"),
        F.when(
            a["timing"].isNotNull(), F.coalesce(a["timing"]["correctionsSeconds"], F.lit(0.0))
        ).alias("corrections_seconds"),
        F.when(
            a["timing"].isNotNull(), F.coalesce(a["timing"]["reviewSeconds"], F.lit(0.0))
        ).alias("review_seconds"),
        a["timing"]["correctionCount"].alias("correction_count"),
        F.coalesce(a["boundary"], F.array()).alias("boundary"),
        F.coalesce(a["uncertainZones"], F.array()).alias("uncertain_zones"),
        F.coalesce(a["exclusions"], F.array()).alias("exclusions"),
        F.coalesce(a["maskSha256"], F.create_map().cast("map<string,string>")).alias("mask_sha256"),
        a["notes"].alias("notes"),
    )


def annotation_struct() -> Column:
    """Flat annotation columns back to the nested record."""
    when_any = lambda names, value: F.when(F.coalesce(*[F.col(c).cast("string") for c in names]).isNotNull(), value)
    c = lambda column, name: F.col(column).alias(name)
    timing = F.struct(
        c("first_pass_seconds", "firstPassSeconds"), c("corrections_seconds", "correctionsSeconds"),
        c("review_seconds", "reviewSeconds"), c("correction_count", "correctionCount"),
    )
    review = F.struct("reviewer", c("reviewed_on", "reviewedOn"), "corrected", c("review_note", "note"))
    return F.struct(
        "schema", c("photo_id", "photoId"), "width", "height",
        F.struct(*[F.try_element_at("masks", F.lit(role)).alias(role) for role in MASK_ROLES]).alias("masks"),
        "boundary", c("uncertain_zones", "uncertainZones"), "exclusions", "annotator", c("annotated_on", "annotatedOn"),
        "revision", "status", when_any(["reviewer", "reviewed_on"], review).alias("review"), c("pass_label", "passLabel"),
        c("independent_pass", "independentPass"), when_any(["first_pass_seconds", "review_seconds"], timing).alias("timing"),
        c("mask_sha256", "maskSha256"), "notes",
    )


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """One JSON line per annotation."""
    return annotations.select(F.to_json(annotation_struct()).alias("value"))


def parse_draws(bodies: DataFrame, schema_tag: str, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Raw draw JSON to (usable rows, quarantined rows with their problems)."""
    draw = F.col("draw")
    checked = bodies.withColumn("draw", F.from_json(column, DRAW)).withColumn(
        "problems",
        codes(
            (~draw["schema"].eqNullSafe(F.lit(schema_tag)), "wrong_schema"),
            (draw["photoId"].isNull(), "missing_photoId"),
            (draw["width"].isNull(), "missing_width"),
            (draw["height"].isNull(), "missing_height"),
            (draw["floorPolygons"].isNull(), "missing_floorPolygons"),
            (F.size(draw["floorPolygons"]) == 0, "no_floor_polygon"),
        ),
    )
    rest = [c for c in bodies.columns if c != column]
    good = checked.where(F.size("problems") == 0).select(*rest, "draw")
    bad = checked.where(F.size("problems") > 0).select(*rest, column, "problems")
    return good, bad


def content_hash(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SHA-256 per file. Files stay under Spark's 2 GiB row limit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("digest"))


def text_hash(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col(column), 256))
