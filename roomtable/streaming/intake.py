"""Stream of measurement rows: verdicts with the batch functions, no state.

Rows arrive as JSON files in a folder. Unreadable and undersized rows go to a
refusals table with a code; the log keeps a fixed list of columns and nothing
else. Batches are written under their number, so a replayed batch replaces its
own files instead of adding to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roomtable.functions.settings import DEFAULTS, Settings
from roomtable.operators.image import classify_sharpness, quality_codes
from roomtable.operators.scenes import decide_status

MEASURE = T.StructType(
    [T.StructField("photo_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("width", "height", "working_side")]
    + [
        T.StructField(c, T.DoubleType())
        for c in (
            "luma_mean", "contrast_ratio", "dark_pixel_ratio", "bright_pixel_ratio",
            "clipped_high_ratio", "clipped_low_ratio", "strong_gradient_ratio",
            "laplacian_variance", "reblur_ratio", "edge_width_normalized", "total_ms",
        )
    ]
)
#: The only columns a log line may carry.
LOG_COLUMNS = ("status", "width", "height", "warnings", "total_ms")


def judge(measures: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds codes, status and refusal to measurement rows, batch or stream."""
    seen = classify_sharpness(measures, settings)
    coded = quality_codes(seen, settings).withColumn("scene_present", F.lit(False))
    refusal = F.when(F.col("photo_id").isNull() | F.col("luma_mean").isNull(), "unreadable").when(
        F.col("width").isNull() | (F.least("width", "height") <= 0), "no_pixels"
    )
    return decide_status(coded).withColumn("refusal", refusal)


def log_lines(judged: DataFrame) -> DataFrame:
    return judged.withColumn("warnings", F.array_join("codes", "|")).select(*LOG_COLUMNS)


def intake_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Judge all files that are there, then stop."""
    rows = spark.readStream.schema(MEASURE).json(source)
    judged = judge(rows, settings)

    def store(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        good = kept.where("refusal IS NULL")
        good.select("photo_id", "status", F.array_join("codes", "|").alias("codes")).write.mode(
            "overwrite"
        ).parquet(f"{target}/verdicts/batch={number}")
        kept.where("refusal IS NOT NULL").select("photo_id", "refusal").write.mode("overwrite").parquet(
            f"{target}/refusals/batch={number}"
        )
        log_lines(good).write.mode("overwrite").json(f"{target}/log/batch={number}")
        kept.unpersist()

    return (
        judged.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
