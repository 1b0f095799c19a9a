"""Stream of photo registrations: late and repeated ones, the last per id wins.

The manifest lies in hash buckets of the photo's id. A batch rewrites only the buckets it
touches, under its own number, and writes a small table that says which version of every
bucket holds from then on; so replaying a batch rewrites the same files from the same
inputs, and a batch of one photo costs one bucket. Files carry a sequence number; the
highest one of an id decides, whatever order they arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roomtable.operators.governance import register_photo
from roomtable.session import cut_lineage

REGISTRATION = T.StructType(
    [
        T.StructField("photo_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("redistributable", T.BooleanType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
BUCKETS = 64
_VERSIONS = "bucket int, version long"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("photo_id"), F.lit(buckets)).cast("int")


def bucket_folder(manifest: str, number: int) -> str:
    return f"{manifest}/data/version={number}"


def versions(spark: SparkSession, manifest: str, number: int) -> dict[int, int]:
    """Version of each bucket after batch `number`; at most one entry a bucket."""
    if number < 0:
        return {}
    rows = spark.read.schema(_VERSIONS).parquet(f"{manifest}/versions/batch={number}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def read_buckets(spark: SparkSession, manifest: str, held: dict[int, int]) -> DataFrame:
    """Photos of the given buckets, each in its version."""
    folders = [f"{bucket_folder(manifest, number)}/bucket={bucket}" for bucket, number in sorted(held.items())]
    return spark.read.schema(REGISTRATION).parquet(*folders) if folders else spark.createDataFrame([], REGISTRATION)


def current_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """Photos after the last batch."""
    last = spark.read.option("basePath", f"{manifest}/versions").parquet(f"{manifest}/versions").agg(F.max("batch")).first()[0]
    return read_buckets(spark, manifest, versions(spark, manifest, last))


def merge_batch(batch: DataFrame, number: int, manifest: str, refused: str, buckets: int = BUCKETS) -> None:
    """Merge one batch into the buckets it touches."""
    session = batch.sparkSession
    placed = batch.withColumn("bucket", _bucket(buckets))
    touched = {r["bucket"] for r in placed.select("bucket").distinct().collect()}  # at most one row a bucket
    before = versions(session, manifest, number - 1)
    current = read_buckets(session, manifest, {b: v for b, v in before.items() if b in touched})
    merged, bad = register_photo(current, batch, "seq")
    merged = cut_lineage(merged.withColumn("bucket", _bucket(buckets)))
    merged.write.mode("overwrite").partitionBy("bucket").parquet(bucket_folder(manifest, number))
    bad.write.mode("overwrite").parquet(f"{refused}/batch={number}")
    own = [r["bucket"] for r in merged.select("bucket").distinct().collect()]
    after = before | dict.fromkeys(own, number)
    held = session.createDataFrame(sorted(after.items()), _VERSIONS).coalesce(1)
    held.write.mode("overwrite").parquet(f"{manifest}/versions/batch={number}")


def register_stream(
    spark: SparkSession, source: str, manifest: str, refused: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Merge all registration files that are there, then stop."""
    rows = spark.readStream.schema(REGISTRATION).json(source)
    return (
        rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, manifest, refused, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
