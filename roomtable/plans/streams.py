"""Stream jobs run over the tables: rows become files, files become a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roomtable.plans.image import _CODES, SMALL, measures
from roomtable.plans.registry import query
from roomtable.session import shared_folder
from roomtable.streaming.intake import MEASURE, intake_stream
from roomtable.streaming.registrations import REGISTRATION, current_manifest, register_stream


def _workspace(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(
    "intake_stream",
    "T1",
    f"""{_CODES} SELECT photo_id, CASE WHEN photo_id % 10 <> 7 THEN 'analysis_incomplete' END AS status,
    CASE WHEN photo_id % 10 <> 7 THEN codes END AS codes, CASE WHEN photo_id % 10 = 7 THEN 'unreadable' END AS refusal FROM cd""",
)
def intake(fx):
    """Every measured tile goes through the stream; a tenth of them lost its luma."""
    root = _workspace(fx.spark)
    rows = measures(fx).withColumn("total_ms", F.lit(None).cast("double"))
    damaged = rows.withColumn("luma_mean", F.when(F.col("photo_id") % 10 != 7, F.col("luma_mean")))
    damaged.select(*MEASURE.names).write.json(f"{root}/in")
    intake_stream(fx.spark, f"{root}/in", f"{root}/out", f"{root}/state", SMALL).awaitTermination()
    good = fx.spark.read.parquet(f"{root}/out/verdicts").select("photo_id", "status", "codes")
    bad = fx.spark.read.parquet(f"{root}/out/refusals").select("photo_id", "refusal")
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "registration_stream",
    "T2 S7",
    """WITH q AS (SELECT photo_id, file, license, redistributable, difficulty, 1 AS seq FROM photo
      UNION ALL SELECT photo_id, file, license, redistributable, 'hard', 2 FROM photo WHERE graded),
    ok AS (SELECT * FROM q WHERE NOT (redistributable AND starts_with(file, 'private-real/'))
      AND NOT (NOT redistributable AND starts_with(file, 'public/')))
    SELECT photo_id, arg_max(difficulty, seq) AS difficulty, max(seq)::BIGINT AS seq FROM ok GROUP BY photo_id""",
)
def registrations(fx):
    """Two waves of registrations in two streams; the late wave holds older entries."""
    root = _workspace(fx.spark)
    first = fx.photo.where("graded").withColumn("difficulty", F.lit("hard")).withColumn("seq", F.lit(2))
    late = fx.photo.withColumn("seq", F.lit(1))
    for wave in (first, late):
        wave.select(*REGISTRATION.names).write.mode("append").json(f"{root}/in")
        register_stream(
            fx.spark, f"{root}/in", f"{root}/manifest", f"{root}/refused", f"{root}/state", buckets=8
        ).awaitTermination()
    return current_manifest(fx.spark, f"{root}/manifest").select("photo_id", "difficulty", "seq")
