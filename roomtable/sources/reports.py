"""Report sinks: fixed column list, CSV with a JSON twin, settings snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtable.functions.settings import Settings

#: Names and order of the report columns.
REPORT_COLUMNS = (
    ("id", "string"),
    ("difficulty", "string"),
    ("graded", "boolean"),
    ("status", "string"),
    ("blur_method", "string"),
    ("lens_method", "string"),
    ("width", "bigint"),
    ("height", "bigint"),
    ("expected", "string"),
    ("detected", "string"),
    ("false_positives", "string"),
    ("false_negatives", "string"),
    ("informational", "string"),
    ("strong_gradient_ratio", "double"),
    ("laplacian_variance", "double"),
    ("reblur_ratio", "double"),
    ("edge_width_px", "double"),
    ("blur_sharp", "boolean"),
    ("blur_low_texture", "boolean"),
    ("luma_mean", "double"),
    ("contrast_std", "double"),
    ("clipped_high_ratio", "double"),
    ("clipped_low_ratio", "double"),
    ("lens_verdict", "string"),
    ("lens_suspected_sign", "string"),
    ("lens_usable_edges", "bigint"),
    ("lens_total_track_px", "double"),
    ("lens_spatial_coverage", "double"),
    ("lens_sign_agreement", "double"),
    ("lens_k1_estimate", "double"),
    ("lens_k1_residual_gain", "double"),
    ("truth_k1", "double"),
    ("truth_sign", "string"),
    ("truth_blur_sigma", "double"),
    ("truth_exposure_gain", "double"),
    ("k1_absolute_error", "double"),
    ("sign_correct", "boolean"),
    ("load_image_ms", "double"),
    ("quality_analysis_ms", "double"),
    ("lens_analysis_ms", "double"),
    ("total_ms", "double"),
)


def report_rows(rows: DataFrame) -> DataFrame:
    """The fixed columns in their order; what `rows` lacks becomes null."""
    return rows.select(
        *[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in REPORT_COLUMNS
        ]
    )


def write_report(rows: DataFrame, folder: str) -> None:
    report = report_rows(rows)
    report.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    report.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/json")


def stamp_config(report: DataFrame, settings: Settings) -> DataFrame:
    """Adds the settings that decide a result as one JSON column; numbers stay numbers."""
    values = [F.lit(value).alias(name) for name, value in sorted(settings.snapshot().items())]
    return report.withColumn("config", F.to_json(F.struct(*values)))
