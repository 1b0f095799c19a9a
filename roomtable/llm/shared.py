"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtable.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "ensure_checkpoint_dir", "table", "whole_text", "words_of", "hashed_sample", "pair_ranges"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8: bytes split on just these characters."""
    return text.encode("utf-8", "surrogatepass").split()


def hashed_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` distinct keys, those of the smallest hash: the same rows in each run."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(bound)


def pair_ranges(start_a, size_a, start_b, size_b) -> tuple[np.ndarray, np.ndarray]:
    """Members (i, j) of all products of two ranges, one product after the other."""
    sizes = size_a * size_b
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = np.repeat(size_b, sizes)
    return np.repeat(start_a, sizes) + place // wide, np.repeat(start_b, sizes) + place % wide
