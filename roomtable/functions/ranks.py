"""Order statistics and neighbours that survive a hot group.

Spark's percentile() keeps one map of all distinct values per group, and a
lag() over a hot key sorts that whole key in one task. Both helpers split the
work by (group, value range) first, so one group never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtable.functions.numbers import fixed

_STEPS = 1024


def value_range(value: Column) -> Column:
    """Monotone integer bucket: power of two, cut in 1024 steps, signed."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * _STEPS)
    magnitude = (power + 1100) * _STEPS + step
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude).cast("bigint")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float | str],
) -> DataFrame:
    """Exact quantiles per group: one row per group, one column per entry.

    A number p asks for the linear quantile at p (numpy's default); the string
    "upper" asks for the element at index n // 2 of the sorted values. Also
    gives counted, total, lowest and highest of the non-null values, which cost
    nothing extra. Groups without any value have no row. Keys must not be null.
    """
    keys = list(keys)
    tallies = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_range(F.col("_v")))
    )
    along = Window.partitionBy(*keys).orderBy("_b")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranks = []
    for name, p in wanted.items():
        if p == "upper":
            low = high = F.floor(F.col("_total") / 2)
        else:
            position = F.lit(float(p)) * (F.col("_total") - 1)
            low, high = F.floor(position), F.ceil(position)
        ranks += [
            F.struct(F.lit(f"{name}:lo").alias("tag"), low.cast("bigint").alias("rank")),
            F.struct(F.lit(f"{name}:hi").alias("tag"), high.cast("bigint").alias("rank")),
        ]
    histogram = (
        tallies.groupBy(*keys, "_b")
        .agg(
            F.sum("_n").alias("_bn"),
            F.sum(F.col("_v") * F.col("_n")).alias("_bs"),
            F.min("_v").alias("_bl"),
            F.max("_v").alias("_bh"),
        )
        .select(
            "*",
            F.sum("_bn").over(along).alias("_to"),
            F.sum("_bn").over(whole).alias("_total"),
            F.sum("_bs").over(whole).alias("_sum"),
            F.min("_bl").over(whole).alias("_low"),
            F.max("_bh").over(whole).alias("_high"),
        )
    )
    start = F.col("_to") - F.col("_bn")
    hits = (
        histogram.withColumn(
            "_asked",
            F.filter(
                F.array(*ranks),
                lambda r: (r["rank"] >= start) & (r["rank"] < F.col("_to")),
            ),
        )
        .where(F.size("_asked") > 0)
        .select(*keys, "_b", "_total", "_sum", "_low", "_high", start.alias("_from"), "_asked")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    found = (
        tallies.join(hits, [*keys, "_b"])
        .withColumn("_upto", F.col("_from") + F.sum("_n").over(inside))
        .withColumn("_hit", F.explode("_asked"))
        .where(
            (F.col("_hit.rank") >= F.col("_upto") - F.col("_n"))
            & (F.col("_hit.rank") < F.col("_upto"))
        )
    )

    def at(tag: str) -> Column:
        return F.max(F.when(F.col("_hit.tag") == tag, F.col("_v")))

    picks = []
    for name in wanted:
        picks += [at(f"{name}:lo").alias(f"_{name}_lo"), at(f"{name}:hi").alias(f"_{name}_hi")]
    out = found.groupBy(*keys).agg(
        F.max("_total").alias("counted"),
        F.max("_sum").alias("total"),
        F.max("_low").alias("lowest"),
        F.max("_high").alias("highest"),
        *picks,
    )
    finals = []
    for name, p in wanted.items():
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        if p == "upper":
            finals.append(lo.alias(name))
        else:
            position = F.lit(float(p)) * (F.col("counted") - 1)
            finals.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return out.select(*keys, "counted", "total", "lowest", "highest", *finals)


def describe(df: DataFrame, keys: Sequence[str], value: str, digits: int) -> DataFrame:
    """counted, mean, median, min and max per group, nulls skipped.

    A group without values keeps its row, with counted 0 and null statistics.
    """
    keys = list(keys)
    found = quantiles(df, keys, value, {"median": 0.5})
    groups = df.select(*keys).distinct()
    return groups.join(found, keys, "left").select(
        *keys,
        F.coalesce("counted", F.lit(0)).alias("counted"),
        fixed(F.col("total") / F.col("counted"), digits).alias("mean"),
        fixed(F.col("median"), digits).alias("median"),
        fixed(F.col("lowest"), digits).alias("min"),
        fixed(F.col("highest"), digits).alias("max"),
    )


def previous_in_group(
    df: DataFrame, group: str, position: str, value: str, alias: str, width: int = 4096
) -> DataFrame:
    """lag(value) over (partition by group order by position), cut in ranges.

    Each window partition holds at most `width` positions of a group. The last
    value of the range before comes from a table with one row per range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(position) / width).cast("bigint"))
    lasts = ranged.groupBy(group, "_range").agg(F.max_by(value, position).alias("_last"))
    before = lasts.withColumn(
        "_before", F.lag("_last").over(Window.partitionBy(group).orderBy("_range"))
    ).drop("_last")
    local = F.lag(value).over(Window.partitionBy(group, "_range").orderBy(position))
    first = F.row_number().over(Window.partitionBy(group, "_range").orderBy(position)) == 1
    return (
        ranged.withColumn("_local", local)
        .withColumn("_first", first)
        .join(before, [group, "_range"], "left")
        .withColumn(alias, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_local")))
        .drop("_range", "_local", "_first", "_before")
    )


def dense_index(
    df: DataFrame, group: str, order: str, alias: str, total: str, buckets: int = 64
) -> DataFrame:
    """0-based dense numbers within a group, and the group size.

    The order is by hash bucket, then by `order`; each window sees one bucket of a
    group, and bucket offsets come from a table of at most `buckets` rows a group.
    """
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(order), F.lit(buckets)))
    inside = Window.partitionBy(group, "_h").orderBy(order)
    along = Window.partitionBy(group).orderBy("_h")
    sizes = hashed.groupBy(group, "_h").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select(
        group,
        "_h",
        (F.sum("_c").over(along) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(group)).alias(total),
    )
    return (
        hashed.withColumn("_i", F.row_number().over(inside) - 1)
        .join(offsets, [group, "_h"])
        .withColumn(alias, (F.col("_i") + F.col("_before")).cast("bigint"))
        .drop("_h", "_i", "_before")
    )
