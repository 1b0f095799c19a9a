"""Structural difference of nested records: which paths were added, removed or changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roomtable.functions.numbers import codes

_LEAF = "array<struct<path: string, value: string>>"
#: Members of an annotation that its geometry consists of; the others describe it.
GEOMETRY = ("boundary", "uncertain_zones", "exclusions", "mask_sha256")


def leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """Array of (path, value) of all scalars in a nested value; nulls have no leaf.

    Members are named, items numbered from 0; empty arrays and maps are a leaf of their own,
    so that an array that becomes empty differs from one that was never there.
    """
    none = F.array().cast(_LEAF)
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return none
        parts = [leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(*parts)).otherwise(none)
    if isinstance(kind, T.MapType):
        entries = F.sort_array(F.map_entries(value))
        inner = F.flatten(F.transform(entries, lambda e: leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
        return _held(value, F.size(value), inner, path, "{}")
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return _held(value, F.size(value), inner, path, "[]")
    leaf = F.struct(path.alias("path"), value.cast("string").alias("value"))
    return F.when(value.isNotNull(), F.array(leaf)).otherwise(none).cast(_LEAF)


def _held(value: Column, size: Column, inner: Column, path: Column, empty: str) -> Column:
    alone = F.array(F.struct(path.alias("path"), F.lit(empty).alias("value"))).cast(_LEAF)
    return F.when(value.isNull(), F.array().cast(_LEAF)).when(size == 0, alone).otherwise(inner).cast(_LEAF)


def record_leaves(records: DataFrame, keys: Sequence[str], members: Sequence[str]) -> DataFrame:
    """(keys, path, value) of every scalar in the named columns."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    parts = [leaves(F.col(c), kinds[c], F.lit(c)) for c in members]
    return records.select(*keys, F.explode(F.concat(*parts)).alias("_leaf")).select(*keys, "_leaf.path", "_leaf.value")


def record_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], members: Sequence[str]) -> DataFrame:
    """(keys, path, kind, before, after) of every path that differs; kind is added, removed or changed.

    Records meet by the keys, which must not be null; a record that only one side has gives
    all its leaves. Leaves are rows, so a long outline is many rows and not one long array.
    """
    keys = list(keys)
    old = record_leaves(before, keys, members).withColumnRenamed("value", "before")
    new = record_leaves(after, keys, members).withColumnRenamed("value", "after")
    both = old.join(new, [*keys, "path"], "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, "path", kind.alias("kind"), "before", "after")


def revision_changes(annotations: DataFrame, keys: Sequence[str], members: Sequence[str] = GEOMETRY) -> DataFrame:
    """Changes of each revision against the one before it in its group: keys, revision and the change."""
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy("revision")
    numbered = annotations.withColumn("_at", F.row_number().over(ordered)).select(*keys, "revision", "_at", *members)
    names = numbered.select(*keys, "revision", F.col("_at").alias("_at"))
    later = numbered.where("_at > 1").drop("revision")
    earlier = numbered.withColumn("_at", F.col("_at") + 1).drop("revision")
    # the last revision has none after it
    earlier = earlier.join(later.select(*keys, "_at"), [*keys, "_at"], "left_semi")
    return record_changes(earlier, later, [*keys, "_at"], members).join(names, [*keys, "_at"]).drop("_at")


def check_corrections(annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, revision, changed (paths of the geometry), issues of every revision.

    A review that says it corrected the outline goes with a change, and a change of a
    reviewed annotation with such a review; revisions count up by one from 1, once each.
    """
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy("revision")
    changed = revision_changes(annotations, keys).groupBy(*keys, "revision").agg(F.count(F.lit(1)).alias("changed"))
    listed = annotations.select(
        *keys, "revision", "corrected", "reviewer", F.lag("revision").over(ordered).alias("_before")
    )
    first = F.col("_before").isNull()
    joined = listed.join(changed, [*keys, "revision"], "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    corrected = F.coalesce("corrected", F.lit(False))
    return joined.withColumn(
        "issues",
        codes(
            (F.col("revision") < 1, "revision_below_one"),
            (~first & (F.col("revision") == F.col("_before")), "revision_repeated"),
            (~first & (F.col("revision") > F.col("_before") + 1), "revision_skipped"),
            (~first & corrected & (F.col("changed") == 0), "corrected_without_change"),
            (~first & F.col("reviewer").isNotNull() & ~corrected & (F.col("changed") > 0), "change_without_correction"),
        ),
    ).select(*keys, "revision", "changed", "issues")
