"""SimHash near-duplicate groups, found with a vantage-point partition."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from roomtable.llm import vantage
from roomtable.llm.components import components
from roomtable.llm.shared import cut_lineage, whole_text, words_of

SHINGLE = 4
SEED = 42
#: Fingerprints that one task compares with each other or with as many of another shard.
SHARD_SIZE = 50_000
_SHINGLES_AT_ONCE = 1 << 16


def simhash(text: str) -> int:
    """64-bit fingerprint: majority of each bit over the XXH64 of all 4-word shingles.

    A-Z are lower-cased. Fewer than four words are one shingle; no word gives zero.
    """
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    width = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(first), _SHINGLES_AT_ONCE):
        part = slice(k, k + _SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(first[part], last[part], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(first), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _simhash_column(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in text], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""
    return docs.select("doc_id", _simhash_column(whole_text()).alias("fp"))


def _visits(levels: int):
    """Rows (half, lo, hi, side, fp): each pair of overlapping shards gets both sides."""

    def visit(batches):
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for half in range(vantage.HALVES):
                row, home, seen = vantage.shard_visits(own, half, levels)
                lo, hi = np.minimum(home, seen), np.maximum(home, seen)
                yield pd.DataFrame({"half": half, "lo": lo, "hi": hi, "side": (home > lo).astype(int), "fp": own[row].view(np.int64)})

    return visit


def _links_of_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    fps, side = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["side"].to_numpy()
    alone = key[1] == key[2] and key[3] == key[4]
    links = vantage.spanning_links(fps[side == 0], None if alone else fps[side == 1], int(key[0]))
    return pd.DataFrame({"a": links[:, 0].view(np.int64), "b": links[:, 1].view(np.int64)})


def near_links(distinct: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links (a, b) that connect all of the distinct `fp` within four bits of each other.

    The top levels of both trees deal the fingerprints to shards; their number follows
    the count of fingerprints. A fingerprint also visits the shards its search ball
    overlaps. A shard above `shard_size` is cut into parts and every part meets every
    part, so no task holds more than two parts, whatever the data. Every pair within
    the radius is compared in some task, and a task returns a spanning set of its links.
    """
    count = distinct.count()
    levels = min(vantage.LEVELS, max(2, math.ceil(math.log(max(count, 1) / shard_size, 4))))
    visits = distinct.mapInPandas(_visits(levels), "half int, lo long, hi long, side int, fp long")
    home = F.when(F.col("side") == 0, F.col("lo")).otherwise(F.col("hi"))
    parts = (
        visits.where("lo = hi").groupBy("half", F.col("lo").alias("shard"))
        .agg(F.ceil(F.count("*") / F.lit(shard_size)).alias("parts")).where("parts > 1")
    )
    one = F.lit(1).cast("long")
    visits = (
        visits.join(parts.select("half", F.col("shard").alias("lo"), F.col("parts").alias("lo_parts")), ["half", "lo"], "left")
        .join(parts.select("half", F.col("shard").alias("hi"), F.col("parts").alias("hi_parts")), ["half", "hi"], "left")
        .withColumns({"lo_parts": F.coalesce("lo_parts", one), "hi_parts": F.coalesce("hi_parts", one)})
    )
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, F.col("lo_parts")).otherwise(F.col("hi_parts")))
    others = F.when(F.col("side") == 0, F.col("hi_parts")).otherwise(F.col("lo_parts"))
    met = visits.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    same = F.col("lo") == F.col("hi")
    first, second = F.least("own", "other"), F.greatest("own", "other")
    dealt = met.select(
        "half", "lo", "hi", "fp",
        F.when(same, first).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("lo_part"),
        F.when(same, second).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("hi_part"),
        F.when(same, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"),
    )
    return dealt.groupBy("half", "lo", "hi", "lo_part", "hi_part").applyInPandas(_links_of_group, "a long, b long")


def _grouped(docs: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; a component has one root, a fingerprint."""
    own = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(distinct.select("fp"), shard_size))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "root", "component_id")
    return own.join(by_print, "fp").select("doc_id", "fp", "root", "component_id")


def near_copies(docs: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    Rows link when their fingerprints differ in four bits or fewer; component_id is the
    smallest doc_id reachable. Equal fingerprints are joined first, so a group of copies
    costs one fingerprint. Other columns are not read. Null or blank texts have the
    fingerprint zero and link like any other; repeated rows stay repeated; a row without
    doc_id keeps its fingerprint and gets its group's id, null if nobody there has one.
    An empty table gives no rows.
    """
    return _grouped(docs, shard_size).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, less all near copies but one row of each group.

    The row of smallest doc_id stays, of several with that id the first by text. Rows are
    judged by their own text: of two unrelated texts under one id neither goes. Rows
    without doc_id cannot be told apart from their copies by id and all stay.
    """
    groups = cut_lineage(_grouped(docs.where("doc_id is not null")))
    again = cut_lineage(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    alone = docs.join(gone.union(again).distinct(), "doc_id", "left_anti").select(*docs.columns)
    of_text = groups.join(again, "doc_id", "left_semi").distinct()
    repeated = docs.join(again, "doc_id", "left_semi").select("doc_id", whole_text().alias("text"), F.struct(*docs.columns).alias("row"))
    first = Window.partitionBy("root", "doc_id").orderBy("text")
    once = (
        repeated.withColumn("fp", _simhash_column("text"))
        .join(of_text, ["doc_id", "fp"]).where("doc_id = component_id")
        .withColumn("nth", F.row_number().over(first)).where("nth = 1")
    )
    return alone.union(once.select("row.*"))
