"""Lines that other documents hold already, found in levelled sorted runs of line hashes.

Only DataFrame functions are used. A run is a table of (h1, h2, owner), bucketed and sorted
by the hashes; all runs have the same buckets, so a batch of lines that is dealt by its
hashes merges with each run as it lies: the runs are never shuffled again. Runs of a level
are merged into one of the next level when there are `fanout` of them, so a batch meets
few runs and a key is rewritten once a level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtable.llm.shared import cut_lineage, ensure_checkpoint_dir, whole_text

#: Code points of the shortest key that is looked for.
LEAST = 10
BATCHES = 4
FANOUT = 2
#: A row without doc_id counts as one document after all others.
LAST_PLACE = 2**63 - 1
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASHES = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _placed(docs: DataFrame, *more: Column) -> DataFrame:
    """(place, t): the document, and which of its texts; rows equal in both are the same text."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST_PLACE)).alias("place"), F.xxhash64(whole_text()).alias("t"), *more)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(place, t, pos, h1, h2) of every line whose key is long enough; the hash has 128 bits."""
    lines = _placed(docs, F.posexplode(F.split(whole_text(), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("place", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST)
    return keyed.select("place", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(LEAST), "key").alias("h2"))


class LineRuns:
    """The keys seen so far, with the smallest place of each, in levels of runs.

    The tables stand in a schema of their own in the shared folder; `close` drops it.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        ensure_checkpoint_dir(spark)
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.schema = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        spark.sql(f"CREATE SCHEMA {self.schema} LOCATION '{spark.sparkContext.getCheckpointDir()}/{self.schema}'")

    def close(self) -> None:
        self.spark.sql(f"DROP SCHEMA {self.schema} CASCADE")

    def saved(self, rows: DataFrame, bucketed: bool = True) -> str:
        name = f"{self.schema}.t{uuid.uuid4().hex}"
        writer = rows.write.format("parquet")
        (writer.bucketBy(self.buckets, *_HASHES).sortBy(*_HASHES) if bucketed else writer).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """(place, t, pos) of the lines of a batch that go; their keys become a run.

        A line goes if an earlier batch holds its key, or a smaller place of this one. Batches
        must come in ascending places for the smallest of all to keep its lines; else the
        first batch that holds a key does.
        """
        keys = lines.groupBy(*_HASHES).agg(F.min("place").alias("first"), F.max("place").alias("last"))
        keys = keys.withColumn("known", F.lit(None).cast("long"))
        for name in self.runs():
            run = self.spark.table(name).where("known is null").select(*_HASHES, "owner")
            keys = keys.join(run.hint("merge"), _HASHES, "left").select(*_HASHES, "first", "last", F.coalesce("known", "owner").alias("known"))
        fresh = self.saved(keys.select(*_HASHES, F.col("first").alias("owner"), "last", "known"))
        shared = self.spark.table(fresh).where("known is not null or last > owner")
        shared = self.spark.table(self.saved(shared.select(*_HASHES, F.coalesce("known", "owner").alias("owner")), bucketed=False))
        self.levels[0].append(fresh)
        gone = lines.join(shared, _HASHES).where("place > owner").select("place", "t", "pos")
        self._compact()
        return gone

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            own = [self.spark.table(name).where("known is null") for name in level]
            merged = self.saved(reduce(DataFrame.unionByName, own).repartition(self.buckets, *_HASHES))
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k], self.levels[k + 1] = [], [*self.levels[k + 1], merged]


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text of every row of `docs`.

    Keys of at least LEAST code points that two or more documents hold lose all their lines
    but those of the smallest doc_id. The documents come in `batches` ranges of doc_id; the
    result is the same for any number. A null text is one empty line. Rows of one doc_id are
    one document, rows without doc_id one after all others; repeated rows stay repeated. An
    empty table gives no rows; other columns are not read.

    A key costs one row for each task that holds it, a line of a shared key one row, in a
    join whose large partitions Spark splits; texts are dealt once, by document.
    """
    runs = LineRuns(docs.sparkSession, fanout)
    shares = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(LAST_PLACE)), shares, 10_000)).first()[0] if shares else None
    batch = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("place"))) if bounds else F.lit(0)
    lines = f"{runs.schema}.lines"
    hashed_lines(docs).withColumn("batch", batch).write.format("parquet").partitionBy("batch").saveAsTable(lines)
    gone = [runs.add(docs.sparkSession.table(lines).where(F.col("batch") == k).drop("batch")) for k in range(batches)]
    by_text = reduce(DataFrame.union, gone).groupBy("place", "t").agg(F.collect_set("pos").alias("gone"))
    by_text = cut_lineage(by_text)
    runs.close()
    whole = _placed(docs, F.col("doc_id"), F.split(whole_text(), "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return whole.join(by_text, ["place", "t"], "left").select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n").alias("text"),
    )
