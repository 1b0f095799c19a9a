"""Items of an array in one large JSON document, read by many tasks.

The document is read as text whose records end at a closing brace, so Spark splits it like
any text file. Whether a split begins inside a string, how deep, and under which key of the
root follows from sums over the splits before it: unescaped quotes alternate, and a split's
change of depth is known for either start. Three readings give the summaries, the keys and
the items; only items that cross a split's border are dealt out to be joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.session import cut_lineage

_CLOSE = "}"
#: An escape outside a string is one of a string that a split began in: its quote ends nothing.
_TOKEN = re.compile(r'\\.|"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_SPLIT = ["file", "start"]
#: Depth of the root's keys, of the array under one of them, and inside its items.
_ROOT, _ARRAY, _ITEM = 1, 2, 3


class _Scan:
    """Walks through records with the state that JSON needs: in a string or not, and the depth."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth

    def tokens(self, record: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, token) of brackets and whole strings; `depth` is that after the token."""
        at = 0
        if self.in_string:
            end = _STRING_END.match(record)
            if not end:
                return
            self.in_string, at = False, end.end()
        for found in _TOKEN.finditer(record, at):
            token = found[0]
            if token in "{[":
                self.depth += 1
            elif token in "}]":
                self.depth -= 1
            elif token[0] == "\\":
                continue
            elif not _STRING_END.fullmatch(token, 1):
                self.in_string = True
                return
            yield found.start(), found.end(), token


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", _CLOSE).text(path)
    return rows.select(
        F.concat("value", F.lit(_CLOSE)).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _splits(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(values of `columns`, records) of each split of a task, in the order of the file."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in [*columns, "value"]), strict=True))
    held = next(rows, None)
    while held is not None:
        now = held[:-1]

        def own(now=now):
            nonlocal held
            while held is not None and held[:-1] == now:
                yield held[-1]
                held = next(rows, None)

        records = own()
        yield now, records
        for _ in records:
            pass


def _in_arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: whether its quotes are odd, and its change of depth from outside and inside a string."""
    out = []
    for split, records in _splits(batches, _SPLIT):
        scans = _Scan(False, 0), _Scan(True, 0)
        for record in records:
            for scan in scans:
                for _ in scan.tokens(record):
                    pass
        out.append((*split, scans[0].in_string, scans[0].depth, scans[1].depth))
    yield _in_arrow(out, _SUMMARY)


_STARTS = [*_SPLIT, "in_string", "depth"]
_KEYS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("last_key", pa.string()), ("carried", pa.int64()), ("named", pa.int64())])


def _key_after(record: str, end: int) -> bool:
    return record[end:].lstrip()[:1] == ":"


def _keys(field: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per split: its last key of the root, and how many items end before its first key and under `field` after."""
        out = []
        for (file, start, in_string, depth), records in _splits(batches, _STARTS):
            scan, key, carried, named = _Scan(in_string, depth), None, 0, 0
            for record in records:
                for _, end, token in scan.tokens(record):
                    if token[0] == '"' and scan.depth == _ROOT and _key_after(record, end):
                        key = token
                    elif token == _CLOSE and scan.depth == _ARRAY:
                        carried += key is None
                        named += key == field
            out.append((file, start, key, carried, named))
        yield _in_arrow(out, _KEYS)

    return rows


_ITEMS = pa.schema([("file", pa.string()), ("position", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])


def _items(field: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items of the array under `field` by position; those that cross a border come in parts."""
        for (file, start, in_string, depth, key, position), records in _splits(batches, [*_STARTS, "key", "position"]):
            scan, out = _Scan(in_string, depth), []
            inside, part, crossed = key == field and depth >= _ITEM, [], True
            for record in records:
                begin = 0
                for at, end, token in scan.tokens(record):
                    if token[0] == '"' and scan.depth == _ROOT and _key_after(record, end):
                        key = token
                    elif key == field and token == "{" and scan.depth == _ITEM:
                        inside, begin, part, crossed = True, at, [], False
                    elif key == field and token == _CLOSE and scan.depth == _ARRAY:
                        out.append((file, position, start, not crossed, "".join([*part, record[begin:end]])))
                        position, inside, part = position + 1, False, []
                if inside:
                    part.append(record[begin:])
                if len(out) >= 1000:
                    yield _in_arrow(out, _ITEMS)
                    out = []
            if inside and part:
                out.append((file, position, start, False, "".join(part)))
            yield _in_arrow(out, _ITEMS)

    return rows


def array_items(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, position, value): the objects in the array under a key of the root, as JSON text.

    A folder of documents gives the items of each. Other members of the root, of any kind,
    are skipped; items that are no objects too. A missing path raises.
    """
    name = f'"{field}"'
    records = _records(spark, path)
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    ddl = "file string, start long, "
    splits = records.mapInArrow(_summaries, ddl + "odd boolean, outside long, inside long")
    starts = splits.withColumn("in_string", F.coalesce(F.sum(F.col("odd").cast("int")).over(order), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    starts = starts.withColumn("depth", F.coalesce(F.sum(change).over(order), F.lit(0)))
    starts = cut_lineage(starts.select(*_STARTS))
    keyed = records.join(F.broadcast(starts), _SPLIT).select("value", *_STARTS)
    keys = keyed.mapInArrow(_keys(name), ddl + "last_key string, carried long, named long")
    keys = keys.withColumn("key", F.last("last_key", ignorenulls=True).over(order))
    ends = F.col("named") + F.when(F.col("key") == name, F.col("carried")).otherwise(0)
    placed = keys.withColumn("position", F.coalesce(F.sum(ends).over(order), F.lit(0))).select(*_SPLIT, "key", "position")
    placed = cut_lineage(starts.join(placed, _SPLIT))
    marked = records.join(F.broadcast(placed), _SPLIT).select("value", *_STARTS, "key", "position")
    items = cut_lineage(marked.mapInArrow(_items(name), "file string, position long, start long, whole boolean, value string"))
    crossed = items.where("NOT whole").groupBy("file", "position").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").alias("value")
    )
    return items.where("whole").select("file", "position", "value").unionByName(crossed)

