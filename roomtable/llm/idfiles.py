"""Files of token ids: writing documents in order, and reading them back.

A file is a Parquet file of blocks, so it lives in any store that Spark writes to. A row
is one block of at most BLOCK ids that stands on its own: shard and block give its place,
first the number of ids of the shard before it, code the range-coded ids, checksum the
CRC-32 of the ids, ordinal the number of the first document in it within the shard, and
doc_ids and lengths the documents it holds parts of and how many ids of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from roomtable.llm import idcoder
from roomtable.llm.shared import ensure_checkpoint_dir, whole_text
from roomtable.llm.subwords import texts_encoder, vocabulary_path

END_ID = 1
#: Blocks that are coded side by side.
LANES = 8192
SCHEMA = "shard int, block int, first long, ordinal long, doc_ids array<long>, lengths array<long>, n int, checksum long, code binary"


def _coded(shard: int, first: int, block: int, ordinal: int, ids: np.ndarray, docs: list, sizes: np.ndarray) -> pa.RecordBatch:
    """Block rows of a run of ids; docs and sizes are the documents whose ids make it up."""
    low = np.arange(0, len(ids), idcoder.BLOCK)
    high = np.minimum(low + idcoder.BLOCK, len(ids))
    blocks = [ids[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    ends = np.cumsum(sizes)
    a = np.searchsorted(ends, low, "right")
    held = np.searchsorted(ends, high, "left") + 1 - a
    upto = np.cumsum(held)
    inside = np.arange(int(upto[-1])) - np.repeat(upto - held - a, held)
    lengths = np.minimum(ends[inside], np.repeat(high, held)) - np.maximum((ends - sizes)[inside], np.repeat(low, held))
    offsets = pa.array(np.append(0, upto), pa.int32())
    columns = {
        "shard": pa.array(np.full(len(low), shard, np.int32)),
        "block": pa.array(np.arange(block, block + len(low), dtype=np.int32)),
        "first": pa.array(first + low),
        "ordinal": pa.array(ordinal + a),
        "doc_ids": pa.ListArray.from_arrays(offsets, pa.array(docs, pa.int64()).take(pa.array(inside))),
        "lengths": pa.ListArray.from_arrays(offsets, pa.array(lengths)),
        "n": pa.array((high - low).astype(np.int32)),
        "checksum": pa.array([idcoder.checksum(x) for x in blocks], pa.int64()),
        "code": pa.array(idcoder.encode_blocks(blocks), pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = texts_encoder(path), TaskContext.get().partitionId()
        first, block, ordinal, wanted = 0, 0, 0, LANES * idcoder.BLOCK
        end = np.array([end_id], "<u4")
        ids, docs, sizes, held = [], [], [], 0

        def cut(last: bool):
            """Code the whole blocks at hand; a document cut by the end of the last one goes on."""
            nonlocal first, block, ordinal, ids, docs, sizes, held
            stream, size = np.concatenate(ids), np.array(sizes, np.int64)
            take = len(stream) if last else len(stream) // idcoder.BLOCK * idcoder.BLOCK
            ends = np.cumsum(size)
            whole = int(np.searchsorted(ends, take, "right"))
            upto = whole + (whole < len(size) and ends[whole] - size[whole] < take)
            own = size[:upto].copy()
            if upto > whole:
                own[-1] = take - (ends[whole] - size[whole])
            made = _coded(shard, first, block, ordinal, stream[:take], docs[:upto], own)
            left = size[whole:].copy()
            if upto > whole:
                left[0] -= own[-1]
            first, block, ordinal = first + take, block + made.num_rows, ordinal + whole
            ids, docs, sizes, held = [stream[take:].copy()], docs[whole:], left.tolist(), len(stream) - take
            return made

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += own, end
                docs.append(doc_id)
                sizes.append(len(own) + 1)
                held += len(own) + 1
                if held >= wanted:
                    yield cut(False)
        if held:
            yield cut(True)

    return write


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every whole text and an end id, in ascending doc_id order (null ids first).

    Documents are dealt to shards by ranges of doc_id; a shard is one task's output.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_writer(path or vocabulary_path(), end_id), SCHEMA).write.parquet(folder)


def _parts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(shard, ordinal, doc_id, first, n, crc): the parts of documents in some blocks, joined where they follow each other."""
    rows = rows.take(pa.array(np.lexsort((rows.column("block").to_numpy(), rows.column("shard").to_numpy()))))
    shard, block, first, ordinal, n, checksum = (rows.column(c).to_numpy() for c in ("shard", "block", "first", "ordinal", "n", "checksum"))
    ids = memoryview(np.concatenate(idcoder.decode_blocks(rows.column("code").to_pylist(), n.tolist())).astype("<u4", copy=False)).cast("B")
    ends = np.cumsum(n, dtype=np.int64)
    for k, (a, b, told) in enumerate(zip((4 * (ends - n)).tolist(), (4 * ends).tolist(), checksum.tolist(), strict=True)):
        if crc32(ids[a:b]) != told:
            raise ValueError(f"block {block[k]} of shard {shard[k]} is damaged")
    held = rows.column("lengths").value_lengths().to_numpy()
    size = rows.column("lengths").flatten().to_numpy()
    upto = np.cumsum(size)
    at = upto - size
    shards = np.repeat(shard, held)
    number = np.repeat(ordinal - (np.cumsum(held) - held), held) + np.arange(len(size))
    begin = np.repeat(first - (ends - n), held) + at
    fresh = np.ones(len(size), bool)
    fresh[1:] = (shards[1:] != shards[:-1]) | (number[1:] != number[:-1]) | (begin[1:] != (begin + size)[:-1])
    head = np.flatnonzero(fresh)
    low, high = at[head], upto[np.append(head[1:], len(size)) - 1]
    crcs = [crc32(ids[a:b]) for a, b in zip((4 * low).tolist(), (4 * high).tolist(), strict=True)]
    columns = {
        "shard": pa.array(shards[head]), "ordinal": pa.array(number[head]),
        "doc_id": rows.column("doc_ids").flatten().take(pa.array(head)),
        "first": pa.array(begin[head]), "n": pa.array(high - low), "crc": pa.array(crcs, pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each batch; a batch of more blocks than LANES is cut evenly."""
    for batch in batches:
        pieces = -(-batch.num_rows // LANES)
        bounds = [batch.num_rows * k // max(pieces, 1) for k in range(pieces + 1)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield _parts(batch.slice(a, b - a))


@F.pandas_udf(LongType())
def _joined_crc(parts: pd.Series) -> pd.Series:
    """CRC-32 of the joined parts. A CRC is linear, so zeros of a part's length carry the CRC before it over."""
    out = []
    for row in parts:
        row = sorted(row, key=lambda x: x["first"])
        crc = row[0]["crc"]
        for x in row[1:]:
            zeros = bytes(4 * x["n"])
            crc = crc32(zeros, crc) ^ crc32(zeros) ^ x["crc"]
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""
    parts = spark.read.schema(SCHEMA).parquet(folder).mapInArrow(
        _reader, "shard int, ordinal long, doc_id long, first long, n long, crc long"
    )
    whole = parts.groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("first", "n", "crc")).alias("parts"),
    )
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return whole.join(shards, "shard").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", _joined_crc("parts").alias("ids_crc32")
    )


def written_and_read(docs: DataFrame) -> DataFrame:
    """Write all documents to files in the shared folder and return what the files hold of each.

    Null or empty texts are the end id alone; a null doc_id stays null and comes first;
    repeated rows are written as often as they occur. Other columns are not read. An
    empty table writes no block and gives no row.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder)
    return read_documents(spark, folder)
