"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.llm.shared import cut_lineage, whole_text
from roomtable.llm.subwords import vocabulary_path, word_encoder

CAPACITY = 2048
END_ID = 0
#: Rows of one length that one task ranks; a commoner length is dealt to several.
RANKED_AT_ONCE = 4_000
#: Broadcast the plan up to so many runs; a larger one is joined by shuffle.
BROADCAST_RUNS = 100_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece.

    Rank r of a run goes to sequence first + r - first rank, at the offset. Lengths are
    placed from the longest, each piece into the open sequence with the least room that
    holds it; sequences of equal room are handled together, so the work and the result
    follow the number of different lengths and not the number of pieces. Zero lengths
    and counts are left out.
    """
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, sequences = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((first, count))

    for length in sorted((x for x, n in histogram.items() if x > 0 and n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
                used = min(count, left)
                put(room, first + used, count - used)
            else:
                room, first = capacity, sequences
                used = -(-left // (capacity // length))
                sequences += used
            runs.append((length, rank, used, first, capacity - room))
            put(room - length, first, used)
            left, rank = left - used, rank + used
    return runs


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text), np.array([end_id], "<u4")).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), crc32(part.tobytes())))
            made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return cut


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut at `capacity`."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInPandas(_pieces(path or vocabulary_path(), capacity, end_id), schema)


def ranked(rows: DataFrame, at_once: int = RANKED_AT_ONCE) -> DataFrame:
    """`rows` with `rank`: 0, 1, ... within each length.

    Every length is dealt to parts by a hash, as many as its count asks for. Ranks run
    within a part and start where the parts before it end, so no task sees a whole
    length. Equal rows may trade ranks, which changes nothing.
    """
    wide = rows.groupBy("length").agg(F.ceil(F.count("*") / F.lit(at_once)).alias("parts"))
    dealt = rows.join(F.broadcast(wide), "length")  # one row for each length up to the capacity
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts")).drop("parts")
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    own = dealt.withColumn("nth", F.row_number().over(order) - 1)
    return own.join(sizes, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "part")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of `docs`.

    The histogram of piece lengths has at most `capacity` rows and is all that reaches
    the driver; the plan made from it is joined on length and rank. Null texts are empty
    and give one piece, the end id. Repeated rows are packed as often as they occur; a
    null doc_id stays null. Other columns are not read. An empty table gives no rows.
    """
    cut = cut_lineage(pieces(docs, path, capacity, end_id))
    histogram = {x["length"]: x["n"] for x in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    schema = "length long, first_rank long, pieces long, first_sequence long, offset long"
    planned = docs.sparkSession.createDataFrame(runs, schema)
    if len(runs) <= BROADCAST_RUNS:
        planned = F.broadcast(planned)
    place = ranked(cut).join(planned, "length").where("rank >= first_rank and rank < first_rank + pieces")
    return place.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )
