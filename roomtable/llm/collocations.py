"""Collocations from count streams in prefix and suffix order.

Texts become sequences of word numbers; every place of a frequent word opens a window of up
to LONGEST words. The windows are sorted, dealt by ranges of their order and merged there,
so the count of every phrase is a run of neighbours in the prefix-ordered stream. The
counts, again sorted, are then walked twice in step with the chain of phrases that each one
extends: in suffix order for the counts of its endings, in prefix order for those of its
beginnings; the same walks tell which phrases a longer one stands for.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.llm.shared import cut_lineage, ensure_checkpoint_dir, whole_text

LONGEST = 5
LEAST = 100
TOP = 2000
#: A longer phrase stands for a shorter one from this share (in hundredths) of its count.
SHARE = 100
#: Words whose windows a task sorts at a time, and words of a range whose windows a task merges.
CHUNK_WORDS = 1_500_000
RANGE_WORDS = 3_000_000
#: Most frequent words whose numbers are broadcast; they come to a few MB.
COMMON_WORDS = 1 << 18
#: Places of each chunk from which the bounds of the ranges are drawn: only the balance of tasks hangs on them.
SAMPLED_PLACES = 64
_SLICE = 1 << 22
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_UPPER + b"\t" + _BREAKS, _UPPER.lower() + b" " + b"\n" * len(_BREAKS))
_NOTHING, _BREAK, _FIRST = 0, 1, 2
_CHUNK = "chunk string, lang string, own long, tokens binary, words array<string>, counts array<long>"


class _Sequence:
    """Words of one language as numbers in order of appearance, 1 for a break."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(itertools.count(_FIRST).__next__, {b"": _NOTHING, b"\n": _BREAK})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, plain: bytes) -> None:
        words = plain.replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words))
        self.parts.append(codes[codes != _NOTHING])
        self.size += len(self.parts[-1])

    def taken(self, ends: bool) -> dict:
        """The row of what is held; inside a text the last words only follow, and open the next row's windows."""
        codes, words = np.concatenate([np.empty(0, np.uint32), *self.parts]), list(self.numbers)
        own = len(codes) if ends else max(0, len(codes) - LONGEST + 1)
        counts = np.bincount(codes[:own], minlength=len(words))[_FIRST:]
        rest = b" ".join(words[c] for c in codes[own:])
        self.__init__()
        if rest:
            self.add(rest)
        return {"own": own, "tokens": codes.tobytes(), "words": [w.decode("utf-8", "replace") for w in words[_FIRST:]], "counts": counts.tolist()}


def _slices(plain: bytes) -> Iterator[bytes]:
    """The text in parts that end at a space or break."""
    start = 0
    while len(plain) - start > _SLICE:
        cuts = [x for x in (plain.find(b" ", start + _SLICE), plain.find(b"\n", start + _SLICE)) if x >= 0]
        if not cuts:
            break
        yield plain[start : min(cuts) + 1]
        start = min(cuts) + 1
    yield plain[start:]


def _chunks(chunk_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Sequence] = defaultdict(_Sequence)
        names = (f"{TaskContext.get().partitionId()}-{k}" for k in itertools.count())

        def row(lang: str, ends: bool) -> pa.RecordBatch:
            own = {"chunk": next(names), "lang": lang, **held[lang].taken(ends)}
            return pa.RecordBatch.from_pylist([own], _chunk_schema())

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for part in _slices(text.as_py().encode("utf-8", "surrogatepass").translate(_PLAIN)):
                    held[lang].add(part)
                    if held[lang].size >= chunk_words:
                        yield row(lang, False)
                held[lang].add(b"\n")
                if sum(s.size for s in held.values()) >= 2 * chunk_words:
                    for name in list(held):
                        yield row(name, True)
                        del held[name]
        for name in list(held):
            yield row(name, True)

    return rows


def _chunk_schema() -> pa.Schema:
    return pa.schema(
        [("chunk", pa.string()), ("lang", pa.string()), ("own", pa.int64()), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
    )


def _numbered(common):
    """Chunks in numbers of the vocabulary; a rarer word ends a piece just as a break does.

    `common` holds the numbers of the most frequent words by language; those of other words,
    if there are any, stand in the columns pos and id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                codes = np.frombuffer(row.column("tokens")[0].as_buffer(), np.uint32)
                get = common.value.get(row.column("lang")[0].as_py(), {}).get
                words = row.column("words")[0].as_py()
                to = np.zeros(len(words) + _FIRST, np.uint32)
                to[_FIRST:] = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
                if "pos" in batch.schema.names and row.column("pos")[0].is_valid:
                    to[row.column("pos").flatten().to_numpy() + _FIRST] = row.column("id").flatten().to_numpy()
                now = to[codes]
                stays = (now != 0) | (np.concatenate([[1], now[:-1]]) != 0)
                own = int(stays[: row.column("own")[0].as_py()].sum())
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([now[stays].tobytes()], pa.binary())], ["own", "ids"])

    return rows


def windows(ids: np.ndarray, own: int, backward: bool = False) -> np.ndarray:
    """Columns of up to LONGEST numbers from each of the first `own` places on, filled up with 0."""
    near = np.zeros((LONGEST, own), np.uint32)
    padded = np.concatenate([np.zeros(LONGEST, np.uint32), ids, np.zeros(LONGEST, np.uint32)])
    for k in range(LONGEST):
        start = LONGEST - k if backward else LONGEST + k
        near[k] = padded[start : start + own]
        if k:
            near[k][near[k - 1] == 0] = 0
    return near[:, near[0] != 0]


def in_order(columns: np.ndarray) -> np.ndarray:
    """Places of the columns in the order of their numbers."""
    bits = int(columns.max(initial=1)).bit_length()
    wide = columns.astype(np.uint64)
    groups = ((0, 1, 2), (3, 4)) if 3 * bits <= 64 else ((0, 1), (2, 3), (4,))
    keys = []
    for group in groups:
        key = np.zeros(columns.shape[1], np.uint64)
        for k in group:
            key = key << np.uint64(bits) | wide[k]
        keys.append(key)
    return np.lexsort(keys[::-1])


def _changes(columns: np.ndarray) -> np.ndarray:
    """Whether each column differs from the one before; the first does."""
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    return new


def _as_keys(columns: np.ndarray) -> np.ndarray:
    """The columns as byte strings of the same order."""
    return np.ascontiguousarray(columns.T.astype(">u4")).view(f"S{4 * LONGEST}").ravel()


def _packed(columns: np.ndarray, counts: np.ndarray) -> bytes:
    rows = np.ascontiguousarray(np.vstack([columns, counts[None].astype(np.uint32)]))
    planes = np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1, 4).transpose(0, 2, 1))
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, n * 4 * (LONGEST + 1), codec="zstd"), np.uint8).reshape(LONGEST + 1, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32).reshape(LONGEST + 1, n)


def _blocks(bounds: np.ndarray):
    """Rows (part, n, block): the sorted, counted windows of a chunk, cut at the bounds of the ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids in zip(batch.column("own").to_pylist(), batch.column("ids"), strict=True):
                near = windows(np.frombuffer(ids.as_buffer(), np.uint32), own)
                near = near[:, in_order(near)]
                start = np.flatnonzero(_changes(near)) if near.shape[1] else np.empty(0, np.int64)
                counts, near = np.diff(np.append(start, near.shape[1])), near[:, start]
                cuts = [0, *np.searchsorted(_as_keys(near), bounds, "left").tolist(), near.shape[1]]
                met = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
                blocks = [_packed(near[:, cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in met]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met, pa.int32()), pa.array([cuts[k + 1] - cuts[k] for k in met], pa.int32()), pa.array(blocks, pa.binary())], ["part", "n", "block"]
                )

    return rows


def _merged(least: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """Counts of the phrases of a range; at its ends also smaller ones, which the next range adds to."""
        both = np.concatenate([_unpacked(b, n) for b, n in zip(rows["block"], rows["n"], strict=True)], axis=1)
        both = both[:, in_order(both[:LONGEST])]
        near, counts = both[:LONGEST], both[LONGEST].astype(np.int64)
        keys, totals = [], []
        for m in range(1, LONGEST + 1):
            start = np.flatnonzero(_changes(near[:m]))
            total = np.add.reduceat(counts, start)
            good = total >= least
            good[[0, -1]] = True
            good &= near[m - 1][start] != 0
            keys += [k.tobytes() for k in np.ascontiguousarray(near[:m, start[good]].T.astype(">u4"))]
            totals += total[good].tolist()
        return pd.DataFrame({"key": keys, "f": totals})

    return merge


def _turned(key: bytes) -> bytes:
    """The same numbers from last to first."""
    return np.frombuffer(key, ">u4")[::-1].tobytes()


def chains(keys: list[bytes], counts: list[int]) -> Iterator[list[tuple[bytes, int]]]:
    """For each of the sorted keys the keys it extends, with their counts, shortest first."""
    above: list[tuple[bytes, int]] = []
    for key, n in zip(keys, counts, strict=True):
        while above and not key.startswith(above[-1][0]):
            above.pop()
        yield list(above)
        above.append((key, n))


def _dealt(bounds: np.ndarray, turned: bool):
    """Rows of a part: its own phrases, and as guests those of earlier parts that some of its phrases may extend."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            order = [_turned(k) for k in rows["key"]] if turned else [bytes(k) for k in rows["key"]]
            first = np.searchsorted(bounds, np.array(order, f"S{4 * LONGEST}"), "right")
            last = np.searchsorted(bounds, np.array([k.ljust(4 * LONGEST, b"\xff") for k in order], f"S{4 * LONGEST}"), "right")
            again = np.repeat(np.arange(len(rows)), last - first + 1)
            out = rows.iloc[again].reset_index(drop=True)
            out["part"] = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]) if len(rows) else []
            out["guest"] = out["part"].to_numpy() != first[again]
            yield out

    return deal


#: SQL: floor(1000*a*n/(l*r)) of every cut, in decimals that hold the products.
EXACT = """zip_with(heads, tails, (x, y) -> (cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0)) * 1000)
  div (cast(x AS decimal(19, 0)) * cast(y AS decimal(19, 0))))"""
_WALKED = "key binary, f long, tails array<long>, heads array<long>, stands_for binary"


def _walk(turned: bool):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Own phrases with the counts along their chain, and the phrase before if the last word adds nothing."""
        rows = rows.assign(order=[_turned(k) for k in rows["key"]] if turned else [bytes(k) for k in rows["key"]]).sort_values("order")
        out = []
        known = [None] * len(rows) if turned else rows["tails"].tolist()
        for key, order, f, guest, tails, above in zip(rows["key"], rows["order"], rows["f"], rows["guest"], known, chains(rows["order"].tolist(), rows["f"].tolist()), strict=False):
            if guest:
                continue
            along = [n for _, n in above]
            before = None
            if len(order) > 8 and 100 * int(f) >= SHARE * along[-1]:
                before = _turned(above[-1][0]) if turned else above[-1][0]
            out.append((key, f, along[::-1] if turned else tails, None if turned else along, before))
        return pd.DataFrame(out, columns=["key", "f", "tails", "heads", "stands_for"])

    return walk


def _walked(counts: DataFrame, bounds: np.ndarray, turned: bool) -> DataFrame:
    rows = counts if turned else counts.select("key", "f", "tails")
    kind = "key binary, f long, " + ("" if turned else "tails array<long>, ") + "part int, guest boolean"
    return rows.mapInPandas(_dealt(bounds, turned), kind).groupBy("part").applyInPandas(_walk(turned), _WALKED)


def _in_sorted_order(rows: DataFrame, *by: str) -> DataFrame:
    """The rows with their place in the order as `id`, from 1."""
    placed = cut_lineage(rows.orderBy(*by).withColumn("at", F.monotonically_increasing_id()))
    block = F.shiftright("at", 33)
    sizes = placed.groupBy(block.alias("block")).count()
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(starts), block == F.col("block")).select(*rows.columns, at.alias("id"))


def _bounds(numbered: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of ranges of about equal size, in prefix and in suffix order; they come to 20 bytes a range."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids in zip(batch.column("own").to_pylist(), batch.column("ids"), strict=True):
                for backward in (False, True):
                    near = windows(np.frombuffer(ids.as_buffer(), np.uint32), own, backward)
                    near = near[:, :: max(1, -(-near.shape[1] // SAMPLED_PLACES))]
                    keys = [k.tobytes() for k in near.T.astype(">u4")]
                    yield pa.RecordBatch.from_arrays([pa.array([backward] * len(keys), pa.bool_()), pa.array(keys, pa.binary())], ["backward", "place"])

    places = cut_lineage(numbered.mapInArrow(sample, "backward boolean, place binary"))
    found = []
    for backward in (False, True):
        own = _in_sorted_order(places.where(F.col("backward") == backward).select("place"), "place")
        step = max(1, -(-own.count() // parts))
        cuts = own.where((F.col("id") % step == 0)).select("place").collect()
        found.append(np.unique(np.array([bytes(r["place"]) for r in cuts], f"S{4 * LONGEST}")))
    return found[0], found[1]


def _vocabulary(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words counted at least `least` times, numbered from 1 in their order."""
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return _in_sorted_order(frequent, "lang", "word")


def _in_numbers(chunks: DataFrame, words: DataFrame, vocabulary: DataFrame, common_words: int) -> DataFrame:
    """(own, ids) of every chunk: the most frequent words by a broadcast of at most `common_words`, others by a join."""
    first = vocabulary.orderBy(F.desc("f"), "id").limit(common_words).collect()
    common: dict[str, dict[str, int]] = defaultdict(dict)
    for x in first:
        common[x["lang"]][x["word"]] = x["id"]
    known = chunks.select("chunk", "lang", "own", "tokens", "words")
    if len(first) == common_words:
        last = first[-1]
        others = vocabulary.where((F.col("f") < last["f"]) | ((F.col("f") == last["f"]) & (F.col("id") > last["id"])))
        ids = words.join(others.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
        known = known.join(ids, "chunk", "left").select(*known.columns, F.col("ids.pos").alias("pos"), F.col("ids.id").alias("id"))
    shared = chunks.sparkSession.sparkContext.broadcast(dict(common))
    return known.mapInArrow(_numbered(shared), "own long, ids binary")


def phrase_counts(docs: DataFrame, least: int = LEAST, chunk_words: int = CHUNK_WORDS, range_words: int = RANGE_WORDS, common_words: int = COMMON_WORDS):
    """Phrases with their counts along both orders, the vocabulary, and words by language.

    Gives (phrases, vocabulary, totals): phrases (key, f, tails, heads, stands_for) of one to
    LONGEST words counted at least `least` times, where the key has the words' numbers,
    heads the counts of its first 1, 2, ... words, tails those of what follows them, and
    stands_for is a key one word shorter that it stands for (rows with only that may repeat a key).
    """
    spark: SparkSession = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/phrases-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    chunks = kept(texts.mapInArrow(_chunks(chunk_words), _CHUNK), "chunks")
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x"))
    words = words.select("chunk", "lang", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    vocabulary = kept(_vocabulary(words, least), "vocabulary")
    numbered = kept(_in_numbers(chunks, words, vocabulary, common_words), "numbered")
    places = numbered.agg(F.sum("own")).first()[0] or 0
    forward, backward = _bounds(numbered, max(1, -(-places // range_words)))
    blocks = numbered.mapInArrow(_blocks(forward), "part int, n int, block binary")
    counts = blocks.groupBy("part").applyInPandas(_merged(least), "key binary, f long")
    counts = cut_lineage(counts.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    ends = cut_lineage(_walked(counts, backward, True))
    of_ends = ends.where("stands_for is not null").withColumns({c: F.lit(None).cast("array<long>") for c in ("tails", "heads")})
    return cut_lineage(_walked(ends, forward, False).unionByName(of_ends)), vocabulary, totals


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, chunk_words: int = CHUNK_WORDS, range_words: int = RANGE_WORDS, common_words: int = COMMON_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best `top` phrases.

    Words are runs of other than space and tab within pieces between breaks, A-Z lower-cased.
    A phrase has 2 to LONGEST words and at least `least` occurrences (a); of its cuts the one
    of lowest score floor(1000*a*n/(l*r)) counts, then the earliest. A phrase that a longer
    one stands for is left out: one word more suffices to look at, since counts fall with
    length. A null lang counts as `und`, a null text as empty; repeated rows count each; ids
    and other columns are not read; an empty table gives no rows. Score, count and phrase
    (in byte order) settle all ties.
    """
    phrases, vocabulary, totals = phrase_counts(docs, least, chunk_words, range_words, common_words)
    stood_for = phrases.where("stands_for is not null").select(F.col("stands_for").alias("key")).distinct()
    left = phrases.where("size(heads) > 0").join(stood_for, "key", "left_anti").select("key", F.col("f").alias("a"), "heads", "tails")
    number = F.conv(F.hex(F.substring("key", 4 * F.col("k") - 3, 4)), 16, 10).cast("long")
    spelt = left.select("key", F.explode(F.sequence(F.lit(1), (F.octet_length("key") / 4).cast("int"))).alias("k"))
    spelt = spelt.withColumn("id", number).join(vocabulary, "id").groupBy("key")
    spelt = spelt.agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("k", "word"))).alias("words"))
    named = left.join(spelt, "key").join(totals, "lang").withColumn("phrase", F.array_join(F.col("words.word"), " "))
    scored = named.withColumn("scores", F.expr(EXACT)).withColumn("score", F.array_min("scores"))
    cut = (F.array_position("scores", F.col("score")) - 1).cast("int")
    scored = scored.select("lang", "phrase", "a", F.get("heads", cut).alias("l"), F.get("tails", cut).alias("r"), "n", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
