"""Language-model scores by a weighted backoff automaton over corpus-wide counts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.llm.shared import ensure_checkpoint_dir, whole_text
from roomtable.llm.wordkeys import Words, grouped, pieces

#: Characters of text whose automaton one task builds; more for one text that is longer.
BUCKET_CHARS = 16_000_000
FOLDS = 5
HELD_FOLD = 1
#: Keys of the two marks that are no word: the end of a text, and the place before it.
END, START = 1, 2
_TURN = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 6_000_000
_ROWS = 100_000
#: Counts that are bundled at a time.
_BUNDLED = 1_000_000


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of tokens of each text): a key of each word, A-Z lower-cased, made odd, and END after each text."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for some in pieces(texts):
        words = Words(some)
        keys.append(np.insert(words.keys() | np.uint64(1), words.bounds[1:], np.uint64(END)))
        sizes.append(np.diff(words.bounds) + 1)
    return np.concatenate(keys), np.concatenate(sizes)


def pair_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token), made even; so the last bit tells words and pairs apart."""
    mixed = (before ^ (before >> np.uint64(32))) * _TURN
    return (((mixed << np.uint64(23)) | (mixed >> np.uint64(41))) * _TURN + keys) & ~np.uint64(1)


def previous(keys: np.ndarray) -> np.ndarray:
    """The token before each one; behind an END a text starts."""
    before = np.empty_like(keys)
    before[:1], before[1:] = START, keys[:-1]
    before[before == END] = START
    return before


def _marked(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Keys whose last bit, which all of a kind share, tells the known (training) rows."""
    return (keys & ~np.uint64(1)) | known


def _tally(marked: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, with their last bit again, and how often each occurs among the known rows; sorts in place."""
    marked.sort()
    fresh = np.ones(len(marked), bool)
    fresh[1:] = (marked[1:] ^ marked[:-1]) > np.uint64(1)
    starts = np.flatnonzero(fresh)
    own = np.add.reduceat((marked & np.uint64(1)).view(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return (marked[starts] & ~np.uint64(1)) | np.uint64(last), own


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, bucket, own): words and word pairs of a task's texts, by bucket.

    own is the count in training texts; n-grams of held-out texts come with 0, so their
    bucket learns the counts that others have. Counts go out after _FLUSH tokens.
    """
    held: dict[int, list] = {}

    def flush():
        while held:
            bucket, parts = held.popitem()
            for last in (1, 0):
                keys, own = _tally(np.concatenate([p[1 - last] for p in parts]), last)
                for k in range(0, len(keys), _ROWS):
                    part, n = keys[k : k + _ROWS].view(np.int64), min(_ROWS, len(keys) - k)
                    yield pa.RecordBatch.from_pydict(
                        {"key": part, "bucket": np.full(n, bucket, np.int32), "own": own[k : k + _ROWS].astype(np.int32)}
                    )

    waiting = 0
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        texts = batch.column("text").take(pa.array(order)).to_pylist()
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[order]
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
            key, sizes = token_keys(texts[a:b])
            known = np.repeat(train[a:b], sizes)
            held.setdefault(int(bucket[order[a]]), []).append((_marked(key, known), _marked(pair_keys(previous(key), key), known)))
            waiting += len(key)
            if waiting > _FLUSH:
                yield from flush()
                waiting = 0
    yield from flush()


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then their second bytes and so on: runs of equal bytes pack well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, counts): the counts of a bucket side by side, keys as steps from one to the next."""
    held: list[pa.RecordBatch] = []

    def flush():
        bucket, key, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("bucket", "key", "n"))
        held.clear()
        order = np.argsort(bucket, kind="stable")
        bucket, key, n = bucket[order], key[order].view(np.uint64), n[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True))
        keys = [_planes(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in bounds]
        return pa.RecordBatch.from_pydict(
            {"bucket": bucket[starts], "keys": pa.array(keys, pa.binary()), "counts": pa.array([_planes(n[a:b]) for a, b in bounds], pa.binary())}
        )

    waiting = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            waiting += batch.num_rows
        if waiting >= _BUNDLED:
            yield flush()
            waiting = 0
    if waiting:
        yield flush()


@dataclass(frozen=True)
class Scale:
    """Corpus-wide numbers: training tokens, distinct ones, training texts, and the strength of the prior."""

    tokens: int
    distinct: int
    texts: int
    strength: float

    def single(self, count: np.ndarray) -> np.ndarray:
        """log10 of the unigram estimate, additive with one half for each token and for unknown ones."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def prior_strength(bins: list[tuple[int, int]], once: int) -> float:
    """Pseudo-count whose backoff mass is what Good and Turing give to unseen pairs.

    bins: (contexts, uses of them together), of contexts used about equally often. The
    mass of a context used u times is m / (u + m) of its u tokens; all together shall be
    `once`, the number of pairs seen once.
    """
    total = sum(u for _, u in bins)
    if not total:
        return 1.0
    low, high = 1e-3, 1e9
    for _ in range(100):
        mid = math.sqrt(low * high)
        mass = sum(u * mid / (u / n + mid) for n, u in bins if n)
        low, high = (mid, high) if mass < once else (low, mid)
    return math.sqrt(low * high)


class Automaton:
    """States, arcs and failure arcs for the texts of one bucket.

    The empty state has an arc for each token, weighted with its unigram probability.
    Each token, and the place before a text, is a state too: it has an arc for each pair
    seen in training, weighted with the pair's probability under a Dirichlet prior of
    unigram shape, (count + m p) / (uses + m), and a failure arc to the empty state
    weighted m / (uses + m). The weights of a state add up to one. A token leads to its
    own state.
    """

    def __init__(self, words: np.ndarray, count: np.ndarray, arcs: np.ndarray, arc_count: np.ndarray, scale: Scale):
        """Keys ascend; words holds START, END and every word of the bucket."""
        self.scale, self.words, self.count = scale, words, count
        self.single = scale.single(count)
        # A word is a context each time it occurs; an end never is, a start once in each text.
        self.uses = np.where(words == START, scale.texts, np.where(words == END, 0, count)).astype(np.float64)
        self.fail = np.log10(scale.strength / (self.uses + scale.strength))
        self.arcs, self.arc_count = arcs, arc_count

    def walk(self, at: np.ndarray, state: np.ndarray, arc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unigram weight, weight) of each token of some texts, from left to right.

        The state is the token before, START at first. Where it has an arc for the next
        token the arc's weight is taken, else the failure arc's and then the empty
        state's arc. All states of a pass are known from the tokens (places `at` and
        `state` among the words, `arc` among the pairs), so the arcs of all are taken
        together.
        """
        single = self.single[at]
        weight = self.fail[state] + single
        count = self.arc_count[arc]
        found = np.flatnonzero(count)
        weight[found] = np.log10(count[found] / (self.uses[state[found]] + self.scale.strength) + 10.0 ** weight[found])
        return single, weight


def _amended(keys: np.ndarray, own: np.ndarray, news: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Own counts, replaced where the corpus has another count."""
    counts = own.copy()
    counts[np.searchsorted(keys, news[0])] = news[1]
    return counts


def _news(model: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the bundled words, and of the bundled pairs."""
    keys = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(_values(x, np.uint64)) for x in model["keys"]]])
    counts = np.concatenate([np.zeros(0, np.int64), *[_values(x, np.int64) for x in model["counts"]]])
    word = keys & np.uint64(1) == 1
    return [(keys[word], counts[word]), (keys[~word], counts[~word])]


def _scores(scale: Scale):
    def score(docs: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        key, sizes = token_keys(docs["text"].tolist())
        ends = np.cumsum(sizes)
        train = np.repeat(~docs["held_out"].to_numpy(bool), sizes)
        word_news, pair_news = _news(model)
        pairs = pair_keys(previous(key), key)
        place, arc = grouped(pairs)
        arcs = pairs[place]
        del pairs
        arc_count = _amended(arcs, np.bincount(arc[train], minlength=len(arcs)), pair_news)
        place, at = grouped(key)
        words = key[place]
        count = _amended(words, np.bincount(at[train], minlength=len(words)), word_news)
        start = int(np.searchsorted(words, START))
        words, count = np.insert(words, start, np.uint64(START)), np.insert(count, start, 0)
        at += at >= start
        state = np.empty_like(at)
        state[1:] = at[:-1]
        state[ends - sizes] = start
        automaton = Automaton(words, count, arcs, arc_count, scale)
        single, weight = automaton.walk(at, state, arc)
        known = np.add.reduceat((count[at] > 0).astype(np.int64), ends - sizes)
        bounds = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
        made = pd.DataFrame({
            "doc_id": docs["doc_id"].to_numpy(), "held_out": docs["held_out"].to_numpy(bool), "n_tokens": sizes, "n_known": known,
            "train_tokens": np.full(len(sizes), scale.tokens, np.int64),
            "base_score": [float(np.cumsum(single[a:b])[-1]) for a, b in bounds],
            "score": [float(np.cumsum(weight[a:b])[-1]) for a, b in bounds],
        })
        return made.astype({"doc_id": "Int64"})

    return score


def language_scores(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A bucket is the texts of one file split, cut by a hash of doc_id to about
    `bucket_chars` characters; the split keeps them in the task that counts them. Each
    task counts its words and word pairs, counts of one n-gram meet by its key, and only
    counts that differ from a bucket's own go back to the bucket. There the automaton of
    the bucket's n-grams is built and each text is walked once. A few sums are all that
    reaches the driver, and no task holds more than the n-grams of a bucket.

    Pairs are smoothed by a Dirichlet prior whose strength follows from the pairs seen
    once. Null or empty texts are one end token. A null doc_id counts as the text "" in
    the fold rule and stays null; repeated rows are counted and scored as often as they
    occur. Words, and pairs, are told apart by 63 bits of a hash. Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), held.alias("held_out"), split.alias("split"))
    size = plain.groupBy("split").agg(F.sum(F.length("text")).alias("chars"), F.sum((~F.col("held_out")).cast("long")).alias("texts")).agg(
        F.max("chars").alias("chars"), F.sum("texts").alias("texts")
    ).first()
    parts = max(1, math.ceil((size["chars"] or 0) / bucket_chars))
    part = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(parts))
    rows = plain.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out", F.pmod(F.xxhash64("split", part), F.lit(2**31 - 1)).cast("int").alias("bucket"))

    by_key = Window.partitionBy("key")
    known = rows.select("text", "held_out", "bucket").mapInArrow(_counts, "key long, bucket int, own int")
    known = known.select(
        "key", "bucket", "own", F.sum("own").over(by_key).alias("n"),
        (F.row_number().over(by_key.orderBy("bucket")) == 1).alias("first"),
    )
    seen_once = Observation()
    known = known.observe(seen_once, F.count_if(F.expr("key & 1 = 0 and first and n = 1")).alias("once"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/counts-{uuid.uuid4().hex}"
    known.where("n <> own or (key & 1 = 1 and first)").write.option("compression", "zstd").parquet(folder)
    once = seen_once.get["once"]
    known = spark.read.parquet(folder)
    words = known.where("key & 1 = 1 and first and n > 0")
    bins = words.groupBy(F.floor(2 * F.log2("n")).alias("bin")).agg(
        F.count("*").alias("words"), F.sum("n").alias("uses"), F.sum(F.when(F.col("key") == END, F.col("n")).otherwise(0)).alias("ends")
    ).collect()
    contexts = [(x["words"] - (x["ends"] > 0), x["uses"] - x["ends"]) for x in bins] + [(1, size["texts"] or 0)]
    scale = Scale(sum(x["uses"] for x in bins), sum(x["words"] for x in bins), size["texts"] or 0, prior_strength(contexts, once))
    news = known.where("n <> own").select("bucket", "key", "n").mapInArrow(_bundles, "bucket int, keys binary, counts binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("bucket").cogroup(news.groupBy("bucket")).applyInPandas(_scores(scale), schema)
