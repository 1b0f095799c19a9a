"""Quality rules: fixed counts and a hashed n-gram logistic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from roomtable.llm.shared import whole_text, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Labelled rows of each class that the classifier is fitted on, at most.
ROWS_PER_CLASS = 1000
#: Tasks that make the vectors of the labelled texts.
FIT_TASKS = 32
#: A text whose probability of being good is lower is rejected.
KEEP_FROM = 0.2
BUCKET_BITS = 14
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20
_SCALE = np.float32(30.0)
_ROUNDS = 120

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ANSWER = StructType([StructField(name, LongType()) for name in MEASURES] + [StructField("base_failed", BooleanType()), StructField("probability", DoubleType()), StructField("kept", BooleanType())])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    key = ids[:n].copy()
    for i in range(1, WINDOW):
        key = (key ^ (key >> np.uint64(29))) * _FACTOR + ids[i : i + n]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Windows of one hash exist, so the windows are named exactly: pairs of names of half the width.
    name, width = ids.astype(np.int64), 1
    while width < WINDOW:
        pair = name[:-width] * (len(name) + len(known) + 1) + name[width:]
        name, width = np.unique(pair, return_inverse=True)[1], 2 * width
    twice = np.bincount(name)[name] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The counts named in MEASURES."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def _bucket(key: np.ndarray, salt: int) -> np.ndarray:
    return ((key + np.uint64(salt)) * _FACTOR >> np.uint64(64 - BUCKET_BITS)).astype(np.intp)


def ngram_buckets(text: str, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(block, buckets) of the word 1- and 2-grams (block 0) and the 3- to 5-byte grams (block 1).

    Long texts come in slices, so memory does not follow the longest text.
    """
    for k in range(0, len(words), _SLICE):
        part = words[k : k + _SLICE + 1]
        own = np.fromiter(map(crc32, part), np.uint64, len(part))
        yield 0, _bucket(own[:_SLICE], 1)
        yield 0, _bucket((own[:-1] << np.uint64(32)) | own[1:], 2)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for k in range(0, len(raw), _SLICE):
        byte = raw[k : k + _SLICE + 4].astype(np.uint64)
        gram = byte
        for n in (2, 3, 4, 5):
            gram = (gram[:-1] << np.uint64(8)) | byte[n - 1 :]
            if n > 2 and len(gram):
                yield 1, _bucket(gram[:_SLICE], n)


@dataclass(frozen=True)
class Classifier:
    """Weights by (block, bucket), a bias, and the slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: str, words: list[bytes]) -> float:
        """Calibrated probability that the text is good; no n-gram leaves the prior."""
        total, count = np.zeros(2), np.zeros(2)
        for block, buckets in ngram_buckets(text, words):
            total[block] += self.weights[block, buckets].sum(dtype=np.float64)
            count[block] += len(buckets)
        margin = self.bias + float((total / np.maximum(count, 1)).sum()) * float(_SCALE)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(good, places, shares): the sparse n-gram shares of a text."""
    for batch in batches:
        rows = []
        for text, good in zip(batch["text"], batch["good"], strict=True):
            counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
            for block, buckets in ngram_buckets(text, words_of(text)):
                counts[block] += np.bincount(buckets, minlength=1 << BUCKET_BITS)
            shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            places = np.flatnonzero(counts)
            rows.append((bool(good), places.astype(np.int32).tobytes(), shares.ravel()[places].astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["good", "places", "shares"])


def _fit(good: np.ndarray, places: list[np.ndarray], shares: list[np.ndarray], prior: float) -> Classifier:
    """Regularised logistic regression by accelerated gradient steps; Platt's calibration on every fifth row."""
    held = np.arange(len(good)) % 5 == 4
    if len(set(good[~held])) < 2 or len(set(good[held])) < 2:
        return Classifier(np.zeros((2, 1 << BUCKET_BITS), np.float32), 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    sizes = np.array([len(p) for p in places])
    row, column, value = np.repeat(np.arange(len(good)), sizes), np.concatenate(places), np.concatenate(shares) * _SCALE
    fit = ~held[row]
    row_f, column_f, value_f = row[fit], column[fit], value[fit]
    weight, first, second, bias = np.zeros(2 << BUCKET_BITS), np.zeros((2 << BUCKET_BITS) + 1), np.zeros((2 << BUCKET_BITS) + 1), 0.0
    share = np.where(good, 0.5 / max(good[~held].sum(), 1), 0.5 / max((~good[~held]).sum(), 1)) * ~held
    for step in range(1, _ROUNDS + 1):
        margin = np.bincount(row_f, value_f * weight[column_f], len(good)) + bias
        miss = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - good) * share
        slope = np.append(np.bincount(column_f, value_f * miss[row_f], len(weight)) + 1e-5 * weight, miss.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weight, bias = weight - move[:-1], bias - float(move[-1])
    margin = (np.bincount(row, value * weight[column], len(good)) + bias)[held]
    truth = good[held].astype(float)
    aim = np.where(truth > 0, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # damped Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - aim) * margin).sum() + a - 1, (p - aim).sum() + 0.01 * b])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin**2).sum() + 1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    own = truth.mean()
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(own / (1 - own))
    return Classifier(weight.reshape(2, -1).astype(np.float32), bias, float(max(a, 0.0)), float(b + odds))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Classifier:
    """Fit on at most `rows_per_class` labelled texts of each class, those of the smallest hash of doc_id.

    Labels with a null doc_id or quality are left out; of several labels of one id the
    lowest quality counts, and of several texts of one id the first in byte order. With one class or none at hand every text gets the share of
    good labels as its probability. The bound holds the driver's share of the work, however often an id
    repeats; the vectors are made on the executors, and no class is gathered to find its smallest hashes.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    first = lambda good: known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
    chosen = first(True).union(first(False))
    labelled = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = labelled.groupBy("doc_id", "good").agg(F.min("text").alias("text")).repartition(FIT_TASKS)
    vectors = texts.select("doc_id", "text", "good").mapInPandas(_vectors, "good boolean, places binary, shares binary")
    rows = sorted((x["good"], bytes(x["places"]), bytes(x["shares"])) for x in vectors.toLocalIterator())
    rows.sort(key=lambda x: crc32(x[1]))
    good = np.array([x[0] for x in rows], bool)
    return _fit(good, [np.frombuffer(x[1], np.int32) for x in rows], [np.frombuffer(x[2], np.float32) for x in rows], 0.5 if share is None else share)


def verdict_column(docs: DataFrame, model: Classifier, keep_from: float = KEEP_FROM):
    """Column of the struct `_ANSWER` over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                words = words_of(text)
                counts = measures(text, words)
                failed, probability = base_failed(counts[0], counts[4]), shared.value.probability(text, words)
                rows.append((*counts, failed, probability, not failed and probability >= keep_from))
            yield pd.DataFrame(rows, columns=_ANSWER.names)

    return F.pandas_udf(judge, _ANSWER)(whole_text())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of MEASURES, base_failed, probability and kept of every row.

    kept is false where the base rules fail, else whether the calibrated probability
    reaches KEEP_FROM. Null or blank texts have no words and fail. Ids may be null or
    repeated; each row is judged on its own. Other columns are not read.
    """
    return docs.select("doc_id", verdict_column(docs, train(docs, labels)).alias("verdict")).select("doc_id", "verdict.*")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all of their columns."""
    return docs.where(verdict_column(docs, train(docs, labels))["kept"])
