"""Personal data: fixed patterns, and a semi-Markov random field that adds spans."""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from roomtable.llm.semicrf import Field, fit, regions, signed
from roomtable.llm.spanarrays import KINDS
from roomtable.llm.shared import hashed_sample, whole_text

#: Texts whose pattern matches the field is fitted on, and regions taken from them, at most.
SAMPLE_TEXTS = 600
SAMPLE_REGIONS = 600
#: Characters of the texts that are searched together; a longer text is searched alone.
CHARACTERS = 200_000

_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANSWER = StructType(
    [StructField(f"n_{kind}", LongType()) for kind in KINDS] + [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("clean", StringType())]
)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each '@' outwards, so a long run of letters is read once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        right = _EMAIL_RIGHT.match(text, at)
        if right:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, right.end()
                done = right.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches of the four fixed patterns, leftmost and not overlapping within a kind."""
    if not signed(text):
        return []
    found = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if not m[1]:
            continue
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def joined(spans: list[Span]) -> str:
    order = {kind: i for i, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def spans_of(texts: list[str], field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and with them those of the field that overlap no base span."""
    some, size = [], 0
    for text in itertools.chain(texts, [None]):
        if text is None or size + len(text) > CHARACTERS and some:
            bases = [base_spans(x) for x in some]
            for base, more in zip(bases, field.spans(some, [[(s, e) for _, s, e in x] for x in bases]), strict=True):
                yield base, [*base, *more]
            some, size = [], 0
        if text is not None:
            some.append(text)
            size += len(text)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """`spans_of` a single text."""
    return next(spans_of([text], field))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    pieces, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[2])):
        if start >= done:
            pieces += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*pieces, text[done:]])


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(piece, spans): regions that hold a base span, with the spans inside."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base = base_spans(text)
            places = sorted((s, i) for i, (_, s, _) in enumerate(base))
            for start, end in regions(text) if base else ():
                if end - start > 400:
                    continue
                held = sorted(i for _, i in places[bisect_left(places, (start, 0)) : bisect_left(places, (end, 0))])
                if inside := [f"{k}:{s - start}:{e - start}" for k, s, e in map(base.__getitem__, held) if e <= end]:
                    rows.append((text[start:end], ",".join(inside)))
        yield pd.DataFrame(rows, columns=["piece", "spans"])


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_regions: int = SAMPLE_REGIONS) -> Field:
    """Fit the field on pattern matches from a bounded sample, and on written variants of them.

    The sample is the texts with a digit or an '@' of the smallest hashes of doc_id, then
    their regions of the smallest hashes. Without any, the variants alone teach it.
    """
    likely = docs.where(F.col("text").rlike("[0-9@]"))
    texts = likely.join(F.broadcast(hashed_sample(likely, "doc_id", sample_texts)), "doc_id").select("text")
    found = texts.mapInPandas(_examples, "piece string, spans string").distinct()
    rows = found.orderBy(F.xxhash64("piece"), "piece").limit(sample_regions).collect()
    gold = []
    for piece, spans in sorted((x["piece"], x["spans"]) for x in rows):
        parts = [x.split(":") for x in spans.split(",")]
        gold.append((piece, [(k, int(s), int(e)) for k, s, e in parts]))
    return fit(gold)


def spans_column(docs: DataFrame, field: Field, clean: bool = False):
    """Column of the struct `_ANSWER` over the whole text; `clean` fills the masked text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, (base, every) in zip(batch, spans_of(batch, shared.value), strict=True):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(every), masked(text, every) if clean else None))
            yield pd.DataFrame(rows, columns=_ANSWER.names)

    return F.pandas_udf(search, _ANSWER)(whole_text())


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    The counts and the digest are of the base patterns; spans also has those the field
    adds. Offsets are code points, ends exclusive. Null or empty texts have no span and
    the digest of nothing. Ids may be null or repeated: each row stands alone. Other
    columns are not read.
    """
    return docs.select("doc_id", spans_column(docs, train(docs)).alias("found")).select("doc_id", "found.*").drop("clean")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with all columns; each span in the text is replaced by its kind in brackets. Null texts stay null."""
    column = F.when(F.col("text").isNotNull(), spans_column(docs, train(docs), clean=True)["clean"])
    return docs.withColumn("text", column)
