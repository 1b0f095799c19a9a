"""Main text of web pages by differencing each with the nearest page of its host."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from roomtable.llm.pagelines import Line, lines_of
from roomtable.llm.shared import cut_lineage

#: Pages of one host whose neighbours one task finds; a larger host is dealt to several.
NEIGHBOURS_AT_ONCE = 2000

#: Bytes that stand for a line; pages are compared two at a time, so few suffice.
_MARK = 6

#: Bits of a comparison's table that are kept at once.
TABLE_BITS = 1 << 27

#: Lines with as many places keep their mask.
_FREQUENT = 64

#: Signs of a line: shared with the nearest page; and also on most outlines of the host.
SHARED, USUAL = 1, 2

_BLOCKS = StructType(
    [StructField("outline", BinaryType()), StructField("marked", BooleanType()), StructField("places", ArrayType(IntegerType())), StructField("text", StringType())]
)


def line_marks(lines: list[Line]) -> list[bytes]:
    """A mark for each line of the page, equal for equal texts."""
    return [blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=_MARK).digest() for x in lines]


def _masks(b: list) -> Callable[[object], int]:
    """The places of a line in `b` as bits. Masks of frequent lines are kept, so few bits are."""
    places: dict[object, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    kept: dict[object, int] = {}

    def mask(x: object) -> int:
        if x in kept:
            return kept[x]
        bits = bytearray(len(b) // 8 + 1)
        for j in places.get(x, ()):
            bits[j >> 3] |= 1 << (j & 7)
        made = int.from_bytes(bits, "little")
        if len(places.get(x, ())) >= _FREQUENT:
            kept[x] = made
        return made

    return mask


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of `a` a number whose zero bits are the places of `b` where the common subsequence grows."""
    mask, full = _masks(b), (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & mask(x)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of `a` with each start of `b`."""
    row = 0
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_lines(a: list, b: list) -> set[int]:
    """Places in `a` of a longest common subsequence of lines.

    Rows of the table are numbers of one bit a line of `b`, so repeated lines cost no more
    than others. A table above TABLE_BITS is not kept: the first list is halved, the second cut
    where the lengths of both sides add up to most. Common heads and tails go first.
    """
    chosen: set[int] = set()
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            chosen.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            chosen.add(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 > 1 and (a1 - a0) * (b1 - b0) > TABLE_BITS:
            middle = (a0 + a1) // 2
            front = _lengths(a[a0:middle], b[b0:b1])
            back = _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(np.argmax(front + back))
            work += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
            continue
        rows = list(_rows(a[a0:a1], b[b0:b1]))
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                chosen.add(a0 + i)
    return chosen


def markup_blocks(lines: list[Line]) -> tuple[bool, list[int]]:
    """(marked, places): whether the page marks an article, and the lines its markup leaves.

    With a marked article these are its lines, otherwise all but those that are mostly
    links; what the markup frames as furniture is never among them.
    """
    marked = any(x.main and not x.framed for x in lines)
    return marked, [k for k, x in enumerate(lines) if not x.framed and (x.main if marked else not x.linked)]


def _marks_in(outline: bytes | None) -> list[bytes]:
    return [outline[k : k + _MARK] for k in range(0, len(outline or b""), _MARK)]


def _outlines(pages: pd.Series) -> pd.Series:
    return pd.Series([b"".join(line_marks(lines_of(page))) for page in pages], dtype=object)


def _blocks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for page in pages:
            lines = lines_of(page)
            marked, places = markup_blocks(lines)
            rows.append((b"".join(line_marks(lines)), marked, places, "\n".join(lines[k].text for k in places)))
        yield pd.DataFrame(rows, columns=_BLOCKS.names)


def _signs(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each line of an outline: 0, SHARED with the other outline, or shared and USUAL on the host."""
    for owns, others, usuals in batches:
        rows = []
        for own, other, usual in zip(owns, others, usuals, strict=True):
            lines = _marks_in(own)
            shared, usual_lines = common_lines(lines, _marks_in(other)), set(_marks_in(usual))
            rows.append([0 if k not in shared else USUAL if x in usual_lines else SHARED for k, x in enumerate(lines)])
        yield pd.Series(rows, dtype=object)


def usual_lines(outlines: DataFrame) -> DataFrame:
    """(host, usual): marks of the lines that stand on most outlines of a host, and on three at least.

    outlines: host, outline, one row for each outline. Lines are counted by host and mark, combined before
    the shuffle; those of a host are fewer than two outlines hold on average. Hosts go by their hash.
    """
    outlines = outlines.select(F.xxhash64("host").alias("host"), "outline")
    spots = F.sequence(F.lit(1), F.length("outline"), F.lit(_MARK))
    marks = F.array_distinct(F.transform(spots, lambda k: F.substring("outline", k, F.lit(_MARK))))
    lines = outlines.where(F.length("outline") > 0).select("host", F.explode(marks).alias("mark"))
    sizes = outlines.groupBy("host").agg(F.count("*").alias("outlines"))
    counted = lines.groupBy("host", "mark").agg(F.count("*").alias("n")).where("n >= 3").join(sizes, "host")
    usual = counted.where("2 * n > outlines").groupBy("host").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    return usual.select("host", F.aggregate("marks", F.expr("cast('' as binary)"), lambda x, y: F.concat(x, y)).alias("usual"))


def nearest(pages: DataFrame, at_once: int = NEIGHBOURS_AT_ONCE) -> DataFrame:
    """(key, other, host, part): the page of the same host whose path is next to it in path order.

    Of the two neighbours in path order it is the one with the longer common start, the
    earlier in a tie. Pages of one outline count once, so copies are no neighbours of each
    other. A host is cut to ranges of its paths by counts of path starts, and the ends of
    a range are handed to the next one, so no task sorts a whole host.
    """
    span = Window.partitionBy("host", "part").orderBy("path", "key")
    sides = pages.select(
        "key", "path", "host", "part", F.lag("key").over(span).alias("back"), F.lag("path").over(span).alias("back_path"),
        F.lead("key").over(span).alias("on"), F.lead("path").over(span).alias("on_path"),
    )
    edges = pages.groupBy("host", "part").agg(
        F.min_by(F.struct("path", "key"), F.struct("path", "key")).alias("low"), F.max_by(F.struct("path", "key"), F.struct("path", "key")).alias("high")
    )
    order = Window.partitionBy("host").orderBy("low")
    edges = edges.select("host", "part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    sides = sides.join(edges, ["host", "part"])
    back, back_path = F.coalesce("back", "before.key"), F.coalesce("back_path", "before.path")
    on, on_path = F.coalesce("on", "after.key"), F.coalesce("on_path", "after.path")

    def alike(other):
        """Length of the common start of two paths, in path parts and then in characters."""
        own, theirs = F.split("path", "/"), F.split(other, "/")
        same = F.zip_with(own, theirs, lambda x, y: x.eqNullSafe(y))
        upto = F.coalesce(F.expr("0") + F.array_position(same, False) - 1, F.lit(-1))
        return F.when(other.isNull(), F.lit(-2)).otherwise(F.when(upto < 0, F.size(own)).otherwise(upto))

    return sides.select("key", F.when(alike(back_path) >= alike(on_path), back).otherwise(on).alias("other"), "host", "part")


def main_texts(pages: DataFrame, at_once: int = NEIGHBOURS_AT_ONCE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`.

    The lines a page shares with the nearest page of its host, by longest common
    subsequence, are deleted. Inside a marked article that is one sign of two: the line
    must also stand on most outlines of the host, so quotes and near copies of articles
    stay. What the markup frames as navigation, advert, form or comment goes too. Null or blank html gives
    the empty text. Pages without a url, or alone on
    their host, have no neighbour and keep what the markup leaves. Repeated rows are
    treated alike; page_id may be null or repeated. Other columns are not read.

    Only blocks that the markup leaves go through the shuffle with a page, not its html.
    """
    page = F.coalesce(F.col("html"), F.lit(""))
    outline = F.pandas_udf(_outlines, BinaryType())(page)
    bare = F.lower(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"(/|\.html?|/index\.[a-z]+)$", "")
    # One page of each outline of a host takes part, under its first path.
    own = pages.select("url", outline.alias("outline")).where("url is not null")
    own = own.select(host.alias("host"), path.alias("path"), "outline").withColumn("key", F.xxhash64("host", "outline"))
    outlines = cut_lineage(own.groupBy("key").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.min("outline").alias("outline")))
    starts = outlines.select("host", "path", "key", F.substring("path", 1, 6).alias("start"))
    counts = starts.groupBy("host", "start").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("host").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("host", "start", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / at_once).alias("part"))
    dealt = starts.join(parts, ["host", "start"]).select("host", "path", "key", "part")
    hosts = parts.select("host", "part").distinct().withColumn("h", F.xxhash64("host"))
    usual = hosts.join(usual_lines(outlines).withColumnRenamed("host", "h"), "h").select("host", "part", "usual")
    pairs = nearest(dealt, at_once).where("other is not null").join(usual, ["host", "part"], "left").select("key", "other", "usual")
    both = pairs.join(outlines.select(F.col("key").alias("other"), F.col("outline").alias("other_outline")), "other")
    signs = F.pandas_udf(_signs, ArrayType(IntegerType()))("outline", "other_outline", "usual")
    by_key = both.drop("other").join(outlines.select("key", "outline"), "key").select("key", signs.alias("signs"))

    parsed = F.pandas_udf(_blocks, _BLOCKS)(page)
    facts = pages.select("page_id", "url", host.alias("host"), parsed.alias("page"))
    facts = facts.select("page_id", "url", F.xxhash64("host", "page.outline").alias("key"), "page.marked", "page.places", "page.text")
    joined = facts.join(by_key, "key", "left")
    goes_from = F.when(F.col("marked"), USUAL).otherwise(SHARED)
    kept = F.filter(F.split("text", "\n"), lambda _, k: F.coalesce(F.get("signs", F.get("places", k)), F.lit(0)) < goes_from)
    text = F.array_join(kept, "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
