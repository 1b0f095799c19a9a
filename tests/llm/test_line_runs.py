"""Repeated lines against a plain version, and the runs themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from roomtable.llm import line_runs

DOCS = "doc_id long, text string, lang string, place string, t int, pos int, lines string, gone boolean, batch int, owner string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "p", 1, 2, "l", True, 3, "o") for i, t in rows], DOCS)


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain(rows):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key_of(line), set()).add(line_runs.LAST_PLACE if i is None else i)
    out = []
    for i, text in rows:
        place = line_runs.LAST_PLACE if i is None else i
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or len(held[key_of(x)]) < 2 or min(held[key_of(x)]) == place]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    lines = ["a line of prose", "A LINE of prose ", "\tÀ line of prose\r", "à line of prose", "short", "", "   ", "a second line\x0b", "123456789", "1234567890", "éééééééééé", "É" * 10, "\x1ca line of prose"]
    made = [(rng.randrange(30), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    long = "\n".join(f"line number {k % 3000} of a long text" for k in range(6000))
    return [*made, *made[:3], (None, "a line of prose\nmine alone, once"), (None, None), (7, None), (8, ""), (9, "\n"), (50, long), (51, long + "\nits own last line"), (-4, "1234567890")]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines_go_as_a_plain_version_says(spark, rows, batches, fanout):
    assert rows_of(line_runs.without_repeated_lines(docs_of(spark, rows), batches, fanout)) == plain(rows)


def test_no_rows_and_no_ids(spark):
    assert line_runs.without_repeated_lines(docs_of(spark, [])).count() == 0
    blank = [(None, "one whole line"), (None, "one whole line"), (None, None)]
    assert rows_of(line_runs.without_repeated_lines(docs_of(spark, blank))) == plain(blank)


def test_runs_merge_in_levels_without_another_shuffle(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    gone = []
    for k in range(5):
        batch = docs_of(spark, [(10 * k + i, f"line of batch {j} here\nline in all batches") for i, j in enumerate((k, k // 2))])
        gone.append(runs.add(line_runs.hashed_lines(batch)).count())
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert gone == [2, 3, 3, 3, 3]
    keys = line_runs.hashed_lines(docs_of(spark, [(99, "line of batch 1 here")])).groupBy("h1", "h2").count()
    plan = keys.join(spark.table(runs.runs()[0]).hint("merge"), ["h1", "h2"], "left")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text
    assert sum(spark.table(x).where("known is null").count() for x in runs.runs()) == 6
    runs.close()
    assert not spark.catalog.databaseExists(runs.schema)


def test_one_line_in_all_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the line of all\nown line number "), "id").alias("text"))
    out = line_runs.without_repeated_lines(docs)
    assert out.where("n_dropped = 1").count() == 2999 and out.where("text like 'own%'").count() == 2999
