"""Order statistics and neighbours, also with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtable.functions import ranks


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 50)) for _ in range(3000)] + [("hot", 7.0)] * 500
    rows += [("small", v) for v in (0.0, -1.5, 3.0)] + [("one", 4.25)]
    return rows


def test_quantiles_equal_numpy(spark, numbers):
    df = spark.createDataFrame([*numbers, ("hot", None)], "k string, v double")
    found = {
        r["k"]: r for r in ranks.quantiles(df, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.999, "u": "upper"}).collect()
    }
    for key in ("hot", "small", "one"):
        values = [v for k, v in numbers if k == key]
        row = found[key]
        assert row["counted"] == len(values)
        for name, p in (("a", 5), ("m", 50), ("z", 99.9)):
            assert row[name] == pytest.approx(float(np.percentile(values, p)), abs=1e-9)
        assert row["u"] == sorted(values)[len(values) // 2]
        assert row["lowest"] == min(values) and row["highest"] == max(values)


def test_value_range_is_monotone(spark):
    values = sorted([-1e9, -3.0, -1.0, -1e-7, 0.0, 1e-9, 0.4999999, 0.5, 1.0, 1.9999999999, 2.0, 1e12])
    df = spark.createDataFrame([(v,) for v in values], "v double").select(ranks.value_range(F.col("v")).alias("b"))
    found = [r["b"] for r in df.collect()]
    assert found == sorted(found)


def test_previous_in_group_equals_lag(spark):
    rng = random.Random(3)
    rows = [("same" if rng.random() < 0.5 else f"k{i % 40}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long")
    found = {r["i"]: r["p"] for r in ranks.previous_in_group(df, "k", "i", "i", "p", width=64).collect()}
    last = {}
    for k, i in rows:
        assert found[i] == last.get(k)
        last[k] = i


def test_dense_index_numbers_every_row_once(spark):
    df = spark.createDataFrame([(i % 3 == 0, i) for i in range(900)], "g boolean, s long")
    out = ranks.dense_index(df, "g", "s", "i", "n", buckets=8).collect()
    for g in (True, False):
        found = sorted(r["i"] for r in out if r["g"] == g)
        assert found == list(range(len(found)))
        assert {r["n"] for r in out if r["g"] == g} == {len(found)}


def test_describe_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    found = {r["k"]: r for r in ranks.describe(df, ["k"], "v", 4).collect()}
    assert found["a"]["median"] == 1.5 and found["b"]["counted"] == 0 and found["b"]["mean"] is None
