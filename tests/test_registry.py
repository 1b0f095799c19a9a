"""Every query against its SQL on the small tables, and the inventory."""

import re

import harness
import pytest

from roomtable.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
CHECKS = catalog.checks()


@pytest.fixture(scope="module")
def con():
    return harness.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = harness.spark_rows(QUERIES[name](spark, FOLDER))
    if name in CHECKS:
        assert got == harness.check_rows(con, CHECKS[name])
    else:
        assert got[1]


def test_inventory_is_covered():
    rows = {
        **{"S": 11, "P": 26, "J": 7, "A": 25, "W": 6, "I": 11, "M": 14, "L": 12, "C": 5, "T": 2, "U": 2}
    }
    wanted = {f"{letter}{i}" for letter, n in rows.items() for i in range(1, n + 1)}
    found = set(re.findall(r"[A-Z]\d+", " ".join(catalog.inventory().values())))
    assert wanted - found == set()


def test_result_types_are_plain(spark):
    for name in ("confusion_totals", "golden_balance", "primary_pass", "segment_facts"):
        kinds = {kind for _, kind in QUERIES[name](spark, FOLDER).dtypes}
        assert kinds <= {"bigint", "double", "string", "boolean"}
