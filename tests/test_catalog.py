"""Every registered query against its SQL at the smallest scale."""

import itertools
import re

import pytest

import __spark_entry__ as entry
from check import compare, connect
from touchline import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result, _ = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert result == "ok"


@pytest.mark.parametrize("name", ["highlight_json", "highlight_labels", "highlight_texts"])
def test_highlights_broadcast_no_copies_suffixes_or_offsets(spark, name):
    """Rows that a list is spread out to, and one row per chunk, are more than Spark takes them for."""
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z*]", line + "x").start() for line in lines]
    sent = [
        line for at, first in enumerate(lines) if "BroadcastExchange" in first
        for line in itertools.takewhile(lambda x: x, (
            lines[i] if depth[i] > depth[at] else "" for i in range(at + 1, len(lines))
        ))
    ]
    assert sent and not [line for line in sent if "Generate explode" in line or "_pre_" in line]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
