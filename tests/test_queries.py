"""Every registered query against its SQL on the smallest tables; values by value, floats to the places they are rounded to."""

import glob
import math
import os
import sys
import warnings
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__ as entry
from raingrid.plans.registry import ORACLES, QUERIES
from raingrid.sources.shared import shared_folder

DATA = "/root/testdata/sf0.001"

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return float(x) if isinstance(x, (int, float, bool)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in ROWS_ONLY:
        assert got
        return
    cursor = sql.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got), key=str)
    assert have == want


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


def test_unit_scale_reads_all_of_part(spark):
    assert "% 8" not in QUERIES["unit_scale"](spark, DATA)._jdf.queryExecution().toString()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"day", "daily_mean", "valid_hours", "centred_mean"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_core_queries_stay_where_a_library_of_the_optional_part_is_lacking(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("raingrid.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_folder(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/y"}, sparkContext=context)) == "hdfs://x/y"


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["point_metrics_by_time"](spark, DATA)._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_discount:double" in plan
    assert "Python" not in plan and "Pandas" not in plan
