"""The entry point: names, columns and results of queries against their SQL on the smallest tables."""

import glob
import os
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = sorted(n for n in entry.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    show = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "rule", "n"] and df.count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, sql, name):
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), sql.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_seed_means_are_those_of_the_sql_s_curves(spark, sql):
    """Against exact means of the ``bpb`` SQL: a mean of doubles, as in ``seed_ranges``' SQL, depends on their order where it is a half."""
    seeds = {}
    for version, held_set, _, x in sql.execute(f"select version, held_set, seed, bpb from ({entry.oracle_sql()['bpb']})").fetchall():
        seeds.setdefault((version, held_set), []).append(Decimal(str(x)))
    means = {k: (sum(xs) / len(xs)).quantize(Decimal("0.0001"), ROUND_HALF_UP) for k, xs in seeds.items()}
    got = entry.queries()["seed_ranges"](spark, DATA).collect()
    assert {(r.version, r.held_set): (r.mean, r.low, r.high) for r in got} == {k: (float(means[k]), float(min(xs)), float(max(xs))) for k, xs in seeds.items()}
