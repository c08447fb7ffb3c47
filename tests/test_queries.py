"""Every query with SQL against DuckDB on the smallest tables, plus the others' shapes."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from heronry.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f" else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", ["split_lines", "interval_merge", "normalised_levels", "spectral_metrics"])
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_normalised_levels_are_at_level(spark, sf_dir):
    r = QUERIES["normalised_levels"](spark, sf_dir).agg({"rms": "max", "peak": "max"}).first()
    assert math.isclose(r["max(peak)"], 0.9, rel_tol=1e-6) and r["max(rms)"] <= 10 ** (-23 / 20) + 1e-6


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"dataset", "clips", "chars", "speakers"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_pushdown(spark, sf_dir):
    """Column pruning and filters reach the scan."""
    plan = QUERIES["long_turns_of_role"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
    plan = QUERIES["first_n_per_speaker"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
