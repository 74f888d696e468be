"""Every registered query against its SQL in DuckDB, with and without broadcast joins."""

import duckdb
import pytest

import __spark_entry__ as entry
from cohortloom.operators import joins, sizing
from cohortloom.verification.oracle import ORACLE
from cohortloom.verification.queries import QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ["customer", "orders", "nation"]
# Joins of every kind, repeated with all broadcasts off.
SHUFFLED = ["cohort_person_scan", "person_demographics", "not_in_scan", "membership_flag", "breakdown_full_join",
            "sex_distribution", "question_tables_by_cohort", "subgroup_quantity", "ordered_crosstab_noncarriers",
            "multinomial_fit"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected
    assert expected, "a query without rows checks nothing"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("EvalPython" in plan) == (name == "multinomial_pvalues")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", SHUFFLED)
def test_query_matches_sql_without_broadcasts(spark, duck, name, monkeypatch):
    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (0,))
    monkeypatch.setattr(joins.lookup_names, "__defaults__", (0,))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compare(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["age_group", "n_people", "percent"]
