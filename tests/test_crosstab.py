import pytest
from pyspark.sql import functions as F

from cohortloom.operators import crosstab, ranking


@pytest.fixture
def counted(spark):
    data = [("F: b", "g2", 4), ("F: a", "g1", 1), ("Q: z", "g1", 2), ("F: c", "g3", 5), ("F: a", "g3", 7), ("Other", "g2", 1)]
    return spark.createDataFrame(data, "category string, race_ethnicity string, count long")


def test_totals_and_order(counted):
    table = crosstab.with_totals(counted, order=["F: c", "absent", "F: b"])
    assert table.columns == ["row_number", "category", "g1", "g2", "g3", "Total (All Groups)"]
    assert [tuple(r) for r in table.orderBy("row_number").collect()] == [
        (1, "F: c", 0, 0, 5, 5), (2, "F: b", 0, 4, 0, 4),  # listed, in list order
        (3, "F: a", 1, 0, 7, 8), (4, "Q: z", 2, 0, 0, 2), (5, "Other", 0, 1, 0, 1),  # first appearance by group
        (6, "Total Participants", 3, 5, 12, 20)]


def test_given_groups_need_no_lookup_and_keep_the_total_whole(counted):
    table = crosstab.with_totals(counted, ["g1", "g9"]).orderBy("row_number").collect()
    assert tuple(table[-1])[1:] == ("Total Participants", 3, 0, 20)


def test_missing_group_and_category(spark):
    df = spark.createDataFrame([("a", None, 2), (None, "g", 3)], "category string, race_ethnicity string, count long")
    table = crosstab.with_totals(df).orderBy("row_number").collect()
    assert [tuple(r) for r in table] == [(1, None, 3, 0, 3), (2, "a", 0, 2, 2), (3, "Total Participants", 3, 2, 5)]


def test_long_form_split_and_shares(counted, rows):
    long = crosstab.long_counts(crosstab.wide(counted, ["g1", "g2", "g3"]), ["g1", "g2", "g3"])
    assert long.count() == 15
    split = crosstab.split_category(long)
    assert rows(split.filter("category = 'Other'").select("question_group", "answer").distinct()) == [("Other", None)]
    shares = crosstab.bar_shares(split.filter("question_group = 'Q'"))
    assert rows(shares.select("race_ethnicity", "share")) == [("g1", 1.0), ("g2", None), ("g3", None)]


def test_too_many_columns(spark, counted):
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="too many"):
            crosstab.wide(counted)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_long_totals_equal_the_wide_form(counted, rows):
    wide = crosstab.with_totals(counted, order=["F: c", "absent", "F: b"])
    back = wide.unpivot(["row_number", "category"], wide.columns[2:], "race_ethnicity", "count")
    long = crosstab.long_totals(counted, order=["F: c", "absent", "F: b"]).drop("__all_columns")
    assert rows(back) == rows(long.select(back.columns))


def test_long_form_has_no_label_limit(spark):
    """20,000 labels are rows; every label has a cell in both categories and a total."""
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS category", "concat('g', id) AS race_ethnicity", "id AS count")
    long = crosstab.long_totals(df)
    got = {r["category"]: (r["n"], r["s"], r["z"]) for r in long.groupBy("category").agg(
        F.count("*").alias("n"), F.sum("count").alias("s"), F.count_if(F.col("count") == 0).alias("z")).collect()}
    a, b = sum(range(0, 20_000, 2)), sum(range(1, 20_000, 2))
    assert got == {"a": (20_001, 2 * a, 10_001), "b": (20_001, 2 * b, 10_000), "Total Participants": (20_001, 2 * (a + b), 1)}
    assert crosstab.filled(df).count() == 40_000


def test_row_numbers_of_a_million_rows_need_no_single_window(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g"))
    numbered = ranking.row_numbers(df, ranking.ascending("g", "k"))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("], [__slice#" in line for line in windows)
    n = numbered.agg(F.count_distinct("row_number").alias("n"), F.min("row_number").alias("a"), F.max("row_number").alias("b")).first()
    assert tuple(n) == (1_000_000, 1, 1_000_000)
    pairs = numbered.orderBy("row_number").select("g", "k").limit(50_000).collect()
    assert [tuple(p) for p in pairs] == sorted((p["g"], p["k"]) for p in df.where("g = 0").collect())[:50_000]
