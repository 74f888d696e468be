import pytest
from pyspark.sql import functions as F

from cohortloom.operators import checks, counts, tables


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(
        [("lo",)] * 3 + [("hi",)] * 2 + [("odd 1",), ("odd 2",), ("PMI: Skip",), (None,)], "answer string")


def test_ordered_table_counts_before_mapping_levels(answers):
    got = [tuple(r) for r in tables.ordered_table(answers, "answer", ["lo", "mid", "hi"]).collect()]
    assert got[:2] == [(1, "lo", 3, "37.50"), (3, "hi", 2, "25.00")]
    assert got[2:5] == [(4, None, 1, "12.50")] * 3  # two unlisted answers and the missing one
    assert got[5] == (5, "Total", 8, "100.00")


def test_ordered_table_by_group_and_empty(spark, answers):
    by = tables.ordered_table(answers.withColumn("g", F.lit("a")), "answer", ["lo"], by=["g"])
    assert by.columns == ["g", "row_order", "answer", "count", "percent"]
    assert by.filter("answer = 'Total'").first()["count"] == 8
    empty = tables.ordered_table(answers.limit(0), "answer", ["lo"]).collect()
    assert [tuple(r) for r in empty] == [(3, "Total", 0, "0.00")]


def test_plain_table(answers):
    got = [(r.answer, r["count"]) for r in tables.ordered_table(answers).collect()]
    assert got == [(None, 1), ("hi", 2), ("lo", 3), ("odd 1", 1), ("odd 2", 1), ("Total", 8)]


def test_stratified_merges_unlisted_answers(spark, rows):
    df = spark.createDataFrame([("A", "lo"), ("A", "odd 1"), ("A", "odd 2"), ("B", "lo")], "g string, answer string")
    table = tables.stratified_np(df, "g", "answer", ["lo", "hi"])
    assert [(r[0], r[2], r[3], r[5]) for r in rows(table)] == [
        ("A", "lo", 1, "1 (33.33%)"), ("A", None, 2, "2 (66.67%)"), ("B", "lo", 1, "1 (100.00%)")]
    wide = tables.stratified_np_wide(table, "g", "answer", ["A", "B"]).collect()
    assert [tuple(r) for r in wide] == [(1, "lo", "1 (33.33%)", "1 (100.00%)"), (None, None, "2 (66.67%)", None)]


def test_stratified_from_counts(spark, rows):
    raw = spark.createDataFrame([("A", "lo")] * 5 + [("A", None)] * 2, "g string, answer string")
    counted = counts.count_by(raw, "g", "answer", name="count")
    assert rows(tables.stratified_np(raw, "g", "answer", ["lo"])) == rows(
        tables.np_from_counts(counted, "g", "answer", ["lo"]))


def test_group_distribution(spark):
    df = spark.createDataFrame([("b",)] * 2 + [("a",)] * 3 + [(None,)] * 3 + [("z",)], "g string")
    assert [tuple(r) for r in tables.group_distribution(df, "g", ["a", "b"]).collect()] == [
        ("a", 3, 33.33), ("b", 2, 22.22), (None, 3, 33.33), ("z", 1, 11.11)]
    assert [r.g for r in tables.group_distribution(df, "g").collect()] == [None, "a", "b", "z"]


def test_counts(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, None)], "person_id long, g string")
    assert rows(counts.count_by(df, "g")) == [("a", 2), (None, 2)]
    assert rows(counts.frequency(df, "g")) == [("a", 2)]
    assert rows(counts.distinct_by(df, "g")) == [("a", 1), (None, 2)]
    assert rows(df.agg(counts.distinct_count("g"))) == [(2,)]
    assert rows(df.limit(0).agg(counts.distinct_count("g"))) == [(0,)]
    assert rows(counts.duplicates(df)) == [(1, 2)]
    assert rows(counts.distinct_values(df, "g")) == [("a",), (None,)]
    assert [r["percent"] for r in counts.percent_table(df, "person_id").collect()] == [50.0, 25.0, 25.0]
    assert rows(counts.largest_group(df, "person_id")) == [(1, 2)]
    tie = spark.createDataFrame([("b",), ("a",)], "g string")
    assert rows(counts.largest_group(tie, "g")) == [("a", 1)]
    assert counts.head_rows(df, 1, ["person_id"]).count() == 1


def test_percent_of_everything_never_moves_all_groups_to_one_task(spark):
    table = counts.with_percent(counts.count_by(spark.range(100), "id"))
    assert "Window" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.agg(F.sum("percent")).first()[0] == pytest.approx(100.0)


def test_stack_by_name(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.5, 3)], "d double, i int")
    assert rows(counts.stack_by_name([a, b])) == [(1, "x", None), (3, None, 2.5)]


def test_reconcile(spark, rows):
    left, right = spark.range(3), spark.range(4)
    got = checks.reconcile([
        ("good", [checks.row_total(left), checks.row_total(spark.range(1))], [checks.row_total(right)]),
        ("bad", [checks.row_total(left)], [checks.sum_total(right, "id")])])
    assert rows(got) == [("bad", 3, 6, False), ("good", 4, 4, True)]
