from pyspark.sql import functions as F

from cohortloom.operators import cohorts, sizing


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "person_id long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_any_flag_is_the_union_of_the_flags(spark, rows):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (3, 1, 1), (4, None, None)], "person_id long, a int, b int")
    union = cohorts.union_distinct([cohorts.any_flag(df, [f]) for f in ("a", "b")])
    assert rows(cohorts.any_flag(df, ["a", "b"])) == rows(union) == [(1,), (3,)]
    assert rows(cohorts.flagged(df, ["a", "b"])) == [(1,), (3,), (3,)]


def test_carriers_filter_before_explode(spark, rows):
    df = spark.createDataFrame([("v", [1, 2]), ("w", [2, 3]), ("v", [5]), ("v", [])], "vid string, person_ids array<long>")
    assert rows(cohorts.carriers(df, ["v"])) == [(1,), (2,), (5,)]


def test_carrier_list_is_broadcast_only_when_counted_small(spark):
    left = ids(spark, range(50))
    small = cohorts.keep_members(left, sizing.broadcast_if_small(ids(spark, [1, 2]), max_rows=2))
    large = cohorts.keep_members(left, sizing.broadcast_if_small(ids(spark, [1, 2, 3]), max_rows=2))
    assert ["strategy=broadcast" in sizing.broadcast_if_small(ids(spark, [1, 2]), n)._jdf.queryExecution().analyzed().toString() for n in (1, 2)] == [False, True]
    assert "BroadcastHashJoin" in plan(small)
    assert "SortMergeJoin" in plan(large)
    assert small.count() == 2 and large.count() == 3


def test_not_in_follows_sql(spark, rows):
    left = ids(spark, [1, 2, None])
    for listed in ([1], [1, None], [None], []):
        right = ids(spark, listed)
        expected = spark.sql("SELECT * FROM {l} WHERE person_id NOT IN (SELECT person_id FROM {r})", l=left, r=right)
        assert rows(cohorts.not_in(left, right)) == rows(expected), listed
    assert "NullAware" not in plan(cohorts.not_in(left, ids(spark, [1])))


def test_anti_join_by_two_routes(spark, rows):
    left, right = ids(spark, [1, 1, 2, None]), ids(spark, [2, 2, None])
    assert rows(cohorts.drop_members(left, right)) == rows(cohorts.drop_members_via_left(left, right)) == [
        (1,), (1,), (None,)]


def test_membership_flag_keeps_rows_and_column_order(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "person_id long, x string")
    flagged = cohorts.membership_flag(left, ids(spark, [1, 1]), "gene")
    assert flagged.columns == ["person_id", "x", "gene"]
    assert rows(flagged) == [(1, "a", 1), (1, "b", 1), (2, "c", 0)]
    assert rows(cohorts.membership_flag(flagged, ids(spark, [2]), "gene")) == [(1, "a", 0), (1, "b", 0), (2, "c", 1)]


def test_id_sets(spark, rows):
    a, b = ids(spark, [1, 2, 2, 3]), ids(spark, [2, 3, 3, 4])
    assert rows(cohorts.ids_in_both(a, b)) == [(2,), (3,)]
    assert rows(cohorts.ids_missing(a, b)) == [(1,)]


def test_single_row_groups_drop_the_whole_group(spark, rows):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, None)], "person_id long, answer string")
    assert rows(cohorts.single_row_groups(df)) == [(2, "A"), (3, None)]


def test_single_row_groups_fold_a_hot_group_before_the_shuffle(spark):
    hot = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 10).alias("person_id"),
                                      F.col("id").cast("string").alias("answer"))
    assert cohorts.single_row_groups(hot).count() == 200_000 - 66_667
    assert "partial_first" in plan(cohorts.single_row_groups(hot))
    assert "Window" not in plan(cohorts.single_row_groups(hot))


def test_carrier_rows_do_not_depend_on_the_size_of_the_list(spark, rows):
    from cohortloom.plans import crosstabs
    from cohortloom.sources.sample_tables import SampleWarehouse

    w = SampleWarehouse(spark, "/root/testdata/sf0.001", "short")
    found = w.person.select("person_id").filter("person_id % 3 = 0")
    small, large = (crosstabs.carrier_data(w, sizing.broadcast_if_small(found, n), [1586201]) for n in (1_000_000, 0))
    assert [rows(f) for f in small] == [rows(f) for f in large]
