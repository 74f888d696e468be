import pytest
from pyspark.sql import functions as F

from cohortloom.operators import counts, joins


def test_suffixes(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "person_id long, answer string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "person_id long, answer string")
    joined = joins.suffix_join(a, b, ["person_id"])
    assert joined.columns == ["person_id", "answer.x", "answer.y"]
    assert rows(joined) == [(1, "x", "p"), (1, "x", "q"), (2, "y", None)]
    assert joins.suffix_join(a, b, ["person_id"], suffixes=(".gene", ".list")).columns[1:] == ["answer.gene", "answer.list"]


def test_null_keys_match_only_on_request(spark, rows):
    a = spark.createDataFrame([(None, 1), (7, 2)], "k long, a int")
    b = spark.createDataFrame([(None, 3)], "k long, b int")
    assert rows(joins.key_join(a, b, ["k"], "inner")) == []
    assert rows(joins.key_join(a, b, ["k"], "inner", null_safe=True)) == [(None, 1, 3)]
    assert rows(joins.key_join(a, b, ["k"], "left_anti", null_safe=True)) == [(7, 2)]
    assert rows(joins.key_join(a, b, ["k"], "full", null_safe=True)) == [(7, 2, None), (None, 1, 3)]


def test_lookup_ways_agree(spark, rows):
    """Names by a map or by joins; the first reads its frame once, and neither runs a job while the plan is built."""
    people = spark.createDataFrame([(i, i % 2, 5 if i % 3 else None) for i in range(300)], "person_id long, g int, s int")
    concept = spark.createDataFrame([(i, f"name {i}") for i in range(40)] + [(None, "none")], "concept_id int, concept_name string")
    counted = people.groupBy("person_id", "g", "s").count().drop("count")
    args = (counted, concept, {"gender": "g", "sex": "s"}, "concept_id", "concept_name", people)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "plan only")
    try:
        mapped, joined = joins.lookup_names(*args), joins.lookup_names(*args, few_codes=False)
        assert not tracker.getJobIdsForGroup("lookup")
        assert "Join" not in mapped._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [person_id")[0].split("scalar-subquery")[0]
        assert mapped._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [person_id") == 1
        results = [rows(mapped), rows(joined)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert results[0] == results[1] and len(results[0]) == 300
    assert results[0][0] == (0, 0, None, "name 0", None)
    assert mapped.columns == joined.columns == ["person_id", "g", "s", "gender", "sex"]


def test_too_many_codes_for_a_map_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_CODES", 3)
    people = spark.range(10).select(F.col("id").alias("g"))
    lookup = spark.range(10).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    with pytest.raises(Exception, match="few_codes=False"):
        joins.lookup_names(people, lookup, {"name": "g"}, "k", "v", people).collect()
    assert joins.lookup_names(people, lookup, {"name": "g"}, "k", "v", people, few_codes=False).count() == 10


def test_merge_counts_leaves_missing_sides_null(spark, rows):
    a = spark.createDataFrame([("a", 1)], "k string, x long")
    b = spark.createDataFrame([("b", 2)], "k string, y long")
    assert rows(joins.merge_counts(a, b, "k")) == [("a", 1, None), ("b", None, 2)]


def test_count_joined_equals_join_then_count(spark, rows):
    answers = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("person_id"),
                                       (F.col("id") % 4).alias("answer"))
    lookup = spark.createDataFrame([(i, f"g{i % 3}") for i in range(40)] + [(1, "extra")], "person_id long, g string")
    direct = answers.join(lookup, "person_id").groupBy("g", "answer").count()
    assert rows(counts.count_joined(answers, lookup, ["answer"], ["g"])) == rows(direct)
