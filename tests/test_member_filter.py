from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.operators import cohorts
from cohortloom.operators.member_filter import maybe_members
from cohortloom.plans import answers, people
from cohortloom.sources.sample_tables import SAMPLE_VIDS, SampleWarehouse


def test_members_pass_and_few_others(spark):
    df = spark.range(-1000, 20_000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.lit("v").alias("v"))
    keys = spark.range(0, 20_000, 40).union(spark.range(0, 400, 40)).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    kept = maybe_members(df, keys, "k", "id")
    assert kept.columns == ["k", "v"]
    exact = df.join(keys, df.k == keys.id, "left_semi")
    assert kept.join(keys, kept.k == keys.id, "left_semi").count() == exact.count() == 400
    assert 400 <= kept.count() < 450
    full = maybe_members(df, df, "k", bits=6)  # a full table lets all known keys pass
    assert full.count() == df.where("k is not null").count()
    assert maybe_members(df, keys.where("false"), "k", "id").count() == 0


def test_answers_are_filtered_below_their_first_count(spark, rows):
    w = SampleWarehouse(spark, "/root/testdata/sf0.001")
    ids = cohorts.checked_carriers(w.variants, SAMPLE_VIDS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = answers.subgroup_answers(w, ids, vocab.FREQUENCY, vocab.FREQUENCY_LEVELS)
        lines = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    at = next(i for i, line in enumerate(lines) if "getbit" in line.lower() and "Filter" in line)
    assert any("Aggregate [person_id" in line for line in lines[:at]) and not any("Aggregate" in line for line in lines[at:at + 1])
    plain = people.one_group(answers.halves(w, ids)).join(answers.single_subgroup(w).withColumnRenamed("answer", "subgroup"), "person_id")
    assert rows(answers.subgroup_members(w, ids).select("person_id", "half", "subgroup")) == rows(
        plain.filter("subgroup is not null").select("person_id", "half", "subgroup"))
