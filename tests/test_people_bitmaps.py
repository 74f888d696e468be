import itertools

from pyspark.sql import functions as F

from cohortloom.operators import counts, people_bitmaps


def _data(spark):
    """Dense, sparse, negative and missing ids; groups that overlap; one person with very many rows."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.col("id") * 1_000_003 - 5_000_000_000).when(
        F.col("id") % 13 == 0, -(F.col("id") % 70_000)).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("id") % 40_000)
    return spark.range(60_000).select(ids.cast("bigint").alias("person_id"), (F.col("id") % 4).alias("a"),
                                      F.when(F.col("id") % 7 > 0, F.concat(F.lit("x"), F.col("id") % 5)).alias("b"))


def test_totals_equal_exact_distinct_counts(spark):
    df = _data(spark)
    want = df.agg(counts.distinct_count("person_id"), counts.distinct_count("b"), F.count(F.lit(1))).first()
    got = people_bitmaps.distinct_totals(df, "person_id", "b")
    assert tuple(got.first()) == tuple(want)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(people_bitmaps.distinct_totals(df.where("false"), "person_id", "b").first()) == (0, 0, 0)


def test_every_level_of_a_cube_equals_its_own_distinct_count(spark, rows):
    df = _data(spark)
    sets = [list(s) for n in range(3) for s in itertools.combinations(["a", "b"], n)]
    got = {}
    for r in people_bitmaps.people_by(df, sets, ["a", "b"]).collect():
        got.setdefault(r["level"], []).append((r["a"], r["b"], r["n_people"]))
    for s in sets:
        level = sum(bit for bit, c in ((2, "a"), (1, "b")) if c not in s)
        direct = df.where("person_id is not null").groupBy(*s).agg(F.count_distinct("person_id").alias("n"))
        want = [(r["a"] if "a" in s else None, r["b"] if "b" in s else None, r["n"]) for r in direct.collect()]
        assert sorted(got[level], key=repr) == sorted(want, key=repr)


def test_dense_ids(spark):
    df = _data(spark)
    numbered = people_bitmaps.dense_ids(df)
    n = df.agg(F.count_distinct("person_id")).first()[0]
    assert tuple(numbered.agg(F.count(F.lit(1)), F.count_distinct("dense_id"), F.min("dense_id"), F.max("dense_id")).first()) == (n, n, 1, n)
    dense = df.join(numbered, "person_id")
    assert people_bitmaps.bitmaps(dense, (), "dense_id").count() == n // 32_768 + 1  # neighbouring ids share a bitmap
    assert people_bitmaps.bitmaps(dense, (), "dense_id").agg(people_bitmaps.size()).first()[0] == n
