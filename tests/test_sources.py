import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from cohortloom import Warehouse, vocab
from cohortloom.session import scratch_path, shared_folder
from cohortloom.plans import people
from cohortloom.sources import csv_shards, schemas, warehouse
from cohortloom.sources.sample_tables import SampleWarehouse
from cohortloom.sources.sql import sql_frame
from cohortloom.sources.warehouse import save_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """The six tables as Parquet under their warehouse names."""
    person = [(i, 1, dt.datetime(1980, 1, 1), 8515, 0, 2, 3) for i in range(1, 6)]
    data = {
        "person": person,
        "concept": [(1, "G"), (2, "Male"), (3, "S")],
        "survey": [(1, vocab.FREQUENCY, "q", "a", "v1"), (2, vocab.QUANTITY, "q", None, "v1"), (3, 7, "q", "z", "v2")],
        "availability": [(i, i % 2, 0, 0, 0) for i in range(1, 6)],
        "variants": [("v", [1, 2])],
        "deaths": [(5, dt.date(2020, 1, 1), 1, None, True, "s")] * 2,
    }
    for table, schema in schemas.TABLES.items():
        spark.createDataFrame(data[table], schema).write.parquet(str(tmp_path / schemas.WAREHOUSE_NAMES[table]))
    return tmp_path


def test_warehouse_scans(spark, stored, rows):
    w = Warehouse.from_parquet(spark, str(stored))
    scan = warehouse.survey_scan(w.survey, [vocab.FREQUENCY, vocab.QUANTITY], ("person_id", "answer"))
    assert rows(scan) == [(1, "a"), (2, None)]
    assert "PushedFilters: [In(question_concept_id, [1586201,1586207])]" in plan(scan)
    assert "ReadSchema: struct<person_id:bigint,question_concept_id:bigint,answer:string>" in plan(scan)
    assert rows(warehouse.deaths_scan(w.deaths)) == [(5, dt.date(2020, 1, 1), 1, None, True, "s")]
    people = warehouse.demographics(w.person, w.concept, list(warehouse.ROLES), ["race_concept_id"])
    assert people.columns == ["person_id", "date_of_birth", "race_concept_id", *warehouse.ROLES]
    assert tuple(people.orderBy("person_id").first())[2:] == (8515, "G", "Male", "S")


def test_32_bit_columns_widen(spark, stored):
    narrow = spark.createDataFrame([(1, "a")], "concept_id int, concept_name string")
    narrow.write.parquet(str(stored / "narrow"))
    w = Warehouse.from_parquet(spark, str(stored), {"concept": "narrow"})
    assert w.concept.dtypes[0] == ("concept_id", "bigint") and w.concept.first().concept_id == 1


def test_warehouse_names_and_catalog(spark, stored):
    (stored / "ds_survey").rename(stored / "other")
    assert Warehouse.from_parquet(spark, str(stored), {"survey": "other"}).survey.count() == 3
    names = {t: f"cat_{t}" for t in schemas.TABLES}
    w = Warehouse.from_parquet(spark, str(stored), {"survey": "other"})
    for table in schemas.TABLES:
        getattr(w, table).createOrReplaceTempView(names[table])
    assert Warehouse.from_catalog(spark, names=names).person.count() == 5


def test_bucketed_person_tables_meet_without_a_shuffle(spark, tmp_path, rows):
    w = SampleWarehouse(spark, "/root/testdata/sf0.001")
    stored = save_bucketed(w, str(tmp_path / "b"), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cohort = people.cohort(stored)
        plan = cohort._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 3
        assert rows(cohort) == rows(people.cohort(w))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    again = save_bucketed(w, str(tmp_path / "c"), 4, prefix="again_")
    assert spark.table("again_person").count() == again.person.count() == w.person.count()


def test_every_order_is_a_survey_row(spark):
    w = SampleWarehouse(spark, "/root/testdata/sf0.01")
    assert w.survey.count() == w.orders.count()
    asked = {r[0]: r[1] for r in w.survey.groupBy("question_concept_id").count().collect()}
    assert set(asked) == {*vocab.COHORT_QUESTIONS} and len(vocab.COHORT_QUESTIONS) == 6
    assert w.survey.filter(F.col("question_concept_id").isin(vocab.ALCOHOL_QUESTIONS)).groupBy("person_id", "question_concept_id").count().filter("count > 1").count() == 0


def test_csv_keeps_awkward_text_and_reads_na_tokens_as_null(spark, tmp_path, rows):
    schema = "person_id BIGINT, answer STRING"
    data = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None), (4, ""), (5, "NA"), (6, "back\\slash"), (7, "NAN")]
    df = spark.createDataFrame(data, schema).repartition(3)
    shards = csv_shards.export_csv(df, str(tmp_path / "out"))
    assert len(glob.glob(shards)) > 1
    assert rows(csv_shards.read_csv_shards(spark, shards, schema)) == [
        (1, 'say "hi", ok'), (2, "two\nlines"), (3, None), (4, None), (5, None), (6, "back\\slash"), (7, "NAN")]


def test_shards_are_split_unless_they_hold_line_breaks(spark, tmp_path, rows):
    """A large shard is read by many tasks; a shard with a line break in a field keeps its records whole."""
    plain, broken = spark.range(20_000).selectExpr("id", "'some text' AS v"), spark.createDataFrame([(-1, 'a\n"b"\r\nc,')], "id long, v string")
    one = csv_shards.export_csv(plain.coalesce(1), str(tmp_path / "x"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert csv_shards.read_csv_shards(spark, one, "id BIGINT, v STRING").rdd.getNumPartitions() > 4
        both = csv_shards.export_csv(plain.coalesce(1).union(broken), str(tmp_path / "y z"))
        got = csv_shards.read_csv_shards(spark, both, "id BIGINT, v STRING")
        assert got.rdd.getNumPartitions() > 4 and got.count() == 20_001
        assert rows(got.filter("id = -1")) == [(-1, 'a\n"b"\r\nc,')]
        assert csv_shards.by_line_breaks(spark, one) == (one, [])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_raw_tokens(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('k,v\n1,\n2,NA\n3,""\n4,x\nNA,y\n')
    (tmp_path / "b.csv").write_text('k,v\n5,"NA"\n')
    glob_ = str(tmp_path / "*.csv")
    expected = [(1, None), (2, None), (3, None), (4, "x"), (5, None), (None, "y")]
    assert rows(csv_shards.read_csv_shards(spark, glob_, "k BIGINT, v STRING")) == expected


def test_csv_schema_modes(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,code,x\n1,007,1.5\n2,NA,NA\n")
    path = str(tmp_path / "*.csv")
    assert csv_shards.read_csv_shards(spark, path).dtypes == [("id", "int"), ("code", "int"), ("x", "double")]
    with pytest.warns(UserWarning, match="no column named 'nope'"):
        mixed = csv_shards.read_csv_shards(spark, path, overrides={"code": "string", "nope": "string"})
    assert rows(mixed) == [(1, "007", 1.5), (2, None, None)]
    assert rows(csv_shards.read_csv_shards(spark, path, all_text=True)) == [("1", "007", "1.5"), ("2", None, None)]
    assert csv_shards.read_csv_shards(spark, path, all_text=["id", "code", "x"]).dtypes[0] == ("id", "string")


def test_export_paths_and_overwrite(spark, tmp_path, rows):
    assert csv_shards.export_path("s3://b/", "t", dt.date(2024, 3, 9)) == "s3://b/20240309/t"
    assert csv_shards.export_path("s3://b", "t") == "s3://b/t"
    monday, tuesday = (csv_shards.export_path(str(tmp_path), "t", day) for day in ("2024-03-04", "2024-03-05"))
    read = lambda path: rows(csv_shards.read_csv_shards(spark, f"{path}/*.csv", "id BIGINT"))
    csv_shards.export_csv(spark.range(3), monday)
    csv_shards.export_csv(spark.range(1), monday)
    csv_shards.export_csv(spark.range(2), tuesday)
    assert (read(monday), read(tuesday)) == ([(0,)], [(0,), (1,)])


def test_a_failed_export_keeps_the_old_rows(spark, tmp_path, rows):
    path = csv_shards.export_path(str(tmp_path), "t", "2024-03-04")
    shards = csv_shards.export_csv(spark.range(5), path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 97, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="half-way"):
        csv_shards.export_csv(broken, path)
    read = lambda: rows(csv_shards.read_csv_shards(spark, shards, "id BIGINT"))
    assert read() == [(i,) for i in range(5)]
    csv_shards.export_csv(spark.range(7), path)  # the next export replaces them
    assert read() == [(i,) for i in range(7)]
    # An export may read what it replaces.
    csv_shards.export_csv(csv_shards.read_csv_shards(spark, shards, "id BIGINT").filter("id > 4"), path)
    assert read() == [(5,), (6,)]


def test_shards_are_bounded(spark, tmp_path):
    shards = csv_shards.export_csv(spark.range(10).coalesce(1), str(tmp_path / "o"), rows_per_shard=3)
    assert len(glob.glob(shards)) == 4


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 5), (1, "a", 4)], "row_number int, category string, `Total (All Groups)` long")
    (name,) = glob.glob(csv_shards.write_report(df, str(tmp_path / "r")))
    with open(name) as f:
        lines = f.read().splitlines()
    assert [line.split(",")[1:] for line in lines] == [["category", "Total (All Groups)"], ["a", "4"], ["b", "5"]]
    assert lines[0].split(",")[0] in ("", '""') and [line[0] for line in lines[1:]] == ["1", "2"]


def test_sql_with_bound_values(spark, rows):
    spark.range(5).createOrReplaceTempView("cdr_numbers")
    got = sql_frame(spark, "SELECT id FROM IDENTIFIER(:table) WHERE array_contains(:ids, id) AND id IN (SELECT id FROM {keep})",
                    {"table": "cdr_numbers", "ids": F.array(F.lit(1), F.lit(3))}, keep=spark.range(3))
    assert rows(got) == [(1,)]
    assert got.dtypes == [("id", "bigint")]


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(folder)
