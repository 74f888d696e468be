"""What the pipeline's stages let Python workers hold: batches, freed memory, workers for literals."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import jaccard_forest, packing, pipeline
from cohortloom.llm.common import BATCHES, cut, returned, small_batches


def test_batches_have_few_rows_and_few_bytes(spark):
    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    narrow = spark.range(0, 5000, 1, 1).select(F.lit("a").alias("t"))
    wide = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("a"), 1 << 20).alias("t"))
    with small_batches(spark):
        few, big = (cut(df.mapInArrow(seen, "n long, size long")).agg(F.max("n"), F.sum("n"), F.max("size")).first() for df in (narrow, wide))
    assert few[0] <= 1000 and few[1] == 5000
    assert big[1] == 60 and big[2] <= 8 << 20


def test_settings_are_put_back(spark):
    before = {key: spark.conf.get(key) for key in BATCHES}
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        assert {key: spark.conf.get(key) for key in BATCHES} == BATCHES
        raise ZeroDivisionError
    assert {key: spark.conf.get(key) for key in BATCHES} == before


@pytest.mark.parametrize("run", [lambda d: jaccard_forest.near_duplicates(d), lambda d: packing.pack(d, "unused")])
def test_stages_hand_out_small_batches(spark, monkeypatch, run):
    held = []

    def written(df):
        held.append({key: spark.conf.get(key) for key in BATCHES})
        raise StopIteration

    for module in (jaccard_forest, packing):
        monkeypatch.setattr(module, "cut", written)
    with pytest.raises(StopIteration):
        run(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
    assert held == [BATCHES]


def test_freed_memory_goes_back(monkeypatch):
    class Pool:
        times = 0

        def release_unused(self):
            self.times += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    given = returned(iter("ab"))
    assert next(given) == "a" and not pool.times
    assert list(given) == ["b"] and pool.times == 1


def test_weights_start_no_python_worker(spark):
    weights = pipeline.tree_weights(spark)
    assert "ExistingRDD" not in weights._jdf.queryExecution().executedPlan().toString()
    assert weights.dtypes == [("domain", "string"), ("lang", "string"), ("source", "string"), ("weight", "double")]
    rows = {tuple(r) for r in weights.collect()}
    assert len(rows) == 20 and ("domain0", None, None, 4.0) in rows and ("domain3", "es", None, 1.0) in rows and ("domain1", "de", None, 2.0) in rows
