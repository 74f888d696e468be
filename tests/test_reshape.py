from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators.reshape import repeat_rows, widen_lists

SCHEMA = "p long, q string, v string"


def unnest(spark, data):
    return repeat_rows(widen_lists(spark.createDataFrame(data, SCHEMA), ["p"], "q", "v", ["a", "b", "c"]))


def test_recycling(spark, rows):
    data = [(1, "a", "a1"), (1, "b", "x"), (1, "b", "y"), (2, "c", None)]
    assert rows(unnest(spark, data)) == [(1, "a1", "x", None), (1, "a1", "y", None), (2, None, None, None)]


def test_lists_of_equal_length_run_side_by_side(spark, rows):
    data = [(1, "a", "k"), (1, "a", "k"), (1, "a", "l"), (1, "b", "x"), (1, "b", "y"), (1, "b", "y")]
    assert rows(unnest(spark, data)) == [(1, "k", "x", None), (1, "k", "y", None), (1, "l", "y", None)]


def test_unequal_lengths_are_an_error(spark):
    data = [(1, "a", str(i)) for i in range(2)] + [(1, "b", str(i)) for i in range(3)]
    with pytest.raises(Exception, match="unequal lengths"):
        unnest(spark, data).collect()


def test_a_huge_cell_stays_small(spark):
    hot = spark.range(300_000).select(F.lit(1).alias("p"), F.lit("a").alias("q"), F.lit("same").alias("v"))
    runs = widen_lists(hot, ["p"], "q", "v", ["a", "b"])
    assert [tuple(r) for r in runs.collect()] == [(1, "same", None, 300_000)]
    assert repeat_rows(runs).count() == 300_000


def test_weights(spark, rows):
    df = spark.createDataFrame([(1, "a", "x", 2), (1, "a", "x", 1), (1, "b", "y", 1)], SCHEMA + ", n long")
    assert rows(widen_lists(df, ["p"], "q", "v", ["a", "b"], weight="n")) == [(1, "x", "y", 3)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(1, 4), st.tuples(
    st.integers(1, 4), st.sampled_from(["0", "1", "n"]), st.sampled_from(["0", "1", "n"]), st.randoms()), min_size=1))
def test_against_brute_force(spark, rows, people):
    data, expected = [], []
    for person, (length, b, c, random) in people.items():
        cells = defaultdict(list)
        for q, kind in (("a", "n"), ("b", b), ("c", c)):
            size = {"0": 0, "1": 1, "n": length}[kind]
            cells[q] = sorted((random.choice([None, "u", "v"]) for _ in range(size)), key=lambda v: (v is not None, v or ""))
            data += [(person, q, v) for v in cells[q]]
        pick = lambda q, i: None if not cells[q] else cells[q][0] if len(cells[q]) == 1 else cells[q][i]
        expected += [(person, pick("a", i), pick("b", i), pick("c", i)) for i in range(length)]
    assert rows(unnest(spark, data)) == sorted(expected, key=repr)
