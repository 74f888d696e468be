"""Reports on a hand-made warehouse, among them one where a single person has most of the answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom import Warehouse, vocab
from cohortloom.operators import cohorts
from cohortloom.plans import answers, crosstabs, people
from cohortloom.sources import schemas


def build(spark, survey):
    person = [
        (1, 1, dt.datetime(1990, 1, 1), 8515, 0, 1, 1),
        (2, 1, dt.datetime(2003, 6, 1), 8515, 0, 2, 1),
        (3, 2, dt.datetime(1930, 1, 1), 8527, 0, 9, 1),
        (4, 2, dt.datetime(1990, 1, 1), 8515, 38003563, 1, 1),
        (5, 2, dt.datetime(1990, 1, 1), 8515, 0, 1, 1),
        (6, 2, dt.datetime(1990, 1, 1), 8515, 0, 1, 1),
    ]
    flags = [(p, int(p != 6), 0, int(p == 2), 0) for p in range(1, 7)]
    concept = [(1, "Male"), (2, "Female")]
    data = {"person": person, "concept": concept, "survey": [(*r, "v") for r in survey], "availability": flags,
            "variants": [("v", [1, 3]), ("v", [5, 77]), ("w", [2])],
            "deaths": [(5, dt.date(2020, 1, 1), 1, 1, True, "s")]}
    return Warehouse(**{t: spark.createDataFrame(data[t], s) for t, s in schemas.TABLES.items()})


@pytest.fixture
def w(spark):
    s, f, q = vocab.SUBGROUP, vocab.FREQUENCY, vocab.QUANTITY
    return build(spark, [
        (1, s, "r", "Asian Specific: Chinese"), (1, s, "r", "Asian Specific: Korean"),
        (2, s, "r", "Asian Specific: Korean"),
        (1, f, vocab.QUESTION_NAMES[f], vocab.FREQUENCY_LEVELS[0]), (2, f, vocab.QUESTION_NAMES[f], vocab.FREQUENCY_LEVELS[1]),
        (3, f, vocab.QUESTION_NAMES[f], "PMI: Skip"), (2, q, vocab.QUESTION_NAMES[q], vocab.QUANTITY_LEVELS[4]),
    ])


@pytest.fixture
def ids(w):
    return cohorts.checked_carriers(w.variants, ["v"])


def people_of(df):
    return sorted(r.person_id for r in df.collect())


def test_halves_exclude_the_dead_and_the_unflagged(w, ids):
    assert people_of(people.initial_cohort(w)) == [1, 2, 3, 4, 5]
    assert people_of(people.cohort(w)) == [1, 2, 3, 4]
    assert people_of(people.carrier_cohort(w, ids)) == [1, 3]
    assert people_of(people.noncarrier_cohort(w, ids)) == [2, 4]
    assert people_of(people.carrier_people(w, ids)) == [1, 3, 5]
    assert people_of(people.missing_carriers(w, ids)) == [5]
    assert people_of(people.death_overlap(w)) == [5]
    flagged = people.flagged_cohort(w, ids)
    assert people_of(flagged.filter("carrier = 1")) == people_of(people.carrier_cohort(w, ids))


def test_reconciliation_holds(w, ids):
    assert all(r.agrees for r in people.reconciliation(w, ids, "2024-01-01").collect())


def test_age_and_sex(w, ids):
    carriers = people.carrier_cohort(w, ids, [people.BORN, people.SEX])
    assert [tuple(r) for r in people.age_distribution(carriers, "2024-01-01").collect()] == [
        ("30-39", 1, 50.0), ("90+", 1, 50.0)]
    assert [tuple(r) for r in people.sex_distribution(carriers, w).collect()] == [("Male", 1, 50.0), ("Other", 1, 50.0)]
    others = people.noncarrier_cohort(w, ids, [people.BORN])
    assert people.age_range_count(others, "2024-01-01", 18, 21).first()["n_18_21"] == 1


def test_race_tables(w, ids, rows):
    assert rows(people.race_counts(w)) == [("Asian", 3), ("Hispanic or Latino", 1), ("White", 1)]
    assert rows(people.race_breakdown(w, ids)) == [("Asian", 1, 1), ("Hispanic or Latino", None, 1), ("White", 1, None)]


def test_multi_select_people_are_dropped_or_counted_twice(w, ids, rows):
    assert people_of(answers.single_subgroup(w)) == [2]
    lookup = crosstabs.subgroup_lookup(*crosstabs.carrier_data(w, ids, vocab.COHORT_QUESTIONS))
    assert rows(lookup) == [(1, "Chinese"), (1, "Korean")]
    cells = crosstabs.subgroup_cells(*crosstabs.carrier_data(w, ids, vocab.COHORT_QUESTIONS), clean=True)
    assert rows(cells) == [("Frequency: Never", "Chinese", 1), ("Frequency: Never", "Korean", 1)]
    table = crosstabs.subgroup_crosstab(w, ids, with_variant=False).orderBy("row_number").collect()
    assert [r.category for r in table] == [
        "Frequency: Drink Frequency Past Year: Monthly Or Less", "Quantity: Average Daily Drink Count: 10 or More",
        "Total Participants"]


def test_subgroup_tables(w, ids, rows):
    freq = answers.subgroup_answers(w, ids, vocab.FREQUENCY, vocab.FREQUENCY_LEVELS)
    assert rows(freq.select("half", "subgroup", "value")) == [("noncarriers", "Asian Specific: Korean", "1 (100.00%)")]
    drinks = answers.subgroup_answers(w, ids, vocab.QUANTITY, vocab.COLLAPSED_LEVELS, vocab.COLLAPSE_QUANTITY)
    assert rows(drinks.select("answer", "row_order", "value")) == [("3+ drinks", 2, "1 (100.00%)")]
    assert rows(answers.subgroup_distribution(w, ids)) == [("noncarriers", "Asian Specific: Korean", 1, 100.0)]


def test_group_members_are_in_two_cohorts(w, ids, rows):
    got = rows(answers.answers_by_cohort(w, ids, [vocab.FREQUENCY]).select("cohort", "answer", "count"))
    never, monthly = vocab.FREQUENCY_LEVELS[:2]
    assert got == [("carriers (Asian)", never, 1), ("carriers", never, 1), ("carriers", "PMI: Skip", 1),
                   ("noncarriers (Asian)", monthly, 1), ("noncarriers", monthly, 1)]


def test_one_person_with_most_of_the_answers(spark, rows):
    """The hot person's answers are folded before any join; results are those of the plain join."""
    s, f = vocab.SUBGROUP, vocab.FREQUENCY
    w = build(spark, [(1, s, "r", "Asian Specific: Chinese"), (2, s, "r", "Asian Specific: Korean")])
    many = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 6 + 1).alias("person_id"), F.lit(f).alias("question_concept_id"),
        F.lit(vocab.QUESTION_NAMES[f]).alias("question"),
        F.element_at(F.array(*[F.lit(x) for x in vocab.FREQUENCY_LEVELS]), (F.col("id") % 5 + 1).cast("int")).alias("answer"),
        F.lit("v").alias("survey_version_name"))
    w = Warehouse(w.person, w.concept, w.survey.unionByName(many), w.availability, w.variants, w.deaths)
    ids = cohorts.checked_carriers(w.variants, ["v"])
    cells = crosstabs.race_cells(*crosstabs.carrier_data(w, ids, vocab.ALCOHOL_QUESTIONS))
    direct = (crosstabs.race_categories(*crosstabs.carrier_data(w, ids, vocab.ALCOHOL_QUESTIONS))
              .groupBy("race_ethnicity", "category").count())
    assert rows(cells) == rows(direct)
    by_cohort = answers.answers_by_cohort(w, ids, [f])
    assert by_cohort.filter("cohort = 'carriers'").agg(F.sum("count")).first()[0] == many.join(
        people.carrier_cohort(w, ids), "person_id").count()
    regression = crosstabs.regression_counts(w, ids)
    assert rows(regression.groupBy("group").sum("n")) == [("Chinese", many.filter("person_id = 1").count())]
