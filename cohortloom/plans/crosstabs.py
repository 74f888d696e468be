"""Category x race and category x subgroup crosstabs, chart data and the regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.labels import category_by_id, category_by_wording, drinking_outcome
from cohortloom.functions.predicates import is_valid_answer, matches
from cohortloom.functions.text import remove_all, replace_first
from cohortloom.operators import cohorts, crosstab, multinomial
from cohortloom.operators.counts import count_by, count_joined
from cohortloom.operators.reshape import widen_lists
from cohortloom.plans.people import CODES, with_race
from cohortloom.sources.warehouse import Warehouse, survey_scan

ROW = ("person_id", "question_concept_id", "question", "answer")


def carrier_data(w: Warehouse, ids: DataFrame,
                 question_ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Person codes and survey rows of carriers that the availability table knows.

    The survey is always filtered by the list, whatever its size; beyond a broadcast, AQE splits
    the answers of a hot person in the semi join.
    """
    known = cohorts.keep_members(w.availability.select("person_id"), ids)
    people = cohorts.keep_members(w.person.select("person_id", *CODES), ids)
    answers = cohorts.keep_members(survey_scan(w.survey, question_ids, ROW), ids)
    return cohorts.keep_members(people, known), answers


def noncarrier_data(w: Warehouse, ids: DataFrame,
                    question_ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Person codes and survey rows of everyone else (``NOT IN``).

    The list is only taken out of the person side; the reports join the two on the person.
    """
    people = cohorts.not_in(w.person.select("person_id", *CODES), ids)
    return people, survey_scan(w.survey, question_ids, ROW)


def categories(answers: DataFrame) -> DataFrame:
    """``person_id``, ``category`` per valid answer, the category found by question wording."""
    valid = answers.filter(is_valid_answer(F.col("answer")))
    return valid.select("person_id", category_by_wording(F.col("question"), F.col("answer")).alias("category"))


def race_categories(people: DataFrame, answers: DataFrame) -> DataFrame:
    """``person_id``, ``race_ethnicity``, ``category``, one row per valid answer."""
    return with_race(people.select("person_id", *CODES)).join(categories(answers), "person_id")


def race_cells(people: DataFrame, answers: DataFrame) -> DataFrame:
    """Valid answers counted per race group and category."""
    return count_joined(categories(answers), with_race(people), ["category"], ["race_ethnicity"])


def subgroup_lookup(people: DataFrame, answers: DataFrame) -> DataFrame:
    """``person_id``, ``detailed_race``: one row per subgroup a person of the group named.

    Made distinct before the person check, so that repeated answers never reach a join.
    """
    members = people.filter(F.col("race_concept_id") == vocab.ASIAN_CODE).select("person_id")
    named = answers.filter(matches(F.col("answer"), vocab.SUBGROUP_MARK, ignore_case=True))
    label = replace_first(F.col("answer"), vocab.SUBGROUP_PREFIX)
    return cohorts.keep_members(named.select("person_id", label.alias("detailed_race")).distinct(), members)


def subgroup_categories(people: DataFrame, answers: DataFrame, clean: bool) -> DataFrame:
    """Valid alcohol answers per person and subgroup: someone with two subgroups counts in both.

    ``n`` is the number of equal answers; they are counted before the join. ``clean`` strips the
    question name from the answers before the category is made.
    """
    asked = answers.filter(F.col("question_concept_id").isin(vocab.ALCOHOL_QUESTIONS)
                           & is_valid_answer(F.col("answer")))
    shown = remove_all(F.col("answer"), vocab.ANSWER_PREFIXES) if clean else F.col("answer")
    counted = count_by(asked.withColumn("clean_answer", shown), "person_id", "question_concept_id", "clean_answer")
    return (subgroup_lookup(people, answers).withColumnRenamed("detailed_race", "race_ethnicity")
            .join(counted, "person_id")
            .withColumn("category", category_by_id(F.col("question_concept_id"), F.col("clean_answer"))))


def subgroup_cells(people: DataFrame, answers: DataFrame, clean: bool) -> DataFrame:
    """The same counted per subgroup and category."""
    return crosstab.cells(subgroup_categories(people, answers, clean), weight="n")


def race_crosstab(w: Warehouse, ids: DataFrame, with_variant: bool = True) -> DataFrame:
    """Category x race with totals, in report order. The label list is closed, so it is given."""
    load = carrier_data if with_variant else noncarrier_data
    counted = race_cells(*load(w, ids, vocab.ALCOHOL_QUESTIONS))
    return crosstab.with_totals(counted, vocab.ALL_RACES, order=vocab.CATEGORY_ORDER)


def subgroup_crosstab(w: Warehouse, ids: DataFrame, with_variant: bool = True) -> DataFrame:
    """Category x subgroup with totals, in report order. Subgroup labels are looked up."""
    load = carrier_data if with_variant else noncarrier_data
    counted = subgroup_cells(*load(w, ids, vocab.COHORT_QUESTIONS), clean=with_variant)
    order = vocab.CLEAN_CATEGORY_ORDER if with_variant else vocab.CATEGORY_ORDER
    return crosstab.with_totals(counted, order=order)


def chart_data(counted: DataFrame, question_group: str = "Frequency") -> DataFrame:
    """Share of each answer inside each subgroup's bar, for one question group.

    Takes ``subgroup_cells``. Empty cells are part of the chart data.
    """
    split = crosstab.split_category(crosstab.filled(counted)).filter(F.col("question_group") == question_group)
    return crosstab.bar_shares(split)


def regression_rows(rows: DataFrame) -> DataFrame:
    """``race_ethnicity``, ``drinking_frequency``, ``n``: outcome per person and subgroup.

    Takes ``subgroup_categories``. ``n`` is the number of unnested rows, kept as a weight since
    the fit needs only counts.
    """
    lifetime, frequency = str(vocab.LIFETIME), str(vocab.FREQUENCY)
    unnested = widen_lists(rows, ["person_id", "race_ethnicity"], "question_concept_id",
                           "clean_answer", vocab.ALCOHOL_QUESTIONS, weight="n")
    outcome = drinking_outcome(F.col(f"`{lifetime}`"), F.col(f"`{frequency}`"))
    return (unnested.select("person_id", "race_ethnicity", outcome.alias("drinking_frequency"), "n")
                    .filter(F.col("drinking_frequency").isNotNull()))


def regression_counts(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Group x outcome counts of the regression of drinking frequency on subgroup."""
    rows = subgroup_categories(*carrier_data(w, ids, vocab.COHORT_QUESTIONS), clean=True)
    return multinomial.outcome_counts(regression_rows(rows), "race_ethnicity", "drinking_frequency", "n")


def regression(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Coefficients with p-values against the largest subgroup and the non-drinkers."""
    return multinomial.with_p_values(multinomial.fit(regression_counts(w, ids), vocab.NONDRINKER))
