"""Answer tables by cohort, race group and subgroup.

A person may have any number of survey rows, so answers are counted per person before they meet
the cohort (``count_joined``), and the one-row-per-person frames are joined among themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.labels import LevelsBy, as_level, collapse
from cohortloom.functions.predicates import is_answered, not_listed
from cohortloom.operators import cohorts
from cohortloom.operators.counts import count_by, count_joined, with_percent
from cohortloom.operators.member_filter import maybe_members
from cohortloom.operators.tables import np_from_counts, ordered_from_counts
from cohortloom.plans.people import flagged_cohort, initial_cohort, one_group
from cohortloom.sources.warehouse import Warehouse, survey_scan


def question_answers(w: Warehouse, question_id: int) -> DataFrame:
    """``person_id``, ``answer`` of one question."""
    return survey_scan(w.survey, [question_id], ("person_id", "answer"))


def halves(w: Warehouse, ids: DataFrame) -> DataFrame:
    """The cohort with ``half`` = carriers / noncarriers."""
    half = F.when(F.col("carrier") == 1, "carriers").otherwise("noncarriers")
    return flagged_cohort(w, ids).select("person_id", "race_ethnicity", half.alias("half"))


def answers_by_cohort(w: Warehouse, ids: DataFrame,
                      question_ids: Sequence[int] = tuple(vocab.ALCOHOL_QUESTIONS)) -> DataFrame:
    """Count per cohort, question and answer for four cohorts: each half, whole and one group.

    One scan and one join for every question x cohort pair. Members of the group belong to two
    cohorts; that is worked out on the counted rows, not by copying the answers.
    """
    asian = F.col("race_ethnicity") == vocab.RACE_LABELS[vocab.ASIAN_CODE]
    people = halves(w, ids).select("person_id", "half", asian.alias("in_group"))
    counts = count_joined(survey_scan(w.survey, question_ids), people, ["question", "answer"], ["half", "in_group"])
    half = F.col("half")
    cohorts_of = F.when(F.col("in_group"), F.array(half, F.concat(half, F.lit(" (Asian)")))).otherwise(F.array(half))
    return count_by(counts.withColumn("cohort", F.explode(cohorts_of)), "cohort", "question", "answer",
                    name="count", weight="count")


def cohort_question_tables(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Ordered tables with Total of the frequency and the quantity question, four cohorts each."""
    counts = answers_by_cohort(w, ids, [vocab.FREQUENCY, vocab.QUANTITY])
    kept = counts.filter(not_listed(F.col("answer")))
    levels = {vocab.FREQUENCY: vocab.FREQUENCY_LEVELS, vocab.QUANTITY: vocab.QUANTITY_LEVELS}
    return ordered_from_counts(kept, "answer", LevelsBy("question", {vocab.QUESTION_NAMES[q]: own for q, own in levels.items()}),
                               by=["cohort", "question"])


def race_group_answers(w: Warehouse, levels: Mapping[int, Sequence[str]],
                       groups: Sequence[str] = tuple(vocab.REPORTED_RACES)) -> DataFrame:
    """``n (p%)`` of each listed question per race group, of people who answered it."""
    answers = survey_scan(w.survey, list(levels), ("person_id", "question_concept_id", "answer"))
    kept = answers.filter(not_listed(F.col("answer"), vocab.REFUSALS_AND_BLANKS) & is_answered(F.col("answer")))
    order = LevelsBy("question_concept_id", levels)
    kept = kept.withColumn("answer", as_level(F.col("answer"), order))
    people = initial_cohort(w).filter(F.col("race_ethnicity").isin(list(groups)))
    counts = count_joined(kept, people, ["question_concept_id", "answer"], ["race_ethnicity"])
    return np_from_counts(counts, "race_ethnicity", "answer", order, by=["question_concept_id"])


def single_subgroup(w: Warehouse) -> DataFrame:
    """``person_id``, ``answer`` of people with exactly one row for the subgroup question."""
    return cohorts.single_row_groups(question_answers(w, vocab.SUBGROUP))


def subgroup_members(w: Warehouse, ids: DataFrame) -> DataFrame:
    """``person_id``, ``half``, ``subgroup`` of group members who named exactly one subgroup."""
    members = one_group(halves(w, ids)).select("person_id", "half")
    asked = maybe_members(question_answers(w, vocab.SUBGROUP), members, "person_id")
    named = cohorts.single_row_groups(asked).withColumnRenamed("answer", "subgroup")
    return members.join(named, "person_id", "left").filter(F.col("subgroup").isNotNull())


def subgroup_answers(w: Warehouse, ids: DataFrame, question_id: int, levels: Sequence[str],
                     collapsed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``n (p%)`` of one question per subgroup, both halves; levels may be collapsed first.

    The members are a few percent of all people: a bit table of their ids keeps other people's
    answers out of the counting and its shuffle.
    """
    answer = F.col("answer")
    kept = question_answers(w, question_id).filter(
        not_listed(answer, vocab.REFUSALS_AND_BLANKS) & answer.isNotNull())
    if collapsed is not None:
        kept = kept.withColumn("answer", collapse(answer, collapsed))
    kept = kept.withColumn("answer", as_level(answer, levels))
    members = subgroup_members(w, ids)
    counts = count_joined(maybe_members(kept, members, "person_id"), members, ["answer"], ["half", "subgroup"])
    return np_from_counts(counts, "subgroup", "answer", levels, by=["half"])


def subgroup_distribution(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Count and percent of the single-answer subgroups in each half, largest first."""
    counts = count_by(subgroup_members(w, ids), "half", F.col("subgroup").alias("answer"), name="count")
    return with_percent(counts, "count", by=["half"]).orderBy("half", F.desc("count"), "answer")
