"""Queries on the sample tables; ``oracle.py`` has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.labels import collapse, keep_or_other
from cohortloom.functions.predicates import is_answered, is_valid_answer, not_listed
from cohortloom.functions.text import cast_ids, na_to_null, remove_all
from cohortloom.operators import cohorts, counts, crosstab, factor_fit, joins, multinomial, people_bitmaps, reshape, tables
from cohortloom.plans import answers, crosstabs, people
from cohortloom.session import scratch_path
from cohortloom.sources import csv_shards, warehouse
from cohortloom.sources.sample_tables import SAMPLE_VIDS as VIDS
from cohortloom.sources.sample_tables import SampleWarehouse
from cohortloom.sources.sql import sql_frame

AS_OF = "2024-01-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


@lru_cache
def _warehouse(spark: SparkSession, folder: str, wording: str) -> SampleWarehouse:
    """Table definitions (plans, no data) are made once per folder."""
    return SampleWarehouse(spark, folder, wording)


def _query(fn: Callable[[SampleWarehouse], DataFrame], wording: str = "short") -> None:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(_warehouse(spark, sf_dir, wording))


def query(fn):
    _query(fn)
    return fn


def long_wording(fn):
    _query(fn, "long")
    return fn


def _ids(w: SampleWarehouse) -> DataFrame:
    return cohorts.checked_carriers(w.variants, VIDS)


def _dob_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date_of_birth", F.col("date_of_birth").cast("string"))


# --- scans, sources, sinks ---

@query
def survey_scan(w):
    return warehouse.survey_scan(w.survey, vocab.ALCOHOL_QUESTIONS,
                                 ("person_id", "question", "answer", "survey_version_name"))


@query
def cohort_person_scan(w):
    return _dob_text(people.cohort_extract(w))


@query
def person_demographics(w):
    return _dob_text(warehouse.demographics(w.person, w.concept))


@query
def deaths_distinct(w):
    return warehouse.deaths_scan(w.deaths)


@query
def sql_to_frame(w):
    text = """SELECT DISTINCT person_id, death_date FROM {deaths}
              WHERE death_date >= :since AND array_contains(:types, death_type_concept_id)"""
    return sql_frame(w.spark, text, {"since": "2021-01-01", "types": F.array(F.lit(0), F.lit(2))},
                     deaths=w.deaths)


@query
def na_tokens(w):
    segment = F.col("c_mktsegment")
    token = F.when(segment == "BUILDING", "NA").when(segment == "MACHINERY", "").otherwise(segment)
    return w.customers.select(F.col("c_custkey").alias("person_id"), na_to_null(token).alias("answer"))


@query
def cast_keys(w):
    """Ids exported as text; where the balance is negative the text is not a number."""
    text = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    exported = w.customers.select("c_name", text.alias("person_id"),
                                  F.col("c_nationkey").cast("string").alias("race_concept_id"))
    return cast_ids(exported, "person_id", "race_concept_id")


@query
def csv_roundtrip(w):
    """Export the survey as CSV shards under a dated path, then read all shards back."""
    path = csv_shards.export_path(scratch_path(w.spark, "export"), "survey", AS_OF)
    shards = csv_shards.export_csv(w.survey.select(*crosstabs.ROW), path)
    return csv_shards.read_csv_shards(
        w.spark, shards, "person_id BIGINT, question_concept_id INT, question STRING, answer STRING")


# --- labels and filters ---

@query
def race_label(w):
    return people.initial_cohort(w)


@query
def race_counts(w):
    return people.race_counts(w)


@query
def split_by_question(w):
    return w.survey.filter(F.col("question") == vocab.QUESTION_NAMES[vocab.FREQUENCY]).select(
        "person_id", "question", "answer")


@query
def drop_refusals(w):
    return w.survey.filter(not_listed(F.col("answer"))).select("person_id", "question_concept_id", "answer")


@query
def valid_answers(w):
    return w.survey.filter(is_valid_answer(F.col("answer"))).select("person_id", "question_concept_id", "answer")


@long_wording
def regex_categories(w):
    rows = w.survey.filter(F.col("question_concept_id").isin(vocab.COHORT_QUESTIONS))
    return crosstabs.race_categories(w.person, rows)


@query
def clean_answer(w):
    return w.survey.select("person_id", "answer",
                           remove_all(F.col("answer"), vocab.ANSWER_PREFIXES).alias("clean_answer"))


@query
def collapse_levels(w):
    return answers.question_answers(w, vocab.QUANTITY).select(
        "person_id", collapse(F.col("answer"), vocab.COLLAPSE_QUANTITY).alias("drinks"))


@query
def split_category(w):
    rows = w.survey.select("person_id", F.col("answer").alias("category"))
    return crosstab.split_category(rows, into=("question_group", "rest"))


# --- cohort algebra ---

@query
def variant_carriers(w):
    return cohorts.carriers(w.variants, VIDS)


@query
def any_flag_cohort(w):
    return cohorts.union_distinct([cohorts.any_flag(w.availability, [flag]) for flag in vocab.DATA_FLAGS])


@query
def any_flag_or(w):
    return cohorts.any_flag(w.availability)


@query
def genotyped_people(w):
    return people.genotyped(people.with_race(w.person.select("person_id", *people.CODES)), w)


@query
def genotyped_race_table(w):
    everyone = people.genotyped(people.with_race(w.person.select("person_id", *people.CODES)), w)
    return counts.frequency(everyone.filter("gene = 1"), "race_ethnicity")


@query
def cohort_semi_join(w):
    return people.carrier_cohort(w, _ids(w))


@query
def cohort_anti_join(w):
    return people.noncarrier_cohort(w, _ids(w))


@query
def bucketed_cohort(w):
    """Carriers in the cohort, from person tables that are written bucketed by person: their joins shuffle nothing."""
    stored = warehouse.save_bucketed(w, scratch_path(w.spark, "bucketed"), buckets=8)
    return people.carrier_cohort(stored, _ids(w))


@query
def anti_via_left(w):
    return cohorts.drop_members_via_left(people.cohort(w), _ids(w))


@query
def not_in_scan(w):
    return cohorts.not_in(w.person.select("person_id"), _ids(w))


@query
def not_in_null_aware(w):
    """How many people pass a list of ids, a list with missing ids, and an empty list."""
    ids = cohorts.carriers(w.variants, VIDS)
    holed = w.deaths.select(F.when(F.col("primary_death_record"), F.col("person_id")).alias("person_id"))
    empty = w.deaths.filter(F.col("death_date") < "1900-01-01").select("person_id")
    return counts.stack_by_name([
        cohorts.not_in(w.person, lst).agg(F.count(F.lit(1)).alias("n")).withColumn("list", F.lit(name))
        for name, lst in (("ids", ids), ("missing ids", holed), ("empty", empty))])


@query
def membership_flag(w):
    return cohorts.membership_flag(w.person.select("person_id"), _ids(w), "gene")


@query
def ids_in_both(w):
    return people.death_overlap(w)


@query
def ids_missing(w):
    return people.missing_carriers(w, _ids(w))


@query
def single_answer_only(w):
    return answers.single_subgroup(w)


# --- joins ---

@query
def left_join_suffix(w):
    asked = counts.count_by(answers.question_answers(w, vocab.FREQUENCY), "person_id", "answer")
    both = joins.suffix_join(asked, answers.single_subgroup(w), ["person_id"], suffixes=("_x", "_y"))
    return both.filter(F.col("answer_x").isNotNull() & F.col("answer_y").isNotNull())


@query
def answers_by_group(w):
    kept = answers.question_answers(w, vocab.FREQUENCY).filter(
        not_listed(F.col("answer"), vocab.REFUSALS_AND_BLANKS))
    counted = counts.count_by(kept, "person_id", "answer")
    return people.initial_cohort(w).join(counted, "person_id", "left").filter(is_answered(F.col("answer")))


@query
def cohort_with_demographics(w):
    return _dob_text(people.with_age(people.with_demographics(people.carrier_cohort(w, _ids(w)), w), AS_OF, "date_of_birth"))


@query
def breakdown_full_join(w):
    ids = _ids(w)
    half = lambda df, name: counts.count_by(df, "race_ethnicity").withColumnRenamed("n", name)
    return joins.merge_counts(half(people.carrier_cohort(w, ids), "with_variant"),
                              half(people.noncarrier_cohort(w, ids), "without_variant"), "race_ethnicity")


@query
def race_breakdown(w):
    return people.race_breakdown(w, _ids(w))


@query
def multi_select_lookup(w):
    return crosstabs.subgroup_lookup(*crosstabs.carrier_data(w, _ids(w), vocab.COHORT_QUESTIONS))


@query
def stack_by_name(w):
    return counts.stack_by_name([
        w.deaths.select("person_id", "death_date"),
        people.carrier_cohort(w, _ids(w))])


# --- counts ---

@query
def count_by_key(w):
    return counts.count_by(w.survey, "answer", name="count")


@query
def count_by_two_keys(w):
    return counts.count_by(w.survey, "question", "answer", name="count")


@query
def distinct_people_by_group(w):
    return counts.distinct_by(w.survey, "answer")


@query
def distinct_people(w):
    return people_bitmaps.distinct_totals(w.survey, "person_id", "answer").withColumnsRenamed(
        {"n_keys": "n_people", "n_values": "n_answers"})


@query
def distinct_people_rollup(w):
    """Distinct people per race group, half and question, with all totals, from one pass over the answers."""
    asked = w.survey.select("person_id", "question_concept_id").distinct()
    rows = answers.halves(w, _ids(w)).join(asked, "person_id")
    by = ["race_ethnicity", "half", "question_concept_id"]
    sets = [[c for i, c in enumerate(by) if kept >> i & 1] for kept in range(8)]
    return people_bitmaps.people_by(rows, sets, by).withColumn("level", F.col("level").cast("bigint"))


@query
def duplicate_keys(w):
    return counts.duplicates(answers.question_answers(w, vocab.SUBGROUP))


@query
def distinct_values(w):
    return counts.distinct_values(w.survey, "answer")


@query
def freq_table_nonnull(w):
    return counts.frequency(w.survey, "answer")


@query
def freq_n_way(w):
    """People with and without any data, dead or alive, by race group."""
    rows = people.genotyped(people.with_race(w.person.select("person_id", *people.CODES)), w).select("gene", "race_ethnicity")
    return counts.frequency(rows, *rows.columns)


@query
def percent_table(w):
    return counts.percent_table(w.survey, "answer")


@query
def largest_group(w):
    return counts.largest_group(answers.question_answers(w, vocab.SUBGROUP).dropna(), "answer")


@query
def head_rows(w):
    return counts.head_rows(w.survey.select("person_id", "question", "answer"), 5,
                            ["person_id", "question", "answer"])


@query
def reconcile_counts(w):
    return people.reconciliation(w, _ids(w), AS_OF)


# --- age, sex and race ---

@query
def age_distribution(w):
    return people.age_distribution(people.carrier_cohort(w, _ids(w), [people.BORN]), AS_OF)


@query
def age_distribution_noncarriers(w):
    return people.age_distribution(people.noncarrier_cohort(w, _ids(w), [people.BORN]), AS_OF)


@query
def sex_distribution(w):
    return people.sex_distribution(people.carrier_cohort(w, _ids(w), [people.SEX]), w)


@query
def sex_distribution_noncarriers(w):
    return people.sex_distribution(people.noncarrier_cohort(w, _ids(w), [people.SEX]), w)


@query
def group_age_distribution(w):
    return people.age_distribution(people.one_group(people.carrier_cohort(w, _ids(w), [people.BORN])), AS_OF)


@query
def group_sex_distribution(w):
    return people.sex_distribution(people.one_group(people.carrier_cohort(w, _ids(w), [people.SEX])), w)


@query
def group_age_distribution_noncarriers(w):
    return people.age_distribution(people.one_group(people.noncarrier_cohort(w, _ids(w), [people.BORN])), AS_OF)


@query
def group_sex_distribution_noncarriers(w):
    return people.sex_distribution(people.one_group(people.noncarrier_cohort(w, _ids(w), [people.SEX])), w)


@query
def age_range_count(w):
    return people.age_range_count(people.noncarrier_cohort(w, _ids(w), [people.BORN]), AS_OF, 18, 21)


# --- answer tables ---

@query
def ordered_table_total(w):
    return tables.ordered_table(answers.question_answers(w, vocab.FREQUENCY), "answer", vocab.FREQUENCY_LEVELS)


@query
def plain_table_total(w):
    return tables.ordered_table(answers.question_answers(w, vocab.QUANTITY), "answer")


@query
def answers_by_cohort(w):
    return answers.answers_by_cohort(w, _ids(w))


@query
def question_tables_by_cohort(w):
    return answers.cohort_question_tables(w, _ids(w))


@query
def stratified_np(w):
    return answers.race_group_answers(w, {vocab.FREQUENCY: vocab.FREQUENCY_LEVELS, vocab.QUANTITY: vocab.QUANTITY_LEVELS})


@query
def stratified_np_wide(w):
    table = answers.subgroup_answers(w, _ids(w), vocab.FREQUENCY, vocab.FREQUENCY_LEVELS)
    return tables.stratified_np_wide(table, "subgroup", "answer", vocab.SUBGROUPS, by=["half"])


@query
def subgroup_frequency(w):
    return answers.subgroup_answers(w, _ids(w), vocab.FREQUENCY, vocab.FREQUENCY_LEVELS)


@query
def subgroup_quantity(w):
    return answers.subgroup_answers(w, _ids(w), vocab.QUANTITY, vocab.COLLAPSED_LEVELS, vocab.COLLAPSE_QUANTITY)


@query
def subgroup_distribution(w):
    return answers.subgroup_distribution(w, _ids(w))


# --- crosstabs ---

def _race_cells(w):
    return crosstabs.race_cells(*crosstabs.carrier_data(w, _ids(w), vocab.ALCOHOL_QUESTIONS))


def _subgroup_cells(w):
    return crosstabs.subgroup_cells(*crosstabs.carrier_data(w, _ids(w), vocab.COHORT_QUESTIONS), clean=True)


@long_wording
def crosstab_wide(w):
    return crosstab.wide(_race_cells(w), vocab.ALL_RACES)


@query
def fanout_crosstab(w):
    return _subgroup_cells(w)


@long_wording
def crosstab_totals(w):
    return crosstabs.race_crosstab(w, _ids(w))


@long_wording
def crosstab_totals_noncarriers(w):
    return crosstabs.race_crosstab(w, _ids(w), with_variant=False)


@query
def ordered_crosstab(w):
    return crosstabs.subgroup_crosstab(w, _ids(w))


@query
def ordered_crosstab_noncarriers(w):
    return crosstabs.subgroup_crosstab(w, _ids(w), with_variant=False)


@long_wording
def crosstab_report(w):
    """Write the crosstab as a report file, then read the file back."""
    path = csv_shards.write_report(crosstabs.race_crosstab(w, _ids(w)), scratch_path(w.spark, "report"))
    labels = [*vocab.ALL_RACES, vocab.TOTAL_COLUMN]
    columns = ", ".join(f"`{c}` BIGINT" for c in labels)
    return csv_shards.read_csv_shards(w.spark, path, f"row_number INT, category STRING, {columns}")


@long_wording
def unpivot_counts(w):
    return crosstab.long_counts(crosstab.wide(_race_cells(w), vocab.ALL_RACES), vocab.ALL_RACES)


@query
def plot_shares(w):
    return crosstabs.chart_data(_subgroup_cells(w))


# --- regression ---

@query
def pivot_list_unnest(w):
    """Subgroup answers are lists here; the alcohol answers, one per person, are recycled."""
    unnested = reshape.widen_lists(w.survey.filter(is_valid_answer(F.col("answer"))), ["person_id"],
                                   "question_concept_id", "answer", [*vocab.ALCOHOL_QUESTIONS, vocab.SUBGROUP])
    return reshape.repeat_rows(unnested).withColumnsRenamed(
        {str(q): f"answer_{q}" for q in [*vocab.ALCOHOL_QUESTIONS, vocab.SUBGROUP]})


@query
def outcome_label(w):
    data = crosstabs.carrier_data(w, _ids(w), vocab.COHORT_QUESTIONS)
    return crosstabs.regression_rows(crosstabs.subgroup_categories(*data, clean=True))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def multinomial_fit(w):
    fitted = multinomial.fit(crosstabs.regression_counts(w, _ids(w)), vocab.NONDRINKER)
    return _rounded(fitted, 9, "estimate", "std_error", "risk_ratio", "z")


@query
def multinomial_deviance(w):
    return _rounded(multinomial.deviance(crosstabs.regression_counts(w, _ids(w))), 6, "deviance", "aic")


@query
def multinomial_pvalues(w):
    return _rounded(crosstabs.regression(w, _ids(w)), 9, "p_value").select("outcome", "term", "p_value")


@query
def multinomial_two_factors(w):
    """Drinking frequency of cohort members by sex, age half and both together."""
    members = people.with_age(people.everybody(w, _ids(w), [people.BORN, people.SEX]).filter("member"), AS_OF)
    named = joins.lookup_names(members, w.concept, {"name": people.SEX}, "concept_id", "concept_name", w.person)
    rows = named.select("person_id", keep_or_other(F.col("name")).alias("sex"), F.when(F.col("age") < 55, "young").otherwise("old").alias("half"))
    asked = answers.question_answers(w, vocab.FREQUENCY).filter(F.col("answer").isin(vocab.FREQUENCY_LEVELS))
    counted = counts.count_joined(asked, rows, ["answer"], ["sex", "half"], name="n")
    fitted = factor_fit.fit(counted, ["sex", "half"], "answer", vocab.FREQUENCY_LEVELS[0], [["sex", "half"]])
    return _rounded(fitted, 6, "estimate", "std_error", "risk_ratio", "z")
