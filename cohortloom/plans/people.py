"""Cohort extraction, carrier split, and age, sex and race distributions.

``ids`` is a frame of carrier ids. Make it once with ``cohorts.checked_carriers`` and pass it to
every report: its size is then counted once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.dates import AsOf, completed_years
from cohortloom.functions.labels import band, keep_or_other, race_label
from cohortloom.operators import checks, cohorts
from cohortloom.operators.counts import count_by, distinct_by
from cohortloom.operators.joins import lookup_names
from cohortloom.operators.tables import distribution_of, group_distribution
from cohortloom.sources.warehouse import ROLES, Warehouse, demographics

CODES = ["race_concept_id", "ethnicity_concept_id"]
# Person columns the age and sex tables need; carried along, they save a second join to person.
BORN, SEX = "birth_datetime", "sex_at_birth_concept_id"


def cohort_extract(w: Warehouse, flags: Sequence[str] = tuple(vocab.DATA_FLAGS)) -> DataFrame:
    """People with any data flag, their codes, birth date and names of the three roles."""
    people = cohorts.keep_members(w.person, cohorts.any_flag(w.availability, flags))
    return demographics(people, w.concept, list(ROLES), CODES)


def with_race(people: DataFrame) -> DataFrame:
    """Replace the two concept codes by the group label."""
    return (people.withColumn("race_ethnicity", race_label(F.col(CODES[0]), F.col(CODES[1])))
                  .drop(*CODES))


def initial_cohort(w: Warehouse, keep: Sequence[str] = ()) -> DataFrame:
    """``person_id``, ``race_ethnicity``: people with any data flag, dead or alive."""
    people = w.person.select("person_id", *CODES, *keep)
    return with_race(cohorts.keep_members(people, cohorts.any_flag(w.availability)))


def cohort(w: Warehouse, keep: Sequence[str] = ()) -> DataFrame:
    """The same without people who have a death record.

    Three person-level tables joined on one key, so each is shuffled at most once.
    """
    return cohorts.drop_members(initial_cohort(w, keep), w.deaths.select("person_id").distinct())


def race_counts(w: Warehouse) -> DataFrame:
    """Distinct people per group, largest first."""
    return (distinct_by(initial_cohort(w), "race_ethnicity")
            .orderBy(F.desc("n_people"), "race_ethnicity"))


def death_overlap(w: Warehouse) -> DataFrame:
    """Ids of cohort members with a death record."""
    members = cohorts.keep_members(cohorts.flagged(w.availability), w.person.select("person_id"))
    return cohorts.ids_in_both(members, w.deaths)


def genotyped(people: DataFrame, w: Warehouse) -> DataFrame:
    """Add ``gene`` = 1 for people with any data flag, else 0."""
    return cohorts.membership_flag(people, cohorts.flagged(w.availability), "gene")


def carrier_people(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Ids of carriers with a person row that the availability table knows, dead or alive."""
    known = cohorts.keep_members(w.availability.select("person_id"), ids)
    return cohorts.keep_members(known, w.person.select("person_id")).distinct()


def carrier_cohort(w: Warehouse, ids: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cohort members who carry the variant."""
    return cohorts.keep_members(cohort(w, keep), ids)


def noncarrier_cohort(w: Warehouse, ids: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cohort members who do not. A dead carrier is in neither half."""
    return cohorts.drop_members(cohort(w, keep), ids)


def flagged_cohort(w: Warehouse, ids: DataFrame, flag: str = "carrier") -> DataFrame:
    """The cohort with a 0/1 carrier column: both halves in one pass."""
    return cohorts.membership_flag(cohort(w), ids, flag)


def missing_carriers(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Carriers that are not cohort members."""
    return cohorts.ids_missing(carrier_people(w, ids), cohort(w))


def with_demographics(people: DataFrame, w: Warehouse) -> DataFrame:
    """Left-join birth date, gender and sex; ``people`` keeps every row."""
    return people.join(demographics(w.person, w.concept), "person_id", "left")


def with_age(people: DataFrame, as_of: AsOf, born: str = BORN) -> DataFrame:
    """Add ``age`` and ``age_group``."""
    return (people.withColumn("age", completed_years(F.col(born), as_of))
                  .withColumn("age_group", band(F.col("age"))))


def age_distribution(people: DataFrame, as_of: AsOf) -> DataFrame:
    """People and percent per age band, in band order; ``people`` carries ``BORN``."""
    return group_distribution(with_age(people, as_of), "age_group", vocab.AGE_LEVELS)


def sex_distribution(people: DataFrame, w: Warehouse) -> DataFrame:
    """People and percent per sex at birth, unlisted ones as Other, largest first.

    ``people`` carries ``SEX``. Counted per code, so the lookup joins a handful of rows.
    """
    per_code = count_by(people, SEX, name="n_people")
    named = lookup_names(per_code, w.concept, {"sex_at_birth": SEX}, "concept_id", "concept_name", w.person)
    label = keep_or_other(F.col("sex_at_birth")).alias("sex_at_birth")
    return distribution_of(named.groupBy(label).agg(F.sum("n_people").alias("n_people")), "sex_at_birth")


def one_group(people: DataFrame, label: str = vocab.RACE_LABELS[vocab.ASIAN_CODE]) -> DataFrame:
    """Members of one race group."""
    return people.filter(F.col("race_ethnicity") == label)


def age_range_count(people: DataFrame, as_of: AsOf, low: int, high: int) -> DataFrame:
    """How many people are between two ages, both included; ``people`` carries ``BORN``."""
    aged = with_age(people, as_of)
    return aged.filter(F.col("age").between(low, high)).agg(F.count(F.lit(1)).alias(f"n_{low}_{high}"))


def race_breakdown(w: Warehouse, ids: DataFrame) -> DataFrame:
    """Carriers and non-carriers per group side by side; a group without any has NULL.

    Same table as ``merge_counts`` of the two halves' counts, in one pass over the cohort.
    """
    half = lambda flag: F.sum(F.when(F.col("carrier") == flag, 1))
    return (flagged_cohort(w, ids).groupBy("race_ethnicity")
            .agg(half(1).alias("with_variant"), half(0).alias("without_variant")))


def everybody(w: Warehouse, ids: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every person with ``race_ethnicity`` and flags: ``known`` to the availability table, ``member`` of the
    cohort, ``carrier``. The four person-level tables are read once each and joined on one key."""
    flag = reduce(Column.__or__, [F.col(f) == 1 for f in vocab.DATA_FLAGS])
    known = w.availability.groupBy("person_id").agg(F.lit(True).alias("known"), F.bool_or(F.coalesce(flag, F.lit(False))).alias("__flagged"))
    dead = w.deaths.select("person_id").distinct().withColumn("__dead", F.lit(True))
    listed = ids.select("person_id").distinct().withColumn("carrier", F.lit(True))
    people = with_race(w.person.select("person_id", *CODES, *keep))
    for table in (known, dead, listed):
        people = people.join(table, "person_id", "left")
    no = F.lit(False)
    return people.select("person_id", "race_ethnicity", *keep, F.coalesce("known", no).alias("known"), F.coalesce("carrier", no).alias("carrier"),
                         (F.coalesce("__flagged", no) & ~F.coalesce("__dead", no)).alias("member"))


def reconciliation(w: Warehouse, ids: DataFrame, as_of: AsOf) -> DataFrame:
    """Do the halves and the age, sex and race tables add up to the cohort?

    The tables are grouping sets of one pass over ``everybody``; codes are named afterwards, so a code with
    two names or none would show as a difference.
    """
    flags = ["member", "carrier", "known"]
    people = with_age(everybody(w, ids, [BORN, SEX]), as_of).withColumn("in_group", F.col("race_ethnicity") == vocab.RACE_LABELS[vocab.ASIAN_CODE])
    by = [*flags, "age_group", SEX, "in_group"]
    counted = (people.groupingSets([flags, [*flags, "age_group"], [*flags, SEX], [*flags, "in_group"]], *by)
                     .agg(F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n")))
    # Three bits tell the sets: a bit is 0 where the column is kept.
    whole, age, sex, group = (F.col("set") == bits for bits in (0b111, 0b011, 0b101, 0b110))
    names = w.concept.select(F.col("concept_id").alias("__code"), F.col("concept_name").alias("sex_at_birth"))
    named = counted.join(names, sex & (F.col(SEX) == F.col("__code")), "left").withColumn("sex_at_birth", keep_or_other(F.col("sex_at_birth")))
    tables = named.groupBy("set", *flags, "age_group", "in_group", "sex_at_birth").agg(F.sum("n").alias("n"))
    yes, no, everyone = F.col("member") & F.col("carrier"), F.col("member") & ~F.col("carrier"), F.col("member")
    listed = F.col("carrier") & F.col("known")
    return checks.reconcile_counted(tables, [
        ("carriers + non-carriers = cohort", [whole & yes, whole & no], [whole & everyone]),
        ("carriers - missing = carriers in cohort", [whole & listed], [whole & yes, whole & listed & ~everyone]),
        ("age table = carriers", [age & yes], [whole & yes]),
        ("sex table = carriers", [sex & yes], [whole & yes]),
        ("age table = non-carriers", [age & no], [whole & no]),
        ("sex table = non-carriers", [sex & no], [whole & no]),
        ("one group, both halves = group", [group & F.col("in_group") & yes, group & F.col("in_group") & no], [group & F.col("in_group") & everyone]),
    ])
