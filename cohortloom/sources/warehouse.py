"""The six input tables and the scans the reports start from."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.joins import lookup_names
from cohortloom.sources import schemas


@dataclass(frozen=True)
class Warehouse:
    """The input tables as DataFrames; only the ones a report touches are read."""

    person: DataFrame
    concept: DataFrame
    survey: DataFrame
    availability: DataFrame
    variants: DataFrame
    deaths: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, base: str,
                     names: Mapping[str, str] | None = None) -> Warehouse:
        """One Parquet directory per table below ``base``."""
        names = {**schemas.WAREHOUSE_NAMES, **(names or {})}
        return cls(**{table: spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{names[table]}")
                      for table, schema in schemas.TABLES.items()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None,
                     names: Mapping[str, str] | None = None) -> Warehouse:
        """Catalog tables. Bucketed by ``person_id``, the person-level joins need no shuffle."""
        names = {**schemas.WAREHOUSE_NAMES, **(names or {})}
        prefix = f"{database}." if database else ""
        return cls(**{table: spark.table(prefix + names[table]) for table in schemas.TABLES})


#: Tables with one row per person, or few: the ones that are joined with each other on the person.
PERSON_TABLES = ("person", "availability", "deaths")


def save_bucketed(w: Warehouse, base: str, buckets: int, database: str | None = None, prefix: str | None = None) -> Warehouse:
    """Write the person-level tables below ``base``, bucketed and sorted by person, as catalog tables.

    Returns the warehouse with these tables in place of the old ones; ``Warehouse.from_catalog`` finds them again.
    Tables of the same number of buckets meet on the person without a shuffle. Each bucket is written by one task
    as one file. The survey is not bucketed: one person may hold a large part of it, and reports fold it by
    person before the join anyway.
    """
    prefix = prefix if prefix is not None else f"b{uuid.uuid4().hex}_"
    stored = {}
    for table in PERSON_TABLES:
        name = (f"{database}." if database else "") + prefix + schemas.WAREHOUSE_NAMES[table]
        (getattr(w, table).repartition(buckets, "person_id").write.bucketBy(buckets, "person_id").sortBy("person_id")
         .format("parquet").mode("overwrite").option("path", f"{base.rstrip('/')}/{schemas.WAREHOUSE_NAMES[table]}").saveAsTable(name))
        stored[table] = w.person.sparkSession.table(name)
    return Warehouse(**{t: stored.get(t, getattr(w, t)) for t in schemas.TABLES})


def survey_scan(survey: DataFrame, question_ids: Sequence[int],
                columns: Sequence[str] = ("person_id", "question", "answer")) -> DataFrame:
    """Answers to the listed questions. Both the list and the columns reach the file scan."""
    return survey.filter(F.col("question_concept_id").isin(list(question_ids))).select(*columns)


# Role -> key column in person; the same lookup table plays every role.
ROLES = {
    "gender": "gender_concept_id",
    "sex_at_birth": "sex_at_birth_concept_id",
    "self_reported_category": "self_reported_category_concept_id",
}


def demographics(person: DataFrame, concept: DataFrame,
                 roles: Sequence[str] = ("gender", "sex_at_birth"),
                 extra: Sequence[str] = ()) -> DataFrame:
    """``person_id``, ``date_of_birth``, the extra columns and one name per role."""
    keys = {role: ROLES[role] for role in roles}
    slim = person.select("person_id", F.col("birth_datetime").alias("date_of_birth"),
                         *extra, *[k for k in keys.values() if k not in extra])
    named = lookup_names(slim, concept, keys, "concept_id", "concept_name", person)
    return named.select("person_id", "date_of_birth", *extra, *roles)


def deaths_scan(deaths: DataFrame) -> DataFrame:
    """Distinct death records."""
    return deaths.select("person_id", "death_date", "death_type_concept_id", "cause_concept_id",
                         "primary_death_record", "src_id").distinct()
