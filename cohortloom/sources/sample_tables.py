"""The warehouse tables derived from a TPC-H-like star schema, for checks and timings.

Customers become people, orders their survey answers and variant calls, nations the concept
lookup. Codes and answers are functions of the keys (``%`` picks a *value*; no row is left out
to make a table smaller), and missing values are put in, because the base tables have none.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom import vocab
from cohortloom.functions.labels import first_match

# Question per order, by order key modulo 5; the last is for repeated answers to the others.
_QUESTION_IDS = [*vocab.ALCOHOL_QUESTIONS, vocab.SUBGROUP, vocab.RACE]
_SHORT_NAMES = [*vocab.QUESTION_NAMES.values(), "Race: What Race Ethnicity", "Race: Race And Ethnicity"]
_LONG_NAMES = [
    "In your entire life, have you had at least 1 drink of any kind of alcohol?",
    "How often do you have a drink containing alcohol in the past year?",
    "On a typical day when you drink, how many drinks do you have?",
    "How often did you have six or more drinks on one occasion in the past year?",
    "Which of these groups describe you?",
    "Which categories describe you?",
]
# Answers 0-4 of each question; 5 is a refusal, 6 is missing.
_ANSWERS = [
    ["Alcohol Participant: Yes"] * 3 + ["Alcohol Participant: No"] * 2,
    vocab.FREQUENCY_LEVELS,
    vocab.QUANTITY_LEVELS,
    ["6 or More Drinks Occurrence: Never In Last Year", "6 or More Drinks Occurrence: Less Than Monthly"]
    + ["6 or More Drinks Occurrence: Monthly"] * 3,
    vocab.SUBGROUPS,
    ["What Race Ethnicity: Asian", 'What Race Ethnicity: None of these,\n"as I see it"', vocab.SUBGROUPS[0], vocab.SUBGROUPS[2],
     "What Race Ethnicity: White"],
]
SAMPLE_VIDS = ["199603"]
_CARRIERS_PER_ROW = 1000


@lru_cache
def _schema(spark: SparkSession, path: str) -> T.StructType:
    """Looked up in the footer once per path, not once per query."""
    return spark.read.parquet(path).schema


class SampleWarehouse:
    """Same attributes as ``Warehouse``, each built when first used."""

    def __init__(self, spark: SparkSession, folder: str, wording: str = "short"):
        self.spark, self.folder, self.wording = spark, folder.rstrip("/"), wording

    def _read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return self.spark.read.schema(_schema(self.spark, path)).parquet(path)

    @cached_property
    def customers(self) -> DataFrame:
        return self._read("customer")

    @cached_property
    def orders(self) -> DataFrame:
        return self._read("orders")

    @cached_property
    def person(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        return self.customers.select(
            key.alias("person_id"),
            nation.alias("gender_concept_id"),
            F.when(key % 10 == 9, 99).otherwise((key % 4).cast("int")).alias("sex_at_birth_concept_id"),
            (24 - nation).alias("self_reported_category_concept_id"),
            F.get(F.array(*[F.lit(c) for c in vocab.RACE_LABELS]), nation % 7).alias("race_concept_id"),
            F.when(nation % 5 == 0, vocab.HISPANIC_CODE).otherwise(38003564).alias("ethnicity_concept_id"),
            F.date_add(F.lit("1930-01-01").cast("date"), ((key * 3697) % 28000).cast("int"))
             .cast("timestamp").alias("birth_datetime"))

    @cached_property
    def concept(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self._read("nation").select(
            key.alias("concept_id"),
            first_match([(key == 0, "Female"), (key == 1, "Male"), (key == 2, "Intersex")],
                        F.col("n_name")).alias("concept_name"))

    @cached_property
    def availability(self) -> DataFrame:
        tests = [F.col("c_acctbal") > 5000, F.col("c_nationkey") == 3,
                 F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_custkey") % 11 == 0]
        return self.customers.select(
            F.col("c_custkey").alias("person_id"),
            *[F.when(t, 1).otherwise(0).alias(flag) for t, flag in zip(tests, vocab.DATA_FLAGS)])

    @cached_property
    def variants(self) -> DataFrame:
        """Several rows per variant, none with more carriers than a block of keys has."""
        month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
        block = F.floor(F.col("o_custkey") / _CARRIERS_PER_ROW)
        return (self.orders.groupBy(month.cast("string").alias("vid"), block.alias("block"))
                    .agg(F.collect_set("o_custkey").alias("person_ids"))
                    .select("vid", "person_ids"))

    @cached_property
    def deaths(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customers.filter(F.col("c_acctbal") < 0).select(
            key.alias("person_id"),
            F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int")).alias("death_date"),
            (key % 3).cast("int").alias("death_type_concept_id"),
            F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("cause_concept_id"),
            (F.col("c_acctbal") < -500).alias("primary_death_record"),
            F.col("c_mktsegment").alias("src_id"))

    @cached_property
    def survey(self) -> DataFrame:
        """One answer per order.

        A person answers each alcohol question once (with the lowest of the orders that ask it) and the subgroup
        question any number of times; further orders of an alcohol question answer the race question.
        """
        order, person, q = F.col("o_orderkey"), F.col("o_custkey"), F.col("q")
        rows = self.orders.select(person.alias("person_id"), order, (order % 5).cast("int").alias("asked"))
        # Joined on the order, so that a person with many orders stays spread over tasks.
        first = (rows.filter("asked < 4").groupBy("person_id", "asked").agg(F.min("o_orderkey").alias("o_orderkey"))
                     .select("o_orderkey", F.lit(True).alias("is_first")))
        picked = (rows.join(first, "o_orderkey", "left")
                      .withColumn("q", F.when(F.col("is_first") | (F.col("asked") == 4), F.col("asked")).otherwise(F.lit(5)))
                      .withColumn("a", ((order + F.col("person_id")) % 7).cast("int")))
        names = _SHORT_NAMES if self.wording == "short" else _LONG_NAMES
        pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), q)
        refusal = F.when(q.isin(1, 4), vocab.REFUSALS[0]).otherwise(vocab.REFUSALS[1])
        answers = F.array(*[F.array(*[F.lit(a) for a in row]) for row in _ANSWERS])
        return picked.select(
            "person_id",
            pick(_QUESTION_IDS).alias("question_concept_id"),
            pick(names).alias("question"),
            F.when(F.col("a") == 5, refusal).otherwise(F.get(F.get(answers, q), F.col("a"))).alias("answer"),
            F.concat(F.lit("wave "), q.cast("string")).alias("survey_version_name"))
