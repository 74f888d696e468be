"""Joins with explicit column naming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More codes than this are no lookup for ``few_codes``; the list of names is then a table, not a value.
MAX_CODES = 10_000


def lookup_names(df: DataFrame, lookup: DataFrame, roles: Mapping[str, str], key: str, value: str,
                 codes: DataFrame, few_codes: bool = True) -> DataFrame:
    """Left-join one lookup table once per role; adds a column per role. Codes are unique in the lookup.

    Lookup codes are few and hot (one code can hold a third of the rows), so the big side should not
    be shuffled on them. ``codes`` is a base table with the roles' columns: the names of the codes
    it uses become one map, a scalar subquery, and every role reads it where the rows lie. ``df`` is
    scanned once, whatever the roles, and planning runs no job. More than ``MAX_CODES`` codes are an
    error; with ``few_codes`` off the lookup is an ordinary join per role, which AQE turns into a
    broadcast by the measured size or splits at hot codes.
    """
    small = lookup.select(F.col(key).cast("bigint").alias("__key"), F.col(value).alias("__name")).filter(F.col("__key").isNotNull())
    if not few_codes:
        for role, column in roles.items():
            df = df.join(small.select(F.col("__key").alias("__k"), F.col("__name").alias(role)), F.col(column) == F.col("__k"), "left").drop("__k")
        return df
    used = codes.select(F.explode(F.array(*[F.col(c).cast("bigint") for c in roles.values()])).alias("__key")).distinct()
    too_many = F.raise_error(F.lit(f"more than {MAX_CODES} codes in use: pass few_codes=False"))
    entries = F.collect_list(F.struct("__key", "__name"))
    names = (small.join(used, "__key", "left_semi")
                  .agg(F.map_from_entries(F.when(F.count(F.lit(1)) <= MAX_CODES, entries).otherwise(too_many))).scalar())
    df = df.withColumn("__names", names)
    return df.withColumns({role: F.try_element_at("__names", F.col(c).cast("bigint")) for role, c in roles.items()}).drop("__names")


def suffix_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                suffixes: tuple[str, str] = (".x", ".y"), null_safe: bool = False) -> DataFrame:
    """Join that keeps both copies of same-named columns, told apart by a suffix.

    ``null_safe`` lets a missing key match a missing key.
    """
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return key_join(left, right, on, how, null_safe)


def key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
             null_safe: bool = False) -> DataFrame:
    """Equi-join on same-named keys, one copy of each key in the result."""
    if not null_safe:
        return left.join(right, list(on), how)
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    test = reduce(Column.__and__, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on])
    joined = left.join(renamed, test, how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [c for c in joined.columns if c not in on and not c.startswith("__r_")]
    keys = [F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) for c in on]
    return joined.select(*keys, *[f"`{c}`" for c in rest])


def merge_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two count tables; a count missing on one side stays NULL."""
    return left.join(right, key, "full")
