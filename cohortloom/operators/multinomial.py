"""Multinomial logit of an outcome on one categorical factor.

With a single factor the model is saturated: its maximum-likelihood fit is a function of the
group x outcome counts. So the data is read by one ``groupBy().count()`` and nothing iterates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.normal import two_sided_p
from cohortloom.session import pinned

INTERCEPT = "(Intercept)"


def outcome_counts(df: DataFrame, group: str, outcome: str, weight: str | None = None) -> DataFrame:
    """``group``, ``outcome``, ``n``; rows with a missing value take no part in the fit."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return (df.filter(F.col(group).isNotNull() & F.col(outcome).isNotNull())
              .groupBy(F.col(group).alias("group"), F.col(outcome).alias("outcome"))
              .agg(n.alias("n")))


def _per_group(counts: DataFrame) -> DataFrame:
    """One row per group: its size and a map outcome -> n (as long as there are outcomes)."""
    return counts.groupBy("group").agg(
        F.sum("n").alias("size"),
        F.map_from_entries(F.collect_list(F.struct("outcome", "n"))).alias("by_outcome"))


def _reference(groups: DataFrame, group: str | None) -> Column:
    """Row of the reference group: the named one, else the largest, first in label order on a tie."""
    chosen = groups.filter(F.col("group") == group) if group is not None else groups
    return (chosen.orderBy(F.desc("size"), F.asc("group")).limit(1)
                  .select(F.struct("group", "by_outcome")).scalar())


def fit(counts: DataFrame, base_outcome: str, base_group: str | None = None) -> DataFrame:
    """Estimates, standard errors, relative risk ratios and z, one row per outcome and term.

    A term with an empty cell has no finite estimate: its numbers are NULL and ``finite`` false.
    The counts are pinned, as the groups, the outcomes and the reference row all come from them.
    """
    counts = pinned(counts)
    groups = _per_group(counts)
    outcomes = counts.agg(F.array_sort(F.collect_set("outcome"))).scalar()
    cell = lambda m, key: F.coalesce(F.try_element_at(m, key), F.lit(0))
    base = F.lit(base_outcome)
    rows = (groups
            .withColumn("ref", _reference(groups, base_group))
            .withColumn("outcome", F.explode(F.array_remove(outcomes, base_outcome)))
            .select(
                "outcome",
                (F.col("group") == F.col("ref.group")).alias("is_ref"),
                "group",
                cell(F.col("by_outcome"), F.col("outcome")).alias("n"),
                cell(F.col("by_outcome"), base).alias("n_base"),
                cell(F.col("ref.by_outcome"), F.col("outcome")).alias("ref_n"),
                cell(F.col("ref.by_outcome"), base).alias("ref_n_base")))

    nonzero = lambda c: F.nullif(F.col(c), F.lit(0))  # ANSI mode raises on division by zero
    here = F.ln(F.col("n") / nonzero("n_base"))
    there = F.ln(F.col("ref_n") / nonzero("ref_n_base"))
    inverse = lambda c: F.lit(1.0) / nonzero(c)
    own_variance = inverse("n") + inverse("n_base")
    variance = F.when(F.col("is_ref"), own_variance).otherwise(
        own_variance + inverse("ref_n") + inverse("ref_n_base"))
    finite = (F.col("n") > 0) & (F.col("n_base") > 0) & (F.col("ref_n") > 0) & (F.col("ref_n_base") > 0)
    estimate = F.when(finite, F.when(F.col("is_ref"), here).otherwise(here - there))
    return (rows
            .select("outcome",
                    F.when(F.col("is_ref"), F.lit(INTERCEPT)).otherwise(F.col("group")).alias("term"),
                    F.col("n").cast("bigint").alias("cell_n"),
                    finite.alias("finite"),
                    estimate.alias("estimate"),
                    F.when(finite, F.sqrt(variance)).alias("std_error"))
            .withColumn("risk_ratio", F.exp("estimate"))
            .withColumn("z", F.col("estimate") / F.col("std_error")))


def with_p_values(fitted: DataFrame) -> DataFrame:
    """Add the two-sided Wald p-value."""
    return fitted.withColumn("p_value", two_sided_p(F.col("z")))


def deviance(counts: DataFrame) -> DataFrame:
    """One row: residual deviance, number of free coefficients and AIC."""
    counts = pinned(counts)
    outcomes = counts.agg(F.count_distinct("outcome")).scalar()
    groups = _per_group(counts)
    log_likelihood = F.aggregate(
        F.map_values("by_outcome"), F.lit(0.0),
        lambda total, n: total + n * F.ln(n / F.col("size")))
    return (groups.agg(F.sum(log_likelihood).alias("ll"), F.count(F.lit(1)).alias("groups"))
            .select((F.lit(-2.0) * F.col("ll")).alias("deviance"),
                    ((outcomes - 1) * F.col("groups")).alias("edf"))
            .withColumn("aic", F.col("deviance") + 2 * F.col("edf")))
