"""Multinomial logit of an outcome on several categorical factors, with interactions.

The data are counts per combination of factor levels and outcome: one ``groupBy`` folds any number of rows to a table.
``pyspark.ml`` finds the neighbourhood of the maximum; Newton steps, each one distributed pass over the counts that
sums gradient and Fisher matrix, finish it to the last digits and leave the standard errors behind.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.multinomial import INTERCEPT
from cohortloom.session import pinned

#: Standard errors beyond this belong to estimates that grow without bound (an empty cell).
_UNBOUNDED = 1e3
Term = tuple[tuple[str, str], ...]


def factor_counts(df: DataFrame, factors: Sequence[str], outcome: str, weight: str | None = None) -> DataFrame:
    """Rows (or the sum of a weight) per combination of factor levels and outcome; rows with a missing value take no part."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.dropna(subset=[*factors, outcome]).groupBy(*factors, outcome).agg(n.alias("n"))


def levels_of(counts: DataFrame, column: str, first: str | None = None) -> list[str]:
    """The labels of a column, the reference first: the named one, else the largest (the first in order on a tie)."""
    rows = counts.groupBy(column).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc(column)).collect()
    labels = [r[0] for r in rows]
    reference = first if first is not None else labels[0]
    return [reference, *sorted(x for x in labels if x != reference)]


def terms_of(levels: Mapping[str, Sequence[str]], interactions: Sequence[Sequence[str]]) -> list[Term]:
    """The intercept, each level but the reference of each factor, and the products that interactions ask for."""
    groups = [(f,) for f in levels] + [tuple(i) for i in interactions]
    return [()] + [tuple(zip(group, chosen)) for group in groups for chosen in itertools.product(*[levels[f][1:] for f in group])]


def _regressor(term: Term) -> Column:
    test = F.lit(True)
    for factor, level in term:
        test = test & (F.col(f"`{factor}`") == level)
    return test.cast("double")


def _sums(beta: np.ndarray):
    """Gradient and Fisher matrix of a partition's counts, one after the other in one array."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, columns = beta.shape
        size = classes * columns
        gradient, fisher = np.zeros((classes, columns)), np.zeros((size, size))
        for frame in frames:
            for x, k, n in zip(frame["x"], frame["k"], frame["n"]):
                x = np.asarray(x)
                score = np.append(0.0, beta @ x)
                p = np.exp(score - score.max())
                p = (p / p.sum())[1:]
                gradient += n * np.outer((np.arange(1, classes + 1) == k) - p, x)
                fisher += n * np.kron(np.diag(p) - np.outer(p, p), np.outer(x, x))
        yield pd.DataFrame({"sums": [np.concatenate([gradient.ravel(), fisher.ravel()])]})

    return run


def _step(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One aggregation: as many numbers come back as the matrix has."""
    parts = rows.mapInPandas(_sums(beta), "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    sums = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    return sums[: beta.size], sums[beta.size :].reshape(beta.size, beta.size)


def fit(counts: DataFrame, factors: Sequence[str], outcome: str, base_outcome: str, interactions: Sequence[Sequence[str]] = (),
        base_levels: Mapping[str, str] | None = None, max_steps: int = 25) -> DataFrame:
    """Estimates, standard errors, relative risk ratios and z, one row per outcome and term.

    A term is named by its levels, interactions with a colon. An estimate that an empty cell drives beyond all bounds
    is NULL and ``finite`` false. Factors are report variables: their labels, and the square matrix of (terms x
    outcomes), are as large as the table of coefficients, not as the data.
    """
    counts = pinned(counts)
    levels = {f: levels_of(counts, f, (base_levels or {}).get(f)) for f in factors}
    outcomes = levels_of(counts, outcome, base_outcome)
    terms = terms_of(levels, interactions)
    k = F.array_position(F.array(*[F.lit(o) for o in outcomes]), F.col(f"`{outcome}`")) - 1
    rows = counts.select(F.array(*[_regressor(t) for t in terms]).alias("x"), k.cast("double").alias("k"), F.col("n").cast("double").alias("n"))
    start = LogisticRegression(featuresCol="v", labelCol="k", weightCol="n", family="multinomial", regParam=0.0, fitIntercept=False,
                               standardization=False, maxIter=30, tol=1e-8).fit(rows.withColumn("v", array_to_vector("x")))
    free = start.coefficientMatrix.toArray()
    beta = free[1:] - free[0]
    for _ in range(max_steps):
        gradient, fisher = _step(rows, beta)
        move = np.linalg.lstsq(fisher, gradient, rcond=None)[0].reshape(beta.shape)
        beta = beta + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-11:
            break
    _, fisher = _step(rows, beta)
    errors = np.sqrt(np.abs(np.diag(np.linalg.pinv(fisher, rcond=1e-14)))).reshape(beta.shape)
    weak = np.diag(fisher).reshape(beta.shape) < 1 / _UNBOUNDED**2
    out = []
    for i, name in enumerate(outcomes[1:]):
        for j, term in enumerate(terms):
            finite = bool(errors[i, j] < _UNBOUNDED and not weak[i, j])
            b, e = float(beta[i, j]), float(errors[i, j])
            out.append((name, ":".join(level for _, level in term) or INTERCEPT, finite, *((b, e, float(np.exp(b)), b / e) if finite else (None,) * 4)))
    return counts.sparkSession.createDataFrame(
        out, "outcome string, term string, finite boolean, estimate double, std_error double, risk_ratio double, z double")
