"""Exact top-k search by columnar branch-and-bound (operator 9).

Candidates lie in vertical layout, one row per dimension. Scores grow block by block of dimensions; after each block the
inner product of what is left cannot exceed the product of the remaining lengths of query and candidate (its remaining
mass). Candidates whose score plus that bound stays below the k-th best lower bound are compacted away.

Queries and candidates meet in groups of bounded size: candidates are dealt to slices, queries to blocks, and each
(slice, block) is one task's work that returns at most k rows per query. Nothing is broadcast.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part.
Vectors only meet others of equal length. Rows with the query's own id are not its candidates. Repeated rows are
candidates each. Ties go to the smaller id. Integer scores are exact; they must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Integer components floor(scale * x), computed in double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return df.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & ~bad).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), scaled(x).alias("v")).withColumn("dim", F.size("v"))


def best(columns: np.ndarray, remaining: list[np.ndarray], query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the ``k`` best candidates, ties to the smaller id. ``columns``: dimensions x candidates."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), columns.dtype)
    for at, begin in enumerate(range(0, len(query), BLOCK)):
        score = score + query[begin : begin + BLOCK] @ columns[begin : begin + BLOCK, alive]
        rest = query[begin + BLOCK :].astype(np.float64)
        mass = np.sqrt(rest @ rest) * remaining[at][alive] * (1 + 1e-9) + 1e-3
        if len(alive) > k and begin + BLOCK < len(query):
            low = score - mass
            least = np.partition(low, len(low) - k)[len(low) - k]
            stay = score + mass >= least
            alive, score = alive[stay], score[stay]
    if len(alive) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        stay = score >= least
        alive, score = alive[stay], score[stay]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order]


def searched(k: int):
    """Top k of one slice of candidates for one block of queries."""
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return shape.empty_table()
        dim = queries["dim"][0].as_py()
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), dim)
        q, c = matrix(queries), matrix(candidates)
        most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(dim, 1)
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object  # exact in each case
        # Dimensions that hold most mass come first, so that bounds are tight early.
        order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        columns = np.ascontiguousarray(c.T[order]).astype(kind)
        q = q[:, order].astype(kind)
        square = columns.astype(np.float64) ** 2
        tail = np.vstack([np.cumsum(square[::-1], axis=0)[::-1], np.zeros((1, len(c)))]) if dim else np.zeros((1, len(c)))
        remaining = [np.sqrt(tail[min(b + BLOCK, dim)]) for b in range(0, max(dim, 1), BLOCK)]
        ids = candidates["id"].to_numpy()
        out = [(own, *best(columns, remaining, row, ids, own, k)) for own, row in zip(queries["id"].to_pylist(), q)]
        return pa.table([np.repeat([o for o, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64), np.concatenate([i for _, i, _ in out]),
                         pa.array([int(x) for _, _, s in out for x in s], pa.int64())], schema=shape)

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
          slice_rows: int = 16_384, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` highest integer inner products.

    ``is_query`` is a condition on the column ``id``. The numbers of slices and blocks follow the counts of rows.
    """
    rows = usable(df, vec_id, vector)
    asked = rows.where(is_query)
    n = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    slices, blocks = max(1, -(-n[0] // slice_rows)), max(1, -(-n[1] // block_rows))
    part = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("id", "v", "dim", part(slices, 1).alias("slice"), every(blocks).alias("block"))
    queries = asked.select("id", "v", "dim", part(blocks, 2).alias("block"), every(slices).alias("slice"))
    keys = ["dim", "slice", "block"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        searched(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
