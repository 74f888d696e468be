"""A filter by a list of keys that costs no shuffle: a bit table of hashed keys, as in a Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** 20 bits are 128 KB, whatever the number of keys.
_BITS = 20


def _word(key: Column, bits: int) -> tuple[Column, Column]:
    """Which 64-bit word of the table, and which bit of it, belongs to a key."""
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")


def bit_table(keys: DataFrame, key: str, bits: int = _BITS) -> Column:
    """The table as a scalar subquery: ``2 ** bits`` bits, however many keys there are.

    Spark runs it before the rows that it filters. Tasks fold their keys to words first, so only
    words are shuffled; one array of them is made, whose size ``bits`` fixes (6 at least).
    """
    word, bit = _word(F.col(key), bits)
    filled = keys.select(word.alias("w"), bit.alias("b"))
    words = filled.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    spark = keys.sparkSession
    empty = spark.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("v"))
    dense = words.union(empty).groupBy("w").agg(F.bit_or("v").alias("v"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])).scalar()


def in_table(keys: DataFrame, key: str, keys_key: str | None = None, bits: int = _BITS) -> Column:
    """Whether the bit of the column ``key`` is set in the table of ``keys``; NULL for a missing key."""
    word, bit = _word(F.col(key), bits)
    table = bit_table(keys.filter(F.col(keys_key or key).isNotNull()), keys_key or key, bits)
    return F.when(F.col(key).isNotNull(), F.getbit(F.get(table, word), bit) == 1)


def maybe_members(df: DataFrame, keys: DataFrame, key: str, keys_key: str | None = None, bits: int = _BITS) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``, and few others: about ``n / 2 ** bits`` of the rest for ``n`` keys.

    To be followed by the exact join. A list that fills the table filters nothing, and loses nothing.
    A missing key is no member.
    """
    return df.filter(in_table(keys, key, keys_key, bits))


def split_members(df: DataFrame, keys: DataFrame, key: str, keys_key: str | None = None,
                  bits: int = _BITS) -> tuple[DataFrame, DataFrame]:
    """``maybe_members`` and all other rows: these need not take part in a join with ``keys``."""
    there = F.coalesce(in_table(keys, key, keys_key, bits), F.lit(False))
    return df.filter(there), df.filter(~there)
