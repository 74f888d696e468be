"""Interaction of filters by an incremental stream with retractions (operator 13).

Five filters fail a document by its text. Four look at the text alone; the fifth fails every document whose text a
smaller id has, so a verdict can change while documents arrive. All files are read as available-now micro-batches.
State keyed by text (in buckets) holds the smallest id so far and the masks of its rows; a row that comes with a larger id fails the fifth
filter at once, and when a smaller id arrives, the masks counted for the earlier one are retracted and counted again
with the failure. What the stream emits are changes of counters by part and mask, written per micro-batch under its
number, so that a repeated batch replaces itself. Any order of files ends at the same counters.

Before rows meet their text's state, each Arrow batch is folded: of the rows of one text only those of the smallest id
go on as they are, the others as counts, spread over keys of their own. So no task gets all copies of a frequent text.

The counters (32 masks per part) give every order of the filters: what a filter removes depends only on the set of
filters before it.

Defined results: a null text is empty, a null part is the empty string. A null id has no smaller id and is smaller than
none. Rows with equal ids and texts stand beside each other: neither fails for the other. A document counts as good or
toxic if any of its labels says so; without an id it has no labels. Texts are read whole, their identity is a 128-bit
digest (BLAKE2b). No rows give no result. Input columns are read by the names given only.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortloom.llm.common import cut
from cohortloom.session import scratch_path

FILTERS = "ABCDE"
DUPLICATE = 16  # the bit of the last filter
_SIGNS, _UPPER = b"#$%&*|", bytes(range(65, 91))
KINDS = ["part", "mask", "good", "toxic"]
_ROW = {"key": pa.binary(), "id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "good": pa.int32(), "toxic": pa.int32(),
        "counted": pa.bool_(), "n": pa.int64()}


def text_mask(text: str) -> int:
    """Bits of the filters that a text fails by itself: few words, few distinct ones, capitals, signs."""
    raw = text.encode()
    words = raw.split()  # bytes split at space and the control characters from tab to carriage return
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 2 * len(text)) << 2
            | (len(raw.translate(None, _SIGNS)) < len(raw)) << 3)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, keys = [], []
        for text in batch.column("t"):
            text = text.as_py()
            masks.append(text_mask(text))
            keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
                                         ["id", "part", "mask", "key"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text in a batch, the rows of its smallest id; all others as counts, under one key for the batch."""
    for batch in batches:
        rows = batch.to_pylist()
        least: dict[bytes, int] = {}
        for r in rows:
            if r["id"] is not None and r["id"] < least.get(r["key"], math.inf):
                least[r["key"]] = r["id"]
        open_rows, rest = Counter(), Counter()
        for r in rows:
            kind = (r["part"], r["mask"], r["good"], r["toxic"])
            if r["id"] is None:
                rest[kind] += 1
            elif r["id"] > least[r["key"]]:
                rest[kind[0], kind[1] | DUPLICATE, *kind[2:]] += 1
            else:
                open_rows[(r["key"], r["id"], *kind)] += 1
        out = [(*k, False, n) for k, n in open_rows.items()]
        if rest:
            own = hashlib.blake2b(repr((len(rows), rows[0])).encode(), digest_size=8).digest()
            out += [(own, 0, *k, True, n) for k, n in rest.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ROW.values())], list(_ROW))


def _kept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the rows of a bucket's texts; the state has each text's smallest id and its masks."""
    changes: Counter = Counter()
    held: dict[bytes, tuple[int, list[tuple]]] = pickle.loads(state.get[0]) if state.exists else {}
    for frame in frames:
        for digest, i, part, mask, good, toxic, counted, n in zip(*[frame[c].tolist() for c in _ROW]):
            kind = (part, mask, good, toxic)
            if counted:
                changes[kind] += n
                continue
            least, kinds = held.get(digest, (math.inf, []))
            if i < least:
                for (p, m, g, t), k in kinds:  # retract, and count again as copies
                    changes[p, m, g, t] -= k
                    changes[p, m | DUPLICATE, g, t] += k
                held[digest] = (i, [(kind, n)])
                changes[kind] += n
            elif i == least:
                kinds.append((kind, n))
                changes[kind] += n
            else:
                changes[part, mask | DUPLICATE, good, toxic] += n
    state.update((pickle.dumps(held),))
    if found := [(*k, n) for k, n in changes.items() if n]:
        yield pd.DataFrame(found, columns=["part", "mask", "good", "toxic", "change"])


def counters(docs: DataFrame, labels: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic``, ``n`` of a stream of documents, run to the end of what is available.

    Texts share ``buckets`` rows of state by their digests, as a call per text would cost more than its work: about a
    thousand texts in each keep a state row below 100 KB. The number does not change the result.
    """
    spark = docs.sparkSession
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = cut(marks.where("l_id is not null and (good = 1 or toxic = 1)"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.mapInArrow(_measured, "id bigint, part string, mask int, key binary")
    rows = rows.join(marks, F.col("id") == F.col("l_id"), "left").select(
        "key", "id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    folded = rows.mapInArrow(_folded, "key binary, id bigint, part string, mask int, good int, toxic int, counted boolean, n bigint")
    folded = folded.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    changes = folded.groupBy("bucket").applyInPandasWithState(
        _kept, "part string, mask int, good int, toxic int, change bigint", "held binary", "append", GroupStateTimeout.NoTimeout)
    out, numbers = scratch_path(spark, "changes"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*KINDS).agg(F.sum("change").alias("change")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        numbers.append(number)

    changes.writeStream.foreachBatch(write).outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", scratch_path(spark, "stream")).start().awaitTermination()
    schema = "part string, mask int, good int, toxic int, change bigint, batch int"
    done = spark.read.schema(schema).parquet(out) if numbers else spark.createDataFrame([], schema)
    return done.groupBy(*KINDS).agg(F.sum("change").alias("n")).where("n <> 0")


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters by part and mask.

    A filter's step depends on the set of filters before it: 80 pairs of filter and set are counted per part, and each
    is then given to the orders that have it.
    """
    steps = [(f, sum(1 << i for i in before), 1 << f, math.factorial(len(before)) * math.factorial(4 - len(before)),
              ["".join(FILTERS[i] for i in (*a, f, *b)) for a in itertools.permutations(before)
               for b in itertools.permutations(set(range(5)) - {f, *before})], len(before) + 1)
             for f in range(5) for k in range(5) for before in itertools.combinations(sorted(set(range(5)) - {f}), k)]
    known = F.explode(F.array(*[F.struct(
        F.lit(bit).alias("bit"), F.lit(before).alias("before"), F.lit(weight).cast("long").alias("weight"),
        F.array(*[F.lit(o) for o in orders]).alias("orders"), F.lit(step).alias("step")) for _, before, bit, weight, orders, step in steps]))
    rows = counted.select(*KINDS, "n", known.alias("s"))
    mask, bit = F.col("mask"), F.col("s.bit")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("s.before")) != 0
    total = lambda *which: F.sum(F.when(reduce(and_, which), F.col("n")).otherwise(F.lit(0))).cast("long")
    each = rows.groupBy("part", "s.bit", "s.before").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(~gone & fails, F.col("good") == 1).alias("good_lost"),
        total(~gone & fails, F.col("toxic") == 1).alias("toxic_lost"),
        F.first("s.weight").alias("weight"), F.first("s.orders").alias("orders"), F.first("s.step").alias("step"))
    by = Window.partitionBy("part", "bit")  # 16 rows
    each = each.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(by))
    return each.select("part", F.explode("orders").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails",
                       "good_lost", "toxic_lost", "shapley")
