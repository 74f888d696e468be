"""Benchmark decontamination by a prefix-filtered set join (operator 11).

An item is cut into windows of ``window`` consecutive words (an item of fewer words is one window). A window is a set of
3-word shingles. Shingles are ordered by rarity: by how many documents hold them. A window that must share
``containment`` of its shingles shares at least one of its rarest few (its prefix), so documents meet windows on prefix
shingles alone. Length and position of the shared shingle bound where the window can start, and each place left is
verified on the words themselves.

One pass reads the texts. It keeps the stretches of words whose shingles may belong to a window, by a bit table of
window shingles whose size is bounded (``max_bits``); a full table keeps more words, never fewer. Equal stretches are
looked at once, however many documents hold them. Everything after the pass is as large as these stretches.

Defined results: words are case-folded for A-Z only. Null and empty texts and texts without a word have no words and hit
nothing; such items have no window. Repeated documents count each, repeated items once. An item without an id hits
words and counts as one item, but no id is listed for it. Texts and items of any length are used whole; a hit never
reaches past the end of its text. Empty tables give no rows, or rows without hits. Input columns come back in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import cut
from cohortloom.llm.words import blocks, hash_shingles, hash_words, split_words

SHINGLE = 3
#: Bytes of words: digits, letters (A-Z folded) and everything outside ASCII; all others are 0.
_FOLD = np.zeros(256, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[65:91] = _FOLD[97:123]
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def _item_windows(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item"], frame["t"]):
                words = _WORDS.findall(text.encode().lower())
                n = min(window, len(words))
                if not n:
                    continue
                code = _FOLD[np.frombuffer(b" ".join(words), np.uint8)]
                hashes = hash_shingles(hash_words(code, *split_words(code, np.array([0]))), min(SHINGLE, n)).view(np.int64)
                for low in range(0, len(words) - n + 1, 4096):
                    at = range(low, min(low + 4096, len(words) - n + 1))
                    yield pd.DataFrame({"item": item, "pattern": [b" ".join(words[i : i + n]).decode() for i in at], "n": n,
                                        "hashes": [hashes[i : i + n - min(SHINGLE, n) + 1] for i in at]})

    return run


def _stretches(bits, sizes: dict[int, int], reach: int):
    """Per text: its number of words, and its stretches of words that may belong to a window."""

    def chunk(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        code = _FOLD[raw]
        starts, ends = split_words(code, offsets)
        texts = len(offsets) - 1
        which = np.searchsorted(offsets, starts, "right") - 1
        edge = np.searchsorted(which, np.arange(texts + 1))
        found: list[list[dict]] = [[] for _ in range(texts)]
        if not sizes or not len(starts):
            return np.diff(edge), found
        words, table = hash_words(code, starts, ends), bits.value
        wanted = np.zeros(len(starts) + 1, np.int64)
        for size, least in sizes.items():
            h = hash_shingles(words, size) & np.uint64(8 * len(table) - 1)
            hit = np.flatnonzero(((table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                                 & (which[size - 1 :] == which[: len(h)])) if len(h) else np.empty(0, np.int64)
            low, high = np.maximum(hit - reach, edge[which[hit]]), np.minimum(hit + size + reach, edge[which[hit] + 1])
            mine = np.cumsum(np.bincount(low, minlength=len(wanted)) - np.bincount(high, minlength=len(wanted))) > 0
            a, b = _runs(mine[:-1], which)
            long = b - a >= least
            wanted += np.bincount(a[long], minlength=len(wanted)) - np.bincount(b[long], minlength=len(wanted))
        for a, b in zip(*_runs(np.cumsum(wanted)[:-1] > 0, which)):
            piece = code[starts[a] : ends[b - 1]].tobytes()
            found[which[a]].append({"start": int(a - edge[which[a]]), "words": b" ".join(_WORDS.findall(piece)).decode()})
        return np.diff(edge), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for _, _, raw, offsets in blocks(batch.column("t")):
                n, runs = chunk(raw, offsets)
                counts.append(n)
                found += runs
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(np.concatenate(counts), pa.int64()),
                     pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.string())])))], ["row", "n_words", "runs"])

    return run


def _runs(inside: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of ``inside`` begin and end, cut where ``which`` changes."""
    same = np.append(False, inside[:-1] & (which[1:] == which[:-1]))
    begin = np.flatnonzero(inside & ~same)
    end = np.flatnonzero(inside & ~np.append(same[1:] & inside[1:], False)) + 1
    return begin, end


def _bit_table(hashes: DataFrame, max_bits: int) -> np.ndarray:
    """Bits of the distinct hashes ``h``: about 64 for each, but at most 2 ** ``max_bits`` (16 MB at 27)."""
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(max_bits, max(15, int(64 * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(2**bits - 1)) + 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    table = np.zeros(2**bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        table[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["b"], np.uint8)
    return table


def _shingles(words: Column, size: Column) -> Column:
    """(pos, shingle) of every ``size`` consecutive words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size),
                       lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, size), " ").alias("shingle")))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, containment: float = 1.0, text: str = "text",
                item_id: str = "item_id", item_text: str = "text", max_bits: int = 27) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (rid, row, n_words, runs), places of windows in their stretches, and windows with their items.

    A place (k1, k2, start, n, pattern, share) says that the ``n`` words from ``start`` of the stretch with hashes k1 and
    k2 hold ``share`` of the shingles of ``pattern``, at least ``containment``. At a containment of 1 a place has the
    window's words one by one.
    """
    windows = cut(items.select(F.col(f"`{item_id}`").alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("t"))
                  .mapInPandas(_item_windows(window), f"item {dict(items.dtypes)[item_id]}, pattern string, n int, hashes array<bigint>"))
    lengths = windows.groupBy(F.least("n", F.lit(SHINGLE)).alias("size")).agg(F.min("n").alias("n")).collect()  # 3 rows at most
    exact = containment >= 1
    sizes = {r["size"]: r["n"] if exact else 1 for r in lengths}
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(windows.select(F.explode("hashes").alias("h")), max_bits))
    kept = docs.columns if text not in docs.columns else [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.mapInArrow(_stretches(bits, sizes, 0 if exact else window - 1),
                           f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,words:string>>")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    # One row per distinct stretch, with the number of times that documents hold it.
    stretches = rows.select(F.explode("runs").alias("run")).groupBy(F.col("run.words").alias("words")).agg(F.count(F.lit(1)).alias("held"))
    stretches = stretches.select(*run_key(F.col("words")), "held", F.split("words", " ").alias("w"))
    around = F.lit(window - 1)
    each = [F.transform(_shingles(F.col("w"), F.lit(size)), lambda s: F.struct(
        s["pos"].alias("pos"), s["shingle"].alias("shingle"), F.least(s["pos"], around).alias("before"),
        F.slice("w", s["pos"] - F.least(s["pos"], around) + 1, F.least(s["pos"], around) + window).alias("near")))
        for size in sizes]
    places = [stretches.where(F.size("w") >= size).select("k1", "k2", "held", F.explode(s).alias("s")) for size, s in zip(sizes, each)]
    if not places:
        places = [stretches.where("false").select("k1", "k2", "held", F.explode(_shingles(F.col("w"), F.lit(1))).alias("s"))
                  .withColumn("s", F.struct("s.*", F.lit(0).alias("before"), F.array(F.lit("")).alias("near")))]
    spots = places[0]
    for more in places[1:]:
        spots = spots.union(more)
    spots = cut(spots.select("k1", "k2", "held", "s.*"))
    patterns = windows.select("pattern", "n").distinct().withColumn("w", F.split("pattern", " "))
    own = patterns.select("pattern", "n", F.explode(_shingles(F.col("w"), F.least("n", F.lit(SHINGLE)))).alias("s"))
    own = own.groupBy("pattern", "n", F.col("s.shingle").alias("shingle")).agg(F.collect_list("s.pos").alias("offsets"))  # a window at most
    rarity = spots.groupBy("shingle").agg(F.sum("held").alias("held"))
    by = Window.partitionBy("pattern")
    ranked = own.join(rarity, "shingle", "left").withColumn("rank", F.row_number().over(by.orderBy(F.coalesce("held", F.lit(0)), "shingle")))
    ranked = ranked.withColumn("size", F.count(F.lit(1)).over(by)).withColumn("needed", F.ceil(F.col("size") * F.lit(float(containment)) - 1e-9))
    prefix = ranked.where(F.col("rank") <= F.col("size") - F.greatest("needed", F.lit(1)) + 1).select("pattern", "n", "shingle", "offsets", "size")
    # Where the window can start, as seen from the shared shingle: at its own offsets, or anywhere around it.
    span = F.col("n") - F.least("n", F.lit(SHINGLE))
    back = F.explode("offsets") if exact else F.explode(F.sequence(F.lit(0), span))
    met = spots.select("k1", "k2", "pos", "shingle", "before", "near").join(prefix, "shingle").select("*", back.alias("back"))
    met = met.where((F.col("back") <= F.col("before")) & (F.col("before") - F.col("back") + F.col("n") <= F.size("near")))
    met = met.withColumn("there", F.slice("near", F.col("before") - F.col("back") + 1, F.col("n")))
    if exact:
        met = met.where(F.array_join("there", " ") == F.col("pattern")).withColumn("share", F.lit(1.0))
    else:
        shingles = lambda w: F.transform(_shingles(w, F.least("n", F.lit(SHINGLE))), lambda s: s["shingle"])
        met = met.withColumn("share", F.size(F.array_intersect(shingles(F.col("there")), shingles(F.split("pattern", " ")))) / F.col("size"))
        met = met.where(F.col("share") >= containment - 1e-9)
    found = met.select("k1", "k2", (F.col("pos") - F.col("back")).alias("start"), "n", "pattern", "share").distinct()
    return rows, cut(found), windows.select("pattern", "item").distinct()


def run_key(words: Column) -> list[Column]:
    """Two 64-bit hashes of a stretch."""
    return [F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(1), words).alias("k2")]


def spans(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Every place of a window in a document: ``row``, first word, number of words, item and shared part."""
    rows, found, owners = occurrences(docs, items, **how)
    held = rows.select("rid", "row", F.explode("runs").alias("run")).select("rid", "row", "run.start", *run_key(F.col("run.words")))
    got = held.withColumnRenamed("start", "from").join(found, ["k1", "k2"]).join(owners, "pattern")
    return got.select("rid", "row", (F.col("from") + F.col("start")).alias("first_word"), F.col("n").alias("n_words"), "item", "share")


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``row``, ``n_words``, ``n_hit`` (words inside windows), ``n_items`` and ``items`` (their ids as sorted strings)."""
    rows, found, owners = occurrences(docs, items, **how)
    # Stretches do not overlap and hold their windows whole, so hit words are counted once per distinct stretch.
    hit = found.select("k1", "k2", "start", "n").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda a, x: F.struct(
        F.greatest(a["to"], x["start"] + x["n"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["to"], x["start"]))).alias("n")))
    hit = hit.select("k1", "k2", covered["n"].alias("hit"))
    whose = found.select("k1", "k2", "pattern").distinct().join(owners, "pattern").select(
        "k1", "k2", F.struct(F.col("item").cast("string").alias("id")).alias("item")).groupBy("k1", "k2").agg(F.collect_set("item").alias("of"))
    each = cut(hit.join(whose, ["k1", "k2"]))
    held = rows.select("rid", F.explode("runs").alias("run")).select("rid", *run_key(F.col("run.words")))
    per_doc = held.join(each, ["k1", "k2"]).groupBy("rid").agg(
        F.sum("hit").cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("of"))).alias("of"))
    out = rows.select("rid", "row", "n_words").join(per_doc, "rid", "left")
    ids = F.array_sort(F.filter(F.transform("of", lambda x: x["id"]), lambda x: x.isNotNull()))
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce(F.size("of"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce(ids, F.array().cast("array<string>")).alias("items"))
