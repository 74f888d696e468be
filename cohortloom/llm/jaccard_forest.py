"""Similarity join on word shingles by a MinHash LSH forest (operator 8).

Documents are sets of 5-word shingles. Equal sets are one class, which only its representative stands for. Each class
has a signature for every tree of the forest; classes with equal signatures in a tree are candidates. All signatures have
one fixed depth (banding): the longest at which the chance that two sets at the threshold meet in some tree reaches the
target recall. No longer or shorter prefix is matched.

Candidates are verified exactly. A node of the trie is one group, larger ones are cut into blocks of members and every
pair of blocks is a group of its own: no task holds more than two blocks, and no pair leaves the task. A group returns
per member its number of links and the smallest member that it is joined with; a pair that shares nodes in several
trees counts in the first of them alone.

Defined results: words are split at white space, case and punctuation count. A text of one to four words is one shingle
of all its words. Null, empty and blank texts have no shingles, link with nothing and form a class each. Repeated rows
are copies of each other. An empty table gives an empty result. Texts of any length are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import BITS, cut, release, returned, small_batches, text_key
from cohortloom.llm.words import blocks, hash_shingles, hash_words, split_words
from cohortloom.operators.member_filter import maybe_members, split_members

WORDS = 5
#: Bytes of words as they are, white space as 0; the byte 0 itself takes the place of a separator that is white space.
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[0], _SPACE[[9, 10, 11, 12, 13, 32]] = 28, 0
#: White space besides: characters, and the bytes that they may start with.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_BYTES = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def matched_prefix(trees: int, max_depth: int, threshold: float, target_recall: float) -> int:
    """The longest prefix at which a pair at ``threshold`` meets in some tree with the target probability."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target_recall:
        depth -= 1
    return depth


def _letters(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts (see ``words.blocks``) with 0 for every white space."""
    for first, to, raw, offsets in blocks(texts):
        if _ODD_BYTES.search(raw.tobytes()):  # white space outside of ASCII's: texts of such blocks are written anew
            plain = pa.array([_ODD_SPACE.sub(" ", t) for t in texts.slice(first, to - first).to_pylist()], pa.string())
            yield from ((first + a, first + b, _SPACE[r], o) for a, b, r, o in blocks(plain))
        else:
            yield first, to, _SPACE[raw], offsets


def shingled(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles."""
    for first, to, code, offsets in _letters(texts):
        starts, ends = split_words(code, offsets)
        words = hash_words(code, starts, ends)
        edge = np.searchsorted(starts, offsets)
        for i in range(to - first):
            own = words[edge[i] : edge[i + 1]]
            yield np.unique(hash_shingles(own, min(WORDS, len(own)))) if len(own) else own


def signed(trees: int, depth: int):
    """Per text: the set's digest and the key of its node in every tree."""
    mix = np.random.default_rng(12).integers(1, 2**31, (trees * depth, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returned(batches):
            digests, keys = [], []
            for s in shingled(batch.column("t")):
                if not len(s):
                    digests.append(None)
                    keys.append([])
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                short = (s >> np.uint64(32)).astype(np.uint32)  # minima need few bits; equal minima are verified anyway
                low = np.full(len(mix), np.iinfo(np.uint32).max, np.uint32)
                for at in range(0, len(s), 1024):  # bounded memory for long texts
                    low = np.minimum(low, (short[at : at + 1024] * mix).min(axis=1))
                keys.append([xxhash.xxh3_64_intdigest(p.tobytes(), seed=t) - 2**63 for t, p in enumerate(low.reshape(trees, depth))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "k1", "k2", "node", "keys"])

    return run


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest connected index of every row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(threshold: float):
    """Exact links within each group of a partition that is sorted by (tree, key, left, right)."""

    def group(rows: list[tuple]) -> tuple | None:
        rows = list({r[0]: r for r in rows}.values())  # a repeated representative is one member
        rows.sort(key=lambda r: r[0])
        tree, left, right = rows[0][6], rows[0][4], rows[0][5]
        n = len(rows)
        if n < 2:
            return None
        size = np.array([len(r[1]) for r in rows], np.float64)
        which = np.repeat(np.arange(n), size.astype(int))
        values, at, times = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True, return_counts=True)
        shared = times[at] > 1  # a shingle of one member alone is in no intersection
        which, at = which[shared], at[shared]
        place = np.cumsum(times > 1) - 1
        at, total = place[at], int((times > 1).sum())
        common = np.zeros((n, n), np.float32)
        order = np.argsort(at, kind="stable")
        which, at = which[order], at[order]
        step = max(1024, 4_000_000 // n)
        for begin in range(0, total, step):
            a, b = np.searchsorted(at, [begin, begin + step])
            m = np.zeros((n, min(step, total - begin)), np.float32)
            m[which[a:b], at[a:b] - begin] = 1
            common += m @ m.T
        union = size[:, None] + size[None, :] - common
        linked = common >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        if left != right:  # pairs inside one block belong to that block's own group
            block = np.array([r[3] for r in rows])
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            return None
        keys = np.array([r[2] for r in rows])
        counted = linked.copy()
        for t in range(tree):
            counted &= keys[:, t][:, None] != keys[:, t][None, :]
        weight = np.array([r[7] for r in rows], np.int64)
        root, links, touched = _components(linked), counted @ weight, linked.any(axis=1)
        return [rows[i][0] for i in np.flatnonzero(touched)], [rows[root[i]][0] for i in np.flatnonzero(touched)], links[touched]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for frame in returned(frames):
            out: list[tuple] = []
            for node, raw, keys, block, left, right, tree, weight, key in zip(
                    *[frame[c] for c in ("node", "shingles", "keys", "block", "left", "right", "tree", "weight", "key")]):
                if (mine := (tree, key, left, right)) != now:
                    if rows and (found := group(rows)):
                        out.append(found)
                    now, rows = mine, []
                rows.append((node, np.frombuffer(raw, np.uint64), keys, block, left, right, tree, weight))
            yield _links(out)
        if rows and (found := group(rows)):
            yield _links([found])

    return run


def _links(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"a": [x for f in found for x in f[0]], "b": [x for f in found for x in f[1]],
                         "links": np.concatenate([f[2] for f in found]) if found else np.empty(0, np.int64)})


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in returned(batches):
        sets = [s.tobytes() for s in shingled(batch.column("t"))]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): the smallest node of every connected component.

    Alternates between hanging each node's larger neighbours below its smallest one and its smaller neighbours
    together, until nothing moves. Each round is two aggregations and joins of narrow rows; nothing is gathered per node.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = cut(edges), None
    while True:
        # Larger neighbours of a node hang below the smallest node around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # A node's smaller neighbours hang below the smallest of them.
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges, old = cut(small), edges
        release(old)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, trees: int = 20,
                    max_depth: int = 8, target_recall: float = 0.9999, block: int = 512, only: DataFrame | None = None,
                    bits: int = BITS) -> DataFrame:
    """Per row of ``df``: ``id``, the hashes ``k1`` and ``k2`` of its text, ``class_id`` and ``n_links``.

    ``class_id`` is the smallest id of the class: documents joined by chains of links. ``n_links`` is the number of
    other rows whose set has a Jaccard similarity of at least ``threshold``, copies included. ``only`` (k1, k2) leaves
    all other texts out, as if they were not in ``df``.

    Texts that are needed a second time are picked by a bit table of their ids (``2 ** bits`` bits, whatever their
    number), so that others are not shuffled; where the table is full, all are, and results stay the same.
    """
    depth = matched_prefix(trees, max_depth, threshold, target_recall)
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), t.alias("t"), *text_key(t))
    if only is not None:
        rows = maybe_members(rows, only, "k1", bits=bits)
    kind = dict(rows.dtypes)["id"]
    sets = rows.withColumn("t", F.coalesce("t", F.lit(""))).mapInArrow(
        signed(trees, depth), f"id {kind}, k1 bigint, k2 bigint, node binary, keys array<bigint>")
    with small_batches(df.sparkSession):
        sets = cut(sets if only is None else sets.join(only.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"))
    classes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"))
    classes = cut(classes)
    spots = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    # Nodes of a trie with the same members in several trees are looked at once, in the first of these trees.
    nodes = spots.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                             F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where(F.col("members") > 1)
    first = nodes.groupBy("members", "x", "y").agg(F.min(F.struct("tree", "key")).alias("at"))
    first = first.select("at.tree", "at.key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    # Merge joins at every size, so that the plan measured on little data is the plan on much.
    members = cut(spots.join(first.hint("merge"), ["tree", "key"]))
    wanted = members.select("node").distinct().join(classes.select("node", "rep", "weight", "keys"), "node")
    wanted = cut(wanted)
    # Only classes that have candidates are shingled again.
    again = wanted.select(F.col("rep").alias("r"), F.xxhash64("rep").alias("h")).distinct()
    texts = maybe_members(rows.select("id", "t", F.xxhash64("id").alias("h")), again, "h", bits=bits).select("id", "t")
    texts = texts.join(again.select("r").hint("merge"), F.col("id").eqNullSafe(F.col("r")), "left_semi")
    full = texts.select("t").where(F.trim("t") != "").mapInArrow(_with_shingles, "node binary, shingles binary")
    full = full.join(wanted.select("node", "weight", "keys"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = members.withColumn("block", mine).select("node", "tree", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("node", "tree", "key", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    groups = full.join(spread, "node").repartition("tree", "key", "left", "right").sortWithinPartitions("tree", "key", "left", "right")
    with small_batches(df.sparkSession):
        found = cut(groups.mapInPandas(verify(threshold), "a binary, b binary, links bigint"))
    release(members, wanted)
    roots = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    per_class = classes.select("node", "rep", "weight").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = per_class.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_class = per_class.join(ids, "root").select(F.col("node").alias("c_node"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return sets.join(per_class, F.col("node") == F.col("c_node"), "left").select(
        "id", "k1", "k2", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.hex("root"), F.concat_ws("/", "id", "k1", "k2")).alias("group"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, **how: float) -> DataFrame:
    """The rows of ``df``, all columns, that stay: of each class the one with the smallest id, ties to the smaller hash.

    Rows that are equal in id and text cannot be told apart by their verdict, so only those are made distinct. Rows
    whose class has no other row, nearly all in most corpora, pass where they lie: only the others meet their verdict
    by a join.
    """
    found = near_duplicates(df, doc_id, text, bits=bits, **how)
    same = cut(found.groupBy("group", "id", "k1", "k2").agg(F.count(F.lit(1)).alias("times")))
    classes = same.groupBy("group").agg(F.sum("times").alias("rows"), F.min(F.struct("id", "k1", "k2")).alias("first")).where("rows > 1")
    here = F.struct("id", "k1", "k2")
    verdicts = cut(same.join(classes, "group").select(F.col("id").alias("v_id"), F.col("k1").alias("v1"), F.col("k2").alias("v2"), "times",
                                                      here.eqNullSafe(F.col("first")).alias("stays"), F.xxhash64("id", "k1", "k2").alias("h")))
    release(same)
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), *text_key(t))
    doubtful, alone = split_members(rows.withColumn("h", F.xxhash64("id", "k1", "k2")), verdicts, "h", bits=bits)
    judged = doubtful.drop("h").join(verdicts.drop("h"), F.col("id").eqNullSafe(F.col("v_id")) & (F.col("k1") == F.col("v1")) & (F.col("k2") == F.col("v2")), "left")
    judged = judged.where(F.coalesce("stays", F.lit(True)))
    once = judged.where(F.coalesce("times", F.lit(1)) == 1).select("row")
    kept = alone.select("row").union(once).union(judged.where("times > 1").dropDuplicates(["id", "k1", "k2"]).select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
