"""Recurring lines by a tree of line templates (operator 3).

The tree has a fixed depth: the number of tokens of a line, then its leading tokens (those with a digit stand for any
value). In a leaf of the tree, a token is part of the template where enough lines hold it at that position; every other
position is a variable field. Lines with equal templates belong together. A line that recurs across documents is
boilerplate, wherever it stands, and is dropped from all of them.

Documents are counted by classes: exact copies and near copies (chains of 5-word shingle sets with a Jaccard similarity
of at least ``similar``, among the documents that hold a line like one of another text) count once, so copies do not make
their own text look like boilerplate. A line needs
``min_classes`` classes that hold it as it is, or its template ``min_varied`` classes. Counts at a limit reach it; a
line that recurs both as it is and by its template is named by the greater template.

Defined results: null texts stay null, empty texts stay empty; a text whose lines all go becomes empty. Lines with
fewer than ``min_tokens`` tokens recur by chance more often: they have no variable fields and need ``min_varied``
classes. Lines without a letter or digit stay. Equal texts get equal results. An empty table gives an empty result. All
input columns come back; working columns live beside a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import BITS, cut, release, text_key
from cohortloom.llm.jaccard_forest import near_duplicates
from cohortloom.operators.member_filter import maybe_members, split_members


def leading(line: Column, n: int) -> Column:
    """The first ``n`` tokens, tokens with a digit masked."""
    return F.regexp_replace(F.substring_index(F.trim(line), " ", n), r"[^ ]*[0-9][^ ]*", "<*>")


def lines_of(texts: DataFrame, lead: int) -> DataFrame:
    """Line number, line, its hash, its number of tokens and its leaf of the tree, of every line of ``t`` with a word."""
    lines = texts.select("k1", "k2", F.posexplode(F.split("t", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    n = (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
    lines = lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("n", n).withColumn("h", F.xxhash64("line"))
    return lines.withColumn("leaf", F.xxhash64("n", leading(F.col("line"), lead)))


def recurring_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lead: int = 3, min_classes: int = 2, min_varied: int = 5,
                    min_constant: float = 0.7, min_tokens: int = 5, similar: float = 0.75, bits: int = BITS) -> DataFrame:
    """Distinct (k1, k2, line_no, template) of the lines to drop; k1 and k2 are the hashes of the whole text.

    Lines are hashes and numbers until a leaf is known to need their words. A line recurs only if two different texts
    hold lines of its leaf; only documents with such a line are put into classes, and chains of near copies are looked
    for among them. A leaf with fewer classes than a line needs holds none. A template of which less than
    ``min_constant`` is constant says nothing; its lines count as they are.
    """
    t = F.col(f"`{text}`").cast("string")
    texts = df.select(F.col(f"`{doc_id}`").alias("id"), t.alias("t"), *text_key(t)).where(F.col("t").isNotNull())
    # Equal lines of equal texts are one row: a task folds the copies that it sees.
    lines = cut(lines_of(texts, lead).select("k1", "k2", "line_no", "leaf", "h", "n").distinct())
    shared = lines.groupBy("leaf").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b").select("leaf")
    cand = cut(maybe_members(lines, shared, "leaf", bits=bits).join(shared, "leaf", "left_semi"))
    release(lines)
    owners = cut(cand.select("k1", "k2").distinct())
    classes = near_duplicates(texts.select("id", "t"), "id", "t", threshold=similar, only=owners, bits=bits)
    classes = cut(classes.groupBy("k1", "k2").agg(F.min(F.xxhash64("group")).alias("class")))
    # One row per distinct line and class from here on, then one per distinct line.
    held = cut(cand.join(classes, ["k1", "k2"]).select("leaf", "h", "n", "class").distinct())
    leaves = held.groupBy("leaf").agg(F.count_distinct("class").alias("in_leaf")).where(F.col("in_leaf") >= min_classes)
    known = cut(held.groupBy("leaf", "h", "n").agg(F.count(F.lit(1)).alias("classes")).join(leaves, "leaf"))
    varied = known.where((F.col("in_leaf") >= min_varied) & (F.col("n") >= min_tokens)).select("leaf", "h", "n", "classes")
    # The words of these lines, from the documents that hold them.
    holders = cand.join(varied.select("leaf", "h"), ["leaf", "h"], "left_semi").select("k1").distinct()
    again = lines_of(maybe_members(texts, holders, "k1", bits=bits), lead).select("leaf", "h", "line")
    again = maybe_members(again, varied, "h", bits=bits).distinct().join(varied, ["leaf", "h"])
    tokens = cut(again.select("leaf", "h", "n", "classes", F.posexplode_outer(F.split("line", " ")).alias("pos", "token")))
    constant = tokens.groupBy("leaf", "pos", "token").agg(F.sum("classes").alias("s")).where(F.col("s") >= min_varied)
    constant = constant.select("leaf", "pos", "token", F.lit(True).alias("constant"))
    tokens = tokens.join(constant, ["leaf", "pos", "token"], "left")
    field = F.when(F.col("constant"), F.col("token")).otherwise(F.lit("<*>"))
    parsed = tokens.groupBy("leaf", "h", "n").agg(
        F.bit_xor(F.xxhash64("pos", field)).alias("shape"), F.count("constant").alias("n_constant"))
    parsed = cut(parsed.where(F.col("n_constant") >= min_constant * F.col("n")).select("leaf", "h", F.xxhash64("leaf", "shape").alias("template")))
    common = held.join(parsed, ["leaf", "h"]).select("template", "class").distinct().groupBy("template").agg(
        F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_varied).select("template")
    least = F.when(F.col("n") >= min_tokens, min_classes).otherwise(min_varied)
    found = known.where(F.col("classes") >= least).select("leaf", "h", F.xxhash64("leaf", "h").alias("template"))
    found = found.union(parsed.join(common, "template", "left_semi").select("leaf", "h", "template"))
    found = cut(found.groupBy("leaf", "h").agg(F.max("template").alias("template")))
    drop = cut(maybe_members(cand, found, "h", bits=bits).join(found, ["leaf", "h"]).select("k1", "k2", "line_no", "template"))
    release(cand, owners, classes, held, known, tokens, parsed, found)
    return drop


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without the numbers in the sorted array ``gone``: the stretches between them, in one pass."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda j: F.slice(
        lines, F.get(ends, j - 1) + 2, F.get(ends, j) - F.get(ends, j - 1) - 1)))


def without_recurring(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, **how: float) -> DataFrame:
    """``df`` as struct ``row`` with ``clean`` (its text without recurring lines), ``n_lines`` and ``n_dropped``.

    Texts that lose no line pass where they lie; only the others are brought together with their numbers.
    """
    drop = recurring_lines(df, text, doc_id, bits=bits, **how)
    gone = cut(drop.groupBy(F.col("k1").alias("d1"), F.col("k2").alias("d2")).agg(F.sort_array(F.collect_list("line_no")).alias("gone")))
    release(drop)
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), t.alias("t"), *text_key(t))
    doubtful, whole = split_members(rows, gone, "k1", "d1", bits)
    doubtful = doubtful.join(gone, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left").select("row", "t", "gone")
    rows = doubtful.union(whole.select("row", "t", F.lit(None).cast("array<int>").alias("gone"))).withColumn("lines", F.split("t", "\n"))
    return rows.select("row", F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(without(F.col("lines"), F.col("gone")), "\n")).alias("clean"),
                       F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                       F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
