"""The training-data pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Each stage takes all that its predecessor kept; all but the last return the columns of documents. Defined results for
every stage: nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns,
whatever their names, go through; what happens to such rows is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import jaccard_forest, line_templates, mixing, packing, quality_rules
from cohortloom.llm.common import cut, table

#: Share of the tokens that reach the mixing stage which it passes on.
MIX_BUDGET = 0.9


def tree() -> list[Column]:
    """Domain, language and source of a document; the tables have no domain, so sources are dealt to four."""
    domain = F.concat(F.lit("domain"), F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4)).cast("string"))
    return [domain, F.col("lang"), F.col("source")]


def tree_weights(spark: SparkSession) -> DataFrame:
    """Weights of the tree's nodes; a node that is not listed weighs 1. Literals: no Python worker is started for them."""
    rows = [(f"domain{k}", None, None, w) for k, w in enumerate((4.0, 3.0, 2.0, 1.0))]
    rows += [(f"domain{k}", lang, None, w) for k in range(4) for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))]
    node = [F.struct(*[F.lit(v).cast(kind).alias(c) for c, kind, v in zip(
        ("domain", "lang", "source", "weight"), ("string", "string", "string", "double"), row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*node)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own figures and whose host pass. Null and empty texts fail; repeated rows share their verdict."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document of which nothing is left goes.

    ``n_chars`` is counted anew, null texts stay null, and all other columns pass as they are.
    """
    got = line_templates.without_recurring(docs)
    gone = (F.col("n_dropped") > 0) & (F.trim("clean") == "")
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return got.where(~F.coalesce(gone, F.lit(False))).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id, null before all. Null and blank texts are classes of their own."""
    return jaccard_forest.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Target weights over what is left, each document at most once; equal rows are taken together."""
    got = mixing.mixed(docs, tree(), tree_weights(spark), MIX_BUDGET, 1, 7)
    return got.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; of the documents' columns only the id goes on. A null text is packed as an empty one."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mix), ("packing", pack)]
#: Token ids, MinHash classes and seeded orders have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
