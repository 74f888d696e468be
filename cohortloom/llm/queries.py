"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (decontaminate, filter_audit, jaccard_forest, licence_index, line_templates, main_text, merkle, mixing,
                            neighbour_quality, packing, pipeline, quality_rules, secret_forest, topk)
from cohortloom.llm.common import table
from cohortloom.llm.sql import ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, for as many tokens as the corpus has, at most four epochs."""
    docs = table(spark, sf_dir, "documents")
    got = mixing.mixed(docs.select("doc_id", "text", "lang", "source"), pipeline.tree(), pipeline.tree_weights(spark), 1.0, 4, 7)
    return got.select(F.col("id").alias("doc_id"), *mixing.LEVELS, F.col("epochs").cast("long").alias("epochs"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), file).withColumnRenamed("id", "doc_id")


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_templates.without_recurring(table(spark, sf_dir, "documents"))
    return got.select("row.doc_id", F.col("clean").alias("text"), "n_lines", "n_dropped")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_forest.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licence_index.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neighbour_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).withColumnRenamed("id", "doc_id")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("row.doc_id", *[f"m.{c}" for c in quality_rules.MEASURES], "base_failed", "kept", "host_rejected")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    got = decontaminate.decontaminate(docs, items)
    return got.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof; the root again from its leaf, tampered with where 3 divides crc32."""
    docs = table(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(65, 91)))
    changed = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(changed))
    got = merkle.manifest(docs, tampered=tampered).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return got.select("row.doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters, from a stream over the files of the documents in four to eight micro-batches."""
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    files = max(1, len(docs.inputFiles()) // 4)
    buckets = docs.count() // 1000 + 1  # from the files' footers
    # A pattern, since a stream's plain path must be a folder and the table may be one file.
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/documents.parque[t]")
    return filter_audit.audit(filter_audit.counters(stream, table(spark, sf_dir, "labels"), buckets))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_line_templates": op3_line_templates,
    "op8_jaccard": op8_jaccard,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_main_text": op7_main_text,
    "op9_topk": op9_topk,
    "op10_quality_rules": op10_quality_rules,
    "op11_decontaminate": op11_decontaminate,
    "op12_merkle": op12_merkle,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline.run,
}

__all__ = ["ORACLE", "QUERIES"]
