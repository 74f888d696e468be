"""The secret scan on planted findings that it was not trained on."""

from pyspark.sql import functions as F

from cohortloom.llm import secret_forest
from cohortloom.llm.planted_findings import HARMLESS, SECRETS, planted

SF = "/root/testdata/sf0.01"


def test_precision_and_recall_on_texts_kept_apart(spark):
    """Split by text: a fifth of the planted texts is only scored."""
    words = secret_forest.dictionary(spark.read.parquet(f"{SF}/documents.parquet"), "text", 5)
    texts = planted(spark, 60)
    held = F.crc32(F.col("doc_id").cast("binary")) % 5 == 0
    known = secret_forest.labelled_findings(texts.where(~held), words)
    truth = secret_forest.labelled_findings(texts.where(held), words).select("id", "place", F.sha2("value", 256).alias("value_hash"), "label")
    got = secret_forest.scan(texts.where(held), labelled=known).join(truth, ["id", "place", "value_hash"]).collect()
    hits = sum(r["is_secret"] and r["label"] == 1 for r in got)
    assert len(got) > 350 and hits / sum(r["is_secret"] for r in got) >= 0.97 and hits / sum(r["label"] == 1 for r in got) >= 0.95


def test_planted_texts(spark):
    rows = planted(spark, 5).collect()
    assert len(rows) == 5 * (len(SECRETS) + len(HARMLESS)) and all(r["value"] and r["value"] in r["text"] for r in rows)
    assert {r["kind"] for r in rows if r["label"] == 1} == set(SECRETS)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, planted(spark, 5).collect()))


def test_key_words_up_to_three_words_back(spark):
    rows = [(1, "the password is Hunter2024 and more"), (2, "password for it Hunter2024"), (3, "password one two three Hunter2024"), (4, "x" * 100_000 + " y"),
            (5, "token = " + "9f" * 20_000), (6, None), (7, "the password is Hunter2024 the password is Hunter2024")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id int, text string, source string, value int")
    got = {}
    for r in secret_forest.candidates(df, "doc_id", "text", "source").collect():
        got.setdefault(r["id"], []).append((r["place"], r["value"]))
    assert (3, "Hunter2024") in got[1] and (3, "Hunter2024") in got[2] and got[3] == [(3, "three")] and len(got[5]) == 1 and 6 not in got
    assert {(3, "Hunter2024"), (7, "Hunter2024")} <= set(got[7])
