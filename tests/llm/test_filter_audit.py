"""The filter audit against filters that are applied one after another, for any order of files."""

import itertools
import random
import uuid

import pytest

from cohortloom.llm import filter_audit as fa

DOCS = "doc_id bigint, text string, source string, part int, mask int, key int"
WHITE = " \t\n\x0b\x0c\r"


def fails(rows):
    """Per row the letters of the filters that fail it."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]
        f = {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        f |= {"E"} if doc_id is not None and doc_id > least[text] else set()
        out.append(f)
    return out


def brute(rows, labels):
    failed = fails(rows)
    good = {d for d, q, t in labels if d is not None and q == 1}
    toxic = {d for d, q, t in labels if d is not None and t == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                removed = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(x in f for _, f in mine) - len(removed), sum(f == {x} for _, f in mine),
                                          sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = lambda k: " ".join(f"w{(i * k) % 997}" for i in range(220))
    texts = [long(1), long(2), long(3) + " #", "A" * 9 + " " + long(4), "two words", "same " * 400, "X " * 250, "", None, " ".join(["z"] * 300),
             "a\x1cb " * 150, "é|" * 5, long(5).replace(" ", "\x0b")]
    out = [(i, rng.choice(texts), rng.choice(["s0", "s0", "s1", None, ""])) for i in range(400)]
    return out + [out[3], out[4], (5, "two words", "s9"), (None, long(1), "s1"), (None, None, None), (2**60 + 1, long(2), "s1"), (2**60 + 2, long(2), "s1")]


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 400, 3)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (9, None, 1)]


def streamed(spark, folder, rows, files, per_trigger, buckets=7):
    """The rows in files of their own, written one after another."""
    path = f"{folder}/{uuid.uuid4().hex}"
    step = -(-len(rows) // files)
    for low in range(0, len(rows), step):
        spark.createDataFrame([(*r, 1, 2, 3) for r in rows[low : low + step]], DOCS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    return fa.counters(stream, labels, buckets)


@pytest.mark.parametrize("order, files, per_trigger", [("down", 6, 1), ("mixed", 5, 2), ("up", 1, 1)])
def test_equals_filters_one_after_another(spark, tmp_path, rows, order, files, per_trigger):
    """With falling ids every later file retracts what an earlier one counted."""
    rows = sorted(rows, key=lambda r: r[0] or 0, reverse=order == "down")
    if order == "mixed":
        random.Random(1).shuffle(rows)
    got = fa.audit(streamed(spark, tmp_path, rows, files, per_trigger)).collect()
    assert sorted(map(tuple, got)) == brute(rows, LABELS)


def test_many_copies_and_an_empty_table(spark, tmp_path):
    copies = [(5000 - i, "a b c", "hot") for i in range(5000)]
    got = {r["mask"]: r["n"] for r in streamed(spark, tmp_path, copies, 3, 1).groupBy("mask").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == {1: 1, 17: 4999}
    empty = f"{tmp_path}/none"
    spark.createDataFrame([], DOCS).write.parquet(empty)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fa.audit(fa.counters(spark.readStream.schema(DOCS).parquet(empty), labels, 1)).count() == 0


def test_masks_of_a_text():
    assert fa.text_mask("") == 1 and fa.text_mask("A") == 1 | 4 and fa.text_mask("x " * 300) == 2
    assert fa.text_mask(" ".join(f"w{i}" for i in range(200))) == 0 and fa.text_mask("&") == 1 | 8
