"""Benchmark decontamination against a plain search for every window at every place."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate as dec
from cohortloom.llm import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, n_words int, runs int, row int"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    patterns = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        out.append((doc_id, len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS),
            spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, pattern int"))


def got(docs, items, **how):
    rows = dec.decontaminate(docs, items, **how).select("row.doc_id", "n_words", "n_hit", "n_items", "items").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["items"])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def corpus():
    """Few words, so that shingles repeat; passages of items, cut, changed, doubled and beside each other."""
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Dé", "e1", "ñandú", "the", "of", "x" * 40]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(25)]
    items += [(3, items[3][1]), (90, "a a a a a a a a a a a a"), (None, text(14)), (91, None), (92, ""), (93, " .,- "), (94, items[0][1].upper())]
    docs = []
    for i in range(120):
        pieces = [text(rng.choice([0, 1, 5, 40]))]
        for _ in range(rng.choice([0, 1, 3])):
            w = words_of(rng.choice(items)[1])
            if w:
                low, n = rng.randrange(len(w)), rng.randint(1, 14)
                pieces += [rng.choice([" ", ", ", "\n\n", "--"]).join(w[low : low + n]), text(rng.choice([0, 2]))]
        docs.append((i, rng.choice([". ", "\n"]).join(pieces)))
    docs += [docs[5], (200, None), (None, items[5][1]), (201, ""), (202, "!? -"), (203, "a " * 3000), (204, text(20_000))]
    return docs, items


def test_equals_brute_force(spark, corpus):
    docs, items = corpus
    assert got(*frames(spark, docs, items)) == brute(docs, items)


def test_blocks_of_any_size_give_the_same_stretches(corpus, monkeypatch):
    texts = pa.array([t or "" for _, t in corpus[0]] + ["y" * 5000 + " the of a b"])
    batch = pa.RecordBatch.from_arrays([pa.array([{"x": i} for i in range(len(texts))]), texts], ["row", "t"])
    bits = type("Bits", (), {"value": np.random.default_rng(1).integers(0, 255, 64, dtype=np.uint8) & 0x55})
    results = []
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(words, "BLOCK", size)
        results.append([b.to_pylist() for b in dec._stretches(bits, {3: 10, 1: 1}, 2)(iter([batch]))])
    assert results[0] == results[1] == results[2] and any(r["runs"] for r in results[0][0])
    assert [r["n_words"] for r in results[0][0]] == [len(words_of(t)) for t in texts.to_pylist()]


def test_long_items_only(spark, corpus):
    docs, items = corpus
    items = [(i, t) for i, t in items if len(words_of(t)) > 9]
    assert got(*frames(spark, docs, items)) == brute(docs, items)
    # A bit table that is full keeps every word and changes nothing.
    assert got(*frames(spark, docs, items), window=6, max_bits=15) == brute(docs, items, 6)


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, *corpus)
    assert dec.decontaminate(docs.where("false"), items).count() == 0
    none = got(docs, items.where("false"))
    assert len(none) == len(corpus[0]) and all(r[2:] == (0, 0, []) for r in none)


def test_windows_that_share_a_part(spark):
    """At a containment below 1, every window of the item's length that holds enough of its shingles is found."""
    rng = random.Random(8)
    item = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(60):
        w = list(item)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(12)] = rng.choice(item + ["other"])
        docs.append((i, " ".join(["x"] * rng.randint(0, 9) + w + ["y"] * rng.randint(0, 9))))
    shingles = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = set()
    for i, text in docs:
        w = text.split()
        for start in range(len(w) - 9):
            for low in range(3):
                share = len(shingles(w[start : start + 10]) & shingles(item[low : low + 10])) / 8
                if share >= 0.5:
                    want.add((i, start, 10, 7, share))
    a, b = frames(spark, docs, [(7, " ".join(item))])
    spans = dec.spans(a, b, containment=0.5).select("row.doc_id", "first_word", "n_words", "item", "share").collect()
    assert {tuple(r) for r in spans} == want and any(s[4] < 1 for s in want)


def test_a_passage_of_many_documents(spark):
    passage = " ".join(f"q{i}" for i in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.when(F.col("id") % 3 == 0, F.lit(passage)).otherwise("nothing"), F.lit(" end")).alias("text"))
    items = spark.createDataFrame([(1, passage), (2, passage + " more")], "item_id bigint, text string")
    rows = dec.decontaminate(docs, items).groupBy("n_hit", "n_items").count().collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 2000), (30, 2, 1000)]


def test_equal_words_have_equal_hashes_anywhere():
    code = dec._FOLD[np.frombuffer("Été one TWO one été two".encode(), np.uint8)]
    h = words.hash_words(code, *words.split_words(code, np.array([0])))
    assert len(h) == 6 and h[1] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 4
