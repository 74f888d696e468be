"""The whole pipeline against its five stages written out in plain Python."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from test_line_templates import brute as without_lines
from test_line_templates import classes_of
from test_mixing import filler
from tokenizers import Tokenizer

import corpus_pipeline
from cohortloom.llm import quality_rules
from cohortloom.llm.sql import ORACLE

TINY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs, weights):
    """Ids that the budget takes: each leaf's documents in the seeded order, until its tokens are reached."""
    leaf = {d: (f"domain{zlib.crc32(r['source'].encode()) % 4}", r["lang"], r["source"]) for d, r in docs.items()}
    n = {d: len(WORD.findall(r["text"])) for d, r in docs.items()}
    tokens = collections.Counter()
    for d in docs:
        tokens[leaf[d]] += n[d]
    shares, _ = filler([(*k, t) for k, t in tokens.items()], weights, corpus_pipeline.MIX_BUDGET, 1)
    taken = set()
    for k, t in tokens.items():
        share = int(shares[k] + 1e-6)
        whole, rest = divmod(share, t) if t else (0, 0)
        order = sorted((hashlib.md5(f"7:{whole}:{d}".encode()).hexdigest(), d) for d in docs if leaf[d] == k)
        for _, d in order:
            if whole or rest > 0:
                taken.add(d)
            rest -= n[d]
    return taken


def test_run_equals_the_stages_written_out(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TINY}/documents.parquet'")
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op10_quality_rules']}) WHERE kept").fetchall()}
    docs = {d: r for d, r in docs.items() if d in kept}
    for r, text in zip(docs.values(), without_lines([r["text"] for r in docs.values()])):
        r["before"], r["text"] = r["text"], text
    docs = {d: r for d, r in docs.items() if r["text"].strip(" ") or r["text"] == r["before"]}
    group = classes_of(sorted({r["text"] for r in docs.values()}), 0.8)
    first = {}
    for d in sorted(docs):
        first.setdefault(group[docs[d]["text"]], d)
    docs = {d: docs[d] for d in first.values()}
    weights = [tuple(r) for r in corpus_pipeline.tree_weights(spark).collect()]
    docs = {d: docs[d] for d in mixed(docs, weights)}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, r in docs.items():
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, TINY).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want) and len(want) > 50
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_an_odd_table_passes_all_stages(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text and clashing names, through every stage."""
    long = " ".join(f"w{i % 7919}" for i in range(30_000))
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s1"), (1, text, "en", "s1"), (2, None, None, None), (None, text + " x", "en", None), (3, "", "de", "s1"),
            (4, long, None, "s2"), (5, " \n\t ", "fr", "s2"), (6, text + "\n" + text.upper(), "en", "s1"), (7, text.upper(), "en", "s1"),
            *[(10 + i, " ".join(f"{c}{i}" for i in range(60)), "en", None if i % 2 else "s1") for i, c in enumerate("pqrstuvw")]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, m int, t int, k1 int, id int, h int, lines int, clean int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(8)) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TINY)
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r["n_chars"] == len(r["text"] or "") and r["clean"] == 7 for r in out.collect())
        docs = out
    left = {r["doc_id"] for r in docs.collect()}
    # Texts whose only lines recur in other documents go, and so do empty ones and those that repeat their own words.
    assert not left & {1, 2, 3, 4, 5, 6, 7} and len(left & set(range(10, 18))) >= 6


def test_documents_of_a_rejected_host_go(spark):
    """Good documents of a bad host and of a null host that is bad go with it; all others pass by their own figures."""
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, good(i) if i % 8 == 0 else "short", "bad" if i < 40 else None) for i in range(80)]
    rows += [(100 + i, good(i) if i % 10 else "short", f"h{i % 7}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(3)
    judged = quality_rules.judged(docs).where("kept").select("row.doc_id").collect()
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in judged} == {100 + i for i in range(70) if i % 10}
