"""The Merkle manifest against trees that are built one node at a time."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, g int, i int, h int, path int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def canonical(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """Last node, and the path of each node: (left digests, right digests) level by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i - i % fanout
            paths[k].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + fanout])))
        nodes = [H(*nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return (nodes or [None])[0], paths


def brute(rows, fanout):
    leaves = [(r, H(*map(canonical, r[:5]))) for r in rows]
    groups = {}
    for r, leaf in leaves:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, above = tree([subs[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above):
        for (known, doc_id, leaf), path in zip(sorted(groups[g]), subs[g][1]):
            out.append((doc_id if known else None, leaf, subs[g][0], root, tuple(path + up)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    langs = ["en"] * 6 + ["de", "fr", "é", None, ""]
    out = [(i * 7 % 301, f"s{i % 3}" if i % 5 else None, langs[i % len(langs)], i if i % 4 else None, f"Text {i}\n" * (i % 4) if i % 9 else None)
           for i in range(300)]
    out += [out[0], out[1], (None, None, None, None, None), (None, "x", "en", 1, ""), (7, "other", "en", 1, "same id"), (1, "s", "only", 1, "t " * 40_000)]
    out += [(5, "s", f"lang{k}", 1, "t") for k in range(12)]
    return out


@pytest.mark.parametrize("fanout", [8, 2, 3])
def test_equals_trees_built_by_hand(spark, rows, fanout):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    got = merkle.manifest(df, fanout=fanout, changed=F.lit("x")).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    got = got.withColumn("proof", merkle.proof(F.col("path"))).collect()
    want = brute(rows, fanout)
    assert sorted(((r["row"]["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"])) for r in got), key=repr) == want
    assert all(r["folded"] == r["root"] and r["changed"] == "x" and r["proof"] == H(*[s for x in r["path"] for s in (x["left"], x["right"])]) for r in got)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_sizes_at_the_edges(spark, n):
    df = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('t', id) AS text")
    got = merkle.manifest(df).collect()
    want = brute([(i, "s", "en", i, f"t{i}") for i in range(n)], 8)
    assert sorted(((r["row"]["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"])) for r in got), key=repr) == want
    if n == 1:
        assert got[0]["root"] == got[0]["leaf"] and not got[0]["path"]


def test_a_changed_leaf_does_not_lead_to_the_root(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    got = merkle.manifest(df).withColumn("folded", merkle.fold(F.sha2(F.lit("changed"), 256), F.col("path")))
    assert got.where("folded = root").count() == 0
