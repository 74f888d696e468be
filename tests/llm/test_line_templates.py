"""Recurring lines against the same rules written out in plain Python."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from cohortloom.llm import line_templates

TINY = "/root/testdata/sf0.001"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_of(texts, similar):
    """Smallest text that a chain of near copies leads to."""
    sets, parent = {t: shingles(t) for t in texts}, {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {t: root(t) for t in texts}


def brute(texts, min_classes=2, min_varied=5, min_constant=0.7, min_tokens=5, similar=0.75):
    """What is left of each text."""
    lines = collections.defaultdict(list)
    for t in {t for t in texts if t is not None}:
        for i, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if re.search(r"[^\W_]", line):
                tokens = line.split(" ")
                lines[t].append((i, line, (len(tokens), " ".join("<*>" if re.search("[0-9]", x) else x for x in tokens[:3]))))
    in_texts = collections.defaultdict(set)
    for t, own in lines.items():
        for _, _, leaf in own:
            in_texts[leaf].add(t)
    shared = {leaf for leaf, ts in in_texts.items() if len(ts) > 1}
    group = classes_of(sorted(t for t, own in lines.items() if any(leaf in shared for _, _, leaf in own)), similar)
    held, in_leaf = collections.defaultdict(set), collections.defaultdict(set)
    for t in group:
        for _, line, leaf in lines[t]:
            if leaf in shared:
                held[leaf, line].add(group[t])
                in_leaf[leaf].add(group[t])
    count = collections.Counter()
    varied = [(leaf, line) for leaf, line in held if leaf[0] >= min_tokens and len(in_leaf[leaf]) >= min_varied]
    for leaf, line in varied:
        for pos, token in enumerate(line.split(" ")):
            count[leaf, pos, token] += len(held[leaf, line])
    template, members = {}, collections.defaultdict(set)
    for leaf, line in varied:
        shape = tuple(x if count[leaf, p, x] >= min_varied else None for p, x in enumerate(line.split(" ")))
        if sum(x is not None for x in shape) >= min_constant * leaf[0]:
            template[leaf, line] = (leaf, shape)
            members[leaf, shape] |= held[leaf, line]
    dropped = {k for k, c in held.items() if len(in_leaf[k[0]]) >= min_classes and len(c) >= (min_classes if k[0][0] >= min_tokens else min_varied)}
    dropped |= {k for k, m in template.items() if len(members[m]) >= min_varied}
    out = []
    for t in texts:
        gone = {i for i, line, leaf in lines.get(t, []) if (leaf, line) in dropped}
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return out


def cleaned(df):
    return {r["doc_id"]: r["clean"] for r in line_templates.without_recurring(df).select("row.doc_id", "clean").collect()}


def test_random_documents(spark):
    """Few words, lines that recur as they are, with fields, in near copies only, in two documents, and short ones."""
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 4) or "")
    fresh = lambda n: " ".join(f"{word()}x{rng.randint(0, 10**6)}" for _ in range(n))
    texts = []
    for i in range(150):
        lines = [fresh(rng.randint(3, 12)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"Posted on day {i} by user{i % 7} in this forum")
        if i % 4 == 0:
            lines.append(f"  Read more about {rng.choice('abc')} here today please ")
        if i % 50 == 1:
            lines.append("a line that only very few documents of all hold")
        if i % 5 == 0:
            lines += ["Home", "- - -", ""]
        texts.append("\n".join(lines))
    for i in range(0, 30, 3):  # near copies with lines of their own
        texts.append(texts[i] + "\nlast words")
    texts += [texts[0], None, "", "\n\n", "Home"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    want = dict(enumerate(brute(texts)))
    assert cleaned(df) == want
    assert any(want[i] != t for i, t in enumerate(texts)) and sum(want[i] == t for i, t in enumerate(texts)) > 20


def test_documents_of_the_sample(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert cleaned(docs) == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows])))


def test_a_text_of_many_lines(spark):
    """100,000 lines of which every second one goes, in one pass over them."""
    long = "\n".join("this very line stands in all of them" if i % 2 else f"w{i} is a word of its own kind{i}" for i in range(100_000))
    rows = [(0, long), (1, "this very line stands in all of them\nx y z"), (2, "other text\nthis very line stands in all of them")]
    got = line_templates.without_recurring(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    by = {r["row"]["doc_id"]: r for r in got}
    assert by[0]["n_lines"] == 100_000 and by[0]["n_dropped"] == 50_000 and by[0]["clean"].count("\n") == 49_999
    assert by[0]["clean"].startswith("w0 is a word of its own kind0\nw2 is") and by[1]["clean"] == "x y z" and by[2]["clean"] == "other text"


def test_without_takes_numbers_out(spark):
    df = spark.createDataFrame([([0, 1, 2], "a"), ([1], "b"), ([0, 2], "c"), ([2], "d"), ([0], "e")], "gone array<int>, k string")
    lines = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    got = {r["k"]: r["left"] for r in df.select("k", line_templates.without(lines, F.col("gone")).alias("left")).collect()}
    assert got == {"a": [], "b": ["x", "z"], "c": ["y"], "d": ["x", "y"], "e": ["y", "z"]}
