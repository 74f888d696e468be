"""Licence scan by a positional index of rare words (operator 4), in DataFrame functions only.

A word's rarity is counted over all documents. The rarest different words of each template are its postings (word, place
in the template), so what else a document holds does not matter. Every occurrence of a posted word at place i of the
text proposes that a template starts at i minus its place there. Starts that two posted words of a template agree on
are verified: the mandatory key phrase must stand at its place, and the matched words must carry enough of the
template's total rarity.

Defined results: a null text is empty. A document without licence words has empty labels and score 0. Repeated rows are
scanned each. Of words equally rare the first in alphabetical order is posted. An empty table gives an empty result. Texts
are scanned whole; only named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import text_or_empty

# Phrases whose places count, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Words of licence notices, and the phrase that must be there.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    "lgpl": ("under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
}
VOCABULARY = sorted({w for text, _ in TEMPLATES.values() for w in text.split()})
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text of which A-Z are lower-cased.

    Lower-casing all letters gives the same words as far as phrases of a-z go, but for two signs that would turn into
    ASCII letters; texts with these take the slow way.
    """
    odd = text.contains("İ") | text.contains("K")
    small = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.filter(F.split(small, BETWEEN), lambda x: x != "")


def rarity(df: DataFrame, text: str) -> dict[str, float]:
    """Inverse document frequency of every licence word over all documents; one row per word of the vocabulary returns."""
    held = df.select(words_of(text_or_empty(text)).alias("w"))
    held = held.select(F.explode_outer(F.array_intersect("w", F.lit(VOCABULARY))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = df.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in VOCABULARY}


def places(words: str, phrase: str) -> Column:
    """Starts of a phrase; texts without its last word are not walked through."""
    first, *rest = phrase.split()
    same = lambda x, i: (x == first) & _all([F.get(words, i + k + 1) == w for k, w in enumerate(rest)])
    found = F.filter(F.transform(words, lambda x, i: F.when(same(x, i), i)), lambda i: i.isNotNull())
    return F.when(F.array_contains(words, rest[-1]), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def postings_of(idf: dict[str, float]) -> dict[str, list[tuple[str, int]]]:
    """Per word, the templates and places it is looked up for: the two rarest words of each template's key phrase, which
    a hit must hold, at all their places in the phrase."""
    out: dict[str, list[tuple[str, int]]] = {}
    for name, (text, key) in TEMPLATES.items():
        words, must = text.split(), key.split()
        offset = offset_of(words, must)
        for w in sorted(set(must), key=lambda w: (-idf[w], w))[:2]:
            for at, x in enumerate(must):
                if x == w:
                    out.setdefault(w, []).append((name, offset + at))
    return out


def offset_of(words: list[str], must: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(must)] == must)


def scan(df: DataFrame, text: str = "text", least_share: float = 0.75) -> DataFrame:
    """``df`` without its text (struct ``row``), with the counts, places, labels and score of each document."""
    idf = rarity(df, text)
    names = [c for c in df.columns if c != text]
    postings = postings_of(idf)
    pair = lambda t, p: F.struct(F.lit(t).alias("template"), F.lit(p).alias("at"))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), words_of(text_or_empty(text)).alias("w"))
    for n, phrase in enumerate(PHRASES):
        out = out.withColumn(f"p{n}", places("w", phrase))
    rows = ["row", "w", *[f"p{n}" for n in range(len(PHRASES))]]
    index = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[pair(*p) for p in ps]))])
    at = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(*sorted(postings)))
    starts = F.flatten(F.transform(at, lambda s: F.transform(
        F.element_at(index, s["x"]), lambda p: F.struct(p["template"].alias("template"), (s["i"] - p["at"]).alias("start")))))
    out = out.select(*rows, F.sort_array(starts).alias("starts"))
    # Both posted words agree on a start: it stands twice or more in the sorted list.
    agreed = F.filter("starts", lambda s, k: (F.get("starts", k + 1) == s) & ~(F.get("starts", k - 1).eqNullSafe(s)))
    out = out.select(*rows, agreed.alias("agreed"))
    verified = F.transform("agreed", lambda s: F.struct(s["template"].alias("label"), _verified(s, idf).alias("score")))
    out = out.select(*rows, F.filter(verified, lambda s: s["score"] >= least_share).alias("hits"))
    sizes = [F.size(f"p{n}") for n in range(len(PHRASES))]
    all_places = F.concat(*[F.col(f"p{n}") for n in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(s > 0, F.lit(label)) for s, label in zip(sizes, PHRASES.values())]), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("hits", lambda h: h["label"]))))
    n_base = sizes[0] + sizes[1] + sizes[2]
    score = F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.when(n_base > 0, F.lit(0.5)), F.lit(0.0))
    return out.select("row", F.size("w").cast("long").alias("n_words"), n_base.cast("long").alias("n_base"),
                      F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
                      F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _verified(s: Column, idf: dict[str, float]) -> Column:
    """Share of the template's rarity that stands at its places; 0 where the key phrase does not."""
    out = F.lit(0.0)
    for name, (text, key) in TEMPLATES.items():
        words, must = text.split(), key.split()
        offset = offset_of(words, must)
        total = sum(idf[w] + 0.01 for w in words)
        stands = lambda k, w: F.coalesce(F.get("w", s["start"] + k) == w, F.lit(False))
        keyed = _all([stands(offset + k, w) for k, w in enumerate(must)])
        got = sum((F.when(stands(k, w), F.lit((idf[w] + 0.01) / total)).otherwise(F.lit(0.0)) for k, w in enumerate(words)), F.lit(0.0))
        out = F.when(s["template"] == name, F.when(keyed, F.least(got, F.lit(1.0))).otherwise(F.lit(0.0))).otherwise(out)
    return out
