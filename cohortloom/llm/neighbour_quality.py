"""Quality score by nearest-neighbour voting in a latent-semantic space (operator 5).

A text becomes hashed counts of its words and of their outward form (case, trailing signs, repetition). Labelled texts
are weighted by inverse document frequency and projected on the leading singular directions; these labelled vectors are
broadcast. Every text is projected likewise, its cosines with all labelled vectors are computed in exact blocks, and the
labels of the nearest ones vote with their similarity as weight.

Only the fit uses a bounded sample: at most ``sample`` labelled rows, the first by a hash of their id.

Defined results: null and empty texts have no features and get the share of label 1 in the sample. Without labels every
score is 0.5. Texts are read whole. Repeated rows get equal scores. A document that is labelled twice is fitted twice, with
each of its labels; null labels and labels without a document count for nothing. Of labelled vectors that are equally
near, any may vote. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BUCKETS, FORM_BUCKETS, REPEATS = 512, 256, 4
WIDTH = WORD_BUCKETS + FORM_BUCKETS + REPEATS


class Counter:
    """Feature counts of texts; what a word contributes is worked out once per distinct word."""

    def __init__(self, room: int = 200_000) -> None:
        self.room = room
        self.index: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = []

    def _add(self, word: str) -> int:
        core = word.strip("#*$%&|<>!?.,;:\"'()[]{}=-_/\\+~^`")
        tail = word[len(word.rstrip("#*$%&|<>!?.,;:\"'()[]{}=-_/\\+~^`")) :] if core else word
        case = "u" if core.isupper() and len(core) > 1 else "t" if core.istitle() else "l" if core.islower() else "d" if core.isdigit() else "m"
        if tail in (".", ","):
            tail = ""
        form = WORD_BUCKETS + zlib.crc32(f"{case}{tail[:4]}".encode()) % FORM_BUCKETS
        size = WORD_BUCKETS + zlib.crc32(f"{case}#{min(len(core), 24) // 4}".encode()) % FORM_BUCKETS
        self.index[word] = at = len(self.rows)
        self.rows.append((zlib.crc32(core.lower().encode()) % WORD_BUCKETS, form, size))
        return at

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > self.room:
            self.index, self.rows = {}, []
        get, add, known = self.index.get, self._add, []
        for text in texts:
            at = []
            for w in (text or "").split():
                i = get(w)
                at.append(add(w) if i is None else i)
            known.append(np.array(at, np.int64))
        features = np.array(self.rows, np.int64).reshape(-1, 3)
        out = np.zeros((len(texts), WIDTH), np.float32)
        for row, at, text in zip(out, known, texts):
            if len(at):
                row[:] = np.bincount(features[at].ravel(), minlength=WIDTH)
                lines = text.split("\n")
                row[-4] = np.count_nonzero(at[1:] == at[:-1])
                row[-3] = len(at) - len(np.unique(at))
                row[-2] = len(lines) - len(set(lines))
                row[-1] = 1
        return out


@dataclass
class Space:
    """Weights, directions, labelled vectors and labels of a fit."""

    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = _scaled(counts, self.weight) @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior = float(self.labels.mean())
        near = self.project(counts) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.exp(sharpness * (np.take_along_axis(near, top, 1).astype(np.float64) - 1))
        score = ((weight * self.labels[top]).sum(axis=1) + 1e-9 * prior) / (weight.sum(axis=1) + 1e-9)
        return np.where(counts.any(axis=1), np.clip(score, 0, 1), prior)


def _scaled(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Damped counts per part (words, forms with repetition), each part of equal length, times the weights."""
    x = np.sqrt(counts) * weight
    words, forms = x[:, :WORD_BUCKETS], x[:, WORD_BUCKETS:]
    words = words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
    forms = forms / np.maximum(np.linalg.norm(forms, axis=1, keepdims=True), 1e-12)
    return np.hstack([0.35 * words, forms])


def fit(counts: np.ndarray, labels: np.ndarray, rank: int) -> Space:
    n = len(counts)
    weight = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = _scaled(counts, weight)
    values, vectors = np.linalg.eigh(x.T @ x)
    space = Space(weight, vectors[:, ::-1][:, : min(rank, n, WIDTH)].astype(np.float32), np.empty((0, 0), np.float32), labels)
    space.vectors = space.project(counts)
    return space


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by 5 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        counts = counter.counts(batch.column("t").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([c.tobytes() for c in counts], pa.binary())], ["label", "counts"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int, rank: int, label: str = "quality") -> Space:
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t")).join(F.broadcast(known), F.col("id") == F.col("l_id"))
    got = rows.select("label", "t").mapInArrow(_features, "label double, counts binary").collect()
    # In an order of their own, so that a fit does not depend on how rows arrive.
    got = sorted(((r["counts"], r["label"]) for r in got))
    counts = np.frombuffer(b"".join(bytes(c) for c, _ in got), np.float32).reshape(-1, WIDTH)
    return fit(counts, np.array([y for _, y in got]), rank)


def scored(space: Space, neighbours: int, sharpness: float, block: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for begin in range(0, len(batch), block):
                part = batch.slice(begin, block)
                score = space.scores(counter.counts(part.column("t").to_pylist()), neighbours, sharpness)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score, pa.float64())], ["id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, rank: int = 96, neighbours: int = 15, sharpness: float = 20.0) -> DataFrame:
    """id, held_out and score (0 to 1, higher: label 1 likelier) of every row of ``docs``."""
    space = fitted(docs, labels, sample, rank)
    rows = docs.select(F.col("doc_id").alias("id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(scored(space, neighbours, sharpness), f"id {dict(rows.dtypes)['id']}, held_out boolean, score double")
