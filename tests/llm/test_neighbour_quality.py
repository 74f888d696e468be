"""The neighbours' vote against a plain search through all labelled vectors."""

import math

import numpy as np

from cohortloom.llm import neighbour_quality as nq


def test_scores_equal_a_plain_search():
    rng = np.random.default_rng(6)
    counter = nq.Counter()
    words = [f"word{i}" for i in range(60)] + ["LOUD!!!", "Fine.", "x#", "12"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 80))) for _ in range(120)]
    counts, labels = counter.counts(texts), rng.integers(0, 2, 120).astype(float)
    space = nq.fit(counts, labels, 24)
    asked = counter.counts([" ".join(rng.choice(words, 30)) for _ in range(20)] + ["", None])
    got = space.scores(asked, 7, 20.0)
    for row, score in zip(asked, got):
        if not row.any():
            assert score == labels.mean()
            continue
        v = nq._scaled(row[None], space.weight)[0] @ space.directions
        near = sorted(((float(v @ u) / (np.linalg.norm(v) * np.linalg.norm(u)), y) for u, y in zip(space.vectors, labels)), reverse=True)[:7]
        weights = [math.exp(20.0 * (c - 1)) for c, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-4


def test_counts_do_not_depend_on_the_batch():
    texts = ["One two two\none", "", None, "#### one", "two " * 500]
    whole = nq.Counter().counts(texts)
    alone = np.vstack([nq.Counter(room=1).counts([t]) for t in texts])
    assert (whole == alone).all() and not whole[1].any() and not whole[2].any()
