import math

import numpy as np
import pytest

from cohortloom.operators import factor_fit, multinomial

CELLS = {"g1": {"base": 30, "k1": 12, "k2": 5}, "g2": {"base": 20, "k1": 25, "k2": 9}, "g3": {"base": 11, "k1": 3, "k2": 14}}


@pytest.fixture
def counts(spark):
    data = [(g, k, n) for g, row in CELLS.items() for k, n in row.items()]
    return spark.createDataFrame(data, "group string, outcome string, n long")


def newton(cells, base_group, base, groups, outcomes):
    """Newton's method on the likelihood: estimates and standard errors to compare with."""
    terms = [g for g in groups if g != base_group]
    x = np.array([[1.0] + [float(g == t) for t in terms] for g in groups])
    y = np.array([[cells[g].get(k, 0) for k in outcomes] for g in groups], float)
    total = np.array([sum(cells[g].values()) for g in groups], float)
    width, beta = x.shape[1], np.zeros(x.shape[1] * len(outcomes))
    for _ in range(60):
        e = np.exp(x @ beta.reshape(len(outcomes), width).T)
        p = e / (1 + e.sum(1, keepdims=True))
        score = ((y - total[:, None] * p).T @ x).ravel()
        info = np.zeros((beta.size, beta.size))
        for i in range(len(groups)):
            w = total[i] * (np.diag(p[i]) - np.outer(p[i], p[i]))
            info += np.kron(w, np.outer(x[i], x[i]))
        beta = beta + np.linalg.solve(info, score)
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    names = [(k, t) for k in outcomes for t in [multinomial.INTERCEPT, *terms]]
    return {name: (b, s) for name, b, s in zip(names, beta, se)}


def test_closed_form_is_the_maximum_likelihood_fit(counts):
    fitted = {(r.outcome, r.term): r for r in multinomial.fit(counts, "base").collect()}
    expected = newton(CELLS, "g2", "base", ["g1", "g2", "g3"], ["k1", "k2"])  # g2 is the largest
    assert set(fitted) == set(expected)
    for name, (estimate, error) in expected.items():
        assert fitted[name].estimate == pytest.approx(estimate, abs=1e-8)
        assert fitted[name].std_error == pytest.approx(error, abs=1e-8)
        assert fitted[name].risk_ratio == pytest.approx(math.exp(estimate), rel=1e-8)
        assert fitted[name].z == pytest.approx(estimate / error, rel=1e-6)


def test_chosen_reference_group(counts):
    terms = {r.term for r in multinomial.fit(counts, "base", "g3").collect()}
    assert terms == {multinomial.INTERCEPT, "g1", "g2"}


def test_largest_group_on_a_tie_is_the_first_label(spark):
    tie = spark.createDataFrame([("b", "base", 2), ("b", "k", 2), ("a", "base", 3), ("a", "k", 1)],
                                "group string, outcome string, n long")
    assert {r.term for r in multinomial.fit(tie, "base").collect()} == {multinomial.INTERCEPT, "b"}


def test_empty_cell_is_flagged(spark):
    data = [("a", "base", 5), ("a", "k1", 5), ("a", "k2", 1), ("b", "base", 3), ("b", "k2", 1)]
    counts = spark.createDataFrame(data, "group string, outcome string, n long")
    got = {(r.outcome, r.term): r for r in multinomial.with_p_values(multinomial.fit(counts, "base")).collect()}
    missing = got["k1", "b"]
    assert (missing.cell_n, missing.finite, missing.estimate, missing.std_error, missing.p_value) == (0, False, None, None, None)
    assert got["k2", "b"].finite and got["k1", multinomial.INTERCEPT].finite


def test_p_values(counts):
    for r in multinomial.with_p_values(multinomial.fit(counts, "base")).collect():
        assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-14)


def test_deviance(counts):
    row = multinomial.deviance(counts).first()
    expected = -2 * sum(n * math.log(n / sum(c.values())) for c in CELLS.values() for n in c.values())
    assert row.deviance == pytest.approx(expected)
    assert (row.edf, row.aic) == (6, pytest.approx(expected + 12))


def test_outcome_counts_drop_missing_values(spark, rows):
    df = spark.createDataFrame([("a", "k", 2), ("a", "k", 1), (None, "k", 9), ("a", None, 9)], "g string, y string, w long")
    assert rows(multinomial.outcome_counts(df, "g", "y")) == [("a", "k", 2)]
    assert rows(multinomial.outcome_counts(df, "g", "y", "w")) == [("a", "k", 3)]


def test_general_fit_equals_the_closed_form_on_one_factor(counts):
    closed = {(r.outcome, r.term): (r.estimate, r.std_error, r.risk_ratio, r.z) for r in multinomial.fit(counts, "base").collect()}
    general = {(r.outcome, r.term): (r.estimate, r.std_error, r.risk_ratio, r.z) for r in
               factor_fit.fit(counts, ["group"], "outcome", "base").collect()}
    assert general.keys() == closed.keys()
    for key, values in closed.items():
        assert general[key] == pytest.approx(values, abs=1e-6)


def test_two_factors_without_interaction(spark):
    """Against Newton's method on the same design, written out."""
    rng = np.random.default_rng(4)
    rows = [(a, b, k, int(rng.integers(3, 40))) for a in ("x", "y", "z") for b in ("u", "v") for k in ("base", "k1", "k2")]
    df = spark.createDataFrame([*rows, ("x", None, "k1", 9)], "a string, b string, k string, w long")
    counted = factor_fit.factor_counts(df, ["a", "b"], "k", "w")
    got = {(r.outcome, r.term): (r.estimate, r.std_error) for r in factor_fit.fit(counted, ["a", "b"], "k", "base", base_levels={"a": "x", "b": "u"}).collect()}
    cells = {(a, b): {k: n for a2, b2, k, n in rows if (a, b) == (a2, b2)} for a, b, *_ in rows}
    x = np.array([[1.0, a == "y", a == "z", b == "v"] for a, b in cells])
    y = np.array([[c["k1"], c["k2"]] for c in cells.values()], float)
    total = np.array([sum(c.values()) for c in cells.values()], float)
    beta = np.zeros(8)
    for _ in range(40):
        e = np.exp(x @ beta.reshape(2, 4).T)
        p = e / (1 + e.sum(1, keepdims=True))
        info = sum(np.kron(total[i] * (np.diag(p[i]) - np.outer(p[i], p[i])), np.outer(x[i], x[i])) for i in range(len(x)))
        beta = beta + np.linalg.solve(info, ((y - total[:, None] * p).T @ x).ravel())
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    names = [(k, t) for k in ("k1", "k2") for t in (multinomial.INTERCEPT, "y", "z", "v")]
    assert set(got) == set(names)
    for name, b, s in zip(names, beta, se):
        assert got[name] == pytest.approx((b, s), abs=1e-7)


def test_an_empty_cell_is_flagged(spark):
    rows = [(g, k, n) for g, c in {"p": (20, 9), "q": (11, 0)}.items() for k, n in zip(("base", "k1"), c) if n]
    got = {r.term: r for r in factor_fit.fit(spark.createDataFrame(rows, "g string, k string, n long"), ["g"], "k", "base").collect()}
    assert got["(Intercept)"].finite and got["(Intercept)"].estimate == pytest.approx(math.log(9 / 20), abs=1e-6)
    assert not got["q"].finite and got["q"].estimate is None
