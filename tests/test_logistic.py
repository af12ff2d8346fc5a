"""Newton's logistic regression against numpy, its importance against a plain shuffle."""

import numpy as np
from pyspark.sql import functions as F

from listenflow.operators import logistic
from listenflow.operators.experiment import experiment_readout
from listenflow.operators.model import score_auc

COLS = ("a", "b", "c")


def users(n=400, seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rnd.normal(), rnd.normal(2, 5), float(rnd.integers(0, 4))
        y = int(rnd.random() < 1 / (1 + np.exp(-(1.5 * a - 0.2 * b + 0.1))))
        rows.append((i, y, a, None if i % 17 == 0 else b, c))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, converted int, a double, b double, c double").repartition(3)


def design(rows):
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], float)
    train = np.array([r[0] % 10 >= 2 for r in rows])
    mean, std = np.nanmean(x[train], axis=0), np.nanstd(x[train], axis=0)
    z = np.nan_to_num((x - mean) / np.where(std > 0, std, 1.0))
    return np.column_stack([np.ones(len(rows)), z]), np.array([r[1] for r in rows], float), train


def plain_weights(rows, steps=logistic.STEPS):
    x, y, train = design(rows)
    x, y, w = x[train], y[train], np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    return w


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_weights_and_probabilities(spark):
    rows = users()
    df = frame(spark, rows)
    model = logistic.fit_logistic(df, COLS)
    w = plain_weights(rows)
    assert np.allclose(model.weights, w, atol=1e-9)
    x, y, train = design(rows)
    got = {r.user_id: r for r in logistic.conversion_probability(df, model).collect()}
    p = 1 / (1 + np.exp(-x @ w))
    assert all(abs(got[i].probability - p[i]) < 1e-6 and got[i].held_out == (not train[i]) for i in got)
    one = logistic.probability_auc(logistic.conversion_probability(df, model)).first()
    assert abs(one.auc - auc(np.round(p[~train], 6), y[~train])) < 1e-6 and one.auc > 0.75


def test_importance_by_a_plain_shuffle(spark):
    rows = users()
    df = frame(spark, rows)
    model = logistic.fit_logistic(df, COLS)
    x, y, train = design(rows)
    held = [i for i, t in enumerate(train) if not t]
    a, b, m = logistic.SHUFFLE
    got = {r.feature: r for r in logistic.permutation_importance(df, model).collect()}
    assert set(got) == set(COLS)
    for j, name in enumerate(COLS):
        moved = x[held].copy()
        moved[:, j + 1] = x[sorted(held, key=lambda i: ((i * a + j * b) % m, i)), j + 1]
        p = np.round(1 / (1 + np.exp(-moved @ np.array(model.weights))), 6)
        assert abs(got[name].permuted_auc - auc(p, y[held])) < 2e-6
    assert got["a"].auc_drop > got["c"].auc_drop


def test_degenerate_training_sets(spark):
    nobody = logistic.fit_logistic(frame(spark, []), COLS)
    assert nobody.weights == (0.0,) * 4 and nobody.scales == (1.0,) * 3
    same = [(i, 1, 1.0, None, 2.0) for i in range(30)]      # one class, constant and missing features
    model = logistic.fit_logistic(frame(spark, same), COLS)
    assert all(r.probability > 0.9 for r in logistic.conversion_probability(frame(spark, same), model).collect())
    assert logistic.probability_auc(logistic.conversion_probability(frame(spark, same), model)).first().auc is None


def test_auc_per_group(spark):
    rnd = np.random.default_rng(1)
    rows = [(g, float(rnd.integers(0, 6)), int(rnd.integers(0, 2))) for g in "abc" for _ in range(60)]
    got = {r.g: r.auc for r in score_auc(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", by=["g"]).collect()}
    for g in "abc":
        s, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        assert abs(got[g] - auc(s, y)) < 1e-6


def test_guardrail_intervals(spark):
    rnd = np.random.default_rng(2)
    rows = [(i % 2, int(rnd.random() < 0.4), float(rnd.normal(10 + i % 2, 1 + 3 * (i % 2))), None if i % 5 == 0 else 1.0)
            for i in range(200)]
    r = experiment_readout(spark.createDataFrame(rows, "arm int, activated int, sessions double, avg_session_sec double")).first()
    x0, x1 = (np.array([s for a, _, s, _ in rows if a == k]) for k in (0, 1))
    diff, se = x1.mean() - x0.mean(), np.sqrt(x1.var(ddof=1) / len(x1) + x0.var(ddof=1) / len(x0))
    assert np.allclose([r.sessions_diff, r.sessions_ci_low, r.sessions_ci_high],
                       [diff, diff - 1.959964 * se, diff + 1.959964 * se], atol=1e-4)
    assert r.avg_session_sec_diff == 0 and r.avg_session_sec_p_value is None       # no spread, no test
    alone = experiment_readout(spark.createDataFrame(rows[:1], "arm int, activated int, sessions double, avg_session_sec double")).first()
    assert alone.sessions_diff is None and alone.sessions_p_value is None
