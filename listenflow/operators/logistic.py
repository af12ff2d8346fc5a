"""Logistic regression by Newton's method on native aggregates, and its
permutation importance.

Every step is one aggregate over the training users: the gradient and the Gram
sums of the weighted design, ``k + 1`` features wide.  Only those sums (an
11 x 11 system for ten features) reach the driver, whatever the number of
users.  The number of steps is fixed and the penalty makes the system positive
definite, so another engine that repeats the arithmetic gets the same model.

Features are scaled by their mean and standard deviation over the training
users; a missing value counts as the mean.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenflow.functions.numeric import round_half_away
from listenflow.operators.model import MODEL_FEATURES, score_auc
from listenflow.operators.ranking import row_number_within
from listenflow.session import materialize

STEPS = 8
RIDGE = 1.0
DECIMALS = 6            # of probabilities, so that they do not depend on the order of sums
# the keyed shuffle of feature number j puts users in the order of (id * A + j * B) mod M
SHUFFLE = (7919, 104729, 1000003)


def held_out_users(user_col: str = "user_id") -> Column:
    """A fifth of the users, by id."""
    return F.pmod(F.col(user_col), F.lit(10)) < 2


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]          # intercept first

    def scaled(self, i: int) -> Column:
        return F.coalesce((F.col(self.features[i]).cast("double") - F.lit(self.means[i])) / F.lit(self.scales[i]), F.lit(0.0))

    def logit(self) -> Column:
        z = F.lit(self.weights[0])
        for i in range(len(self.features)):
            z = z + F.lit(self.weights[i + 1]) * self.scaled(i)
        return z


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_logistic(frame: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "converted",
                 steps: int = STEPS, ridge: float = RIDGE, held_out: Column | None = None) -> LogisticModel:
    """Fit on the users that are not held out and have a label."""
    features = tuple(features)
    train = frame.where(~(held_out_users() if held_out is None else held_out) & F.col(label).isNotNull())
    stats = train.agg(*[x for c in features for x in (F.avg(c), F.stddev_pop(c))]).first()
    means = tuple(float(stats[2 * i] or 0.0) for i in range(len(features)))
    scales = tuple(float(stats[2 * i + 1] or 0.0) or 1.0 for i in range(len(features)))
    k = len(features) + 1
    weights = np.zeros(k)
    scaler = LogisticModel(features, means, scales, (0.0,) * k)
    # read by every step: the scaled design, one narrow row per training user
    design = materialize(train.select(F.col(label).cast("double").alias("y"),
                                      *[scaler.scaled(i).alias(f"x{i + 1}") for i in range(len(features))]))
    x = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(1, k)]
    for _ in range(steps):
        z = F.lit(float(weights[0]))
        for i in range(1, k):
            z = z + F.lit(float(weights[i])) * x[i]
        rows = design.withColumn("p", _sigmoid(z)).withColumn("w", F.col("p") * (1 - F.col("p")))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = rows.agg(*[F.sum(x[i] * (F.col("y") - F.col("p"))) for i in range(k)],
                        *[F.sum(F.col("w") * x[i] * x[j]) for i, j in pairs]).first()
        if sums[0] is None:             # nobody to train on
            break
        penalty = np.full(k, ridge)
        penalty[0] = 0.0
        gradient = np.array(sums[:k], float) - penalty * weights
        hessian = np.diag(penalty)
        for value, (i, j) in zip(sums[k:], pairs):
            hessian[i, j] += value
            if i != j:
                hessian[j, i] += value
        weights = weights + np.linalg.solve(hessian, gradient)
    return LogisticModel(features, means, scales, tuple(float(w) for w in weights))


def conversion_probability(frame: DataFrame, model: LogisticModel, label: str = "converted") -> DataFrame:
    """``user_id, converted, held_out, probability`` of every user."""
    return frame.select("user_id", F.col(label).cast("int").alias("converted"), held_out_users().alias("held_out"),
                        round_half_away(_sigmoid(model.logit()), DECIMALS).alias("probability"))


def probability_auc(scored: DataFrame) -> DataFrame:
    """AUC on the held-out users (one row)."""
    return score_auc(scored.where("held_out"), "probability", "converted")


def permutation_importance(frame: DataFrame, model: LogisticModel, label: str = "converted") -> DataFrame:
    """``feature, auc, permuted_auc, auc_drop``: how much of the AUC on the
    held-out users is lost when one feature is dealt out among them anew.

    The deal is the join of two rankings of the users, by id and by a keyed
    order of the feature's own; both are skew-safe rankings over range
    segments, and all features are dealt in one pass.
    """
    a, b, m = SHUFFLE
    users = frame.where(held_out_users() & F.col(label).isNotNull())
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("j"), model.scaled(i).alias("x"),
                                F.lit(model.weights[i + 1]).alias("weight")) for i, c in enumerate(model.features)])
    long = materialize(users.select("user_id", F.col(label).cast("int").alias("y"), model.logit().alias("z"), F.inline(values)))
    order = F.pmod(F.col("user_id") * a + F.col("j") * b, F.lit(m))
    own = row_number_within(long, ["user_id"], ["feature"], out="place")
    dealt = row_number_within(long.withColumn("key", order), ["key", "user_id"], ["feature"], out="place")
    moved = own.join(dealt.select("feature", "place", F.col("x").alias("other")), ["feature", "place"])
    scored = moved.select("feature", "y", round_half_away(
        _sigmoid(F.col("z") + F.col("weight") * (F.col("other") - F.col("x"))), DECIMALS).alias("p"))
    permuted = score_auc(scored, "p", "y", by=["feature"]).select("feature", F.col("auc").alias("permuted_auc"))
    base = probability_auc(conversion_probability(frame, model, label)).first().auc     # one number
    return permuted.select(
        "feature", F.lit(base).cast("double").alias("auc"), "permuted_auc",
        round_half_away(F.lit(base).cast("double") - F.col("permuted_auc"), DECIMALS).alias("auc_drop"))
