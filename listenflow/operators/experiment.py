"""Two-arm experiment read-out (overall and per segment).

Arms and outcome come from the data: the arm is ``user_id % 2`` (1 =
treatment) and the outcome is Day-30 activation (at least 5 distinct sessions
by signup + 30 days), the funnel's fourth stage.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenflow.functions.numeric import round_half_away
from listenflow.functions.stats import Z_95, two_sided_p
from listenflow.operators._user import attach_user, back_to_users
from listenflow.sources.product import ProductTables

ACTIVATION = (30, 5)


def experiment_frame(t: ProductTables, activation: tuple[int, int] = ACTIVATION) -> DataFrame:
    """One row per user: arm, activated (0/1), guardrail metrics."""
    days, min_sessions = activation
    # one pass over sessions: per (user, session) the first date and the
    # duration sum/count, so the per-user mean duration stays exact
    s = (t.sessions.groupBy("user_id", "session_id")
         .agg(F.min("session_date").alias("first_date"),
              F.sum("session_duration_sec").alias("dur"), F.count(F.lit(1)).alias("rows")))
    s = attach_user(s, t.users, ["signup_date"])
    per_user = s.groupBy("user_id").agg(
        F.count("session_id").cast("long").alias("n_sessions"),
        F.count(F.when(F.col("session_id").isNotNull()
                       & (F.col("first_date") <= F.date_add("signup_date", days)), 1)).cast("long").alias("n_act"),
        (F.sum("dur") / F.sum("rows")).alias("avg_session_sec"))
    u = back_to_users(t.users.select("user_id"), per_user, ["n_sessions", "n_act"])
    return u.select("user_id", (F.col("user_id") % 2).cast("int").alias("arm"),
                    F.when(F.col("n_act") >= min_sessions, 1).otherwise(0).alias("activated"),
                    F.col("n_sessions").alias("sessions"), "avg_session_sec")


def experiment_readout(df: DataFrame, arm: str = "arm", outcome: str = "activated",
                       guardrails: Sequence[str] = ("sessions", "avg_session_sec"),
                       by: Sequence[str] = ()) -> DataFrame:
    """n, rate per arm; lift (pp), 95 % CI (unpooled), pooled z, two-sided p;
    guardrail means per arm, their difference with interval and p.  Arm 0 =
    control, 1 = treatment."""
    by = list(by)
    aggs = []
    for a, name in ((0, "control"), (1, "treatment")):
        in_arm = F.col(arm) == a
        aggs += [F.count(F.when(in_arm, 1)).cast("long").alias(f"{name}_n"),
                 F.sum(F.when(in_arm, F.col(outcome)).otherwise(0)).cast("long").alias(f"{name}_x")]
        # mean, sample variance and count merge from partial aggregates
        aggs += [x for g in guardrails for value in [F.when(in_arm, F.col(g))] for x in (
            F.avg(value).alias(f"{name}_{g}"), F.var_samp(value).alias(f"_{name}_{g}_var"),
            F.count(value).cast("double").alias(f"_{name}_{g}_n"))]
    g = df.groupBy(*by).agg(*aggs)
    n0, x0, n1, x1 = (F.col(c).cast("double") for c in ("control_n", "control_x", "treatment_n", "treatment_x"))
    p0, p1 = x0 / n0, x1 / n1
    se = F.sqrt(p1 * (F.lit(1.0) - p1) / n1 + p0 * (F.lit(1.0) - p0) / n0)
    pool = (x0 + x1) / (n0 + n1)
    se_pool = F.sqrt(pool * (F.lit(1.0) - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n0))
    lift = p1 - p0
    z = F.when(se_pool > 0, lift / se_pool)
    ok = (n0 > 0) & (n1 > 0)
    out = g.select(
        *by, "control_n", "treatment_n",
        round_half_away(F.when(ok, p0 * 100), 4).alias("control_rate_pct"),
        round_half_away(F.when(ok, p1 * 100), 4).alias("treatment_rate_pct"),
        round_half_away(F.when(ok, lift * 100), 4).alias("lift_pp"),
        round_half_away(F.when(ok, (lift - F.lit(Z_95) * se) * 100), 4).alias("ci_low_pp"),
        round_half_away(F.when(ok, (lift + F.lit(Z_95) * se) * 100), 4).alias("ci_high_pp"),
        round_half_away(F.when(ok, z), 4).alias("z"),
        round_half_away(F.when(ok, two_sided_p(z)), 4).alias("p_value"),
        *[round_half_away(f"{name}_{gr}", 4).alias(f"{name}_{gr}")
          for name in ("control", "treatment") for gr in guardrails],
        *[c for gr in guardrails for c in _guardrail(gr)])
    return out


def _guardrail(g: str) -> list:
    """Difference of the arms' means with its 95 % interval and two-sided p,
    the variances taken apart; null where an arm has fewer than two values."""
    diff = F.col(f"treatment_{g}") - F.col(f"control_{g}")
    se = F.sqrt(F.col(f"_treatment_{g}_var") / F.col(f"_treatment_{g}_n") + F.col(f"_control_{g}_var") / F.col(f"_control_{g}_n"))
    p = F.when(se > 0, two_sided_p(diff / se))
    return [round_half_away(diff, 4).alias(f"{g}_diff"), round_half_away(diff - F.lit(Z_95) * se, 4).alias(f"{g}_ci_low"),
            round_half_away(diff + F.lit(Z_95) * se, 4).alias(f"{g}_ci_high"), round_half_away(p, 4).alias(f"{g}_p_value")]


def experiment_by_segment(df: DataFrame, segment: str, arm: str = "arm", outcome: str = "activated",
                          guardrails: Sequence[str] = ("sessions", "avg_session_sec")) -> DataFrame:
    return experiment_readout(df, arm, outcome, guardrails, by=[segment])
