"""Conversion model on day-7 features (MLlib) and a distributed rank-sum AUC."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenflow.functions.numeric import round_half_away
from listenflow.operators.ranking import running_counts

# fixed: model inputs (the exported day-7 features without id and label)
MODEL_FEATURES = ("sessions_d7", "total_listen_min_d7", "avg_session_min_d7", "distinct_days_d7",
                  "distinct_devices_d7", "skip_rate_pct", "completion_rate_pct", "playlist_saves_d7",
                  "likes_d7", "upgrade_clicks_d7")
HOLDOUT_BUCKETS = 10      # hash(user_id) % 10 < 2 → held out (20 %)


def holdout_flag(user_col: str = "user_id", holdout: float = 0.2):
    b = F.pmod(F.xxhash64(F.col(user_col)), F.lit(HOLDOUT_BUCKETS))
    return b < F.lit(int(round(holdout * HOLDOUT_BUCKETS)))


def score_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC of ``score`` for binary ``label`` by the rank-sum formula, tied
    scores sharing their average rank.  One row (per group of ``by``): n_pos,
    n_neg, auc."""
    by = list(by)
    d = df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y")) \
          .where(F.col("_s").isNotNull() & F.col("_y").isNotNull())
    # one row per distinct score first: ties then share one row, not one task
    counts = d.groupBy(*by, "_s").agg(F.sum("_y").cast("long").alias("pos"), F.count(F.lit(1)).cast("long").alias("cnt"))
    ranked = running_counts(counts, "_s", ["cnt"], by)
    per_score = ranked.select(*by, "pos", "cnt", (F.col("cnt_upto") - F.col("cnt") + 1).alias("lo"),
                              F.col("cnt_upto").alias("hi"))
    tot = per_score.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("lo") + F.col("hi")) / F.lit(2.0)).alias("rank_sum"),
                        F.sum("pos").cast("long").alias("n_pos"),
                        (F.sum("cnt") - F.sum("pos")).cast("long").alias("n_neg"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.when((p > 0) & (n > 0), (F.col("rank_sum") - p * (p + 1) / 2) / (p * n))
    return tot.select(*by, "n_pos", "n_neg", round_half_away(auc, 6).alias("auc"))


def _model_input(features: DataFrame, cols: Sequence[str], holdout: float) -> DataFrame:
    return features.select("user_id", F.col("converted").cast("double").alias("label"),
                           *[F.col(c).cast("double").alias(c) for c in cols]) \
                   .withColumn("held_out", holdout_flag("user_id", holdout))


def fit_conversion_model(features: DataFrame, cols: Sequence[str] = MODEL_FEATURES, holdout: float = 0.2,
                         max_iter: int = 20, seed: int = 42):
    """Fit Imputer → VectorAssembler → GBTClassifier on the users not held out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    cols = list(cols)
    imputed = [f"{c}_i" for c in cols]
    pipe = Pipeline(stages=[Imputer(inputCols=cols, outputCols=imputed, strategy="median"),
                            VectorAssembler(inputCols=imputed, outputCol="features"),
                            GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter,
                                          maxDepth=4, seed=seed)])
    return pipe.fit(_model_input(features, cols, holdout).where(~F.col("held_out")))


def conversion_model(features: DataFrame, cols: Sequence[str] = MODEL_FEATURES, holdout: float = 0.2,
                     max_iter: int = 20, seed: int = 42, fitted=None) -> DataFrame:
    """Gradient-boosted trees on the day-7 features; returns every user's
    conversion probability and whether the user was held out."""
    from pyspark.ml.functions import vector_to_array

    fitted = fitted or fit_conversion_model(features, cols, holdout, max_iter, seed)
    scored = fitted.transform(_model_input(features, list(cols), holdout))
    return scored.select("user_id", F.col("label").cast("int").alias("converted"), "held_out",
                         vector_to_array("probability")[1].alias("probability"))


def holdout_auc(scored: DataFrame) -> DataFrame:
    """AUC of the model's probability on the held-out users (one row)."""
    return score_auc(scored.where(F.col("held_out")), "probability", "converted")


def feature_importance_frame(fitted, spark, cols: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """(feature, importance) of a fitted pipeline's trees, one row per input."""
    imp = fitted.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(cols, imp)), "feature string, importance double")
