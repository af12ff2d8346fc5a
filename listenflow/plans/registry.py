"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Planning a query may already run jobs: what several queries share (the load
step, the feature tables) is stored on first use, and rankings write their
range segments.

The names are the keys of ``__spark_entry__.queries()``; the DuckDB oracle in
``oracle/`` has a statement for each name that SQL can express.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.operators import (churn, content, experiment, features, funnel, logistic, model, retention,
                                  segments, timing, validate)
from listenflow.session import checkpoint_dir
from listenflow.sources import feature_weeks
from listenflow.sources.sinks import export_features_csv, save_feature_table
from listenflow.sources.product import load_product_tables, stored

QueryFn = Callable[[SparkSession, str], DataFrame]

# fixed evaluation dates of the churn queries (stand-ins for CURRENT_DATE)
CHURN_AS_OF = dt.date(2024, 2, 25)
CHURN_AS_OF_ALT = dt.date(2024, 2, 21)
# the weekly feature table first knows the data up to this date
FEATURES_KNOWN_TO = dt.date(2024, 1, 10)
WIDE_STAGES = ((7, 15), (30, 40))


def _q(fn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_product_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _nb(t):
    """The notebook feature frame, stored once and read by every query of it."""
    return stored(t, "notebook_features", lambda: features.notebook_features(t))


def _d7(t):
    """The day-7 feature table, stored once and read by every query of it."""
    return stored(t, "user_day7_features", lambda: features.user_day7_features(t))


# the model is fitted once per (application, source folder) and shared by the
# three model queries
_FITTED: dict[tuple[str, str], object] = {}


def _fit_once(spark, sf_dir: str, what: str, fit):
    key = (spark.sparkContext.applicationId, f"{sf_dir.rstrip('/')}#{what}")
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _logistic_q(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = _nb(load_product_tables(spark, sf_dir))
        return make(frame, _fit_once(spark, sf_dir, "logistic", lambda: logistic.fit_logistic(frame)))
    return run


def _model_q(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_product_tables(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in _FITTED:
            _FITTED[key] = model.fit_conversion_model(_nb(t))
        return make(spark, t, _FITTED[key])
    return run


QUERIES: dict[str, QueryFn] = {
    # 1 funnel
    "funnel_overall": _q(funnel.funnel_overall),
    "funnel_overall_wide_stages": _q(lambda t: funnel.funnel_overall(t, WIDE_STAGES)),
    "funnel_by_device": _q(funnel.funnel_by_device),
    "funnel_elapsed_days": _q(funnel.funnel_elapsed_days),
    "funnel_dropoff": _q(lambda t: funnel.funnel_dropoff(funnel.funnel_elapsed_days(t))),
    # 2 retention
    "cohort_retention": _q(retention.cohort_retention),
    "cohort_retention_w2": _q(lambda t: retention.cohort_retention(t, max_week=2)),
    "cohort_retention_elapsed": _q(retention.cohort_retention_elapsed),
    "cohort_matrix": _q(lambda t: retention.cohort_matrix(retention.cohort_retention_elapsed(t))),
    "cohort_matrix_first3": _q(lambda t: retention.cohort_matrix(retention.cohort_retention_elapsed(t), first_n=3)),
    "retention_curve": _q(lambda t: retention.retention_curve(retention.cohort_retention_elapsed(t))),
    "retention_curve_first3": _q(lambda t: retention.retention_curve(retention.cohort_retention_elapsed(t), first_n=3)),
    "cohort_day3_vs_retention": _q(retention.cohort_day3_vs_retention),
    "day3_retention_correlation": _q(retention.day3_retention_correlation),
    # 3 features
    "d7_session_features": _q(features.d7_session_features),
    "d7_event_features": _q(features.d7_event_features),
    "d7_track_features": _q(features.d7_track_features),
    "user_day7_features": _q(features.user_day7_features),
    "d7_features_minutes": _q(features.d7_features_minutes),
    "feature_export": _q(lambda t: features.feature_export(_nb(t))),
    "features_describe": _q(lambda t: features.features_describe(_nb(t))),
    "compare_converters_hist": _q(lambda t: features.compare_converters_hist(_nb(t))),
    "converter_medians": _q(lambda t: features.converter_medians(_nb(t))),
    "converter_ratio_table": _q(lambda t: features.converter_ratio_table(_d7(t))),
    "feature_conversion_corr": _q(lambda t: features.feature_conversion_corr(_d7(t))),
    # 4 segments
    "free_user_tiers": _q(segments.free_user_tiers),
    "free_user_tiers_corrected": _q(segments.free_user_tiers_corrected),
    "conversion_by_quartile": _q(segments.conversion_by_quartile),
    "engagement_qcut_segments": _q(lambda t: segments.engagement_qcut_segments(_nb(t))),
    "segment_share": _q(lambda t: segments.segment_share(segments.engagement_qcut_segments(_nb(t)))),
    # 5 churn
    "premium_churn_users": _q(lambda t: churn.premium_churn_users(t, CHURN_AS_OF)),
    "premium_churn_users_corrected": _q(lambda t: churn.premium_churn_users_corrected(t, CHURN_AS_OF)),
    "churn_distribution": _q(lambda t: churn.churn_distribution(t, CHURN_AS_OF)),
    "churn_distribution_alt_date": _q(lambda t: churn.churn_distribution(t, CHURN_AS_OF_ALT)),
    "premium_churn_users_alt_date": _q(lambda t: churn.premium_churn_users(t, CHURN_AS_OF_ALT)),
    # 6 content
    "genre_by_plan": _q(content.genre_by_plan),
    "audio_profile_by_type": _q(content.audio_profile_by_type),
    "audio_profile_user_mean": _q(content.audio_profile_user_mean),
    # 7 timing
    "days_to_convert": _q(timing.days_to_convert),
    "upgrade_click_conversion": _q(timing.upgrade_click_conversion),
    # 8 validation
    "row_counts": _q(validate.row_counts),
    "plan_distribution": _q(validate.plan_distribution),
    "date_ranges": _q(validate.date_ranges),
    "null_checks": _q(validate.null_checks),
    "dataset_summary": _q(lambda t: validate.dataset_summary(t, _nb(t))),
    # 9 model and experiment
    "score_auc": _q(lambda t: model.score_auc(segments.qcut_scored(_nb(t)), "engagement_score", "converted")),
    "experiment_readout": _q(lambda t: experiment.experiment_readout(experiment.experiment_frame(t))),
    "experiment_by_segment": _q(lambda t: experiment.experiment_by_segment(
        # every user has a segment, so the segments add up to the read-out
        experiment.experiment_frame(t).join(
            segments.free_user_tiers_corrected(t).select("user_id", "user_segment"), "user_id", "left")
        .withColumn("user_segment", F.coalesce("user_segment", F.lit("Premium"))),
        "user_segment")),
    "conversion_probability": _logistic_q(logistic.conversion_probability),
    "conversion_probability_auc": _logistic_q(
        lambda frame, m: logistic.probability_auc(logistic.conversion_probability(frame, m))),
    "permutation_importance": _logistic_q(logistic.permutation_importance),
    "conversion_model": _model_q(lambda s, t, m: model.conversion_model(_nb(t), fitted=m)),
    "conversion_model_auc": _model_q(lambda s, t, m: model.holdout_auc(model.conversion_model(_nb(t), fitted=m))),
    "conversion_model_importance": _model_q(lambda s, t, m: model.feature_importance_frame(m, s)),
}


def feature_table_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table saved if it is not there yet, then read back."""
    tag = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir.rstrip('/')}".encode()).hexdigest()[:12]
    name = f"user_day7_features_{tag}"
    save_feature_table(_d7(load_product_tables(spark, sf_dir)), name,
                       path=f"{checkpoint_dir(spark).rstrip('/')}/listenflow/{name}")
    return spark.table(name)


def feature_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported CSV files, read back with the frame's schema."""
    frame = features.feature_export(_nb(load_product_tables(spark, sf_dir)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/listenflow/{uuid.uuid4().hex}"
    export_features_csv(frame, path)
    return spark.read.schema(frame.schema).option("header", True).csv(path)


def feature_table_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly feature table: built from the users and facts up to a date,
    then brought up to date with the rest, then read."""
    t = load_product_tables(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/listenflow/{uuid.uuid4().hex}"
    known = FEATURES_KNOWN_TO

    def upto(df: DataFrame, c: str) -> DataFrame:
        return df.where(F.col(c) <= F.lit(known))
    early = replace(t, users=upto(t.users, "signup_date"), sessions=upto(t.sessions, "session_date"),
                    plays=upto(t.plays, "play_date"), source=None)
    feature_weeks.rebuild(early, path)
    last = t.users.agg(F.max("signup_date")).first()[0]
    feature_weeks.update(t, path, known + dt.timedelta(days=1), max(last, known))
    return feature_weeks.read(spark, path)


QUERIES["feature_table_stored"] = feature_table_stored
QUERIES["feature_table_by_week"] = feature_table_by_week
QUERIES["feature_export_csv"] = feature_export_csv

# queries without a SQL oracle (iterative fit): the driver checks rows only
NO_ORACLE = {"conversion_model", "conversion_model_auc", "conversion_model_importance"}

FLAGSHIP = "funnel_overall"
