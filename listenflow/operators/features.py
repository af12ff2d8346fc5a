"""Day-7 behavioural feature tables (SQL form and notebook form) and their summaries."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenflow.functions.dates import elapsed_days
from listenflow.functions.numeric import pct, round_half_away
from listenflow.operators._user import attach_user, back_to_users, count_where
from listenflow.operators.ranking import exact_percentiles
from listenflow.session import materialize
from listenflow.sources.product import ProductTables

D7_DAYS = 7
# fixed: event types counted per user, in output order (play is not counted)
EVENT_FEATURES = (("skip", "skips_d7"), ("like", "likes_d7"), ("playlist_save", "playlist_saves_d7"),
                  ("share", "shares_d7"), ("search", "searches_d7"),
                  ("upgrade_click", "upgrade_clicks_d7"), ("ad_view", "ad_views_d7"))
# fixed: notebook export columns, in order
EXPORT_COLUMNS = ("user_id", "converted", "sessions_d7", "total_listen_min_d7", "avg_session_min_d7",
                  "distinct_days_d7", "distinct_devices_d7", "skip_rate_pct", "completion_rate_pct",
                  "playlist_saves_d7", "likes_d7", "upgrade_clicks_d7")
# fixed: the eight columns compared between converters and non-converters
COMPARE_COLUMNS = ("sessions_d7", "total_listen_min_d7", "distinct_days_d7", "skip_rate_pct",
                   "completion_rate_pct", "playlist_saves_d7", "likes_d7", "upgrade_clicks_d7")
HIST_BINS = 30
# fixed: README's converter/non-converter comparison features
RATIO_COLUMNS = ("sessions_d7", "skip_rate_pct", "playlist_saves_d7", "completion_rate_pct",
                 "upgrade_clicks_d7")


def _in_window(date_col: str, days: int):
    return lambda c: c(f"f.{date_col}").between(c("u.signup_date"), F.date_add(c("u.signup_date"), days))


def _window_sessions(t: ProductTables, days: int) -> DataFrame:
    """Session rows dated signup .. signup + days (inclusive), with user attrs."""
    if not 0 <= days <= 62:
        raise ValueError("a window has 1 to 63 dates")
    s = t.sessions.select("session_id", "user_id", "session_date", "session_duration_sec", "device_type")
    return attach_user(s, t.users, ["signup_date"], condition=_in_window("session_date", days))


def _day_set(date_col: str, first_col: str) -> F.Column:
    """Distinct days of a window of at most 63 dates from ``first_col`` on: one
    bit per date, merged by the partial aggregates like a sum."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.datediff(date_col, first_col))
    return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long")


def _session_feature_aggs() -> list:
    # a bitmap of days leaves one distinct in the group (devices), which Spark
    # plans as a two-level aggregate; with several it would expand every row
    return [F.count("session_id").cast("long").alias("sessions_d7"),        # one row per session
            F.sum("session_duration_sec").cast("long").alias("total_listen_sec_d7"),
            F.avg("session_duration_sec").alias("avg_session_sec_d7"),
            _day_set("session_date", "signup_date").alias("distinct_days_active_d7"),
            F.countDistinct("device_type").cast("long").alias("distinct_devices_d7")]


def _session_aggs(t: ProductTables, days: int) -> DataFrame:
    """Per user with an in-window session: the five session features."""
    return _window_sessions(t, days).groupBy("user_id").agg(*_session_feature_aggs())


SESSION_COUNTS = ("sessions_d7", "distinct_days_active_d7", "distinct_devices_d7")


def d7_session_features(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    out = back_to_users(t.users.select("user_id", "signup_date", "plan_type"), _session_aggs(t, days),
                        SESSION_COUNTS)
    return out.select("user_id", "signup_date", "plan_type", "sessions_d7", "total_listen_sec_d7",
                      "avg_session_sec_d7", "distinct_days_active_d7", "distinct_devices_d7")


def _events_per_session(t: ProductTables, types: Sequence[str], since=None) -> DataFrame:
    """Per session_id: event count by type and in total (pre-aggregated before
    any join, so raw events are never shuffled to the user).

    ``since`` (a date) is for callers that keep the sessions dated from then
    on only: a session's date is that of its first event, so none of its
    events is earlier, and the bound reaches the scan of the events.
    """
    events = t.events if since is None else t.events.where(F.col("event_ts") >= F.lit(since).cast("timestamp"))
    aggs = [count_where(F.col("event_type") == et).alias(f"n_{et}") for et in types]
    aggs.append(F.count(F.lit(1)).cast("long").alias("n_events"))
    return events.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(*aggs)


EVENT_COUNTS = tuple(name for _, name in EVENT_FEATURES)


def _event_aggs(t: ProductTables, days: int) -> DataFrame:
    """Per user with an in-window session that has events: the seven counts."""
    ev = _events_per_session(t, [et for et, _ in EVENT_FEATURES])
    s = _window_sessions(t, days).select("session_id", "user_id").join(ev, "session_id", "inner")
    return s.groupBy("user_id").agg(*[F.sum(f"n_{et}").cast("long").alias(name) for et, name in EVENT_FEATURES])


def _session_and_event_aggs(t: ProductTables, days: int) -> DataFrame:
    """Session features and event counts in one pass over the in-window
    sessions: per-session event counts (one row per session) are attached
    first, so durations are not repeated per event."""
    ev = _events_per_session(t, [et for et, _ in EVENT_FEATURES])
    s = _window_sessions(t, days).join(ev, "session_id", "left")
    return s.groupBy("user_id").agg(*_session_feature_aggs(),
                                    *[F.sum(f"n_{et}").cast("long").alias(name) for et, name in EVENT_FEATURES])


def d7_event_features(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    out = back_to_users(t.users.select("user_id"), _event_aggs(t, days), EVENT_COUNTS)
    return out.select("user_id", *EVENT_COUNTS)


TRACK_COUNTS = ("tracks_played_d7", "tracks_completed_d7", "unique_tracks_d7", "unique_genres_d7")
TRACK_MEANS = ("avg_track_energy", "avg_track_danceability", "avg_track_valence")


def _track_aggs(t: ProductTables, days: int) -> DataFrame:
    """Per user with an in-window play: the seven track features."""
    p = t.plays.select("play_id", "user_id", "track_id", "play_date", "completed")
    p = attach_user(p, t.users, ["signup_date"], condition=_in_window("play_date", days))
    # one row per user and track before the tracks are joined: fewer rows meet
    # them, and counting rows replaces the distinct count of tracks
    p = p.groupBy("user_id", "track_id").agg(
        F.count("play_id").cast("long").alias("n"),
        F.sum(F.when(F.col("completed") == F.lit(True), 1).otherwise(0)).cast("long").alias("done"),
        F.count(F.lit(1)).cast("long").alias("rows"))
    p = p.join(t.tracks.select("track_id", "genre", "energy", "danceability", "valence"), "track_id", "left")

    def mean(c: str) -> F.Column:       # over plays; 9 decimals make it independent of row order
        plays = F.sum(F.when(F.col(c).isNotNull(), F.col("rows")))
        return round_half_away(F.sum(F.col(c) * F.col("rows")) / plays, 9).alias(f"avg_track_{c}")
    return p.groupBy("user_id").agg(
        F.sum("n").cast("long").alias("tracks_played_d7"),
        F.sum("done").cast("long").alias("tracks_completed_d7"),
        F.count("track_id").cast("long").alias("unique_tracks_d7"),
        F.countDistinct("genre").cast("long").alias("unique_genres_d7"),
        mean("energy"), mean("danceability"), mean("valence"))


def d7_track_features(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    # a user without plays still has one NULL row in the SQL's left join, whose
    # CASE gives 0: so every count, the completed sum included, is 0, not NULL
    out = back_to_users(t.users.select("user_id"), _track_aggs(t, days), TRACK_COUNTS)
    return out.select("user_id", *TRACK_COUNTS, *TRACK_MEANS)


def _ratios() -> list:
    return [pct("skips_d7", "tracks_played_d7", 2).alias("skip_rate_pct"),
            pct("tracks_completed_d7", "tracks_played_d7", 2).alias("completion_rate_pct"),
            pct("skips_d7", "ad_views_d7", 2, scale=1).alias("skips_per_ad")]


def user_day7_features(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    """The 25-column feature table, one row per user: the session+event and
    the track aggregates joined once each onto the users (all 1:1)."""
    u = t.users.select("user_id", "plan_type")
    j = u.join(_session_and_event_aggs(t, days), "user_id", "left") \
         .join(_track_aggs(t, days), "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    j = j.select("user_id", "plan_type",
                 F.when(F.col("plan_type") == "premium", 1).otherwise(0).alias("converted"),
                 zero("sessions_d7"), "total_listen_sec_d7", "avg_session_sec_d7",
                 zero("distinct_days_active_d7"), zero("distinct_devices_d7"),
                 *[zero(c) for c in EVENT_COUNTS], *[zero(c) for c in TRACK_COUNTS], *TRACK_MEANS)
    return j.select("*", *_ratios())


def _event_track_features(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    """Only the event and track parts of the feature table, with the ratios."""
    j = t.users.select("user_id").join(_event_aggs(t, days), "user_id", "left") \
         .join(_track_aggs(t, days), "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    j = j.select("user_id", *[zero(c) for c in EVENT_COUNTS], *[zero(c) for c in TRACK_COUNTS])
    return j.select("*", *_ratios())


def d7_features_minutes(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    """Notebook form: sessions within floor-elapsed ``days`` of signup (no lower
    bound), minutes; users without such a session are absent."""
    s = attach_user(t.sessions.select("user_id", "session_id", "session_start", "session_duration_sec",
                                      "device_type"), t.users, ["signup_date", "plan_type"])
    s = s.where(elapsed_days("signup_date", "session_start") <= days)
    g = s.groupBy("user_id", "plan_type").agg(
        F.count("session_id").cast("long").alias("sessions_d7"),
        (F.sum("session_duration_sec") / F.lit(60.0)).alias("total_listen_min_d7"),
        (F.avg("session_duration_sec") / F.lit(60.0)).alias("avg_session_min_d7"),
        # no lower bound on the days, so no bitmap: the few device names of a user form a set instead
        F.countDistinct(F.to_date("session_start")).cast("long").alias("distinct_days_d7"),
        F.size(F.collect_set("device_type")).cast("long").alias("distinct_devices_d7"))
    return g.select("user_id", "sessions_d7", "total_listen_min_d7", "avg_session_min_d7",
                    "distinct_days_d7", "distinct_devices_d7", "plan_type",
                    F.when(F.col("plan_type") == "premium", 1).otherwise(0).alias("converted"))


def notebook_features(t: ProductTables, days: int = D7_DAYS) -> DataFrame:
    """The notebook's feature frame: the minutes form plus the event/track
    features (taken from the SQL feature table, where the notebook drew them
    at random)."""
    m = d7_features_minutes(t, days)
    f = _event_track_features(t, days).select("user_id", "skip_rate_pct", "completion_rate_pct",
                                              "playlist_saves_d7", "likes_d7", "upgrade_clicks_d7")
    return m.join(f, "user_id", "left")


def feature_export(features: DataFrame) -> DataFrame:
    return features.select(*EXPORT_COLUMNS)


def _long(features: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` into (feature, value DOUBLE) rows, NULL values dropped."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return features.selectExpr(*keep, f"stack({len(cols)}, {pairs}) AS (feature, value)") \
                   .where(F.col("value").isNotNull())


def compare_converters_hist(features: DataFrame, cols: Sequence[str] = COMPARE_COLUMNS,
                            bins: int = HIST_BINS) -> DataFrame:
    """Per feature and group, ``bins`` equal-width bins over the group's own
    range (last bin closed), density-normalised; min = max widens by ±0.5."""
    # read twice (ranges, then bin counts): written once instead of re-running
    # the feature pipeline
    long = materialize(_long(features, cols, ["converted"]))
    stats = long.groupBy("feature", "converted").agg(
        F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count(F.lit(1)).cast("long").alias("n"))
    stats = stats.select("feature", "converted", "n",
                         F.when(F.col("vmin") == F.col("vmax"), F.col("vmin") - 0.5).otherwise(F.col("vmin")).alias("lo"),
                         F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 0.5).otherwise(F.col("vmax")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    # one row per (feature, group): bounded by len(cols) * 2
    j = long.join(F.broadcast(stats), ["feature", "converted"], "inner")
    idx = F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))),
                  F.lit(bins - 1)).cast("int")
    counts = j.groupBy("feature", "converted", idx.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("users"))
    grid = stats.select("feature", "converted", "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, ["feature", "converted", "bin"], "left")
    users = F.coalesce(F.col("users"), F.lit(0).cast("long"))
    return out.select("feature", "converted", "bin",
                      (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      users.alias("users"),
                      (users / (F.col("n") * width)).alias("density"))


def converter_medians(features: DataFrame, cols: Sequence[str] = COMPARE_COLUMNS) -> DataFrame:
    """Median of each compared feature per group (the dashed lines)."""
    return exact_percentiles(_long(features, cols, ["converted"]), "value", [0.5], ["median"],
                             group_by=["feature", "converted"])


def features_describe(features: DataFrame, cols: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column, rounded to 2."""
    long = materialize(_long(features, cols))     # read by both the moments and the quartiles
    basic = long.groupBy("feature").agg(
        F.count(F.lit(1)).cast("long").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_percentiles(long, "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], group_by=["feature"])
    j = basic.join(q, "feature", "inner")
    return j.select("feature", "count", *[round_half_away(c, 2).alias(c)
                                          for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def converter_ratio_table(features: DataFrame, cols: Sequence[str] = RATIO_COLUMNS) -> DataFrame:
    """Mean of each feature for converters and non-converters, and their ratio."""
    long = _long(features, cols, ["converted"])
    g = long.groupBy("feature").agg(
        F.avg(F.when(F.col("converted") == 1, F.col("value"))).alias("converter_mean"),
        F.avg(F.when(F.col("converted") == 0, F.col("value"))).alias("non_converter_mean"))
    return g.select("feature", round_half_away("converter_mean", 4).alias("converter_mean"),
                    round_half_away("non_converter_mean", 4).alias("non_converter_mean"),
                    round_half_away(F.when(F.col("non_converter_mean") != 0,
                                           F.col("converter_mean") / F.col("non_converter_mean")), 2)
                    .alias("ratio"))


def feature_conversion_corr(features: DataFrame, cols: Sequence[str] = RATIO_COLUMNS) -> DataFrame:
    """Pearson correlation of each feature with the converted flag."""
    long = _long(features, cols, ["converted"])
    g = long.groupBy("feature").agg(F.corr("value", F.col("converted").cast("double")).alias("r"),
                                    F.count(F.lit(1)).cast("long").alias("n"))
    return g.select("feature", "n", round_half_away("r", 4).alias("corr_with_converted"))
