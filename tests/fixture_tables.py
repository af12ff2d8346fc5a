"""The hand-checked micro-fixture (five users, seven sessions, five events)."""

import datetime as dt

from pyspark.sql import types as T

from listenflow.sources.product import ProductTables

D = dt.date
TS = dt.datetime

USERS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("signup_date", T.DateType()),
                      T.StructField("country", T.StringType()), T.StructField("age_group", T.StringType()),
                      T.StructField("plan_type", T.StringType()), T.StructField("converted_date", T.DateType())])
SESSIONS = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("user_id", T.LongType()),
                         T.StructField("session_date", T.DateType()), T.StructField("session_start", T.TimestampType()),
                         T.StructField("session_duration_sec", T.LongType()), T.StructField("device_type", T.StringType())])
EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("session_id", T.LongType()),
                       T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                       T.StructField("event_ts", T.TimestampType())])
TRACKS = T.StructType([T.StructField("track_id", T.LongType()), T.StructField("track_name", T.StringType()),
                       T.StructField("artist", T.StringType()), T.StructField("genre", T.StringType())]
                      + [T.StructField(c, T.DoubleType()) for c in
                         ("energy", "danceability", "acousticness", "tempo", "valence", "popularity")])
PLAYS = T.StructType([T.StructField("play_id", T.LongType()), T.StructField("session_id", T.LongType()),
                      T.StructField("user_id", T.LongType()), T.StructField("track_id", T.LongType()),
                      T.StructField("play_date", T.DateType()), T.StructField("play_duration_sec", T.IntegerType()),
                      T.StructField("track_duration_sec", T.IntegerType()), T.StructField("completed", T.BooleanType())])

USER_ROWS = [(1, D(2024, 1, 1), "US", "18-24", "free", None),
             (2, D(2024, 1, 1), "US", "18-24", "free", None),
             (3, D(2024, 1, 7), "DE", "25-34", "premium", D(2024, 1, 10)),
             (4, D(2024, 1, 8), "DE", "25-34", "premium", D(2024, 1, 9)),
             (5, D(2024, 1, 8), "BR", "35-44", "premium", D(2024, 1, 9))]
SESSION_ROWS = [(20, 2, D(2023, 12, 31), 100, "mobile"), (21, 2, D(2024, 1, 1), 600, "mobile"),
                (22, 2, D(2024, 1, 8), 1200, "mobile"), (23, 2, D(2024, 1, 9), 60, "tablet"),
                (30, 3, D(2024, 1, 7), 300, "mobile"), (31, 3, D(2024, 1, 8), 300, "desktop"),
                (50, 5, D(2024, 1, 9), 90, "mobile")]
EVENT_ROWS = [(1, 21, 2, "like", TS(2024, 1, 1, 9, 0)), (2, 21, 2, "upgrade_click", TS(2024, 1, 1, 9, 1)),
              (3, 21, 2, "skip", TS(2024, 1, 1, 9, 2)), (4, 30, 3, "upgrade_click", TS(2024, 1, 7, 12, 0)),
              (5, 50, 5, "upgrade_click", TS(2024, 1, 9, 6, 0))]


def fixture_tables(spark, sessions=SESSION_ROWS, users=USER_ROWS, events=EVENT_ROWS, plays=()):
    s_rows = [(sid, uid, d, TS(d.year, d.month, d.day), sec, dev) for sid, uid, d, sec, dev in sessions]
    return ProductTables(
        users=spark.createDataFrame(users, USERS),
        sessions=spark.createDataFrame(s_rows, SESSIONS),
        events=spark.createDataFrame(list(events), EVENTS),
        tracks=spark.createDataFrame([], TRACKS),
        plays=spark.createDataFrame(list(plays), PLAYS))
