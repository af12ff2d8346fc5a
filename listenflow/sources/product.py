"""The five product tables, derived from the driver's parquet tables.

The reference analyses read ``users``, ``sessions``, ``events``,
``tracks_played`` and ``tracks``.  The driver ships TPC-H-style tables and an
event stream instead, so each product table is a Spark derivation of them.
The mapping is fixed; the values below must stay as they are for results to
agree with the SQL oracle.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listenflow.functions.dates import elapsed_micros
from listenflow.operators.ranking import release_held
from listenflow.operators.sessionize import sessionize
from listenflow.session import materialize_to_path
from listenflow.sources.raw import read_raw

# ---- fixed values of the table mapping (must not change) --------------------
SIGNUP_BASE = dt.date(2023, 12, 25)      # users sign up on SIGNUP_BASE + custkey % 28
SIGNUP_SPREAD_DAYS = 28
PREMIUM_MIN_ACCTBAL = 7000.0             # c_acctbal >= this → premium
CONVERT_SPREAD_DAYS = 25                 # converted = signup + (custkey * 7) % 25
SESSION_GAP_SECONDS = 4 * 3600           # a gap over 4 h starts a new session
                                         # session_id = event_id of the session's first event
MIN_SESSION_SECONDS = 30
PLAY_EPOCH = dt.date(1995, 1, 1)         # play_date = SIGNUP_BASE + days(o_orderdate - PLAY_EPOCH) % 60
PLAY_SPREAD_DAYS = 60
TRACK_SECONDS = 300
# device by session number % 10: 0-5 mobile, 6-8 desktop, 9 tablet
# event types by (event_type, k = props.k):
#   view → play when k even else ad_view
#   click → like when k even, upgrade_click when k % 10 = 1, else search
#   error → skip;  purchase → playlist_save;  anything else → share
# -----------------------------------------------------------------------------

# observed while loading
DATE_COLUMNS = {"users": ("signup_date",), "sessions": ("session_date",)}
KEY_COLUMNS = {"users": ("user_id", "signup_date", "plan_type")}

PRODUCT_TABLES = ("users", "sessions", "events", "tracks", "plays")


@dataclass(frozen=True)
class ProductTables:
    """The five product tables.  Fields may be DataFrames or zero-argument
    callables returning one; a callable is resolved on first access, so an
    analysis that never reads sessions never runs the sessionization."""
    users: DataFrame
    sessions: DataFrame
    events: DataFrame
    tracks: DataFrame
    plays: DataFrame
    source: tuple[SparkSession, str] | None = None      # set when derived tables are stored once

    def __getattribute__(self, name):
        value = object.__getattribute__(self, name)
        if name in PRODUCT_TABLES and callable(value) and not isinstance(value, DataFrame):
            value = value()
            object.__setattr__(self, name, value)
        return value


def derive_users(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    signup = F.date_add(F.lit(SIGNUP_BASE), (key % SIGNUP_SPREAD_DAYS).cast("int"))
    premium = F.col("c_acctbal") >= F.lit(PREMIUM_MIN_ACCTBAL)
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = nation.select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "inner").select(
        key.cast("long").alias("user_id"),
        signup.alias("signup_date"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("age_group"),
        F.when(premium, "premium").otherwise("free").alias("plan_type"),
        F.when(premium, F.date_add(signup, ((key * 7) % CONVERT_SPREAD_DAYS).cast("int")))
         .alias("converted_date"),
    )


def sessionized_events(raw_events: DataFrame, keep: str = "write") -> DataFrame:
    """Raw events with ``session_id`` and ``session_seq`` (gap sessionization per user).

    The id is the ``event_id`` of the session's first event, so it is unique
    however many sessions a user has; ``session_seq`` numbers them per user.
    """
    ev = raw_events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("raw_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    return sessionize(ev, "user_id", "ts", "event_id", SESSION_GAP_SECONDS, out="session_seq", keep=keep,
                      first_id="session_id")


def derive_sessions(ev: DataFrame, ts: str = "ts") -> DataFrame:
    g = ev.groupBy("session_id", "user_id").agg(F.min(ts).alias("session_start"),
                                                F.max(ts).alias("_end"),
                                                F.min("session_seq").alias("_seq"))
    turn = F.col("_seq") % 10
    return g.select(
        "session_id", "user_id",
        F.to_date("session_start").alias("session_date"),
        "session_start",
        F.greatest(F.lit(MIN_SESSION_SECONDS).cast("long"),
                   F.floor(elapsed_micros("session_start", "_end") / F.lit(1e6)).cast("long"))
         .alias("session_duration_sec"),
        F.when(turn < 6, "mobile").when(turn < 9, "desktop").otherwise("tablet")
         .alias("device_type"),
    )


def derive_events(ev: DataFrame) -> DataFrame:
    k, t = F.col("k"), F.col("raw_type")
    etype = (F.when(t == "view", F.when(k % 2 == 0, "play").otherwise("ad_view"))
              .when(t == "click", F.when(k % 2 == 0, "like").when(k % 10 == 1, "upgrade_click")
                    .otherwise("search"))
              .when(t == "error", "skip")
              .when(t == "purchase", "playlist_save")
              .otherwise("share"))
    return ev.select("event_id", "session_id", "user_id", etype.alias("event_type"),
                     F.col("ts").alias("event_ts"), "session_seq")


def derive_tracks(part: DataFrame) -> DataFrame:
    pk = F.col("p_partkey")
    return part.select(
        pk.cast("long").alias("track_id"),
        F.col("p_name").alias("track_name"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"),
        (F.col("p_size") / F.lit(50.0)).alias("energy"),
        ((F.col("p_retailprice") - 900) / F.lit(100.0)).alias("danceability"),
        ((pk % 101) / F.lit(100.0)).alias("acousticness"),
        (F.lit(60.0) + pk % 140).cast("double").alias("tempo"),
        (((pk * 37) % 100) / F.lit(100.0)).alias("valence"),
        (pk % 100).cast("double").alias("popularity"),
    )


def derive_plays(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    od = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    day = F.datediff(F.to_date("o_orderdate"), F.lit(PLAY_EPOCH)) % PLAY_SPREAD_DAYS
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("play_id"),
        F.col("l_orderkey").cast("long").alias("session_id"),
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("l_partkey").cast("long").alias("track_id"),
        F.date_add(F.lit(SIGNUP_BASE), day.cast("int")).alias("play_date"),
        (F.col("l_quantity") * 6).cast("int").alias("play_duration_sec"),
        F.lit(TRACK_SECONDS).alias("track_duration_sec"),
        (F.col("l_returnflag") == "N").alias("completed"),
    )


# The derivations that involve joins, windows or aggregation (users from
# customer and nation; events sessionized with their product type; sessions
# aggregated from them; plays from lineitem and orders) are a load step: they
# run once per (Spark application, source folder), are written as Parquet
# under spark.checkpoint.dir, and every analysis of the application reads
# those copies (which also survive the loss of an executor).  Filters such as
# plan_type = 'free', session_date >= cutoff or event_type = 'upgrade_click'
# are pushed into the Parquet scans.  Tracks are a plain projection of part
# and stay lazy.
#
# What the load checks ask for (row counts, first and last dates, missing keys)
# is observed while the copies are written, so checking them costs no scan.
_LOADED: dict[tuple[str, str, str], str] = {}          # -> folder of the copy
_OBSERVED: dict[tuple[str, str, str], dict] = {}        # -> metrics of the load
_OPENED: dict[tuple[int, str], DataFrame] = {}          # (session, folder) -> reader


def _metrics(what: str) -> list:
    out = [F.count(F.lit(1)).alias("rows")]
    for c in DATE_COLUMNS.get(what, ()):
        out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return out + [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in KEY_COLUMNS.get(what, ())]


def observed(t: ProductTables, what: str) -> dict | None:
    """Metrics of a loaded table (``rows``, ``min_``/``max_`` of its dates,
    ``null_`` counts of its key columns), taken while it was written; None for
    tables that do not come from a load step."""
    if t.source is None:
        return None
    getattr(t, what)            # loads it, if that has not happened yet
    spark, sf_dir = t.source
    return _OBSERVED.get((spark.sparkContext.applicationId, sf_dir.rstrip("/"), what))


def _load_once(spark: SparkSession, sf_dir: str, what: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what)
    if key not in _LOADED:
        try:
            seen = Observation(f"load {what}")
            _LOADED[key] = materialize_to_path(build().observe(seen, *_metrics(what)))
            _OBSERVED[key] = seen.get
        finally:
            release_held()
    path = _LOADED[key]
    opened = _OPENED.get((id(spark), path))
    if opened is None or opened.sparkSession is not spark:
        opened = _OPENED[(id(spark), path)] = spark.read.parquet(path)
    return opened


def materialized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table (session id and product event type attached)."""
    return _load_once(spark, sf_dir, "events",
                      # segments only live for the one job that writes the events
                      lambda: derive_events(sessionized_events(read_raw(spark, sf_dir, "events"), keep="cache")))


def materialized_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session, aggregated once from the stored events; session
    date cut-offs are then pushed into this table's scan."""
    return _load_once(spark, sf_dir, "sessions",
                      lambda: derive_sessions(materialized_events(spark, sf_dir), ts="event_ts"))


def materialized_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load_once(spark, sf_dir, "users",
                      lambda: derive_users(read_raw(spark, sf_dir, "customer"), read_raw(spark, sf_dir, "nation")))


def materialized_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load_once(spark, sf_dir, "plays",
                      lambda: derive_plays(read_raw(spark, sf_dir, "lineitem"), read_raw(spark, sf_dir, "orders")))


def stored(t: ProductTables, what: str, build) -> DataFrame:
    """``build()`` stored once per application and source, or as it is for
    tables that do not come from a source folder."""
    return _load_once(*t.source, what, build) if t.source else build()


def load_product_tables(spark: SparkSession, sf_dir: str, reuse: bool = True) -> ProductTables:
    """Lazy product tables over the parquet files in ``sf_dir``.

    With ``reuse`` users, events, sessions and plays are derived once per
    application (see :func:`_load_once`); without it every call derives them
    afresh, lazily.
    """
    ev = {}

    def events_with_sessions() -> DataFrame:
        # without reuse: sessionized once per ProductTables, lazily
        if "ev" not in ev:
            ev["ev"] = sessionized_events(read_raw(spark, sf_dir, "events"))
        return ev["ev"]

    return ProductTables(
        users=lambda: (materialized_users(spark, sf_dir) if reuse else
                       derive_users(read_raw(spark, sf_dir, "customer"), read_raw(spark, sf_dir, "nation"))),
        sessions=lambda: (materialized_sessions(spark, sf_dir) if reuse else derive_sessions(events_with_sessions())),
        events=lambda: (materialized_events(spark, sf_dir) if reuse else derive_events(events_with_sessions())),
        tracks=lambda: derive_tracks(read_raw(spark, sf_dir, "part")),
        plays=lambda: (materialized_plays(spark, sf_dir) if reuse else
                       derive_plays(read_raw(spark, sf_dir, "lineitem"), read_raw(spark, sf_dir, "orders"))),
        source=(spark, sf_dir) if reuse else None,
    )
