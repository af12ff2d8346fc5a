"""Genre and audio-feature affinity by plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.numeric import pct, round_half_away
from listenflow.operators._user import attach_user
from listenflow.operators.ordering import ordered
from listenflow.sources.product import ProductTables

AUDIO_MEANS = ("energy", "danceability", "valence", "acousticness")


def _plays_with_tracks(t: ProductTables, track_cols) -> DataFrame:
    p = t.plays.select("play_id", "user_id", "track_id")
    # tracks is a dimension: AQE broadcasts it when its measured size allows,
    # else this is a sort-merge join whose hot tracks AQE can split
    p = p.join(t.tracks.select("track_id", *track_cols), "track_id", "inner")
    return attach_user(p, t.users, ["plan_type"])


def genre_by_plan(t: ProductTables) -> DataFrame:
    j = _plays_with_tracks(t, ["genre", "energy", "danceability", "valence"])
    g = j.groupBy("genre", "plan_type").agg(
        F.countDistinct("user_id").cast("long").alias("user_count"),
        F.count("play_id").cast("long").alias("total_plays"),
        F.avg("energy").alias("e"), F.avg("danceability").alias("d"), F.avg("valence").alias("v"))
    plan_total = F.sum("total_plays").over(Window.partitionBy("plan_type"))   # genres × plans rows
    return ordered(g.select("genre", "plan_type", "user_count", "total_plays",
                            round_half_away("e", 3).alias("avg_energy"),
                            round_half_away("d", 3).alias("avg_danceability"),
                            round_half_away("v", 3).alias("avg_valence"),
                            pct(F.col("total_plays"), plan_total, 1).alias("pct_of_plan_plays")),
                   "plan_type", "-total_plays", "genre")


def audio_profile_by_type(t: ProductTables) -> DataFrame:
    j = _plays_with_tracks(t, ["energy", "danceability", "valence", "acousticness", "tempo", "popularity"])
    user_type = F.when(F.col("plan_type") == "premium", "Converted").otherwise("Free")
    g = j.groupBy(user_type.alias("user_type")).agg(
        *[F.avg(c).alias(c) for c in ("energy", "danceability", "valence", "acousticness", "tempo", "popularity")],
        F.countDistinct("user_id").cast("long").alias("user_count"),
        F.count("play_id").cast("long").alias("total_plays"))
    return g.select("user_type",
                    *[round_half_away(c, 3).alias(f"avg_{c}") for c in ("energy", "danceability", "valence", "acousticness")],
                    round_half_away("tempo", 1).alias("avg_tempo"),
                    round_half_away("popularity", 1).alias("avg_popularity"),
                    "user_count", "total_plays")


def audio_profile_user_mean(t: ProductTables) -> DataFrame:
    """Mean of per-user play-weighted averages, by plan (each user weighs the same)."""
    j = _plays_with_tracks(t, list(AUDIO_MEANS))
    per_user = j.groupBy("user_id", "plan_type").agg(*[F.avg(c).alias(c) for c in AUDIO_MEANS])
    g = per_user.groupBy("plan_type").agg(*[F.avg(c).alias(c) for c in AUDIO_MEANS],
                                          F.count(F.lit(1)).cast("long").alias("users"))
    return g.select("plan_type", *[round_half_away(c, 4).alias(f"avg_{c}") for c in AUDIO_MEANS], "users")
