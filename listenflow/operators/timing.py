"""Time to conversion and upgrade-click conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.dates import MICROS_PER_DAY, elapsed_micros
from listenflow.functions.numeric import pct, round_half_away
from listenflow.operators.ordering import ordered
from listenflow.operators.ranking import exact_percentiles
from listenflow.session import materialize
from listenflow.sources.product import ProductTables


def days_to_convert(t: ProductTables) -> DataFrame:
    u = t.users.where((F.col("plan_type") == "premium") & F.col("converted_date").isNotNull())
    g = u.groupBy(F.datediff("converted_date", "signup_date").cast("long").alias("days_to_convert")) \
         .agg(F.count(F.lit(1)).cast("long").alias("users"))
    total = F.sum("users").over(Window.partitionBy())   # one row per distinct day count
    return ordered(g.select("days_to_convert", "users", pct(F.col("users"), total, 1).alias("pct_of_converters")),
                   "days_to_convert")


def _clickers(t: ProductTables) -> DataFrame:
    """Per user with an upgrade click in one of their sessions: first click,
    plan, and (premium only) fractional days from first click to conversion."""
    clicks = t.events.where(F.col("event_type") == "upgrade_click") \
                     .groupBy("session_id").agg(F.min("event_ts").alias("first_click"))
    s = t.sessions.select("session_id", "user_id").join(clicks, "session_id", "inner")
    per_user = s.groupBy("user_id").agg(F.min("first_click").alias("first_upgrade_click"))
    u = t.users.select("user_id", "plan_type", "converted_date").join(per_user, "user_id", "inner")
    days = elapsed_micros("first_upgrade_click", "converted_date") / F.lit(float(MICROS_PER_DAY))
    return u.withColumn("days_click_to_convert", F.when(F.col("plan_type") == "premium", days))


def upgrade_click_conversion(t: ProductTables) -> DataFrame:
    c = materialize(_clickers(t))     # one row per clicker, read by the counts and by the median
    agg = c.agg(F.count(F.lit(1)).cast("long").alias("users_clicked_upgrade"),
                F.sum(F.when(F.col("plan_type") == "premium", 1).otherwise(0)).cast("long").alias("converted"),
                F.avg("days_click_to_convert").alias("_avg"))
    med = exact_percentiles(c, "days_click_to_convert", [0.5], ["_med"])
    j = agg.crossJoin(med)    # two one-row frames
    return j.select("users_clicked_upgrade", "converted",
                    pct("converted", "users_clicked_upgrade", 1).alias("click_to_convert_pct"),
                    round_half_away("_avg", 1).alias("avg_days_to_convert"),
                    round_half_away("_med", 1).alias("median_days_to_convert"))
