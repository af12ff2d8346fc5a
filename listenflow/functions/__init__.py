"""Scalar Column helpers (JVM-side expressions only, no Python UDFs)."""

from listenflow.functions.numeric import pct, round_half_away
from listenflow.functions.dates import week_start, elapsed_days, elapsed_micros

__all__ = ["pct", "round_half_away", "week_start", "elapsed_days", "elapsed_micros"]
