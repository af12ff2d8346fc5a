"""Sources (driver parquet tables → the five product tables) and sinks."""
