"""Range checks on a stream of whole profiles (levels nested in the header row): stateless, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_ranges(profiles: DataFrame, low: float = -4.0, high: float = 40.0, column: str = "levels") -> DataFrame:
    """The rows with ``flags array<boolean>``: temperatures outside of a range; missing ones pass."""
    bad = lambda x: F.coalesce((x["t"] < low) | (x["t"] > high), F.lit(False))
    return profiles.withColumn("flags", F.transform(column, bad))
