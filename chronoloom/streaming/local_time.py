"""Zone operators on streams: projections have no state, and the zone tables are static sides of broadcast joins.

Windows over local time keep the watermark on the UTC column: local time runs backwards once a year, UTC doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.zones import Lookup, as_ntz, utc_seconds


def with_local(df: DataFrame, ts: str, zone: Lookup, to: str = "local_ts") -> DataFrame:
    """df with the local time, as a timestamp without zone, of a timestamp column."""
    return df.withColumn(to, as_ntz(zone.to_local(utc_seconds(F.col(ts)))))


def per_local_day(df: DataFrame, ts: str, zone: Lookup, aggregates: list[Column], keys: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """Aggregates by local date (and keys). On a stream, groups close once the watermark on ts passes them.

    The group is a UTC window of 15 minutes, which midnight at today's offsets never divides, and the date; so a stream's state is bounded by the watermark. Sum the
    windows of a date to have whole days.
    """
    day = F.date_from_unix_date(zone.local_date(utc_seconds(F.col(ts))).cast("int"))
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, "15 minutes").alias("window"), day.alias("local_date"), *(keys or [])).agg(*aggregates)
