"""The SQL surface: the relations as views, and functions for SQL texts.

register() makes the views tz_rules, tz_zone_entries, tz_links, tz_version, tz_names, tz_periods and tz_local_segments; SQL functions of the calendar, as temporary functions, whose bodies
Catalyst inlines; and the table function tz_transitions(zone, first_year, last_year).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from chronoloom.functions.civil import days_of
from chronoloom.operators.registry import Registry
from chronoloom.plans.periods import local_segments, periods, zone_periods

# name, parameters, type, body
FUNCTIONS = [
    ("tz_fdiv", "a bigint, n bigint", "bigint", "a div n - cast(a % n < 0 as bigint)"),
    ("tz_is_leap", "y bigint", "boolean", "y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0)"),
    ("tz_resolve_civil", "y bigint, m bigint, d bigint", "bigint", "(y - cast(m <= 2 as bigint)) * 365 + floor((y - cast(m <= 2 as bigint)) / 4.0bd) - floor((y - cast(m <= 2 as bigint)) / 100.0bd) + floor((y - cast(m <= 2 as bigint)) / 400.0bd) + (if(m > 2, m - 3, m + 9) * 153 + 2) div 5 + d - 719469"),
    ("tz_dow", "d bigint", "int", "cast(pmod(d + 4, 7) as int)"),
    ("tz_civil_year", "d bigint", "bigint", "year(date_from_unix_date(cast(pmod(d, 146097) as int))) + 400 * (d div 146097 - cast(d % 146097 < 0 as bigint))"),
    ("tz_civil_month", "d bigint", "int", "month(date_from_unix_date(cast(pmod(d, 146097) as int)))"),
    ("tz_civil_day", "d bigint", "int", "day(date_from_unix_date(cast(pmod(d, 146097) as int)))"),
    ("tz_offset_text", "o int", "string", "concat(if(o < 0, '-', '+'), lpad(abs(o) div 3600, 2, '0'), if(abs(o) % 3600 <> 0, lpad(abs(o) % 3600 div 60, 2, '0'), ''), if(abs(o) % 60 <> 0, lpad(abs(o) % 60, 2, '0'), ''))"),
]


def register(spark: SparkSession, registry: Registry | None = None, zones: list[str] | None = None) -> Registry:
    """Views and functions in the session; zones restricts the periods to those in use."""
    registry = registry or Registry()
    db = registry.db
    for name, df in registry.relations(spark).items():
        df.createOrReplaceTempView(name)
    registry.names(spark).createOrReplaceTempView("tz_names")
    zone_periods(spark, db, zones).createOrReplaceTempView("tz_periods")
    local_segments(spark, db, zones).createOrReplaceTempView("tz_local_segments")
    for name, args, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")

    @udtf(returnType="zone string, when bigint, offset int, stdoff int, abbr string")
    class Transitions:
        def eval(self, zone: str, first_year: int, last_year: int):
            own = db.canonical(zone) if zone is not None else None
            if own is not None:
                p = periods(db, own)
                for t, s in list(zip(p.begins, p.states, strict=True))[1:]:
                    if days_of(first_year) * 86400 <= t < days_of(last_year + 1) * 86400:
                        yield own, t, s.walloff, s.stdoff, s.abbr

    spark.udtf.register("tz_transitions", Transitions)
    return registry
