"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The setting of the longest generated method in bytes, and the longest that the JVM compiles.
HUGE, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, with _ for the dots.

    Generated methods of over 8,000 bytes of bytecode are never compiled by the JVM, so such plans are split into smaller ones instead.
    """
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", HUGE: str(METHOD_BYTES)} | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()
