"""Headline queries, timed: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads.

Every query runs once to compile and then RUNS times; its figure is the median. rows_per_sec is the rows of the input over that time. The
kernels compute over a range of instants from 1900 to 2100 as a measure of throughput; those that parse read their texts from Parquet.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from chronoloom.functions import strftime as W
from chronoloom.functions import strptime as P
from chronoloom.operators.zones import Zone, zoned
from chronoloom.queries import NATION_ZONES, QUERIES
from chronoloom.session import session

RUNS = 3
HEADLINE = ["events_by_local_day", "to_local_zones", "to_local_by_customer", "to_sys_new_york", "sys_info_new_york", "format_utc", "format_zoned", "parse_times", "civil_parts", "roll_months_years"]
ROWS = 4_000_000


def kernels(spark):
    """name, rows, DataFrame."""
    t = (F.col("id") * 1577 - 2208988800).alias("t")
    base = spark.range(ROWS).select(t)
    z, c = Zone("America/New_York"), F.col("t")
    names = F.element_at(F.array(*map(F.lit, NATION_ZONES)), (F.pmod(c, F.lit(5)) + 1).cast("int"))
    q = zoned(base.withColumn("zone", names), "zone", zones=NATION_ZONES)
    # texts are written before, so that reading them alone is timed
    folder = tempfile.mkdtemp(prefix="chronoloom-bench-")
    W.with_formatted(spark.range(ROWS).select(t), {"d": "%F", "s": "%F %T"}, c).select("d", "s").write.mode("overwrite").parquet(folder)
    texts = spark.read.parquet(folder)
    return [
        ("kernel_to_local", ROWS, base.select(z.to_local(c).alias("x"))),
        ("kernel_to_sys", ROWS, base.select(z.to_sys(c).alias("x"))),
        ("kernel_to_local_zoned", ROWS, q.df.select(q.to_local(c).alias("x"))),
        ("kernel_format", ROWS // 4, W.with_formatted(spark.range(ROWS // 4).select(t), {"x": "%F %T %Z"}, c, z)),
        ("kernel_parse_date", ROWS, P.with_parsed(texts.select("d"), "x", "%F", F.col("d")).select("x")),
        ("kernel_parse_time", ROWS, P.with_parsed(texts.select("s"), "x", "%F %T", F.col("s")).select("x")),
    ]


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("orders", "events")}
    seconds, rates = {}, {}
    work = [(n, rows["events" if "event" in n else "orders"], QUERIES[n](spark, folder)) for n in HEADLINE] + kernels(spark)
    for name, n, df in work:
        timed(df)
        seconds[name] = round(statistics.median(timed(df) for _ in range(RUNS)), 4)
        rates[name] = round(n / seconds[name])
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
