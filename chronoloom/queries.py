"""The driver queries of the temporal operators, with SQL that computes the same results by other means.

Timestamps of the tables have no zone and are taken as UTC. Orders get a time of day from their key, so that both clock changes are met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import civil as C
from chronoloom.functions import strftime as W
from chronoloom.functions import strptime as P
from chronoloom.operators.registry import Registry
from chronoloom.operators.zones import EARLIEST, LATEST, Zone, database, ntz_seconds, zoned
from chronoloom.plans.rules import active, dated, historical
from chronoloom.session import HUGE, METHOD_BYTES
from chronoloom.sources import posix_tz
from chronoloom.streaming.local_time import per_local_day

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ZONES = ["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Lord_Howe", "America/Sao_Paulo", "Africa/Casablanca"]
# Zones of customers by nation number modulo 5; the last two are links.
NATION_ZONES = ["America/New_York", "Europe/Berlin", "Asia/Tokyo", "US/Pacific", "Asia/Calcutta"]
#: Rows that a task formats or parses, about.
TASK_ROWS = 100_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, d: days, t: UTC seconds."""
    t = ntz_seconds(F.col("o_orderdate"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", t.alias("d0"))
    return rows.select("o_orderkey", "o_custkey", C.fdiv(F.col("d0"), 86400).alias("d"), (F.col("d0") + F.col("o_orderkey") * 7919 % 86400).alias("t"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores, and over more tasks where one would get over TASK_ROWS rows or so, for work on narrow rows that takes far longer than to move them.

    Files may make as many tasks as there are cores and have all rows in a few of them, as a row group is never split; so rows are counted. Such work's generated
    methods are long as well: the session gets the limit that session() sets, above which the JVM would only interpret them. Smaller limits stay.
    """
    spark = df.sparkSession
    if int(spark.conf.get(HUGE, "65535")) > METHOD_BYTES:
        spark.conf.set(HUGE, str(METHOD_BYTES))
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)))


O = "(select o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 as d, epoch_us(o_orderdate) // 1000000 + o_orderkey * 7919 % 86400 as t, o_orderdate::date as day from orders)"
LOCAL = "epoch_us(timezone('{0}', to_timestamp(t))) // 1000000"


@query(f"""select o_orderkey, year(day)::bigint as y, month(day)::int as m, day(day)::int as dom, dayofyear(day)::int as doy, dayofweek(day)::int as dow,
  (year(day) % 4 = 0 and (year(day) % 100 <> 0 or year(day) % 400 = 0)) as leap, day(last_day(day))::int as last_dom,
  date_diff('day', date '1970-01-01', date_trunc('year', day)::date)::bigint as boy, date_diff('day', date '1970-01-01', make_date(year(day), 12, 31))::bigint as eoy,
  date_diff('day', date '1970-01-01', date_trunc('month', day)::date)::bigint as bom, date_diff('day', date '1970-01-01', last_day(day))::bigint as eom from {O}""")
def civil_parts(spark, sf_dir):
    d = F.col("d")
    return orders(spark, sf_dir).select(
        "o_orderkey", C.civil_year(d).alias("y"), C.civil_month(d).alias("m"), C.civil_day(d).alias("dom"), C.day_of_year(d).alias("doy"), C.dow_from_days(d).alias("dow"), C.is_leap(C.civil_year(d)).alias("leap"),
        C.last_day_of_month(C.civil_year(d), C.civil_month(d)).alias("last_dom"), C.civil_boy(d).alias("boy"), C.civil_eoy(d).alias("eoy"), C.civil_bom(d).alias("bom"), C.civil_eom(d).alias("eom"),
    )


@query(f"""select o_orderkey, date_diff('day', date '1970-01-01', (date_trunc('month', day) + to_months((o_orderkey % 121 - 60)::int))::date)::bigint + day(day) - 1 as plus_months,
  date_diff('day', date '1970-01-01', make_date(year(day) + (o_orderkey % 9 - 4), month(day), 1))::bigint + day(day) - 1 as plus_years, d as back from {O}""")
def roll_months_years(spark, sf_dir):
    d, k = F.col("d"), F.col("o_orderkey")
    return orders(spark, sf_dir).select("o_orderkey", C.civil_add_months(d, k % 121 - 60).alias("plus_months"), C.civil_add_years(d, k % 9 - 4).alias("plus_years"), C.resolve_civil(C.civil_year(d), C.civil_month(d), C.civil_day(d)).alias("back"))


@query(f"""with x as (select o_orderkey, d, (o_orderkey % 7) as w, dayofweek(day) as dow, last_day(day) as ld from {O})
select o_orderkey, d + (w - dow + 7) % 7 as ge, d - (dow - w + 7) % 7 as le, date_diff('day', date '1970-01-01', ld) - (dayofweek(ld) - w + 7) % 7 as last_dow, ((dow - w + 7) % 7)::int as apart from x""")
def weekdays(spark, sf_dir):
    d, w = F.col("d"), F.col("o_orderkey") % 7
    return orders(spark, sf_dir).select("o_orderkey", C.resolve_dow_ge(d, w).alias("ge"), C.resolve_dow_le(d, w).alias("le"), C.resolve_last_dow(C.civil_year(d), C.civil_month(d), w).alias("last_dow"), C.weekday_difference(C.dow_from_days(d), w).alias("apart"))


@query("""with x as (select event_id, epoch_us(ts) * 1000 - 1704067200000000000 * (event_id % 3) as ns from events)
select event_id, floor(ns / 1000000000.0)::bigint as s, (ns - floor(ns / 1000000000.0)::bigint * 1000000000)::bigint as rest, floor((event_id - 500) / 7.0)::bigint as q from x""")
def floor_split(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    ns = us * 1000 - F.lit(1704067200000000000) * (F.col("event_id") % 3)
    return events.select("event_id", C.ns_to_s(ns).alias("s"), C.rem(ns, 10**9).alias("rest"), C.fdiv(F.col("event_id") - 500, 7).alias("q"))


@query("""select datediff('day', date '1970-01-01', timezone('America/New_York', timezone('UTC', ts))::date)::bigint as local_date, event_type, count(*) as n, round(sum(value), 2) as total
from events group by all""")
def events_by_local_day(spark, sf_dir):
    """The flagship: events by the day in New York."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = Zone("America/New_York").local_date(ntz_seconds(F.col("ts")))
    return events.groupBy(day.alias("local_date"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _locals_sql() -> str:
    local = ", ".join(f"{LOCAL.format(z)} as l{i}, ({LOCAL.format(z)} - t)::int as o{i}" for i, z in enumerate(ZONES))
    return f"select o_orderkey, {local} from {O}"


@query(_locals_sql())
def to_local_zones(spark, sf_dir):
    t = F.col("t")
    zones = [Zone(z) for z in ZONES]
    return orders(spark, sf_dir).select("o_orderkey", *(c for i, z in enumerate(zones) for c in (z.to_local(t).alias(f"l{i}"), z.offset(t).alias(f"o{i}"))))


@query(f"""select {LOCAL.format('America/New_York')} % 86400 // 3600 as hour, count(*) as n from {O} group by all""")
def local_hours(spark, sf_dir):
    hour = C.fdiv(C.rem(Zone("America/New_York").to_local(F.col("t")), 86400), 3600)
    return orders(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


@query(f"""with z(i, name, canonical) as (values (0, 'America/New_York', 'America/New_York'), (1, 'Europe/Berlin', 'Europe/Berlin'), (2, 'Asia/Tokyo', 'Asia/Tokyo'), (3, 'US/Pacific', 'America/Los_Angeles'), (4, 'Asia/Calcutta', 'Asia/Kolkata'))
select o_orderkey, canonical as zone, epoch_us(timezone(canonical, to_timestamp(t))) // 1000000 as local, (epoch_us(timezone(canonical, to_timestamp(t))) // 1000000 - t)::int as off
from {O} o join customer on o_custkey = c_custkey join z on i = c_nationkey % 5""")
def to_local_by_customer(spark, sf_dir):
    """Zones in a column, of which some are links: a broadcast join with the tables of the names in use."""
    name = F.element_at(F.array(*map(F.lit, NATION_ZONES)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), name.alias("zone_name"))
    z = zoned(orders(spark, sf_dir).join(customers, "o_custkey"), "zone_name", zones=NATION_ZONES)
    return z.df.select("o_orderkey", z.name().alias("zone"), z.to_local(F.col("t")).alias("local"), z.offset(F.col("t")).alias("off"))


# American clock changes since 1967 by date arithmetic. Through 1986 they begin on the last Sunday of April (1974 on January 6th, 1975 on February 23rd), through
# 2006 on its first, later on March's second; they end on the last Sunday of October, from 2007 on on November's first. At 2:00 local time.
CHANGES = """(select y, epoch_us(a) // 1000000 + 7 * 3600 as spring, epoch_us(b) // 1000000 + 6 * 3600 as autumn from (
  select y, case when y = 1974 then make_date(1974, 1, 6) when y = 1975 then make_date(1975, 2, 23) when y < 1987 then make_date(y, 4, 30) - dayofweek(make_date(y, 4, 30))::int
      when y < 2007 then make_date(y, 4, 1) + ((7 - dayofweek(make_date(y, 4, 1))) % 7)::int else make_date(y, 3, 8) + ((7 - dayofweek(make_date(y, 3, 8))) % 7)::int end as a,
    case when y < 2007 then make_date(y, 10, 31) - dayofweek(make_date(y, 10, 31))::int else make_date(y, 11, 1) + ((7 - dayofweek(make_date(y, 11, 1))) % 7)::int end as b from range(1967, 2100) r(y)))"""
STEPS = f"(select spring as begin, -14400 as off, 'EDT' as abbr, 60 as save from {CHANGES} union all select autumn, -18000, 'EST', 0 from {CHANGES})"
FIRST, LAST = C.days_of(1967) * 86400, C.days_of(2099) * 86400


@query(f"""with l as (select o_orderkey, t as l from {O}),
x as (select o_orderkey, l, max(case when l >= spring - 18000 and l < spring - 14400 then spring end) as gap, max(case when l >= autumn - 18000 and l < autumn - 14400 then autumn end) as twice,
  max(case when l >= spring - 14400 and l < autumn - 18000 then 1 else 0 end) as summer from l, {CHANGES} group by all)
select o_orderkey, (case when gap is not null then 1 when twice is not null then 2 else 0 end)::int as kind,
  case when gap is not null then gap when twice is not null or summer = 1 then l + 14400 else l + 18000 end as earliest,
  case when gap is not null then gap when summer = 1 then l + 14400 else l + 18000 end as latest,
  case when gap is null and twice is null then case when summer = 1 then l + 14400 else l + 18000 end end as only_unique from x""")
def to_sys_new_york(spark, sf_dir):
    z, t = Zone("America/New_York"), F.col("t")
    rows = orders(spark, sf_dir)
    return rows.select("o_orderkey", z.local_type(t).alias("kind"), z.to_sys(t, EARLIEST).alias("earliest"), z.to_sys(t, LATEST).alias("latest"), z.try_to_sys(t).alias("only_unique"))


@query(f"""with c as (select spring - 18000 + g as l, g from {CHANGES}, range(-3600, 7200, 600) r(g) where y between 1987 and 2006 union all select autumn - 18000 + g, g from {CHANGES}, range(-3600, 7200, 600) r(g) where y between 1987 and 2006),
k as (select l, max(case when l >= spring - 18000 and l < spring - 14400 then 1 when l >= autumn - 18000 and l < autumn - 14400 then 2 else 0 end)::int as kind from c, {CHANGES} group by all)
select kind, count(*) as n, sum(l)::bigint as total from k group by all""")
def gaps_and_overlaps(spark, sf_dir):
    """Every ten minutes around the changes of New York."""
    z = Zone("America/New_York")
    year = F.col("y")
    spring, autumn = C.nth_dow(year, 4, 1, 0) * 86400 + 7200, C.resolve_last_dow(year, 10, 0) * 86400 + 3600
    times = spark.range(1987, 2007).select(F.col("id").alias("y")).select(F.explode(F.array(spring, autumn)).alias("c")).select("c", F.explode(F.sequence(F.lit(-3600), F.lit(6600), F.lit(600))).alias("g")).select((F.col("c") + F.col("g")).alias("l")).distinct()
    return times.groupBy(z.local_type(F.col("l")).alias("kind")).agg(F.count("*").alias("n"), F.sum("l").alias("total"))


@query(f"""with o as (select o_orderkey, t from {O})
select o_orderkey, begin, (select min(begin) from {STEPS} n where n.begin > o.t) as end, off::int as off, save::int as save, abbr from o asof join {STEPS} s on o.t >= s.begin""")
def sys_info_new_york(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return Zone("America/New_York").with_info(rows, F.col("t")).select("o_orderkey", "begin", "end", F.col("offset").alias("off"), "save", F.col("abbrev").alias("abbr"))


@query(f"""with o as (select o_orderkey, t from {O})
select o_orderkey, (select max(begin) from {STEPS} n where n.begin <= o.t) as before, (select min(begin) from {STEPS} n where n.begin > o.t) as after from o""")
def transitions_around(spark, sf_dir):
    z, t = Zone("US/Eastern"), F.col("t")
    return orders(spark, sf_dir).select("o_orderkey", z.previous_transition(t).alias("before"), z.next_transition(t).alias("after"))


@query(f"""with x as (select o_orderkey, to_timestamp(t)::timestamp as s, t from (select o_orderkey, t from {O}))
select o_orderkey, strftime(timezone('UTC', to_timestamp(t)), '%Y-%m-%d %H:%M:%S') as ft, strftime(timezone('UTC', to_timestamp(t)), '%a %b ') || lpad(day(timezone('UTC', to_timestamp(t)))::varchar, 2, ' ') as abe,
  strftime(timezone('UTC', to_timestamp(t)), '%I:%M %p') as imp, strftime(timezone('UTC', to_timestamp(t)), '%j %y %w') as jyw, strftime(timezone('UTC', to_timestamp(t)), '%A, %d %B %Y') as longer,
  isodow(timezone('UTC', to_timestamp(t)))::varchar as u, (year(timezone('UTC', to_timestamp(t))) // 100)::varchar as c, strftime(timezone('UTC', to_timestamp(t)), '%U %W') as weeks,
  isoyear(timezone('UTC', to_timestamp(t)))::varchar || '-W' || lpad(week(timezone('UTC', to_timestamp(t)))::varchar, 2, '0') as iso, 'UTC +00 ' || t::varchar as rest from x""")
def format_utc(spark, sf_dir):
    t = F.col("t")
    formats = {"ft": "%F %T", "abe": "%a %b %e", "imp": "%I:%M %p", "jyw": "%j %y %w", "longer": "%A, %d %B %Y", "u": "%u", "c": "%C", "weeks": "%U %W", "iso": "%G-W%V", "rest": "%Z %z %s"}
    return W.with_formatted(spread(orders(spark, sf_dir)), formats, t).select("o_orderkey", *formats)


@query("""select event_id, strftime(ts, '%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000 // 1000)::varchar, 3, '0') as ms, strftime(ts, '%Y%m%d-%H%M%S') || '.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') || '000' as ns from events""")
def format_fractions(spark, sf_dir):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    s, ns = C.fdiv(us, 1_000_000), C.rem(us, 1_000_000) * 1000
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", W.fmt_local("%T", s, ns, 3).alias("ms"), W.fmt_local("%Y%m%d-%H%M%S", s, ns, 9).alias("ns"))


@query(f"""with o as (select o_orderkey, t from {O})
select o_orderkey, strftime(timezone('UTC', to_timestamp(t + off)), '%Y-%m-%d %H:%M:%S ') || abbr || case when off = -14400 then ' -04' else ' -05' end as text from o asof join {STEPS} s on o.t >= s.begin""")
def format_zoned(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return W.with_formatted(rows, {"text": "%F %T %Z %z"}, F.col("t"), Zone("America/New_York")).select("o_orderkey", "text")


@query(f"select o_orderkey, t as iso, t - t % 60 as twelve, d as ordinal, t + 19800 as east, t as epoch, d * 86400 as named, d as days from {O}")
def parse_times(spark, sf_dir):
    """Texts that formats write, read back."""
    t = F.col("t")
    formats = {"iso": "%F %T", "twelve": "%d/%m/%Y %I:%M %p", "ordinal": "%Y%j", "east": "%FT%T-0530", "epoch": "%s", "named": "%a, %e %b %y %C", "days": "%F"}
    rows = W.with_formatted(spread(orders(spark, sf_dir)), formats, t).select("o_orderkey", *formats)
    for k, f in formats.items():
        rows = P.with_parsed(rows, k, f.replace("-0530", "%z"), F.col(k))
    return rows.select("o_orderkey", *(C.fdiv(F.col(k), 86400).alias(k) if k in ("ordinal", "days") else k for k in formats))


@query("""select event_id, (epoch_us(ts) // 1000000)::bigint as s, (epoch_us(ts) % 1000000 * 1000)::int as ns, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 60000000 as minutes from events""")
def parse_precise(spark, sf_dir):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    text = W.fmt_local("%FT%T", C.fdiv(us, 1_000_000), C.rem(us, 1_000_000) * 1000, 6)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("x"))
    x = F.col("x")
    return rows.select("event_id", P.parse_precise("%FT%T", x).alias("p"), P.parse_ticks("%FT%T", x, 1, 1000).alias("ms"), P.parse_ticks("%FT%T", x, 60).alias("minutes")).select("event_id", F.col("p.seconds").alias("s"), F.col("p.nanos").alias("ns"), "ms", "minutes")


@query("""with x(k, text) as (select o_orderkey, case o_orderkey % 6 when 0 then '2024-02-30' when 1 then '2024-13-01' when 2 then '24-1-1' when 3 then 'x' when 4 then '2024-02' else '2024-02-05 and more' end from orders)
select text, count(*) as n, case text when '2024-02-30' then 19783 when '2024-13-01' then 20089 when '24-1-1' then -710762 when '2024-02-05 and more' then 19758 end::bigint as days from x group by all""")
def parse_lenient(spark, sf_dir):
    """What doesn't fit is null, what rolls over rolls, and what follows the format is ignored."""
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "2024-02-30").when(k == 1, "2024-13-01").when(k == 2, "24-1-1").when(k == 3, "x").when(k == 4, "2024-02").otherwise("2024-02-05 and more")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(text.alias("text")).agg(F.count("*").alias("n")).select("text", "n", P.try_parse_d("%Y-%m-%d", F.col("text")).alias("days"))


@query("""with y as (select y, date_diff('day', date '1970-01-01', make_date(y, 3, 8) + ((7 - dayofweek(make_date(y, 3, 8))) % 7)::int)::bigint as a, date_diff('day', date '1970-01-01', make_date(y, 11, 1) + ((7 - dayofweek(make_date(y, 11, 1))) % 7)::int)::bigint as b from range(2024, 2040) r(y))
select a * 86400 + 7 * 3600 as when, -18000 as stdoff, -14400 as walloff, 'EDT' as abbr from y union all select b * 86400 + 6 * 3600, -18000, -18000, 'EST' from y""")
def posix_states(spark, sf_dir):
    """Changes that a POSIX TZ string gives."""
    tz = posix_tz.parse("EST5EDT,M3.2.0,M11.1.0")
    return spark.createDataFrame(tz.states(C.days_of(2024) * 86400, C.days_of(2040) * 86400), "when long, stdoff int, walloff int, abbr string")


@query("""with n as (select n_nationkey, n_name, case n_nationkey % 5 when 0 then 'America/New_York' when 1 then 'Europe/Berlin' when 2 then 'Asia/Tokyo' when 3 then 'US/Pacific' else 'Nowhere/At_All' end as zone from nation)
select n_name, zone, case zone when 'US/Pacific' then 'America/Los_Angeles' when 'Nowhere/At_All' then null else zone end as canonical from n""")
def locate_zones(spark, sf_dir):
    names = [*NATION_ZONES[:4], "Nowhere/At_All"]
    zone = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return Registry(db=database()).with_canonical(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", zone.alias("zone")), "zone")


@query("""select 1918 as first_year, 2007 as cyclic_year, 87 as n_historical, 2 as n_active""")
def us_rules(spark, sf_dir):
    rules = database().rules["u"]
    return spark.createDataFrame([(min(r.first for r in rules), max(1 + r.last if r.last else r.first for r in rules), len(historical(rules)), len(active(rules)))], "first_year int, cyclic_year int, n_historical int, n_active int")


@query()
def rule_dates(spark, sf_dir):
    rows = [(n, d, r.at.seconds, r.at.clock, r.save, r.letter) for n, rs in database().rules.items() for d, r in dated(rs, 2037)]
    return spark.createDataFrame(rows, "rule string, date int, at_sec int, at_kind string, save int, letter string")


@query()
def zone_table(spark, sf_dir):
    """Periods of all zones through 2037."""
    from chronoloom.plans.periods import zone_periods

    return zone_periods(spark, database()).where(F.col("begin") < C.days_of(2038) * 86400)


@query()
def local_table(spark, sf_dir):
    """Segments of local time of the zones in use."""
    from chronoloom.plans.periods import local_segments

    return local_segments(spark, database(), ZONES)


@query()
def zone_names(spark, sf_dir):
    return Registry(db=database()).names(spark)


@query("""select date_diff('day', date '1970-01-01', timezone('America/New_York', timezone('UTC', ts))::date)::bigint as local_date, count(*) as n from events group by all""")
def stream_local_days(spark, sf_dir):
    """Events as a stream, counted by local day in windows that the watermark closes; the windows' sums by day."""
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("ts"))
    name = f"local_days_{uuid.uuid4().hex}"
    days = per_local_day(stream, "ts", Zone("America/New_York"), [F.count("*").alias("n")])
    run = days.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).groupBy(F.unix_date("local_date").cast("long").alias("local_date")).agg(F.sum("n").alias("n"))


@query("""select event_id, epoch_us(timezone('America/New_York', timezone('UTC', ts))) * 1000 as local_ns, epoch_us(ts) * 1000 as sys_ns from events""")
def nanoseconds(spark, sf_dir):
    """Local nanoseconds in New York, and back from those in Kolkata, where none is skipped or repeated."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    kolkata = Zone("Asia/Kolkata")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", Zone("America/New_York").to_local_ns(us * 1000).alias("local_ns"), kolkata.to_sys_ns(kolkata.to_local_ns(us * 1000)).alias("sys_ns"))


@query(f"""with x as (select y, spring as begin, autumn as until, -14400 as off, 'EDT' as abbr, 60 as save from {CHANGES} union all
  select y, autumn, lead(spring) over (order by y), -18000, 'EST', 0 from {CHANGES}),
l as (select unnest([spring - 18000 - 60, spring - 18000, spring - 14400 - 1, spring - 14400, autumn - 18000 - 1, autumn - 18000, autumn - 14400 - 1, autumn - 14400]) as l, unnest(range(8)) as k, spring, autumn, y from {CHANGES} where y between 1970 and 2090)
select l, (case when k in (1, 2) then 1 when k in (5, 6) then 2 else 0 end)::int as result, a.begin as begin1, a.abbr as abbr1, b.begin as begin2, b.abbr as abbr2, b.save::int as save2
from l join x a on (k in (0, 1, 2) and a.until = l.spring or k in (3, 4, 5, 6) and a.begin = l.spring or k = 7 and a.begin = l.autumn)
left join x b on (k in (1, 2) and b.begin = l.spring or k in (5, 6) and b.begin = l.autumn)""")
def local_info(spark, sf_dir):
    """What is known about local times at the bounds of what is skipped and repeated."""
    y = F.col("y")
    spring = F.when(y == 1974, C.resolve_civil(y, 1, 6)).when(y == 1975, C.resolve_civil(y, 2, 23)).when(y < 1987, C.resolve_last_dow(y, 4, 0)).when(y < 2007, C.nth_dow(y, 4, 1, 0)).otherwise(C.nth_dow(y, 3, 2, 0)) * 86400 + 7200
    autumn = F.when(y < 2007, C.resolve_last_dow(y, 10, 0)).otherwise(C.nth_dow(y, 11, 1, 0)) * 86400 + 3600
    times = spark.range(1970, 2091).select(F.col("id").alias("y")).select(F.explode(F.array(spring - 60, spring, spring + 3599, spring + 3600, autumn - 1, autumn, autumn + 3599, autumn + 3600)).alias("l"))
    rows = Zone("America/New_York").with_local_info(times, F.col("l"))
    return rows.select("l", "result", *(F.col(k)[f].alias(f"{a}{n}") for n, k in ((1, "first"), (2, "second")) for f, a in (("begin", "begin"), ("abbrev", "abbr"))), F.col("second.save").alias("save2"))


# The American rule since 2007 in the years around 2396, by date arithmetic, as times repeat every 400 years.
CYCLE = """(select epoch_us(make_date(y, 3, 8) + ((7 - dayofweek(make_date(y, 3, 8))) % 7)::int) // 1000000 + 7 * 3600 as spring, epoch_us(make_date(y, 11, 1) + ((7 - dayofweek(make_date(y, 11, 1))) % 7)::int) // 1000000 + 6 * 3600 as autumn from range(2380, 2420) r(y))"""


@query(f"""with x as (select o_orderkey, t + 12622780800 as near, t + 12622780800 * (1 + o_orderkey % 1000) as far from {O}),
s as (select o_orderkey, far, max(case when near >= spring and near < autumn then 1 else 0 end) as summer, max(case when spring <= near then spring end) as spring, max(case when autumn <= near then autumn end) as autumn, max(near) as near from x, {CYCLE} group by all)
select o_orderkey, far + case when summer = 1 then -14400 else -18000 end as local, case when summer = 1 then 'EDT' else 'EST' end as abbr, greatest(spring, autumn) + far - near as begin from s""")
def cyclic_times(spark, sf_dir):
    """Times up to 400,000 years ahead."""
    z, t = Zone("America/New_York"), F.col("far")
    rows = orders(spark, sf_dir).select("o_orderkey", (F.col("t") + F.lit(C.CYCLE_SECONDS) * (1 + F.col("o_orderkey") % 1000)).alias("far"))
    return z.with_info(rows, t).select("o_orderkey", z.to_local(t).alias("local"), F.col("abbrev").alias("abbr"), "begin")


@query(f"""select 'America/New_York' as zone, begin, (lead(begin) over (order by begin))::bigint as end, off::int as offset, -18000 as stdoff, (save * 60)::int as save, abbr from {STEPS} where begin < {LAST} + 400 * 86400 qualify begin < {LAST}""")
def periods_new_york(spark, sf_dir):
    """The relation of periods, since 1967."""
    from chronoloom.plans.periods import zone_periods

    rows = zone_periods(spark, database(), ["US/Eastern"])
    return rows.where((F.col("begin") >= FIRST) & (F.col("begin") < LAST)).drop("seq")


@query(f"""with s as (select begin, off, lag(off) over (order by begin) as before from {STEPS}),
g as (select begin, begin + least(off, before) as lbegin, begin + greatest(off, before) as lend, (case when off > before then 1 else 2 end)::int as kind, before::int as off_first, off::int as off_second from s where before is not null)
select 'America/New_York' as zone, lbegin, lend, kind, off_first, off_second, begin as jump from g where begin between {FIRST + 400 * 86400} and {LAST}""")
def segments_new_york(spark, sf_dir):
    """Local time that is skipped or repeated, with its change."""
    from chronoloom.plans.periods import local_segments

    rows = local_segments(spark, database(), ["America/New_York"]).where("kind <> 0")
    return rows.where(F.col("jump").between(FIRST + 400 * 86400, LAST)).select("zone", "lbegin", "lend", "kind", "off_first", "off_second", "jump")


@query(f"""select o_orderkey, s.off::int as off, s.abbr as abbr from {O} o asof join {STEPS} s on o.t >= s.begin""")
def periods_as_of(spark, sf_dir):
    """The relation of periods joined by range: it is small, so it is broadcast."""
    from chronoloom.plans.periods import zone_periods

    p = zone_periods(spark, database(), ["America/New_York"])
    return orders(spark, sf_dir).join(F.broadcast(p), (F.col("t") >= F.col("begin")) & (F.col("t") < F.col("end"))).select("o_orderkey", F.col("offset").alias("off"), "abbr")


@query(f"""with y as (select y, spring, autumn from {CHANGES} where y between 1967 and 2037)
select epoch_us(date_trunc('day', to_timestamp(spring)::timestamp)) // 86400000000 as date, 7200 as at_sec, 'wall' as at_kind, 3600 as save, 'D' as letter from (select epoch_ms(spring * 1000) as x, spring from y)
union all select epoch_us(date_trunc('day', epoch_ms(autumn * 1000))) // 86400000000, 7200, 'wall', 0, 'S' from y""")
def rule_dates_us(spark, sf_dir):
    """When the rules of the United States take effect, since 1967."""
    rows = [(d, r.at.seconds, r.at.clock, r.save, r.letter) for d, r in dated(database().rules["u"], 2037) if d >= C.days_of(1967)]
    return spark.createDataFrame(rows, "date long, at_sec int, at_kind string, save int, letter string")


@query(f"""select begin, off::int as offset, abbr from {STEPS} where begin between {FIRST} and {LAST}""")
def tzif_states(spark, sf_dir):
    """A zone's compiled file, written and read back, continued by its footer."""
    from chronoloom.sources import tzif

    states = tzif.parse(tzif.compiled(database(), "America/New_York", C.days_of(2037) * 86400, "EST5EDT,M3.2.0,M11.1.0")).states_until(LAST)
    return spark.createDataFrame([(b, s.walloff, s.abbr) for b, s in states if b >= FIRST], "begin long, offset int, abbr string")


def _forms_sql() -> str:
    x = "timezone('UTC', to_timestamp(t))"
    padded = lambda e: f"lpad(({e})::varchar, 2, ' ')"
    half = f"case when hour({x}) % 12 = 0 then 12 else hour({x}) % 12 end"
    date, clock = f"strftime({x}, '%m/%d/%y')", f"strftime({x}, '%H:%M:%S')"
    return f"""select o_orderkey, {padded(f'hour({x})')} || '|' || {padded(half)} || '|' || lower(strftime({x}, '%p')) as small, strftime({x}, '%a %b ') || {padded(f'day({x})')} || strftime({x}, ' %H:%M:%S %Y') as c, {date} || ' ' || {date} as d,
  strftime({x}, '%H:%M') as r, {clock} || ' ' || {clock} as x, strftime({x}, '%I:%M:%S %p') as twelve, lpad((isoyear({x}) % 100)::varchar, 2, '0') as g, '%' || chr(10) || chr(9) || '%' as marks from {O}"""


@query(_forms_sql())
def format_rest(spark, sf_dir):
    formats = {"small": "%k|%l|%P", "c": "%c", "d": "%D %x", "r": "%R", "x": "%T %X", "twelve": "%r", "g": "%g", "marks": "%%%n%t%%"}
    return W.with_formatted(orders(spark, sf_dir), formats, F.col("t")).select("o_orderkey", *formats)


@query(f"""select o_orderkey, strftime(timezone('UTC', to_timestamp(t)), '%Y%m%d') as compact, strftime(timezone('UTC', to_timestamp(t)), '%Y%m%d %H%M%S') as time, strftime(timezone('UTC', to_timestamp(t)), '%Y-%m-%d %H:%M:%SZ') as sane, strftime(timezone('UTC', to_timestamp(t)), '%B %A') as names from {O}""")
def fixed_writers(spark, sf_dir):
    d, t = F.col("d"), F.col("t")
    return orders(spark, sf_dir).select("o_orderkey", C.compact_date(d).alias("compact"), C.compact_time(t).alias("time"), C.sane_time(t, "Z").alias("sane"), F.concat_ws(" ", C.month_name(C.civil_month(d)), C.dow_name(C.dow_from_days(d))).alias("names"))


@query(f"""with x as (select o_orderkey, d, t, timezone('UTC', to_timestamp(t)) as x from {O})
select o_orderkey, t as again, d as zero, (year(x) * 10000 + (month(x) - 1) * 100 + day(x) - 1)::bigint as zeros, d * 86400 + 18000 as midnight, (year(x) * 1000 + dayofyear(x) - 1)::bigint as doy from x""")
def civil_rest(spark, sf_dir):
    d, t = F.col("d"), F.col("t")
    s = C.rem(t, 86400)
    zero, doy = C.to_civil0(d), C.to_civil_year_doy(d)
    return orders(spark, sf_dir).select(
        "o_orderkey", C.resolve_civil_time(C.civil_year(d), C.civil_month(d), C.civil_day(d), C.fdiv(s, 3600), C.fdiv(s % 3600, 60), s % 60).alias("again"), C.resolve_civil0(zero["year"], zero["month"], zero["day"]).alias("zero"),
        (zero["year"] * 10000 + zero["month"] * 100 + zero["day"]).cast("long").alias("zeros"), C.sys_seconds(d, -18000).alias("midnight"), (doy["year"] * 1000 + doy["doy"]).cast("long").alias("doy"),
    )


@query(f"""select o_orderkey, t as c, d * 86400 as american, t % 86400 - t % 60 as clock, t as twelve, t - t % 60 as small, t as spaced, t - 43200 as zoned, d * 86400 as weekday from {O}""")
def parse_rest(spark, sf_dir):
    """Texts that Spark's own functions write, read by the remaining specifiers."""
    ntz = F.timestamp_add("SECOND", F.col("t"), F.lit("1970-01-01").cast("timestamp_ntz"))
    form = lambda f: F.date_format(ntz, f)
    texts = {
        "c": ("%c", F.concat(form("EEE MMM "), F.lpad(form("d"), 2, " "), form(" HH:mm:ss yyyy"))), "american": ("%D", form("MM/dd/yy")), "clock": ("%R", form("HH:mm")), "twelve": ("%x %r", form("MM/dd/yy hh:mm:ss a")), "small": ("%A %h %e %Y %l:%M %P", form("EEEE MMMM d yyyy h:mm a")),
        "spaced": ("%Y%n%m%t%d%n%X", F.concat(form("yyyy"), F.lit(" \t "), form("MM"), F.lit("\n"), form("dd"), F.lit("  "), form("HH:mm:ss"))), "zoned": ("%F %T %Z %z", F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit(" Etc/GMT-12 +1200"))),
        "weekday": ("%w%u %F", F.concat((F.dayofweek(ntz) - 1).cast("string"), (F.weekday(ntz) + 1).cast("string"), form(" yyyy-MM-dd"))),
    }
    rows = orders(spark, sf_dir).select("o_orderkey", *(t.alias(k) for k, (_, t) in texts.items()))
    for k, (f, _) in texts.items():
        rows = P.with_parsed(rows, k, f, F.col(k))
    return rows


# Texts that are cut short or run together; what fits is told by their lengths, as fields take what they may.
DIGITS = "left(o_orderkey::varchar || (2024 + o_orderkey % 7)::varchar || (o_orderkey * 37)::varchar, (o_orderkey % 11)::int)"
# Years that begin in March; a month beyond December counts on.
SINCE = "(y - c) * 365 + (y - c) // 4 - (y - c) // 100 + (y - c) // 400 + ((case when m > 2 then m - 3 else m + 9 end) * 153 + 2) // 5 - 719469"


@query(f"""with x as (select o_orderkey, {DIGITS} as x from orders),
p as (select *, left(x, 4)::bigint as y, x[5:6]::bigint as m, case when m <= 2 then 1 else 0 end as c, x[7:8]::bigint as d, x[5:7]::bigint as doy from x where length(x) >= 7),
j as (select o_orderkey, {SINCE} + doy + case when doy = 0 then 1 else 0 end as yj from (select o_orderkey, left(x, 4)::bigint as y, 1 as m, 1 as c, x[5:7]::bigint as doy from x where length(x) >= 5))
select o_orderkey, x, {SINCE} + d as ymd, yj, case when length(x) >= 5 then left(x, 2)::bigint * 3600 + x[3:4]::bigint * 60 + x[5:6]::bigint end as hms, case when length(x) < 7 then 'unexpected end of input' end as said
from x left join p using (o_orderkey, x) left join j using (o_orderkey)""")
def parse_malformed(spark, sf_dir):
    """Digits without marks, of all lengths: a field gives nothing back for the next one to fit."""
    k = F.col("o_orderkey")
    x = F.left(F.concat(k.cast("string"), (2024 + k % 7).cast("string"), (k * 37).cast("string")), (k % 11).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", x.alias("x"))
    t = F.col("x")
    return rows.select("o_orderkey", "x", P.try_parse_d("%Y%m%d", t).alias("ymd"), P.try_parse_d("%Y%j", t).alias("yj"), P.try_parse_s("%H%M%S", t).alias("hms"), P.problem("%Y%m%d", t).alias("said"))


@query("""with v(k, fmt, text, value) as (values (0, '%y %Y %M', '70 2024 05', 1704067500), (1, '%Y %y', '1999 70', 0), (2, '%C %y', '19 71', 31536000), (3, '%y %C', '71 20', 3187296000), (4, '%b %m', 'Mar 01', 0), (5, '%p %H', 'PM 01', 3600), (6, '%H %p', '01 PM', 46800), (7, '%I %I', '01 02', 10800),
  (8, '%Y%n', '2024', null), (9, '%Y%n', '2024 ', 1704067200), (10, '%F%Z', '2024-01-01', null), (11, '%Z%H', 'EST05', null), (12, '%s', '99999999999999999999', null), (13, '%s%%', '5', null), (14, '%z%H', '+053007', 5400), (15, '%z%H', '+05', null), (16, '%S.%H', '5.25.07', 25205), (17, '%B', 'mayor', 10368000))
select v.k, fmt, text, value::bigint as value, count(*) as n from v join orders on o_orderkey % 18 = v.k group by all""")
def parse_order(spark, sf_dir):
    """Fields that say the same take effect in the format's order; fields that may be empty don't stand at the input's end."""
    forms = [("%y %Y %M", "70 2024 05"), ("%Y %y", "1999 70"), ("%C %y", "19 71"), ("%y %C", "71 20"), ("%b %m", "Mar 01"), ("%p %H", "PM 01"), ("%H %p", "01 PM"), ("%I %I", "01 02"), ("%Y%n", "2024"), ("%Y%n", "2024 "), ("%F%Z", "2024-01-01"), ("%Z%H", "EST05"), ("%s", "9" * 20), ("%s%%", "5"), ("%z%H", "+053007"), ("%z%H", "+05"), ("%S.%H", "5.25.07"), ("%B", "mayor")]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_orderkey") % len(forms)).cast("int").alias("k")).agg(F.count("*").alias("n"))
    pick = lambda f: F.element_at(F.array(*map(f, forms)), F.col("k") + 1)
    return rows.select("k", pick(lambda f: F.lit(f[0])).alias("fmt"), pick(lambda f: F.lit(f[1])).alias("text"), F.coalesce(*(F.when(F.col("k") == i, P.try_parse_s(f, F.lit(t))) for i, (f, t) in enumerate(forms))).alias("value"), "n")
