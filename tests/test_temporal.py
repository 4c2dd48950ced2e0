"""Temporal operators: golden values, and comparison with zoneinfo and with plain calendar arithmetic."""

import datetime as D
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import civil as C
from chronoloom.functions import strftime as W
from chronoloom.functions import strptime as P
from chronoloom.operators.registry import Registry, windows_zones, zone_from_link
from chronoloom.operators.zones import EARLIEST, LATEST, UnknownZone, Zone, database, zoned
from chronoloom.plans import periods, rules
from chronoloom.sources import posix_tz, tzdb, tzif

UTC = D.timezone.utc


def epoch(text):
    return int(D.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()]


# --- calendar


def test_civil_golden(spark):
    rows = [(0, 1970, 1, 1), (-135140, 1600, 1, 1), (-135081, 1600, 2, 29), (10957, 2000, 1, 1), (19782, 2024, 2, 29), (20376, 2025, 10, 15), (-865625, -400, 1, 1)]
    d, c = F.col("d"), C.to_civil(F.col("d"))
    got = values(spark, rows, "d long, y long, m int, n int", c["year"], c["month"], c["day"], C.resolve_civil(F.col("y"), F.col("m"), F.col("n")), C.civil_year(d))
    assert got == [(y, m, n, x, y) for x, y, m, n in rows]


def test_civil_sweep(spark):
    """Every 97th day from 1 to 9999, and far beyond in steps of 400 years."""
    first, last = D.date(1, 1, 1).toordinal() - 719163, D.date(9999, 12, 31).toordinal() - 719163
    d = F.col("id")
    shift = 146097 * 10**9
    cols = [C.civil_year(d), C.civil_month(d), C.civil_day(d), C.day_of_year(d), C.dow_from_days(d), C.civil_boy(d), C.civil_bom(d), C.civil_eom(d), C.civil_eoy(d), C.civil_year(d + shift) - 4 * 10**11, C.resolve_civil(C.civil_year(d), C.civil_month(d), C.civil_day(d))]
    got = spark.range(first, last, 97).select("id", *(c.alias(f"c{i}") for i, c in enumerate(cols))).collect()
    for r in got:
        x = D.date.fromordinal(r[0] + 719163)
        month = x.replace(day=28) + D.timedelta(4) if (x.year, x.month) != (9999, 12) else None
        eom = (month - D.timedelta(month.day)).toordinal() - 719163 if month else last
        want = (x.year, x.month, x.day, x.timetuple().tm_yday, x.isoweekday() % 7, x.replace(month=1, day=1).toordinal() - 719163, x.replace(day=1).toordinal() - 719163, eom, x.replace(month=12, day=31).toordinal() - 719163, x.year, r[0])
        assert tuple(r)[1:] == want


def test_months_roll(spark):
    got = values(spark, [(C.days_of(2025, 1, 31), 1), (C.days_of(2024, 1, 31), 1), (C.days_of(2024, 3, 31), -1), (C.days_of(2024, 5, 15), -60)], "d long, n long", C.civil_add_months(F.col("d"), F.col("n")), C.civil_add_years(F.col("d"), F.lit(1)))
    assert [x[0] for x in got] == [C.days_of(2025, 3, 3), C.days_of(2024, 3, 2), C.days_of(2024, 3, 2), C.days_of(2019, 5, 15)]
    assert values(spark, [(C.days_of(2024, 2, 29),)], "d long", C.civil_add_years(F.col("d"), 1)) == [(C.days_of(2025, 3, 1),)]


def test_weekday_rules(spark):
    got = values(spark, [(1,)], "x int", C.resolve_last_dow(2025, 3, 0), C.resolve_dow_ge(C.resolve_civil(2025, 9, 30), 0), C.resolve_dow_le(C.resolve_civil(2025, 4, 1), 0), C.nth_dow(2025, 11, 1, 0), C.dow_from_civil(2025, 11, 2), C.weekday_difference(1, 3))[0]
    assert got == (C.days_of(2025, 3, 30), C.days_of(2025, 10, 5), C.days_of(2025, 3, 30), C.days_of(2025, 11, 2), 0, 5)


def test_math(spark):
    low = -(2**63) + 1
    assert values(spark, [(-7,), (7,), (low,)], "a long", C.fdiv(F.col("a"), 3), C.rem(F.col("a"), 3)) == [(x // 3, x % 3) for x in (-7, 7, low)]
    assert values(spark, [(-1,), (3697,), (-18000,), (19800,)], "o long", C.shortest_offset(F.col("o"))) == [("-000001",), ("+010137",), ("-05",), ("+0530",)]
    assert [C.necessary_precision(1, n) for n in (1, 10, 1000, 10**9, 3, 7)] == [0, 1, 3, 9, 9, 9] and C.necessary_precision(1, 1, True) == 9 and C.blog2(1023) == 9
    assert values(spark, [(1709301909,)], "t long", C.compact_time(F.col("t")), C.sane_time(F.col("t"), "Z"), C.month_name(3), C.dow_name(0)) == [("20240301 140509", "2024-03-01 14:05:09Z", "March", "Sunday")]


# --- zones


GOLDEN = [
    ("America/New_York", "2025-01-15 12:00:00", "2025-01-15 17:00:00", "2025-01-15 17:00:00", 0),
    ("America/New_York", "2025-07-04 15:30:00", "2025-07-04 19:30:00", "2025-07-04 19:30:00", 0),
    ("America/New_York", "2025-11-02 01:30:00", "2025-11-02 05:30:00", "2025-11-02 06:30:00", 2),
    ("America/New_York", "2025-03-09 02:30:00", "2025-03-09 07:00:00", "2025-03-09 07:00:00", 1),
    ("UTC", "2025-03-09 02:30:00", "2025-03-09 02:30:00", "2025-03-09 02:30:00", 0),
    ("Asia/Kolkata", "2025-01-15 12:00:00", "2025-01-15 06:30:00", "2025-01-15 06:30:00", 0),
]


def test_to_sys_golden(spark):
    df = spark.createDataFrame([(z, epoch(x), epoch(a), epoch(b), k) for z, x, a, b, k in GOLDEN] + [("No/Where", 0, None, None, None), (None, 0, None, None, None)], "z string, l long, a long, b long, k int")
    q = zoned(df, "z", zones=["America/New_York", "UTC", "Asia/Kolkata"])
    got = q.df.select("a", "b", "k", q.to_sys(F.col("l"), EARLIEST).alias("x"), q.to_sys(F.col("l"), LATEST).alias("y"), q.local_type(F.col("l")).alias("t"), q.try_to_sys(F.col("l")).alias("u")).collect()
    assert len(got) == 8
    for r in got:
        assert (r["x"], r["y"], r["t"]) == (r["a"], r["b"], r["k"]) and r["u"] == (r["a"] if r["k"] == 0 else None)


def test_every_second_of_gap_and_overlap(spark):
    z = Zone("America/New_York")
    for text, kind in (("2025-03-09 02:00:00", 1), ("2025-11-02 01:00:00", 2)):
        t = epoch(text)
        got = spark.range(t - 1, t + 3601).groupBy(z.local_type(F.col("id")).alias("k")).agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
        assert {r["k"]: (r["a"], r["b"]) for r in got} == {0: (t - 1, t + 3600), kind: (t, t + 3599)}


def test_strict(spark):
    z = Zone("America/New_York")
    for text in ("2025-03-09 02:30:00", "2025-11-02 01:30:00"):
        with pytest.raises(Exception, match="local time"):
            spark.range(1).select(z.to_sys_strict(F.lit(epoch(text)))).collect()
    with pytest.raises(UnknownZone):
        Zone("Nowhere")


def test_sys_info(spark):
    z = Zone("US/Eastern")
    got = values(spark, [(epoch("2025-11-02 05:59:59"),), (epoch("2025-11-02 06:00:00"),), (epoch("1883-11-18 16:59:59"),)], "t long", z.get_info(F.col("t")), z.name(), z.stdoff(F.col("t")))
    assert tuple(got[0][0]) == (epoch("2025-03-09 07:00:00"), epoch("2025-11-02 06:00:00"), -14400, 60, "EDT") and got[0][1:] == ("America/New_York", -18000)
    assert tuple(got[1][0]) == (epoch("2025-11-02 06:00:00"), epoch("2026-03-08 07:00:00"), -18000, 0, "EST")
    assert got[2][0]["abbrev"] == "LMT" and got[2][0]["begin"] == rules.LOWEST
    none = F.lit(None).cast("long")
    for c in (z.offset(none), z.abbrev(none), z.to_local(none), z.get_info(none), z.local_type(none), z.to_sys(none), z.get_local_info(none)):
        assert spark.range(1).select(c.alias("x")).first()["x"] is None
    rows = spark.createDataFrame([(x,) for x in (epoch("2025-11-02 05:59:59"), epoch("2425-11-02 06:00:00"), rules.LOWEST, None)], "t long").coalesce(1)
    assert all(tuple(r["i"] or (None,) * 5) == tuple(r)[:5] for r in z.with_info(rows, F.col("t")).select("begin", "end", "offset", "save", "abbrev", z.get_info(F.col("t")).alias("i")).collect())
    both = z.with_local_info(rows.withColumn("l", F.try_subtract("t", F.lit(16000))), F.col("l")).select("result", "first", "second", z.get_local_info(F.col("l")).alias("i")).collect()
    assert all(tuple(r["i"] or (None,) * 3) == tuple(r)[:3] for r in both) and both[0]["result"] == 2
    info = values(spark, [(epoch("2025-11-02 01:00:00"),), (epoch("2025-11-02 02:00:00"),)], "l long", z.get_local_info(F.col("l")))
    assert info[0][0]["result"] == 2 and info[0][0]["first"]["abbrev"] == "EDT" and info[0][0]["second"]["abbrev"] == "EST" and info[1][0]["second"] is None


def test_far_times_are_cyclic(spark):
    z, cycle = Zone("Europe/London"), C.CYCLE_SECONDS
    t = epoch("2024-07-01 12:00:00")
    got = values(spark, [(t,), (t + 5 * cycle,), (t + 10**6 * cycle,)], "t long", z.offset(F.col("t")), z.to_sys(z.to_local(F.col("t"))) - F.col("t"), z.sys_range(F.col("t"))["begin"] - F.col("t"))
    assert got[0] == got[1] == got[2]
    ends = values(spark, [(rules.LOWEST,), (rules.HIGHEST,)], "t long", Zone("UTC").to_local(F.col("t")), Zone("Europe/Amsterdam").abbrev(F.col("t")))
    assert ends[0][0] == rules.LOWEST and ends[1][0] == rules.HIGHEST and ends[0][1] == "LMT"


def test_nanoseconds(spark):
    z = Zone("America/New_York")
    t = epoch("2025-07-04 19:30:00") * 10**9 + 5
    assert values(spark, [(t,), (-1,)], "t long", z.to_local_ns(F.col("t")), z.to_sys_ns(z.to_local_ns(F.col("t")))) == [(t - 4 * 3600 * 10**9, t), (-1 - 5 * 3600 * 10**9, -1)]


def test_all_zones_agree_with_compiled_files():
    """Every period of every zone from 1800 to 2100 against the tzdata package, where it has the same version."""
    import tzdata

    db = database()
    if f"version {db.version}" not in open(f"{tzdata.__path__[0]}/zoneinfo/tzdata.zi").readline():
        pytest.skip("another version")
    zoneinfo.reset_tzpath(to=[])
    zoneinfo.ZoneInfo.clear_cache()
    r = random.Random(1)
    for zone in db.zones:
        own, found = zoneinfo.ZoneInfo(zone), rules.states(db, zone)
        begins = [b for b, _ in found]
        times = {x + k for x in begins[1:] if -5e9 < x < 4.1e9 for k in (-1, 0)} | {r.randint(-5 * 10**9, 4 * 10**9) for _ in range(30)}
        i, ordered = 0, sorted(times)
        for t in ordered:
            while i + 1 < len(begins) and begins[i + 1] <= t:
                i += 1
            at = (D.datetime(1970, 1, 1, tzinfo=UTC) + D.timedelta(seconds=t)).astimezone(own)
            assert (at.utcoffset().total_seconds(), at.tzname()) == (found[i][1].walloff, found[i][1].abbr), (zone, t)
    zoneinfo.reset_tzpath()


def test_lookup_equals_periods(spark):
    """The block index against the periods themselves, random instants of all zones."""
    db, r = database(), random.Random(2)
    names = sorted(db.zones)
    rows = [(z, r.randint(epoch("1850-01-01"), epoch("2300-01-01"))) for z in names for _ in range(20)]
    q = zoned(spark.createDataFrame(rows, "z string, t long"), "z")
    got = {(x["z"], x["t"]): tuple(x)[2:] for x in q.df.select("z", "t", q.offset(F.col("t")).alias("o"), q.abbrev(F.col("t")).alias("a"), q.to_sys(q.to_local(F.col("t")), LATEST).alias("s")).collect()}
    for z in names:
        p = periods.periods(db, z)
        for t in {t for n, t in rows if n == z}:
            i = max(k for k, b in enumerate(p.begins) if b <= t)
            assert got[z, t][:2] == (p.states[i].walloff, p.states[i].abbr)
            assert got[z, t][2] >= t


def test_relations_partition_time(spark):
    for df, a, b in ((periods.zone_periods(spark, database(), ["US/Eastern", "Africa/Casablanca"]), "begin", "end"), (periods.local_segments(spark, database(), ["US/Eastern", "Asia/Tokyo"]), "lbegin", "lend")):
        rows = sorted(df.collect(), key=lambda r: (r["zone"], r["seq"]))
        for x, y in zip(rows, rows[1:]):
            assert x[b] == y[a] if x["zone"] == y["zone"] else x[b] == rules.HIGHEST and y[a] == rules.LOWEST


# --- registry


def test_registry(spark, monkeypatch):
    reg = Registry()
    assert reg.locate("US/Eastern").table.zone == "America/New_York" and reg.try_locate("Nope") is None and "Factory" in reg.zones() and reg.loaded
    with pytest.raises(RuntimeError):
        reg.set_install("/x")
    monkeypatch.setenv("CHRONOLOOM_TZ", "Asia/Tokyo")
    assert reg.current_name() == "Asia/Tokyo"
    reg.set_current_zone("Europe/Berlin")
    other = reg.reload()
    assert other is not reg and not other.loaded and reg.loaded
    assert reg.current_zone().table.zone == "Europe/Berlin" and reg.reload_current_zone() == "Asia/Tokyo"
    assert zone_from_link("/usr/share/zoneinfo/America/New_York") == "America/New_York" and zone_from_link("../x/Europe/Paris") == "Europe/Paris" and zone_from_link("/etc/x") is None
    assert windows_zones('<s><mapZone other="Eastern Standard Time" type="America/New_York America/Detroit"/><mapZone other="Eastern Standard Time" type="X"/></s>') == {"Eastern Standard Time": "America/New_York"}
    df = spark.createDataFrame([("GB",), ("Nope",), (None,)], "z string")
    assert [r["canonical"] for r in reg.with_canonical(df, "z").collect()] == ["Europe/London", None, None]
    with pytest.raises(Exception, match="unknown zone"):
        reg.with_canonical(df, "z", strict=True).collect()


def test_sql(spark):
    from chronoloom import sqlapi

    sqlapi.register(spark, zones=["America/New_York"])
    assert spark.sql("select tz_resolve_civil(2024, 2, 29) a, tz_fdiv(-7, 2) b, tz_offset_text(-19800) c, tz_civil_year(-719529) y, tz_dow(0) d").first() == (19782, -4, "-0530", -1, 4)
    assert spark.sql("select count(*) n from tz_transitions('US/Eastern', 2020, 2024)").first()["n"] == 10
    assert spark.sql("select canonical from tz_links where alias = 'GB'").first()[0] == "Europe/London" and spark.table("tz_rules").count() > 1900


# --- sources

SNIPPET = """# version test1
Rule  US 1918 1919 - Mar lastSun 2:00 1:00 D # comment
R US 1967 o - O lastSu 2 0 S
Z Here -5:50:36 - LMT 1883 N 18 17u
 -5 US E%sT
L Here There
"""


def test_tzdb_text():
    db = tzdb.parse(SNIPPET)
    assert db.version == "test1" and len(db.rules["US"]) == 2 and db.canonical("There") == "Here" and len(db.zones["Here"]) == 2
    assert db.rules["US"][0].on.resolve(1918, 3) == C.days_of(1918, 3, 31) and db.zones["Here"][0].stdoff == -21036
    for text, line in (("R a 1 2 - Xyz 1 0 0 -", 1), ("\nZ A 1 - X 2000 Jan 40", 2), ("Q", 1), ("L a", 1)):
        with pytest.raises(tzdb.TzdbError) as e:
            tzdb.parse(text)
        assert e.value.line == line
    assert [rules.abbreviation(*x) for x in (("E%sT", "D", 0, 3600), ("A/B", "", 0, 3600), ("%z", "", 0, 3697), ("LMT", "", 0, 0))] == ["EDT", "B", "+010137", "LMT"]


def test_us_rules():
    us = database().rules["u"]
    assert (min(r.first for r in us), rules.cyclic_year(us), len(rules.historical(us)), len(rules.active(us))) == (1918, 2007, 87, 2)


@pytest.mark.parametrize(
    ("text", "abbr", "off1", "off2", "start", "end"),
    [
        ("KST-9", "KST", 32400, 0, None, None),
        ("<-03>3", "-03", -10800, 0, None, None),
        ("EST5EDT,M3.2.0,M11.1.0", "EST", -18000, -14400, "2025-03-09 07:00:00", "2025-11-02 06:00:00"),
        ("<-02>2<-01>,M3.5.0/-1,M10.5.0/0", "-02", -7200, -3600, "2025-03-30 01:00:00", "2025-10-26 01:00:00"),
        ("EET-2EEST,M3.4.4/50,M10.4.4/50", "EET", 7200, 10800, "2025-03-29 00:00:00", "2025-10-24 23:00:00"),
        ("<+1030>-10:30<+11>-11,M10.1.0,M4.1.0", "+1030", 37800, 39600, "2025-10-04 15:30:00", "2025-04-05 15:00:00"),
    ],
)
def test_posix(text, abbr, off1, off2, start, end):
    tz = posix_tz.parse(text)
    assert (tz.abbr1, tz.off1, tz.off2) == (abbr, off1, off2)
    if start:
        assert (tz.starts(2025), tz.stops(2025)) == (epoch(start), epoch(end))
    else:
        assert tz.states(0, 10**9) == []


def test_posix_states():
    ny = posix_tz.parse("EST5EDT,M3.2.0,M11.1.0")
    assert len(ny.states(epoch("2024-01-01"), epoch("2026-01-01"))) == 4 and len(ny.states(epoch("2024-01-01"), epoch("2024-07-01"))) == 1
    assert posix_tz.parse("XXX-2<+01>-1,0/0,J365/23").permanent()
    with pytest.raises(posix_tz.PosixError):
        posix_tz.parse("12")


def test_tzif(spark, tmp_path, monkeypatch):
    import tzdata

    folder = f"{tzdata.__path__[0]}/zoneinfo/America"
    files = tzif.files(spark, f"file://{folder}/New_York")
    assert tzif.parse(tzif.compiled(database(), "America/New_York", epoch("2037-01-01"), "EST5EDT,M3.2.0,M11.1.0")).states_until(epoch("2050-01-01")) == [(b, s) for b, s in rules.states(database(), "America/New_York") if b < epoch("2050-01-01")]
    head = tzif.headers(files).first()
    assert head["footer"] == "EST5EDT,M3.2.0,M11.1.0" and head["version"] >= 2 and tzif.transitions(files).count() == head["timecnt"] and tzif.types(files).count() == head["typecnt"] and tzif.leap_seconds(files).count() == 0
    for zone in ("New_York", "Sao_Paulo", "St_Johns"):
        z = tzif.parse(open(f"{folder}/{zone}", "rb").read())
        mine = [(b, s.walloff, s.abbr) for b, s in rules.states(database(), f"America/{zone}") if b < epoch("2060-01-01")]
        theirs = [(b, s.walloff, s.abbr) for b, s in z.states_until(epoch("2060-01-01"))]
        merged = lambda xs: [x for i, x in enumerate(xs) if i == 0 or x[1:] != xs[i - 1][1:]]
        assert merged(mine) == merged(theirs)
    file = Zone.from_file(open(f"{folder}/New_York", "rb").read(), "Mine")
    text, t = Zone("America/New_York"), F.col("id")
    same = lambda f: (f(file) == f(text))
    times = spark.range(epoch("1800-01-01"), epoch("2900-01-01"), 7 * 86400 + 1801)
    assert times.where(~(same(lambda z: z.offset(t)) & same(lambda z: z.abbrev(t)) & same(lambda z: z.to_sys(t)))).count() == 0
    (tmp_path / "My").mkdir()
    (tmp_path / "My" / "Zone").write_bytes(open(f"{folder}/New_York", "rb").read())
    monkeypatch.setenv("TZDIR", str(tmp_path))
    assert Registry().locate("My/Zone").table.zone == "My/Zone" and Registry().try_locate("My/Nothing") is None
    with pytest.raises(tzif.TzifError):
        tzif.parse(b"nothing")


# --- formats

TIMES = [0, 86399, 946684800, 1234567890, 1709303109, 32503680000, -62135596800, -1, 951782400, 1704067199, 1735689600, 253402300799]
FORMATS = "%Y|%y|%m|%b|%B|%d|%e|%j|%a|%A|%w|%u|%H|%k|%I|%l|%p|%P|%M|%S|%R|%T|%r|%F|%D|%c|%U|%W|%V|%G|%g|a%%b%n%t".split("|")


def test_format_against_python(spark):
    got = spark.createDataFrame([(t,) for t in TIMES], "t long").coalesce(1)
    got = W.with_formatted(got, {f"f{i}": f for i, f in enumerate(FORMATS)}, F.col("t")).collect()
    for r in got:
        at = D.datetime(1970, 1, 1, tzinfo=UTC) + D.timedelta(seconds=r["t"])
        for i, f in enumerate(FORMATS):
            if at.year >= 1000 or f not in ("%Y", "%F", "%G", "%c"):
                assert r[f"f{i}"] == at.strftime(f), (f, r["t"])


def test_format_golden(spark):
    z = Zone("America/New_York")
    got = spark.range(1).select(
        W.fmt_utc("%Y-%m-%d", F.lit(-62184499200)).alias("a"), W.fmt_utc("%F %T", F.lit(253402300800)).alias("b"), W.fmt_utc("%r", F.lit(1709301909), F.lit(123456789), 3).alias("c"), W.fmt_utc("%c|%s", F.lit(1709301909), F.lit(999999999), 3).alias("d"),
        W.fmt_zoned("%F %T %Z %z", z, F.lit(1762442685)).alias("e"), W.fmt_local("%Z%z%", F.lit(0)).alias("f"), W.fmt_utc("%z %Z %C", F.lit(0)).alias("g"), W.fmt_days("%D", F.lit(-1)).alias("h"), W.fmt_utc("", F.lit(0)).alias("i"), W.fmt_to(W.fmt_utc("%F", F.lit(0)), 4).alias("j"), W.preset("rfc-email", z, F.lit(0)).alias("k"), W.fmt_utc("%F", F.lit(None).cast("long")).alias("l"),
    ).first()
    assert tuple(got)[:9] == ("-1-06-15", "10000-01-01 00:00:00", "02:05:09.123 PM", "Fri Mar  1 14:05:09.999 2024|1709301909.999", "2025-11-06 10:24:45 EST -05", "-00-00%", "+00 UTC 19", "12/31/69", "")
    assert tuple(got["j"]) == ("1970", 4) and got["k"] == "Wed, 31 Dec 1969 19:00:00 -05" and got["l"] is None
    for bad in ("%Q", "x" * 128):
        with pytest.raises(W.FormatError):
            W.parts(bad) if len(bad) > 9 else W.fmt_utc(bad, F.lit(0))


PARSED = [
    ("%Y-%m-%d", "2024-02-30", 19783 * 86400), ("%F %T", "2024-03-01 14:05:09.5xyz", 1709301909), ("%y%j", "69001", -31536000), ("%y", "68", 3092601600), ("%d/%m/%y %I:%M %p", "01/03/24 02:05 PM", 1709301900), ("%F %H:%M%z", "2024-03-01 14:05-0530", 1709321700),
    ("%H:%M%z", "14:05-05", 68700), ("%b %e %Y", "mARCH  1 2024", 1709251200), ("%s", "-86400.25", -86400), ("%H %p", "15 PM", 97200), ("%C%y", "1999", 915148800), ("%F", "nope", None), ("%Y%m%d", "20240301", 1709251200), ("%m-%Y", "13-2024", 1735689600), ("%Y-%j", "2024-000", 1704067200), ("%A, %d %b %Y %Z", "Friday, 01 Mar 2024 EST", 1709251200),
    ("%d", " 5", 345600), ("%M", " 5", None), ("%n%t%%%Y", " \t%1970", 0), ("", "anything", 0), ("%H", "99", 356400), ("%c", "Fri Mar  1 14:05:09 2024", 1709301909), ("%D", "03/01/24", 1709251200), ("%Y", "", None),
]


@pytest.mark.parametrize(("fmt", "text", "want"), PARSED)
def test_parse(spark, fmt, text, want):
    got = spark.createDataFrame([(text,), (None,)], "x string").coalesce(1).select(P.try_parse_s(fmt, F.col("x")).alias("v"), P.problem(fmt, F.col("x")).alias("p")).collect()
    assert got[0]["v"] == want and (got[0]["p"] is None) == (want is not None) and got[1]["v"] is None


def plainly_read(fmt, text):
    """Fields as they come, character by character; None where the text doesn't fit."""
    at, year, month, day, doy, clock = 0, 1970, 1, 1, 0, {"H": 0, "M": 0, "S": 0}

    def digits(most, padded=False):
        nonlocal at
        if padded and text[at : at + 1] == " ":
            at, most = at + 1, 1
        start = at
        while at < len(text) and at - start < most and text[at] in "0123456789":
            at += 1
        if at == start:
            raise ValueError
        return int(text[start:at])

    try:
        for piece in fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").split("%"):
            c, rest = piece[:1], piece[1:]
            match c:
                case "Y":
                    year = digits(4)
                case "y":
                    year = digits(2)
                    year += 2000 if year < 69 else 1900
                case "m":
                    month = digits(2, True)
                case "d":
                    day = digits(2, True)
                case "j":
                    doy = digits(3)
                case "H":
                    clock["H"] = digits(2, True)
                case "M":
                    clock["M"] = digits(2)
                case "S":
                    clock["S"] = digits(2)
                    if text[at : at + 1] == "." and text[at + 1 : at + 2].isdigit():
                        at += 1
                        digits(9)
            for x in rest if c else piece:
                if text[at : at + 1] != x:
                    raise ValueError
                at += 1
    except ValueError:
        return None, at
    days = C.days_of(year, 1, 1) + doy - 1 if doy else C.days_of(year, month, 1) + day - 1
    return days * 86400 + clock["H"] * 3600 + clock["M"] * 60 + clock["S"], at


def test_parse_against_plain_reading(spark):
    """Random short texts: fields give nothing back, filled fields and others agree, and errors name their place."""
    r = random.Random(5)
    formats = ["%Y%m%d", "%Y%j", "%F", "%F %T", "%H%M%S", "%y%m", "%d.%m.%Y", "%Y-%j", "%T"]
    rows = []
    for f in formats:
        for _ in range(150):
            filled = f.replace("%F", "2024-0%d-1%d" % (r.randint(1, 9), r.randint(0, 9))).replace("%T", "1%d:0%d:59" % (r.randint(0, 9), r.randint(0, 9)))
            for c, n in {"Y": 4, "y": 2, "m": 1, "d": 2, "j": 3, "H": 2, "M": 2, "S": 2}.items():
                filled = filled.replace(f"%{c}", "".join(r.choice("0123456789" if c != "m" else "123456789") for _ in range(n)))
            text = list(filled)
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(text) + 1)
                text[at : at + r.randint(0, 1)] = r.choice(["", " ", "+", "-", ".", "7", "x", "\x01"])
            rows.append((f, "".join(text)))
    df = spark.createDataFrame(rows, "f string, x string").coalesce(1)
    for f in formats:
        some = df.where(F.col("f") == f)
        quick = P.with_parsed(some.select("x", P.try_parse_s(f, F.col("x")).alias("v"), P.place(f, F.col("x")).alias("p")), "w", f, F.col("x"), strict=False)
        for row in quick.collect():
            want, at = plainly_read(f, row["x"])
            assert row["v"] == row["w"] == want and row["p"] == at, (f, row["x"], row["v"], row["w"], want, row["p"], at)


def test_errors_name_their_place(spark):
    df = spark.createDataFrame([("2024x",)], "x string")
    with pytest.raises(Exception, match=r"input\[4\] \(char='x'\)"):
        df.select(P.parse_s("%F", F.col("x"))).collect()
    with pytest.raises(Exception, match="doesn't fit"):
        P.with_parsed(df, "v", "%F", F.col("x")).collect()


def test_parse_strict_and_ticks(spark):
    with pytest.raises(Exception, match="doesn't fit"):
        spark.range(1).select(P.parse_s("%F", F.lit("x"))).collect()
    got = spark.range(1).select(P.parse_ticks("%s", F.lit("7.5"), 1, 7).alias("a"), P.parse_ticks("%s", F.lit("-7"), 60).alias("b"), P.parse_ns("%F %T", F.lit("1970-01-02 00:00:00.123")).alias("c"), P.parse_d("%F", F.lit("1969-12-31")).alias("d"), P.parse_precise("%s", F.lit("100.123456789")).alias("e"), P.try_parse_ns("%Y", F.lit("9999")).alias("f")).first()
    assert tuple(got)[:4] == (52, -1, 86400123000000, -1) and tuple(got["e"]) == (100, 123456789) and got["f"] is None
    with pytest.raises(P.FormatError):
        P.compile_format("%Q")


def test_round_trip(spark):
    times = [t for t in TIMES if 0 <= t < 253402300800]
    df = spark.createDataFrame([(t,) for t in times], "t long").coalesce(1)
    formats = {"a": "%F %T", "b": "%d %B %Y %I:%M:%S %p", "c": "%Y%j%H%M%S", "d": "%c", "e": "%FT%T%z", "f": "%s"}
    df = W.with_formatted(df, formats, F.col("t"))
    for k, f in formats.items():
        df = P.with_parsed(df, k, f, F.col(k))
    assert all(r[k] == r["t"] for r in df.collect() for k in formats)


# --- streams and plans


def test_stream_equals_batch(spark, tmp_path):
    from chronoloom.streaming.local_time import per_local_day, with_local

    z = Zone("America/New_York")
    rows = spark.range(0, 4000).select(F.timestamp_seconds(F.lit(epoch("2024-03-09 00:00:00")) + F.col("id") * 61).alias("ts"))
    rows.coalesce(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = per_local_day(stream, "ts", z, [F.count("*").alias("n")]).writeStream.outputMode("complete").format("memory").queryName("per_day").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted(map(tuple, df.groupBy("local_date").agg(F.sum("n")).collect()))
    assert key(spark.table("per_day")) == key(per_local_day(rows, "ts", z, [F.count("*").alias("n")]))
    assert with_local(rows, "ts", z).where("local_ts >= timestamp_ntz'2024-03-10 02:00:00' and local_ts < timestamp_ntz'2024-03-10 03:00:00'").count() == 0


def test_plan_has_no_shuffle_or_python(spark):
    q = zoned(spark.range(10).select(F.when(F.col("id") % 2 == 0, "US/Eastern").otherwise("UTC").alias("z"), "id"), "z", zones=["US/Eastern", "UTC"])
    plan = q.df.select(q.to_local(F.col("id")).alias("l"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


def test_long_work_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A file of one row group makes many tasks, of which one has all rows; and tasks don't grow with the table."""
    from chronoloom import queries

    spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("o_orderdate")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1", "spark.sql.codegen.hugeMethodLimit": "65535"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = queries.orders(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        largest = lambda: max(r["count"] for r in queries.spread(rows).groupBy(F.spark_partition_id()).count().collect())
        assert largest() <= 2000 / spark.sparkContext.defaultParallelism + 20
        monkeypatch.setattr(queries, "TASK_ROWS", 100, raising=False)
        assert largest() <= 120
        # longer methods would only be interpreted
        queries.parse_times(spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "4000")
        assert queries.parse_times(spark, str(tmp_path)).count() == 2000
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_queries_match_their_sql(spark):
    """All temporal queries over the smallest tables, against DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from chronoloom.queries import ORACLES, QUERIES

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in data.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, str(data))
        cols = sorted(got.columns)
        want = con.sql(sql)
        assert cols == sorted(want.columns), name
        text = lambda rows: sorted(map(repr, rows))
        assert text(map(tuple, got.select(*cols).collect())) == text(con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql}) x").fetchall()), name
