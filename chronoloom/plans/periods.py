"""Zone periods as relations, and as arrays for constant-time lookups.

zone_periods() has a row for each period of a zone, a partition of all 64-bit seconds; local_segments() partitions local time and tells where it
is unique, skipped or repeated. Both have at most a thousand-odd rows for each zone, however large the data.

Rows of data don't join those by range. A Table holds, for each zone, the periods' bounds in an array and, for each block of 2**G seconds, the
index of the period at the block's start; a lookup takes the block's index and steps over the few bounds inside the block. The arrays
are literals in an expression for one zone, or a row for each zone that joins by name (a broadcast of at most as many rows as the database has names).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from chronoloom.functions.civil import CYCLE_SECONDS
from chronoloom.plans.rules import HIGHEST, LOWEST, State, cycle_time, states
from chronoloom.sources import posix_tz, tzif
from chronoloom.sources.tzdb import Database

G = 23
UNIQUE, NONEXISTENT, AMBIGUOUS = 0, 1, 2
PERIODS = "zone string, seq int, begin long, end long, offset int, stdoff int, save int, abbr string"
SEGMENTS = "zone string, seq int, lbegin long, lend long, kind int, off_first int, off_second int, jump long, seq_first int, seq_second int"


@dataclass(frozen=True)
class Periods:
    """A zone's periods; beyond cycle + 400 years times repeat, if cycle is not None."""

    zone: str
    begins: list[int]
    states: list[State]
    cycle: int | None

    @property
    def limit(self) -> int:
        """The last instant that is looked up as it is."""
        return HIGHEST if self.cycle is None else self.cycle + CYCLE_SECONDS

    def ends(self) -> list[int]:
        return [*self.begins[1:], HIGHEST]


def periods(db: Database, zone: str) -> Periods:
    """Periods of a canonical zone."""
    entries = db.zones[zone]
    found = states(db, zone)
    forever = isinstance(entries[-1].rule, str) and any(r.last is None for r in db.rules[entries[-1].rule])
    return Periods(zone, [b for b, _ in found], [s for _, s in found], cycle_time(db, entries) if forever else None)


def periods_of_file(raw: bytes, zone: str) -> Periods:
    """Periods of a TZif file, continued by its footer."""
    z = tzif.parse(raw)
    forever = bool(z.footer) and not posix_tz.parse(z.footer).permanent()
    cycle = max(0, (z.times[-1] if z.times else 0) + 2 * 366 * 86400)
    found = z.states_until(cycle + CYCLE_SECONDS + 2 * 366 * 86400) if forever else z.states()
    return Periods(zone, [b for b, _ in found], [s for _, s in found], cycle if forever else None)


def segments(p: Periods) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(lbegin, lend, kind, off_first, off_second, jump, seq_first, seq_second) in order of local time.

    A change of offset from a to b at t makes [t + min, t + max) skipped if b > a, else repeated. Changes must not overlap in local time.
    """
    out: list[tuple] = []
    at = LOWEST
    for i, t in enumerate(p.begins[1:], 1):
        a, b = p.states[i - 1].walloff, p.states[i].walloff
        low, high = t + min(a, b), t + max(a, b)
        if low < at:
            raise ValueError(f"{p.zone}: changes at {t} and before overlap in local time")
        out.append((at, low, UNIQUE, a, a, t, i - 1, i - 1))
        if low < high:
            out.append((low, high, NONEXISTENT if b > a else AMBIGUOUS, a, b, t, i - 1, i))
        at = high
    last = len(p.begins) - 1
    out.append((at, HIGHEST, UNIQUE, p.states[-1].walloff, p.states[-1].walloff, p.begins[-1], last, last))
    return [s for s in out if s[0] < s[1] or s[1] == HIGHEST]


def index(bounds: list[int], g: int = G) -> tuple[int, list[int], int]:
    """(first block, index of the period at the start of each block, most bounds inside a block) of sorted bounds after LOWEST."""
    if len(bounds) < 2:
        return 0, [0], 0
    first, last = bounds[1] >> g, bounds[-1] >> g
    base = [bisect.bisect_right(bounds, b << g) - 1 for b in range(first, last + 2)]
    return first, base, max(y - x for x, y in zip(base, [*base[1:], len(bounds) - 1], strict=True))


@dataclass(frozen=True)
class Table:
    """The arrays of one zone's lookups."""

    zone: str
    cycle: int | None
    limit: int
    begin: list[int]
    offset: list[int]
    stdoff: list[int]
    abbr: list[str]
    block: int
    base: list[int]
    steps: int
    lbegin: list[int]
    kind: list[int]
    off_first: list[int]
    off_second: list[int]
    jump: list[int]
    seq_first: list[int]
    seq_second: list[int]
    lblock: int
    lbase: list[int]
    lsteps: int


def table(db: Database, zone: str) -> Table:
    return table_of(periods(db, zone))


def table_of(p: Periods) -> Table:
    found = segments(p)
    lbegin, _, kind, first, second, jump, seq1, seq2 = (list(x) for x in zip(*found, strict=True))
    return Table(p.zone, p.cycle, p.limit, p.begins, [s.walloff for s in p.states], [s.stdoff for s in p.states], [s.abbr for s in p.states], *index(p.begins), lbegin, kind, first, second, jump, seq1, seq2, *index(lbegin))


TABLE_SCHEMA = (
    "name string, zone string, cycle long, limit long, begin array<long>, offset array<int>, stdoff array<int>, abbr array<string>, block long, base array<int>, "
    "lbegin array<long>, kind array<int>, off_first array<int>, off_second array<int>, jump array<long>, seq_first array<int>, seq_second array<int>, lblock long, lbase array<int>"
)


def names(db: Database) -> list[tuple[str, str]]:
    """(name, canonical zone) of all zones and links."""
    return [(z, z) for z in db.zones] + [(a, c) for a in db.links if a not in db.zones and (c := db.canonical(a))]


def _each(db: Database, rows_of, schema: str, spark: SparkSession, zones: list[str] | None) -> DataFrame:
    """rows_of(zone) for each zone, one task for some zones."""
    wanted = sorted(db.zones if zones is None else {db.canonical(z) or z for z in zones})

    def run(parts):
        for part in parts:
            for zone in part["zone"]:
                yield pd.DataFrame(rows_of(zone), columns=[f.split()[0] for f in schema.split(", ")])

    return spark.createDataFrame([(z,) for z in wanted], "zone string").repartition(max(1, min(16, len(wanted) // 8))).mapInPandas(run, schema)


def zone_periods(spark: SparkSession, db: Database, zones: list[str] | None = None) -> DataFrame:
    """zone, seq, begin, end, offset, stdoff, save, abbr; begin and end of the first and last are the ends of 64 bits."""

    def rows(zone):
        p = periods(db, zone)
        return [(zone, i, b, e, s.walloff, s.stdoff, s.walloff - s.stdoff, s.abbr) for i, (b, e, s) in enumerate(zip(p.begins, p.ends(), p.states, strict=True))]

    return _each(db, rows, PERIODS, spark, zones)


def local_segments(spark: SparkSession, db: Database, zones: list[str] | None = None) -> DataFrame:
    return _each(db, lambda zone: [(zone, i, *s) for i, s in enumerate(segments(periods(db, zone)))], SEGMENTS, spark, zones)


def tables(spark: SparkSession, db: Database, zones: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """(a row of arrays for each name of the zones, most steps in UTC, most steps in local time)."""
    own = {z: table(db, z) for z in ({db.canonical(z) for z in zones} - {None} if zones is not None else db.zones)}
    rows = [(name, t.zone, t.cycle, t.limit, t.begin, t.offset, t.stdoff, t.abbr, t.block, t.base, t.lbegin, t.kind, t.off_first, t.off_second, t.jump, t.seq_first, t.seq_second, t.lblock, t.lbase) for name, z in names(db) if (t := own.get(z))]
    return spark.createDataFrame(rows, TABLE_SCHEMA), max((t.steps for t in own.values()), default=0), max((t.lsteps for t in own.values()), default=0)
