"""Zone operators: UTC to local time and back, offsets, abbreviations, periods.

Instants and local times are 64-bit seconds (nanoseconds where the name says so); utc_seconds() and ntz_seconds() take timestamps there, and
as_ntz() back. Zone(name) makes pure Column expressions for one zone. zoned(df, column) joins the tables of the zones in a column and gives an object with
the same methods; rows whose zone is unknown or null get null results. Nulls give nulls.

Before a zone's first change its first state holds. Beyond its last computed cycle times repeat every 400 years: they are looked up where they repeat, and results keep the time that was asked.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.civil import CYCLE_SECONDS, Number, fdiv, num, rem
from chronoloom.plans.periods import AMBIGUOUS, G, NONEXISTENT, UNIQUE, Table, periods_of_file, table, table_of, tables
from chronoloom.plans.rules import HIGHEST, LOWEST
from chronoloom.sources.tzdb import Database, load

EARLIEST, LATEST = "earliest", "latest"
KINDS = {UNIQUE: "unique", NONEXISTENT: "nonexistent", AMBIGUOUS: "ambiguous"}


class UnknownZone(ValueError):
    """No source has the zone."""


@lru_cache(8)
def database(path: str | None = None) -> Database:
    """The database of a path, by default of the first source there is; read once."""
    return load(path)


def utc_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp, floored."""
    return fdiv(F.unix_micros(ts.cast("timestamp")), 1_000_000)


def ntz_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp without zone, taken as it stands."""
    return fdiv(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts), 1_000_000)


def as_ntz(seconds: Column) -> Column:
    """The timestamp without zone of local seconds, within Spark's years."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))


def cyclic(t: Column, cycle: Column) -> Column:
    """The time in the 400 years from cycle on to which t corresponds."""
    return F.pmod(t - cycle, F.lit(CYCLE_SECONDS)) + cycle


class Lookup:
    """The operators, over columns that hold a zone's arrays."""

    def __init__(self, column, steps: int, lsteps: int):
        self._of, self._steps, self._lsteps = column, steps, lsteps

    def _key(self, t: Column) -> Column:
        return F.when(t > self._of("limit"), cyclic(t, self._of("cycle"))).otherwise(t)

    def _at(self, key: Column, bounds: str, block: str, base: str, steps: int) -> Column:
        """Index of the period that holds key."""
        of = self._of
        if not steps:
            return F.when(key.isNotNull() & of(bounds).isNotNull(), F.lit(0))
        place = F.shiftright(key, G) - of(block)
        start = F.get(of(base), F.least(F.greatest(place, F.lit(0)), F.size(of(base)) - 1).cast("int"))
        # least() and greatest() pass nulls over
        start = F.when(place < 0, F.lit(0)).when(place.isNotNull(), start)
        out = start
        for k in range(1, steps + 1):
            out = out + F.when(key >= F.get(of(bounds), start + k), 1).otherwise(0)
        return out

    def _utc(self, key: Column) -> Column:
        return self._at(key, "begin", "block", "base", self._steps)

    def _local(self, key: Column) -> Column:
        return self._at(key, "lbegin", "lblock", "lbase", self._lsteps)

    def name(self) -> Column:
        return self._of("zone")

    def seq(self, t: Number) -> Column:
        """Place of the period, in zone_periods, to which t corresponds."""
        return self._utc(self._key(num(t)))

    def offset(self, t: Number) -> Column:
        return F.get(self._of("offset"), self.seq(t))

    def stdoff(self, t: Number) -> Column:
        return F.get(self._of("stdoff"), self.seq(t))

    def save(self, t: Number) -> Column:
        return self.offset(t) - self.stdoff(t)

    def abbrev(self, t: Number) -> Column:
        return F.get(self._of("abbr"), self.seq(t))

    def to_local(self, t: Number) -> Column:
        return F.try_add(num(t), self.offset(t).cast("long"))

    def to_local_ns(self, t: Number) -> Column:
        return self.to_local(fdiv(t, 1_000_000_000)) * 1_000_000_000 + rem(t, 1_000_000_000)

    def local_date(self, t: Number) -> Column:
        """Days since the epoch of the local date."""
        return fdiv(self.to_local(t), 86400)

    def _shift(self, t: Column) -> Column:
        return F.when(t > self._of("limit"), t - cyclic(t, self._of("cycle"))).otherwise(F.lit(0).cast("long"))

    def sys_range(self, t: Number) -> Column:
        """struct(begin, end) of the period that holds t; ends of 64 bits where it is open."""
        t = num(t)
        i = self.seq(t)
        begin = F.get(self._of("begin"), i)
        end = F.coalesce(F.get(self._of("begin"), i + 1), F.lit(HIGHEST))
        moved = lambda x: F.when(x.isin(LOWEST, HIGHEST), x).otherwise(x + self._shift(t))
        return F.when(i.isNotNull(), F.struct(moved(begin).alias("begin"), moved(end).alias("end")))

    def get_info(self, t: Number) -> Column:
        """struct(begin, end, offset, save in minutes, abbrev). with_info() does the same over a DataFrame and is faster."""
        t = num(t)
        i = self.seq(t)
        return F.when(i.isNotNull(), self._info(i, self._shift(t)))

    def with_info(self, df: DataFrame, t: Number) -> DataFrame:
        """df with the fields of get_info() as columns begin, end, offset, save and abbrev.

        The lookup is a projection of its own, lest Catalyst repeats it for every field.
        """
        held = df.withColumn("__info_t", num(t)).withColumn("__info_seq", self.seq(F.col("__info_t")))
        return held.withColumns(self._fields(F.col("__info_seq"), self._shift(F.col("__info_t")))).drop("__info_t", "__info_seq")

    def next_transition(self, t: Number) -> Column:
        """The first change after t, or null."""
        end = self.sys_range(t)["end"]
        return F.when(end != HIGHEST, end)

    def previous_transition(self, t: Number) -> Column:
        """The last change at or before t, or null."""
        begin = self.sys_range(t)["begin"]
        return F.when(begin != LOWEST, begin)

    # local time

    def _lkey(self, t: Column) -> Column:
        return self._key(t)

    def _segment(self, local: Column) -> Column:
        return self._local(self._lkey(local))

    def local_type(self, local: Number) -> Column:
        """0 unique, 1 nonexistent, 2 ambiguous."""
        return F.get(self._of("kind"), self._segment(num(local)))

    def local_type_name(self, local: Number) -> Column:
        kind = self.local_type(local)
        return F.when(kind == UNIQUE, KINDS[UNIQUE]).when(kind == NONEXISTENT, KINDS[NONEXISTENT]).when(kind == AMBIGUOUS, KINDS[AMBIGUOUS])

    def to_sys(self, local: Number, choose: str = EARLIEST) -> Column:
        """UTC of a local time: an ambiguous one as chosen, a nonexistent one is the instant of the change."""
        if choose not in (EARLIEST, LATEST):
            raise ValueError(f"choose is {EARLIEST} or {LATEST}, not {choose}")
        local = num(local)
        i = self._segment(local)
        off = F.get(self._of("off_first" if choose == EARLIEST else "off_second"), i).cast("long")
        gap = F.get(self._of("jump"), i) + local - self._lkey(local)
        return F.when(F.get(self._of("kind"), i) == NONEXISTENT, gap).otherwise(F.try_subtract(local, off))

    def to_sys_ns(self, local: Number, choose: str = EARLIEST) -> Column:
        """Nanoseconds; what is below a second counts on from a change as well."""
        return self.to_sys(fdiv(local, 1_000_000_000), choose) * 1_000_000_000 + rem(local, 1_000_000_000)

    def to_sys_strict(self, local: Number) -> Column:
        """UTC of a unique local time; others are errors."""
        kind = self.local_type(local)
        return F.when(kind == AMBIGUOUS, F.raise_error(F.lit("ambiguous local time"))).when(kind == NONEXISTENT, F.raise_error(F.lit("nonexistent local time"))).otherwise(self.to_sys(local))

    def try_to_sys(self, local: Number) -> Column:
        """UTC of a unique local time; null for others."""
        return F.when(self.local_type(local) == UNIQUE, self.to_sys(local))

    def _info(self, i: Column, shift: Column) -> Column:
        return F.struct(*(c.alias(name) for name, c in self._fields(i, shift).items()))

    def _fields(self, i: Column, shift: Column) -> dict[str, Column]:
        of = self._of
        begin, end = F.get(of("begin"), i), F.when(i.isNotNull(), F.coalesce(F.get(of("begin"), i + 1), F.lit(HIGHEST)))
        moved = lambda x: F.when(x.isin(LOWEST, HIGHEST), x).otherwise(x + shift)
        off, std = F.get(of("offset"), i), F.get(of("stdoff"), i)
        return {"begin": moved(begin), "end": moved(end), "offset": off, "save": fdiv(off - std, 60).cast("int"), "abbrev": F.get(of("abbr"), i)}

    def get_local_info(self, local: Number) -> Column:
        """struct(result, first, second): the periods before and after; second is null where local time is unique."""
        local = num(local)
        i, shift = self._segment(local), local - self._lkey(local)
        kind = F.get(self._of("kind"), i)
        first, second = (self._info(F.get(self._of(c), i), shift) for c in ("seq_first", "seq_second"))
        return F.when(kind.isNotNull(), F.struct(kind.alias("result"), first.alias("first"), F.when(kind != UNIQUE, second).alias("second")))

    def with_local_info(self, df: DataFrame, local: Number) -> DataFrame:
        """df with the fields of get_local_info() as columns result, first and second; the lookups are projections of their own."""
        held = df.withColumn("__info_l", num(local)).withColumn("__info_i", self._segment(F.col("__info_l")))
        i, shift = F.col("__info_i"), self._shift(F.col("__info_l"))
        held = held.withColumns({"result": F.get(self._of("kind"), i), "__info_a": F.get(self._of("seq_first"), i), "__info_b": F.get(self._of("seq_second"), i), "__info_shift": shift})
        kind, shift = F.col("result"), F.col("__info_shift")
        first, second = (self._info(F.col(c), shift) for c in ("__info_a", "__info_b"))
        return held.withColumns({"first": F.when(kind.isNotNull(), first), "second": F.when(kind != UNIQUE, second)}).drop("__info_l", "__info_i", "__info_a", "__info_b", "__info_shift")


class Zone(Lookup):
    """The operators for one zone, with the arrays as literals."""

    def __init__(self, name: str, db: Database | None = None, own_table: Table | None = None):
        if own_table is None:
            db = db or database()
            own = db.canonical(name)
            if own is None:
                raise UnknownZone(f"no zone or link {name} in version {db.version}")
            own_table = table(db, own)
        self.table: Table = own_table
        kinds = {"begin": "bigint", "offset": "int", "stdoff": "int", "abbr": "string", "base": "int", "lbegin": "bigint", "kind": "int", "off_first": "int", "off_second": "int", "jump": "bigint", "seq_first": "int", "seq_second": "int", "lbase": "int"}
        kept: dict[str, Column] = {}

        def column(c: str) -> Column:
            if c not in kept:
                value = getattr(self.table, c)
                if c in kinds:
                    kept[c] = F.from_json(F.lit("[" + ",".join(f'"{x}"' if isinstance(x, str) else str(x) for x in value) + "]"), f"array<{kinds[c]}>")
                else:
                    kept[c] = F.lit(value).cast("string" if c == "zone" else "long")
            return kept[c]

        super().__init__(column, self.table.steps, self.table.lsteps)


    @classmethod
    def from_file(cls, raw: bytes, name: str) -> Zone:
        """A zone of a TZif file's bytes."""
        return cls(name, own_table=table_of(periods_of_file(raw, name)))


class Zoned(Lookup):
    """The operators for a column of zone names; df has the joined tables until drop()."""

    def __init__(self, df: DataFrame, steps: int, lsteps: int, prefix: str):
        self.df, self._prefix = df, prefix
        super().__init__(lambda c: F.col(prefix)[c], steps, lsteps)

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(self._prefix)


def zoned(df: DataFrame, column: str, db: Database | None = None, zones: list[str] | None = None, prefix: str = "__zone") -> Zoned:
    """df with the tables of the zones in a column. Names are canonical or links; zones may restrict the tables to those in use.

    The tables are a row for each name of the database at most (some hundreds), so they are broadcast; rows of df never move.
    """
    own, steps, lsteps = tables(df.sparkSession, db or database(), zones)
    own = own.select(F.col("name").alias(f"{prefix}_name"), F.struct(*(c for c in own.columns if c != "name")).alias(prefix))
    return Zoned(df.join(F.broadcast(own), F.col(column) == F.col(f"{prefix}_name"), "left").drop(f"{prefix}_name"), steps, lsteps, prefix)
