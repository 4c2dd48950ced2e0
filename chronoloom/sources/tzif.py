"""TZif files: a scan of compiled zone files as DataFrames, one row for each file, transition, type or leap second.

Files are read by Spark's binaryFile source, so any store that Spark reads will do, and are parsed where they are read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans.rules import LOWEST, State
from chronoloom.sources import posix_tz

YEARS_402 = 402 * 31_556_952


class TzifError(ValueError):
    """Bytes that are no TZif file."""


@dataclass
class Tzif:
    version: int
    times: list[int] = field(default_factory=list)
    index: list[int] = field(default_factory=list)
    #: utoff, isdst, abbreviation
    types: list[tuple[int, bool, str]] = field(default_factory=list)
    #: instant, count so far
    leaps: list[tuple[int, int]] = field(default_factory=list)
    isstd: list[bool] = field(default_factory=list)
    isut: list[bool] = field(default_factory=list)
    footer: str = ""
    counts: tuple[int, ...] = ()

    def leap(self, t: int) -> int:
        """Leap seconds before t."""
        count = 0
        for when, n in self.leaps:
            if when <= t:
                count = n
        return count

    def states(self) -> list[tuple[int, State]]:
        """(begin, state) of the file's periods, leap seconds removed, each different from the one before; the first begins at LOWEST.

        A file tells whether a type saves, not how much: a standard type sets the standard offset, a saving one keeps it, or is an hour off it where both agree.
        """
        first = next((i for i, t in enumerate(self.types) if not t[1]), 0)
        if self.index and not any(i == 0 for i in self.index):
            first = 0
        out: list[tuple[int, State]] = []
        std = None
        for t, i in [(LOWEST, first), *zip(self.times, self.index, strict=True)]:
            off, saves, abbr = self.types[i]
            std = off if not saves else off - 3600 if std is None or std == off else std
            state = State(std, off, abbr)
            if not out or out[-1][1] != state:
                out.append((t if t == LOWEST else t - self.leap(t), state))
        return out

    def states_until(self, end: int) -> list[tuple[int, State]]:
        """states(), continued by the footer's rule."""
        out = self.states()
        if self.footer:
            for t, std, off, abbr in posix_tz.parse(self.footer).states(out[-1][0] if len(out) > 1 else -(1 << 40), end):
                if out[-1][1] != (state := State(std, off, abbr)):
                    out.append((t, state))
        return out


def _header(raw: bytes, at: int) -> tuple[int, tuple[int, ...]]:
    if len(raw) < at + 44 or raw[at : at + 4] != b"TZif":
        raise TzifError("no TZif header")
    version = raw[at + 4]
    return (1 if version == 0 else version - 48), struct.unpack_from(">6I", raw, at + 20)


def _size(counts: tuple[int, ...], width: int) -> int:
    isut, isstd, leap, time, kinds, chars = counts
    return time * width + time + kinds * 6 + chars + leap * (width + 4) + isstd + isut


def parse(raw: bytes) -> Tzif:
    """The file's widest body, and its footer."""
    version, counts = _header(raw, 0)
    at, width = 44, 4
    if version >= 2:
        at += _size(counts, 4)
        _, counts = _header(raw, at)
        at, width = at + 44, 8
    if len(raw) < at + _size(counts, width):
        raise TzifError("the file ends early")
    isut, isstd, leap, time, kinds, chars = counts
    out = Tzif(version, counts=counts)
    code = "q" if width == 8 else "i"
    out.times = list(struct.unpack_from(f">{time}{code}", raw, at))
    at += time * width
    out.index = list(raw[at : at + time])
    at += time
    names = raw[at + kinds * 6 : at + kinds * 6 + chars]
    for k in range(kinds):
        off, dst, name = struct.unpack_from(">iBB", raw, at + 6 * k)
        out.types.append((off, bool(dst), names[name : names.index(b"\0", name)].decode()))
    at += kinds * 6 + chars
    out.leaps = [struct.unpack_from(f">{code}i", raw, at + k * (width + 4)) for k in range(leap)]
    at += leap * (width + 4)
    out.isstd = [bool(x) for x in raw[at : at + isstd]]
    out.isut = [bool(x) for x in raw[at + isstd : at + isstd + isut]]
    at += isstd + isut
    if version >= 2 and raw[at : at + 1] == b"\n":
        out.footer = raw[at + 1 : raw.index(b"\n", at + 1)].decode()
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the TZif files at or below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length >= 44 and substring(content, 1, 4) = X'545a6966'").select("path", "content")


def _scan(source: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts):
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(path, *r) for r in rows_of(parse(content))], columns=names)

    return source.mapInPandas(run, schema)


def headers(source: DataFrame) -> DataFrame:
    return _scan(source, "path string, version int, isutcnt long, isstdcnt long, leapcnt long, timecnt long, typecnt long, charcnt long, footer string", lambda z: [(z.version, *z.counts, z.footer)])


def transitions(source: DataFrame) -> DataFrame:
    return _scan(source, "path string, seq int, when long, type int, utoff int, isdst boolean, abbr string", lambda z: [(i, t, k, *z.types[k]) for i, (t, k) in enumerate(zip(z.times, z.index, strict=True))])


def types(source: DataFrame) -> DataFrame:
    return _scan(source, "path string, type int, utoff int, isdst boolean, abbr string", lambda z: [(i, *t) for i, t in enumerate(z.types)])


def leap_seconds(source: DataFrame) -> DataFrame:
    return _scan(source, "path string, when long, count int", lambda z: z.leaps)


def states(source: DataFrame, end: int | None = None) -> DataFrame:
    """Periods of each file; with end, continued by the footer until then."""

    def rows(z: Tzif):
        found = z.states() if end is None else z.states_until(end)
        return [(i, b, s.walloff, s.stdoff, s.abbr) for i, (b, s) in enumerate(found)]

    return _scan(source, "path string, seq int, begin long, offset int, stdoff int, abbr string", rows)


def zone_name(path):
    """The zone that a file's path names: what follows the last zoneinfo/."""
    return F.regexp_extract(path, r".*zoneinfo/(.+)$", 1)


def compiled(db, zone: str, end: int, footer: str = "") -> bytes:
    """A TZif file of a zone's periods before end; footer is the POSIX TZ string that holds from then on."""
    from chronoloom.plans.rules import states as states_of

    found = [(t, s) for t, s in states_of(db, zone) if t < end]
    kinds: list[tuple[int, bool, str]] = []
    index = []
    for _, s in found:
        kind = (s.walloff, s.walloff != s.stdoff, s.abbr)
        if kind not in kinds:
            kinds.append(kind)
        index.append(kinds.index(kind))
    names, places = b"", []
    for *_, abbr in kinds:
        raw = abbr.encode() + b"\0"
        places.append(names.index(raw) if raw in names else len(names))
        names += raw if raw not in names else b""
    counts = (0, 0, 0, len(found) - 1, len(kinds), len(names))
    body = struct.pack(f">{len(found) - 1}q", *(t for t, _ in found[1:])) + bytes(index[1:]) + b"".join(struct.pack(">iBB", off, dst, at) for (off, dst, _), at in zip(kinds, places, strict=True)) + names
    head = lambda c: b"TZif2" + bytes(15) + struct.pack(">6I", *c)
    # a version 1 body of one type comes first
    return head((0, 0, 0, 0, 1, 1)) + bytes(7) + head(counts) + body + f"\n{footer}\n".encode()
