"""POSIX TZ strings: STDoff[DST[off][,start[/time],end[/time]]]."""

from __future__ import annotations

import re
from dataclasses import dataclass

from chronoloom.functions.civil import days_of, year_of

DAY = 86400
NAME = r"(?:<([A-Za-z0-9+\-]+)>|([A-Za-z]{3,}))"
OFFSET = r"([+\-]?\d{1,3}(?::\d{1,2}(?::\d{1,2})?)?)"
WHEN = r"(M\d{1,2}\.\d\.\d|J\d{1,3}|\d{1,3})(?:/" + OFFSET + ")?"
WHOLE = re.compile(f"{NAME}{OFFSET}(?:{NAME}{OFFSET}?(?:,{WHEN},{WHEN})?)?")


class PosixError(ValueError):
    """A TZ string that can't be read."""


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    h, m, s = ([*map(int, text.lstrip("+-").split(":")), 0, 0])[:3]
    return sign * (h * 3600 + m * 60 + s)


@dataclass(frozen=True)
class When:
    """A day of each year: kind is month (m, week, dow), julian (without February 29th) or day (from 0); time in seconds of local time."""

    kind: str
    month: int = 0
    week: int = 0
    dow: int = 0
    day: int = 0
    time: int = 7200

    def date(self, year: int) -> int:
        first = days_of(year)
        if self.kind == "day":
            return first + self.day
        if self.kind == "julian":
            return first + self.day - 1 + (self.day >= 60 and days_of(year + 1) - first == 366)
        start = days_of(year, self.month)
        at = start + (self.dow - start - 4) % 7 + (self.week - 1) * 7
        end = days_of(year + self.month // 12, self.month % 12 + 1)
        return at if at < end else at - 7

    def local(self, year: int) -> int:
        return self.date(year) * DAY + self.time


@dataclass(frozen=True)
class PosixTz:
    """off1 and off2 are seconds east of Greenwich; abbr2 is empty without saving."""

    abbr1: str
    off1: int
    abbr2: str = ""
    off2: int = 0
    start: When | None = None
    end: When | None = None

    def starts(self, year: int) -> int:
        """UTC seconds at which saving starts."""
        return self.start.local(year) - self.off1

    def stops(self, year: int) -> int:
        return self.end.local(year) - self.off2

    def permanent(self) -> bool:
        """Whether each saving starts as the one before ends."""
        return self.start is None or self.starts(2001) == self.stops(2000)

    def states(self, after: int, before: int) -> list[tuple[int, int, int, str]]:
        """(instant, stdoff, walloff, abbr) of changes later than after and earlier than before."""
        if self.permanent():
            return []
        out = []
        for year in range(year_of(after // DAY) - 1, year_of(before // DAY) + 2):
            out += [(self.starts(year), self.off1, self.off2, self.abbr2), (self.stops(year), self.off1, self.off1, self.abbr1)]
        return sorted(x for x in out if after < x[0] < before)


def _when(text: str, time: str | None) -> When:
    seconds = 7200 if time is None else _seconds(time)
    if text.startswith("M"):
        month, week, dow = map(int, text[1:].split("."))
        if not (1 <= month <= 12 and 1 <= week <= 5 and dow <= 6):
            raise PosixError(f"no day of a month: {text}")
        return When("month", month, week, dow, 0, seconds)
    return When("julian", day=int(text[1:]), time=seconds) if text.startswith("J") else When("day", day=int(text), time=seconds)


def parse(text: str) -> PosixTz:
    m = WHOLE.fullmatch(text)
    if not m:
        raise PosixError(f"no POSIX TZ string: {text}")
    a1, b1, o1, a2, b2, o2, w1, t1, w2, t2 = m.groups()
    off1 = -_seconds(o1)
    if not (a2 or b2):
        return PosixTz(a1 or b1, off1)
    off2 = off1 + 3600 if o2 is None else -_seconds(o2)
    if w1 is None:
        return PosixTz(a1 or b1, off1, a2 or b2, off2)
    return PosixTz(a1 or b1, off1, a2 or b2, off2, _when(w1, t1), _when(w2, t2))
