"""From rules and zone lines to the periods of a zone.

The sequence of a zone is short and each instant in it depends on the saving before, so a zone is walked in plain Python, on the
driver for a few zones or as one task for each (see zone_periods()).
"""

from __future__ import annotations

from dataclasses import dataclass

from chronoloom.functions.civil import CYCLE_SECONDS, days_of, year_of
from chronoloom.sources.tzdb import Database, Entry, Rule

DAY = 86400
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class State:
    stdoff: int
    walloff: int
    abbr: str


def abbreviation(fmt: str, letter: str, stdoff: int, walloff: int) -> str:
    """The abbreviation that a zone line's format gives."""
    if "%s" in fmt:
        return fmt.replace("%s", letter)
    if "%z" in fmt:
        size = abs(walloff)
        h, m, s = size // 3600, size // 60 % 60, size % 60
        text = f"{'-' if walloff < 0 else '+'}{h:02}" + (f"{m:02}{s:02}" if s else f"{m:02}" if m else "")
        return fmt.replace("%z", text)
    standard, slash, saving = fmt.partition("/")
    return saving if slash and walloff != stdoff else standard


def cyclic_year(rules: list[Rule]) -> int:
    """The first year from which on only rules without an end are active, and all of them."""
    return max([1 + r.last for r in rules if r.last is not None] + [r.first for r in rules if r.last is None] or [0])


def dated(rules: list[Rule], last_year: int) -> list[tuple[int, Rule]]:
    """(date, rule) of each time that a rule takes effect, in order of dates, through last_year."""
    out = [(r.on.resolve(y, r.month), r) for r in rules for y in range(r.first, (last_year if r.last is None else min(r.last, last_year)) + 1)]
    return sorted(out, key=lambda x: x[0])


def historical(rules: list[Rule]) -> list[tuple[int, Rule]]:
    """dated() before the cycle begins."""
    return [x for x in dated(rules, cyclic_year(rules) - 1)]


def active(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.last is None]


def cycle_time(db: Database, entries: list[Entry]) -> int:
    """Seconds from which on the zone repeats every 400 years, with some days to spare."""
    times = [0]
    times += [(2 + e.until.date) * DAY for e in entries if e.until]
    if isinstance(entries[-1].rule, str):
        times.append((2 + days_of(cyclic_year(db.rules[entries[-1].rule]))) * DAY)
    return max(times)


def states(db: Database, zone: str, horizon: int | None = None) -> list[tuple[int, State]]:
    """(begin, state) of a zone's periods: the first begins at LOWEST, each differs from the one before. Through horizon, by default two years more than a cycle after cycle_time()."""
    entries = db.zones[zone]
    if horizon is None:
        horizon = cycle_time(db, entries) + CYCLE_SECONDS + 2 * 366 * DAY
    out: list[tuple[int, State]] = []

    def put(t: int, state: State) -> None:
        if out and out[-1][0] == t:
            out.pop()
        if not out or out[-1][1] != state:
            out.append((t, state))

    start: int | None = None
    before, saved = 0, 0
    for e in entries:
        ends = lambda save, e=e: HIGHEST if e.until is None else e.until.at.resolve(e.until.date, e.stdoff, save)
        begin = LOWEST if start is None else start
        if not isinstance(e.rule, str):
            save = e.rule or 0
            put(begin, State(e.stdoff, e.stdoff + save, abbreviation(e.format, "", e.stdoff, e.stdoff + save)))
        else:
            rules = db.rules[e.rule]
            standard = [r for _, r in dated(rules, max(r.first for r in rules)) if r.save == 0]
            letter, save, opened = standard[0].letter if standard else "", 0, False
            last_year = year_of((horizon if e.until is None else min(horizon, (e.until.date + 2) * DAY)) // DAY) + 1
            for date, r in dated(rules, last_year):
                t = r.at.resolve(date, e.stdoff, save)
                if start is not None and not opened and r.at.resolve(date, before, saved) == begin:
                    # read from the clock that the line before kept, it takes effect just as this line begins
                    t = begin
                if t >= ends(save) or t > horizon:
                    break
                if not opened and t > begin:
                    put(begin, State(e.stdoff, e.stdoff + save, abbreviation(e.format, letter, e.stdoff, e.stdoff + save)))
                    opened = True
                save, letter = r.save, r.letter
                if t > begin:
                    put(t, State(e.stdoff, e.stdoff + save, abbreviation(e.format, letter, e.stdoff, e.stdoff + save)))
            if not opened:
                put(begin, State(e.stdoff, e.stdoff + save, abbreviation(e.format, letter, e.stdoff, e.stdoff + save)))
        start, before, saved = ends(save), e.stdoff, save
    return out
