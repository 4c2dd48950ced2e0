"""strftime as Column expressions: a format is compiled once, when the plan is made.

fmt_days(), fmt_local() and fmt_utc() format days, unzoned local seconds and UTC seconds; fmt_zoned() takes the zone's offset and abbreviation. Fractions are cut,
not rounded, and follow the seconds. A format of LIMIT bytes or more is an error, an empty one gives "", a lone % at its end stays.
Specifiers with the C locale's meaning are written out; of the others %U %W %V %G %g are, and the rest are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.civil import DAYS, MONTHS, Number, civil_day, civil_month, civil_year, day_of_year, dow_from_days, fdiv, num, rem, shortest_offset, two, year_text
from chronoloom.operators.zones import Lookup

LIMIT = 128
# What composite specifiers stand for.
COMPOSITE = {"R": "%H:%M", "T": "%H:%M:%S", "X": "%H:%M:%S", "r": "%I:%M:%S %p", "F": "%Y-%m-%d", "D": "%m/%d/%y", "x": "%m/%d/%y", "c": "%a %b %e %H:%M:%S %Y"}
# Presets of the date command.
PRESETS = {
    "iso-date": "%F",
    "iso-hours": "%FT%H%z",
    "iso-minutes": "%FT%H:%M%z",
    "iso-seconds": "%FT%T%z",
    "iso-ns": "%FT%T%z",
    "rfc-email": "%a, %d %b %Y %H:%M:%S %z",
    "default": "%a %b %e %H:%M:%S %Z %Y",
}


class FormatError(ValueError):
    """A format that can't be compiled."""


def _space(x: Column) -> Column:
    return F.lpad(num(x).cast("string"), 2, " ")


def _name(names: list[str], at: Column, short: bool) -> Column:
    return F.element_at(F.array(*(F.lit(n[:3] if short else n) for n in names)), at.cast("int"))


FIELDS = ["day", "second", "year", "month", "dom", "doy"]


def fields(local: Column) -> dict[str, Column]:
    """What formats read from local seconds."""
    day = fdiv(local, 86400)
    return dict(zip(FIELDS, (day, rem(local, 86400), civil_year(day), civil_month(day), civil_day(day), day_of_year(day)), strict=True))


class Moment:
    """The fields of a local time that specifiers write."""

    def __init__(self, local: Column, utc: Column, nanos: Column | None, precision: int, zone: Column, offset: Column, held: dict[str, Column] | None = None):
        """held has the calendar's fields() of local, where they were computed before."""
        get = fields(local) if held is None else held
        self.day, self.second, self.year, self.month, self.dom, self.doy = (get[k] for k in FIELDS)
        self.utc, self.zone, self.offset = utc, zone, offset
        self.fraction = F.concat(F.lit("."), F.substring(F.lpad(num(nanos).cast("string"), 9, "0"), 1, precision)) if precision and nanos is not None else F.lit("")
        self.hour = F.call_function("div", self.second, F.lit(3600))
        self.minute = F.call_function("div", self.second % 3600, F.lit(60))
        self.half = F.when(self.hour % 12 == 0, 12).otherwise(self.hour % 12)

    def _iso(self) -> tuple[Column, Column]:
        """Year and week of ISO 8601: those of the week's Thursday."""
        thursday = self.day - rem(dow_from_days(self.day) + 6, 7) + 3
        return civil_year(thursday), F.floor((day_of_year(thursday) - 1) / 7).cast("long") + 1

    def of(self, c: str) -> Column:
        day, year = self.day, self.year
        dow = dow_from_days(day)
        match c:
            case "Y":
                return year_text(year)
            case "y":
                return two(F.abs(year) % 100)
            case "C":
                century = F.call_function("div", year, F.lit(100))
                return F.when(century.between(0, 99), two(century)).otherwise(century.cast("string"))
            case "m":
                return two(self.month)
            case "b" | "h" | "B":
                return _name(MONTHS, self.month, c != "B")
            case "d" | "e":
                return (two if c == "d" else _space)(self.dom)
            case "j":
                return F.lpad(self.doy.cast("string"), 3, "0")
            case "a" | "A":
                return _name(DAYS, dow + 1, c == "a")
            case "w":
                return dow.cast("string")
            case "u":
                return F.when(dow == 0, 7).otherwise(dow).cast("string")
            case "H" | "k":
                return (two if c == "H" else _space)(self.hour)
            case "I" | "l":
                return (two if c == "I" else _space)(self.half)
            case "p" | "P":
                return F.when(self.hour < 12, "AM" if c == "p" else "am").otherwise("PM" if c == "p" else "pm")
            case "M":
                return two(self.minute)
            case "S":
                return F.concat(two(self.second % 60), self.fraction)
            case "z":
                return self.offset
            case "Z":
                return self.zone
            case "s":
                return F.concat(self.utc.cast("string"), self.fraction)
            case "U" | "W":
                first = dow if c == "U" else rem(dow + 6, 7)
                return two(F.floor((self.doy - 1 + 7 - first) / 7))
            case "V":
                return two(self._iso()[1])
            case "G":
                return year_text(self._iso()[0])
            case "g":
                return two(F.abs(self._iso()[0]) % 100)
        raise FormatError(f"%{c} can't be written")


def parts(fmt: str) -> list[tuple[str, bool]]:
    """(literal text or specifier, whether it is a specifier) of a format, composites resolved."""
    if len(fmt.encode()) >= LIMIT:
        raise FormatError(f"a format has fewer than {LIMIT} bytes")
    out: list[tuple[str, bool]] = []
    at = 0
    while at < len(fmt):
        c = fmt[at : at + 1]
        if c != "%" or at + 1 == len(fmt):
            out.append((c, False))
            at += 1
            continue
        c, at = fmt[at + 1], at + 2
        if c in "%nt":
            out.append(({"%": "%", "n": "\n", "t": "\t"}[c], False))
        elif c in COMPOSITE:
            out += parts(COMPOSITE[c])
        else:
            out.append((c, True))
    return out


def compiled(fmt: str, moment: Moment) -> Column:
    """One concatenation of what a format says."""
    columns: list[Column] = []
    literal = ""
    for text, special in parts(fmt):
        if special:
            columns += [F.lit(literal)] if literal else []
            columns.append(moment.of(text))
            literal = ""
        else:
            literal += text
    columns += [F.lit(literal)] if literal else []
    return F.concat(*columns) if columns else F.lit("")


def _present(x: Column, text: Column) -> Column:
    return F.when(x.isNotNull(), text)


def fmt_utc(fmt: str, t: Number, nanos: Number | None = None, precision: int = 0) -> Column:
    """UTC seconds; %Z is UTC and %z is +00."""
    t = num(t)
    return _present(t, compiled(fmt, Moment(t, t, nanos, precision, F.lit("UTC"), F.lit("+00"))))


def fmt_local(fmt: str, local: Number, nanos: Number | None = None, precision: int = 0) -> Column:
    """Local seconds without zone; %Z and %z are -00."""
    local = num(local)
    return _present(local, compiled(fmt, Moment(local, local, nanos, precision, F.lit("-00"), F.lit("-00"))))


def fmt_days(fmt: str, days: Number) -> Column:
    """Midnight, UTC, of days since the epoch."""
    return fmt_utc(fmt, num(days) * 86400)


def fmt_zoned(fmt: str, zone: Lookup, t: Number, nanos: Number | None = None, precision: int = 0) -> Column:
    """UTC seconds as a zone's local time. with_formatted() does the same over a DataFrame and is faster."""
    t = num(t)
    known = F.struct(t.alias("t"), zone.to_local(t).alias("local"), zone.offset(t).alias("offset"), zone.abbrev(t).alias("abbrev"))
    # the lookup is bound by a lambda, lest every field repeats it
    said = F.transform(F.array(known), lambda x: _present(x["local"], compiled(fmt, Moment(x["local"], x["t"], nanos, precision, x["abbrev"], shortest_offset(x["offset"])))))
    return F.get(said, F.lit(0))


def with_formatted(df: DataFrame, formats: dict[str, str], t: Number, zone: Lookup | None = None, nanos: Column | None = None, precision: int = 0) -> DataFrame:
    """df with a column for each format, of UTC seconds in UTC or as a zone's local time.

    The lookup and the calendar's fields are projections of their own, so all stays within generated code however many formats there are.
    """
    t = num(t)
    state = {"t": t, "local": t, "offset": F.lit("+00"), "abbrev": F.lit("UTC")} if zone is None else {"t": t, "local": zone.to_local(t), "offset": zone.offset(t), "abbrev": zone.abbrev(t)}
    # plain columns, not structs, which Catalyst would take apart and compute again for every field
    df = df.withColumns({f"__at_{k}": c for k, c in state.items()})
    df = df.withColumns({f"__at_{k}": c for k, c in fields(F.col("__at_local")).items()})
    at = {k: F.col(f"__at_{k}") for k in [*state, *FIELDS]}
    moment = Moment(at["local"], at["t"], nanos, precision, at["abbrev"], at["offset"] if zone is None else shortest_offset(at["offset"]), at)
    return df.withColumns({to: _present(at["local"], compiled(fmt, moment)) for to, fmt in formats.items()}).drop(*(f"__at_{k}" for k in at))


def fmt_to(text: Column, count: int) -> Column:
    """struct(text, count): at most count bytes of a text, as into a buffer; formats write ASCII."""
    return F.struct(F.left(text, F.lit(count)).alias("text"), F.least(F.octet_length(text), F.lit(count)).alias("count"))


def preset(name: str, zone: Lookup, t: Number, nanos: Number | None = None) -> Column:
    """A format of the date command by name."""
    return fmt_zoned(PRESETS[name], zone, t, nanos, 9 if name == "iso-ns" else 0)
