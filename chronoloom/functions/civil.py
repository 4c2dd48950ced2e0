"""Calendar arithmetic as Column expressions: proleptic Gregorian, with a leap year 0, days and seconds since 1970-01-01.

All arguments may be Columns or plain numbers and are taken as 64-bit integers; nulls give nulls. Dates are whole numbers of days, so
years far outside Spark's dates work: a day is moved into one 400-year cycle, where Spark's own functions read it.
Nothing is validated: days of a month roll over, in resolve_civil() as in adding months or years.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
CYCLE_DAYS = 146_097
CYCLE_SECONDS = CYCLE_DAYS * DAY
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

Number = Column | int


def num(x: Number) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def fdiv(a: Number, n: Number) -> Column:
    """Floor division; safe at the ends of 64 bits."""
    a, n = num(a), num(n)
    return F.call_function("div", a, n) - ((a % n) < 0).cast("long")


def rem(a: Number, n: int) -> Column:
    """The remainder of fdiv(), never negative."""
    return F.pmod(num(a), F.lit(n).cast("long"))


def blog2(x: int) -> int:
    """Floor of the binary logarithm of a plan-time number."""
    if x <= 0:
        raise ValueError("a positive number is needed")
    return x.bit_length() - 1


def ns_to_s(ns: Number) -> Column:
    return fdiv(ns, 1_000_000_000)


def s_to_ns(s: Number) -> Column:
    return num(s) * 1_000_000_000


def necessary_precision(num_: int, den: int, is_float: bool = False) -> int:
    """Decimal digits that a tick of num_/den seconds needs, 9 at most; plan-time."""
    if is_float:
        return 9
    den = Fraction(num_, den).denominator
    return next((p for p in range(10) if 10**p % den == 0), 9)


def days_to_seconds(d: Number, h: Number = 0, m: Number = 0, s: Number = 0) -> Column:
    return num(d) * DAY + num(h) * 3600 + num(m) * 60 + num(s)


def sys_seconds(d: Number, offset: Number) -> Column:
    """Seconds of midnight of a local date at an offset from UTC."""
    return num(d) * DAY - num(offset)


def is_leap(y: Number) -> Column:
    y = num(y)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def last_day_of_month(y: Number, m: Number) -> Column:
    m = num(m)
    return F.when(m == 2, F.when(is_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def weekday_difference(x: Number, y: Number) -> Column:
    return rem(num(x) - num(y), 7).cast("int")


def resolve_civil(y: Number, m: Number = 1, d: Number = 1) -> Column:
    """Days since the epoch of a year, month and day. Years begin in March here, so leap days end them."""
    y, m, d = num(y), num(m), num(d)
    y = y - (m <= 2).cast("long")
    place = F.when(m > 2, m - 3).otherwise(m + 9)
    return y * 365 + fdiv(y, 4) - fdiv(y, 100) + fdiv(y, 400) + F.call_function("div", place * 153 + 2, F.lit(5).cast("long")) + d - 719_469


def resolve_civil0(y: Number, m0: Number, d0: Number) -> Column:
    return resolve_civil(y, num(m0) + 1, num(d0) + 1)


def resolve_civil_ordinal(y: Number, doy: Number) -> Column:
    """doy from 1."""
    return resolve_civil(y) + num(doy) - 1


def resolve_civil_time(y: Number, m: Number, d: Number, h: Number, mi: Number, s: Number) -> Column:
    return days_to_seconds(resolve_civil(y, m, d), h, mi, s)


def _date(d: Number) -> Column:
    """The DATE at the same place of the cycle that begins in 1970."""
    return F.date_from_unix_date(rem(d, CYCLE_DAYS).cast("int"))


def civil_year(d: Number) -> Column:
    return F.year(_date(d)).cast("long") + fdiv(d, CYCLE_DAYS) * 400


def civil_month(d: Number) -> Column:
    return F.month(_date(d))


def civil_day(d: Number) -> Column:
    return F.dayofmonth(_date(d))


def to_civil(d: Number) -> Column:
    """struct(year, month, day)."""
    return F.struct(civil_year(d).alias("year"), civil_month(d).alias("month"), civil_day(d).alias("day"))


def to_civil0(d: Number) -> Column:
    return F.struct(civil_year(d).alias("year"), (civil_month(d) - 1).alias("month"), (civil_day(d) - 1).alias("day"))


def day_of_year(d: Number) -> Column:
    """From 1."""
    return F.dayofyear(_date(d))


def to_civil_year_doy(d: Number) -> Column:
    """struct(year, doy), doy from 0."""
    return F.struct(civil_year(d).alias("year"), (day_of_year(d) - 1).alias("doy"))


def civil_boy(d: Number) -> Column:
    return num(d) - day_of_year(d) + 1


def civil_eoy(d: Number) -> Column:
    return resolve_civil(civil_year(d), 12, 31)


def civil_bom(d: Number) -> Column:
    return num(d) - civil_day(d) + 1


def civil_eom(d: Number) -> Column:
    return num(d) + F.datediff(F.last_day(_date(d)), _date(d))


def civil_add_months(d: Number, n: Number) -> Column:
    """n months later, without a clamp at the month's end: January 31st and a month is March 2nd or 3rd."""
    m = num(civil_month(d)) - 1 + num(n)
    return resolve_civil(civil_year(d) + fdiv(m, 12), rem(m, 12) + 1, civil_day(d))


def civil_add_years(d: Number, n: Number) -> Column:
    """n years later; February 29th rolls to March 1st."""
    return resolve_civil(civil_year(d) + num(n), civil_month(d), civil_day(d))


def dow_from_days(d: Number) -> Column:
    """Sunday is 0."""
    return rem(num(d) + 4, 7).cast("int")


def dow_from_civil(y: Number, m: Number, d: Number) -> Column:
    return dow_from_days(resolve_civil(y, m, d))


def resolve_dow_ge(d: Number, dow: Number) -> Column:
    """The first such weekday on or after a day."""
    return num(d) + rem(num(dow) - dow_from_days(d), 7)


def resolve_dow_le(d: Number, dow: Number) -> Column:
    return num(d) - rem(dow_from_days(d) - num(dow), 7)


def resolve_last_dow(y: Number, m: Number, dow: Number) -> Column:
    return resolve_dow_le(resolve_civil(y, m, last_day_of_month(y, m)), dow)


def nth_dow(y: Number, m: Number, n: Number, dow: Number) -> Column:
    """The n-th such weekday of a month, from 1; rolls into the next month."""
    return resolve_dow_ge(resolve_civil(y, m, 1), dow) + (num(n) - 1) * 7


def two(x: Number) -> Column:
    return F.lpad(num(x).cast("string"), 2, "0")


def shortest_offset(offset: Number) -> Column:
    """±HH[MM[SS]]."""
    offset = num(offset)
    size = F.abs(offset)
    h, m, s = F.call_function("div", size, F.lit(3600)), F.call_function("div", size % 3600, F.lit(60)), size % 60
    rest = F.when(s != 0, F.concat(two(m), two(s))).when(m != 0, two(m)).otherwise(F.lit(""))
    return F.concat(F.when(offset < 0, "-").otherwise("+"), two(h), rest)


def month_name(m: Number) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), num(m).cast("int"))


def dow_name(dow: Number) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), (num(dow) + 1).cast("int"))


def year_text(y: Number) -> Column:
    """Four digits from 0 to 9999, else the plain number."""
    y = num(y)
    return F.when(y.between(0, 9999), F.lpad(y.cast("string"), 4, "0")).otherwise(y.cast("string"))


def _parts(t: Number) -> tuple[Column, Column]:
    return fdiv(t, DAY), rem(t, DAY)


def _clock(s: Column, sep: str) -> Column:
    return F.concat_ws(sep, two(F.call_function("div", s, F.lit(3600))), two(F.call_function("div", s % 3600, F.lit(60))), two(s % 60))


def compact_date(d: Number) -> Column:
    """YYYYMMDD."""
    return F.concat(year_text(civil_year(d)), two(civil_month(d)), two(civil_day(d)))


def compact_time(t: Number) -> Column:
    """YYYYMMDD HHMMSS."""
    d, s = _parts(t)
    return F.concat(compact_date(d), F.lit(" "), _clock(s, ""))


def sane_time(t: Number, suffix: str | Column = "") -> Column:
    """YYYY-MM-DD HH:MM:SS with a suffix, such as Z or an abbreviation."""
    d, s = _parts(t)
    return F.concat(year_text(civil_year(d)), F.lit("-"), two(civil_month(d)), F.lit("-"), two(civil_day(d)), F.lit(" "), _clock(s, ":"), F.lit(suffix) if isinstance(suffix, str) else suffix)


def days_of(y: int, m: int = 1, d: int = 1) -> int:
    """resolve_civil() of plain numbers, for building tables on the driver."""
    y -= m <= 2
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * (m - 3 if m > 2 else m + 9) + 2) // 5 + d - 719_469


def year_of(d: int) -> int:
    y = math.floor(1970 + d / 365.2425)
    while days_of(y + 1) <= d:
        y += 1
    while days_of(y) > d:
        y -= 1
    return y
