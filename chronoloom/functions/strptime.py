"""strptime as Column expressions: a format is compiled once into a regular expression and arithmetic over its groups.

Fields take as many characters as they may and give none back, so "%Y%m" reads 2024 from "20241" and then 1, and doesn't fit "2024". As the
fields allow: input after the format's end is ignored, values aren't checked against their ranges but roll over (hour 99, February 30th),
%y below 69 is 20xx, %p adds 12 whatever %H says, weekdays and zone names are read and ignored, %z is subtracted, a day of the year other than 0 goes before month and day,
and %s before everything. Fields that say the same take effect in the format's order. What a format lacks is that of 1970-01-01 00:00:00.
Columns of the form strict raise an error on input that doesn't fit; those of the form try_ are null. Null input is null. Specifiers other than
those below are refused.

Where every field has a greatest width and the input fills it, as formats write it, nothing is matched: see fixed().
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.civil import DAYS, MONTHS, fdiv, resolve_civil, resolve_civil_ordinal
from chronoloom.functions.strftime import COMPOSITE, FormatError

MARK = "\x01"
#: Not at the input's end: fields that may be empty want some input all the same.
MORE = r"(?=[\s\S])"
SPACES = MORE + r"[ \t\n\r\x0B\f]*+"
PADDED = r"((?>\d{1,2}+| \d))"
#: Characters of a field that is filled.
WIDTH = {"Y": 4, "y": 2, "C": 2, "m": 2, "d": 2, "H": 2, "I": 2, "M": 2, "S": 2, "j": 3}
SAME = {"e": "d", "k": "H", "l": "I", "B": "b", "h": "b", "A": "a", "P": "p", "t": "n"}


def _names(names: list[str]) -> str:
    return "(?i:" + "|".join(f"{n}|{n[:3]}" for n in names) + ")"


# specifier: (pattern, groups)
PATTERNS = {
    "n": (SPACES, 0),
    "Y": (r"(\d{1,4}+)", 1),
    **dict.fromkeys("yCM", (r"(\d{1,2}+)", 1)),
    **dict.fromkeys("mdHI", (PADDED, 1)),
    "b": (f"((?>{_names(MONTHS)}))", 1),
    "a": (f"(?>{_names(DAYS)})", 0),
    "w": ("[0-6]", 0),
    "u": ("[1-7]", 0),
    "j": (r"(\d{1,3}+)", 1),
    "p": ("((?i:AM|PM))", 1),
    "S": (r"(\d{1,2}+)(?:\.(\d{1,9}+))?+", 2),
    "Z": (MORE + r"[A-Za-z0-9+_/\-]*+", 0),
    "z": (r"([+\-])(\d\d)([0-5]\d)?+", 3),
    "s": (r"(-?+\d++)(?:\.(\d{1,9}+))?+", 2),
}


@dataclass
class Compiled:
    """The steps of a format: literals (None, text) and specifiers (letter, first group)."""

    steps: list[tuple[str | None, str | int]] = field(default_factory=list)
    count: int = 0

    @property
    def pattern(self) -> str:
        return "".join(self.patterns())

    def patterns(self) -> list[str]:
        return [re.escape(x) if c is None else PATTERNS[c][0] for c, x in self.steps]

    def fields(self, letters: str) -> list[tuple[str, int]]:
        """(letter, first group) of the fields among letters, in the format's order."""
        return [(c, x) for c, x in self.steps if c is not None and c in letters]

    def last(self, letter: str) -> int | None:
        return next((x for _, x in reversed(self.fields(letter))), None)


def compile_format(fmt: str) -> Compiled:
    out = Compiled()

    def read(fmt: str) -> None:
        at = 0
        while at < len(fmt):
            c = fmt[at]
            if c != "%" or at + 1 == len(fmt):
                out.steps.append((None, c))
                at += 1
                continue
            c, at = SAME.get(fmt[at + 1], fmt[at + 1]), at + 2
            if c == "%":
                out.steps.append((None, c))
            elif c in PATTERNS:
                out.steps.append((c, out.count + 1))
                out.count += PATTERNS[c][1]
            elif c in COMPOSITE:
                read(COMPOSITE[c])
            else:
                raise FormatError(f"%{c} can't be read")

    read(fmt)
    return out


def _found(fmt: str, text: Column) -> Column:
    """An empty string and all groups of one match, as an array; something else where the input doesn't fit."""
    form = compile_format(fmt)
    return F.split(F.regexp_replace(text, f"(?s)^{form.pattern}.*$", "".join(f"{MARK}${k + 1}" for k in range(form.count))), MARK)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _parts(form: Compiled, whole, text) -> dict[str, Column]:
    """What the fields say, of which _seconds() makes seconds; whole(group) is a number and text(group) as it stands."""
    year, century, small = _long(1970), False, False
    for c, n in form.fields("YyC"):
        if c == "Y":
            year = whole(n)
        elif c == "y":
            small = True
            year = year + whole(n) if century else whole(n) + F.when(whole(n) < 69, 2000).otherwise(1900)
        else:
            year = (year - F.when(year < 2000, 1900).otherwise(2000) if small else _long(0)) + whole(n) * 100
            century = True
    month = _long(1)
    for c, n in form.fields("mb")[-1:]:
        # the names differ in their first three letters
        month = whole(n) if c == "m" else F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), F.lower(F.left(text(n), F.lit(3)))).cast("long")
    get = lambda c, default=0: _long(default) if form.last(c) is None else whole(form.last(c))
    hour = _long(0)
    for c, n in form.fields("HIp"):
        hour = whole(n) if c == "H" else hour + (whole(n) % 12 if c == "I" else F.when(F.upper(text(n)) == "PM", 12).otherwise(0))
    clock = hour * 3600 + get("M") * 60 + get("S")
    if (n := form.last("z")) is not None:
        size = whole(n + 1) * 3600 + F.coalesce(whole(n + 2), _long(0)) * 60
        clock = clock - F.when(text(n) == "-", -size).otherwise(size)
    return {"year": year, "month": month, "day": get("d", 1), "doy": get("j"), "clock": clock}


def _seconds(form: Compiled, parts: dict[str, Column]) -> Column:
    days = resolve_civil(parts["year"], parts["month"], parts["day"])
    if form.last("j") is not None:
        days = F.when(parts["doy"] != 0, resolve_civil_ordinal(parts["year"], parts["doy"])).otherwise(days)
    return days * 86400 + parts["clock"]


def _groups(found: Column):
    """Functions of a group's number: its text, a whole number, nanoseconds of a fraction."""
    text = lambda n: F.get(found, F.lit(n))
    whole = lambda n: F.ltrim(text(n)).try_cast("long")
    frac = lambda n: F.coalesce(F.rpad(F.nullif(text(n), F.lit("")), 9, "0").try_cast("long"), _long(0))
    return text, whole, frac


def _fits(fmt: str, source: Column, found: Column) -> Column:
    form = compile_format(fmt)
    if not form.count or form.steps[0] == (None, MARK):
        return compiled_fits(fmt, source)
    # groups never hold the mark; input that has it can't look like a match if it doesn't begin with it
    text, whole, _ = _groups(found)
    fits = (F.size(found) == form.count + 1) & (text(0) == "") & ~F.startswith(source, F.lit(MARK))
    return fits & whole(form.fields("s")[0][1]).isNotNull() if form.fields("s") else fits


def _read(fmt: str, source: Column, found: Column) -> tuple[Column, Column, Column]:
    """(whether the input fits, seconds, nanoseconds) of what _found() gives."""
    form = compile_format(fmt)
    text, whole, frac = _groups(found)
    fits = _fits(fmt, source, found)
    if form.fields("s"):
        n = form.fields("s")[0][1]
        return fits, whole(n), frac(n + 1)
    nanos = frac(form.last("S") + 1) if form.last("S") is not None else _long(0)
    return fits, _seconds(form, _parts(form, whole, text)), nanos


def fixed(fmt: str, text: Column) -> tuple[Column, Callable[[Column], dict[str, Column]]] | None:
    """(number, what the fields of a number say) of input whose fields are all filled with digits and that has no fraction, null for other input; None if the format has other fields.

    The digits are put together and read as one number, so nothing is matched: a sign, space or point among them, which a
    number may have too, is at its ends only and is looked for there.
    """
    form = compile_format(fmt)
    kinds = [c for c, _ in form.steps if c is not None]
    if not kinds or any(c not in WIDTH for c in kinds) or sum(WIDTH[c] for c in kinds) > 18:
        return None
    at, digits, checks, places, below = 1, [], [], {}, sum(WIDTH[c] for c in kinds)
    for k, (c, x) in enumerate(form.steps):
        if c is None:
            checks.append(F.substring(text, at, 1) == x)
            at += 1
            continue
        below -= WIDTH[c]
        places[x] = (below, WIDTH[c])
        digits.append((at, WIDTH[c]))
        at += WIDTH[c]
        if c == "S":
            checks.append(F.substring(text, at, 1) != ".")
    # neighbouring digits are one piece
    runs: list[list[int]] = []
    for start, n in digits:
        if runs and runs[-1][0] + runs[-1][1] == start:
            runs[-1][1] += n
        else:
            runs.append([start, n])
    joined = F.concat(*(F.substring(text, a, n) for a, n in runs)) if len(runs) > 1 else F.substring(text, *runs[0])
    checks += [F.length(joined) == sum(WIDTH[c] for c in kinds), joined >= "0", joined < ":", F.substring(joined, -1, 1) >= "0"]

    def said(number: Column) -> dict[str, Column]:
        return _parts(form, lambda n: F.call_function("div", number, _long(10 ** places[n][0])) % 10 ** places[n][1], None)

    return F.when(reduce(Column.__and__, checks), joined.try_cast("long")), said


def _strict(fmt: str, text: Column, fits: Column, value: Column) -> Column:
    fault = F.raise_error(F.concat(F.lit(f"input doesn't fit {fmt}: "), text, F.lit(", "), F.coalesce(_said(fmt, text), F.lit("number out of range"))))
    return F.when(text.isNull(), F.lit(None)).when(fits, value).otherwise(fault)


def _bound(fmt: str, text: Column, value) -> Column:
    """value(fits, seconds, nanos), where a lambda binds the match, lest every field repeats it."""
    return F.get(F.transform(F.array(_found(fmt, text)), lambda found: value(*_read(fmt, text, found))), F.lit(0))


def _quick(fmt: str, text: Column, slow: Column) -> Column:
    quick = fixed(fmt, text)
    return slow if quick is None else F.coalesce(_seconds(compile_format(fmt), quick[1](quick[0])), slow)


def parse_precise(fmt: str, text: Column) -> Column:
    """struct(seconds, nanos)."""
    return _bound(fmt, text, lambda fits, s, ns: _strict(fmt, text, fits, F.struct(s.alias("seconds"), ns.cast("int").alias("nanos"))))


def try_parse_precise(fmt: str, text: Column) -> Column:
    return _bound(fmt, text, lambda fits, s, ns: F.when(fits, F.struct(s.alias("seconds"), ns.cast("int").alias("nanos"))))


def parse_s(fmt: str, text: Column) -> Column:
    """UTC seconds; fractions are cut, downwards."""
    return _quick(fmt, text, _bound(fmt, text, lambda fits, s, _: _strict(fmt, text, fits, s)))


def try_parse_s(fmt: str, text: Column) -> Column:
    return _quick(fmt, text, _bound(fmt, text, lambda fits, s, _: F.when(fits, s)))


def with_parsed(df: DataFrame, to: str, fmt: str, text: Column, strict: bool = True) -> DataFrame:
    """df with parse_s() in column to, or try_parse_s(): the match is a projection of its own, so several columns stay within generated code."""
    form = compile_format(fmt)
    # plain columns, not a struct: Catalyst would take a struct apart and repeat the match for every field
    found, source, number, *names = (f"__{to}_{k}" for k in ("found", "text", "number", "year", "month", "day", "doy", "clock"))
    held, quick = df.withColumn(source, text), fixed(fmt, F.col(source))
    match = _found(fmt, F.col(source))
    if quick is not None:
        held = held.withColumn(number, quick[0])
        match = F.when(F.col(number).isNull(), match)
    held, fits = held.withColumn(found, match), _fits(fmt, F.col(source), F.col(found))
    group, whole, _ = _groups(F.col(found))
    if form.fields("s"):
        seconds = whole(form.fields("s")[0][1])
    else:
        parts = _parts(form, whole, group)
        if quick is not None:
            fits = F.col(number).isNotNull() | fits
            parts = {k: F.when(F.col(number).isNotNull(), x).otherwise(parts[k]) for k, x in quick[1](F.col(number)).items()}
        held = held.withColumns(dict(zip(names, parts.values(), strict=True)))
        seconds = _seconds(form, dict(zip(parts, map(F.col, names), strict=True)))
    value = _strict(fmt, F.col(source), fits, seconds) if strict else F.when(fits, seconds)
    return held.withColumn(to, value).drop(found, source, number, *names)


def parse_d(fmt: str, text: Column) -> Column:
    """Days since the epoch."""
    return fdiv(parse_s(fmt, text), 86400)


def try_parse_d(fmt: str, text: Column) -> Column:
    return fdiv(try_parse_s(fmt, text), 86400)


def parse_ns(fmt: str, text: Column) -> Column:
    """Nanoseconds, from 1677 to 2262; an error beyond."""
    return _bound(fmt, text, lambda fits, s, ns: _strict(fmt, text, fits, s * 1_000_000_000 + ns))


def try_parse_ns(fmt: str, text: Column) -> Column:
    return _bound(fmt, text, lambda fits, s, ns: F.when(fits, F.try_add(F.try_multiply(s, F.lit(1_000_000_000)), ns)))


def parse_ticks(fmt: str, text: Column, number: int, den: int = 1) -> Column:
    """Ticks of number/den seconds, floored."""
    x = parse_precise(fmt, text)
    # whole ticks of the seconds and of what they leave, so that nothing overflows before the result does
    ticks = fdiv(x["seconds"], number) * den
    rest = (x["seconds"] - fdiv(x["seconds"], number) * number) * 1_000_000_000 + x["nanos"]
    return ticks + fdiv(rest * den, 1_000_000_000 * number)


def place(fmt: str, text: Column) -> Column:
    """How many characters the format takes before the one that it can't: one match of ever longer beginnings of the format."""
    form = compile_format(fmt)
    nested = ""
    for (c, _), pattern in reversed(list(zip(form.steps, form.patterns(), strict=True))):
        # a padded field may take its space before it fails
        nested = f"(?>{pattern}{nested}{'| ' if c is not None and c in 'mdHI' else ''})?+"
    return F.length(F.regexp_extract(text, f"^({nested})", 1))


def _said(fmt: str, text: Column) -> Column:
    at = place(fmt, text)
    return F.when(at >= F.length(text), F.lit("unexpected end of input")).otherwise(F.concat(F.lit("error at input["), at.cast("string"), F.lit("] (char='"), F.substring(text, at + 1, F.lit(1)), F.lit("')")))


def problem(fmt: str, text: Column) -> Column:
    """Why input doesn't fit: the place of the first character that the format can't take, or the end; null where it fits."""
    return F.when(text.isNotNull() & ~compiled_fits(fmt, text), _said(fmt, text))


def compiled_fits(fmt: str, text: Column) -> Column:
    return text.rlike(f"(?s)^{compile_format(fmt).pattern}")


def local_seconds(fmt: str, text: Column) -> Column:
    """Local seconds without zone; an offset in the input is subtracted as in parse_s()."""
    return parse_s(fmt, text)
