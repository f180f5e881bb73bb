"""Dates, times and durations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioquery.functions.registry import function, subject
from folioquery.plans.compiler import UNIT_MONTHS, UNIT_MS, Val, difference, duration, duration_parts, either, errors, literal
from folioquery.plans.syntax import ExpressionError
from folioquery.values import BOOL, DATE, DURATION, INT, STRING, TIMESTAMP

#: Tokens of date formats.
FORMAT_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss", "SSS": "SSS"}


def parse_duration(text: str) -> tuple[int, int]:
    """Months and milliseconds of texts such as ``1d``, ``2h 30m``, ``-1 month`` or ``P1Y2M3DT4H``."""
    iso = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text.strip())
    if iso and any(iso.groups()[1:]):
        y, mo, w, d, h, mi = (int(g or 0) for g in iso.groups()[1:7])
        ms = (((w * 7 + d) * 24 + h) * 60 + mi) * 60_000 + round(float(iso[8] or 0) * 1000)
        sign = -1 if iso[1] else 1
        return sign * (12 * y + mo), sign * ms
    months = ms = 0
    terms = re.findall(r"([+-]?)\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    if not terms or re.sub(r"([+-]?)\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)[\s,]*", "", text).strip():
        raise ExpressionError(f"no duration: {text!r}")
    for sign, n, unit in terms:
        amount = float(n) * (-1 if sign == "-" else 1)
        if unit in UNIT_MONTHS:
            months += int(amount * UNIT_MONTHS[unit])
        elif unit in UNIT_MS:
            ms += round(amount * UNIT_MS[unit])
        else:
            raise ExpressionError(f"no unit of time: {unit!r}")
    return months, ms


@function("plain", "duration")
def plain_duration(c, target, args):
    """Milliseconds of one number and unit, a month as 30 days and a year as 365; an ISO text has days and less."""
    v, _ = subject(target, args)
    if isinstance(v.const, str) and v.const.strip().lstrip("-").startswith("P"):
        months, ms = parse_duration(v.const)
        return literal(ms) if not months else Val(F.lit(None).cast("long"), INT, F.lit("type_error"))
    text = v.col.cast("string")
    n, months, ms = duration_parts(text)
    days = F.when(months >= 12, 365).otherwise(30)
    out = (n * F.coalesce(ms, days.cast("long") * UNIT_MS["d"])).cast("long")
    out = F.when(months.isNotNull() | ms.isNotNull(), out)
    return Val(out, INT, either(v.err, F.when(out.isNull(), F.lit("type_error"))))


@function("cel view", "duration")
def duration_(c, target, args):
    v, _ = subject(target, args)
    if isinstance(v.const, str):
        months, ms = parse_duration(v.const)
        return Val(duration(F.lit(months), F.lit(ms)), DURATION, const=(months, ms))
    return Val(duration(F.lit(0), c.number(v).col.cast("long")), DURATION, v.err)


def as_time(c, v: Val) -> Val:
    """A text as the timestamp or date it holds."""
    if v.kind.name in ("date", "timestamp"):
        return v
    ts = F.try_to_timestamp(v.col.cast("string"))
    return Val(ts, TIMESTAMP, v.err)


@function("cel plain view", "now")
def now(c, target, args):
    return Val(F.to_timestamp(F.lit(c.scope.now)), TIMESTAMP)


@function("cel plain view", "today")
def today(c, target, args):
    return Val(local_date(c, now(c, None, [])), DATE)


def local_date(c, v: Val):
    """The calendar day in the query's time zone."""
    if v.kind == DATE:
        return v.col
    if c.scope.timezone == "UTC":
        return v.col.cast("date")
    return F.from_utc_timestamp(v.col.cast("timestamp"), c.scope.timezone).cast("date")


@function("cel plain view", "date")
def date(c, target, args):
    v, _ = subject(target, args)
    if v.kind.name in ("date", "timestamp"):
        return Val(local_date(c, v), DATE, v.err)
    if c.grammar.name == "cel":  # a full date and nothing else
        col = F.when(F.rlike(v.col, F.lit(r"\A\d{4}-\d{2}-\d{2}\z")), v.col.try_cast("date"))
        return c.strict(col, DATE, v, why="not a date")
    col = F.regexp_extract(v.col, r"\A([^T ]*)", 1).try_cast("date")
    return Val(F.coalesce(col, F.lit("1970-01-01").cast("date")) if c.grammar.name == "view" else col, DATE, v.err)


@function("cel", "timestamp")
def timestamp(c, target, args):
    v = args[0]
    return v if v.kind == TIMESTAMP else c.strict(F.try_to_timestamp(v.col), TIMESTAMP, v, why="not a timestamp")


@function("plain", "datetime")
def datetime(c, target, args):
    return as_time(c, subject(target, args)[0])


@function("cel", "startOfDay")
def start_of_day(c, target, args):
    """First valid instant of the day in the query's zone: a gap at midnight moves forward."""
    v, _ = subject(target, args)
    return Val(F.to_utc_timestamp(local_date(c, as_time(c, v)).cast("timestamp"), c.scope.timezone), TIMESTAMP, v.err)


def _moved(unit):
    def run(c, target, args):
        v, rest = subject(target, args)
        v, n = as_time(c, v), rest[0].col.cast("int")
        months, ms = (F.lit(0), n.cast("long") * 86_400_000) if unit == "day" else (n * (12 if unit == "year" else 1), F.lit(0))
        from folioquery.plans.compiler import shift

        return shift(v, Val(duration(months, ms), DURATION, rest[0].err), 1)

    return run


function("cel", "addDays")(_moved("day"))
function("cel", "addMonths")(_moved("month"))
function("cel", "addYears")(_moved("year"))


@function("cel", "daysUntil")
def days_until(c, target, args):
    v, rest = subject(target, args)
    a, b = as_time(c, v), as_time(c, rest[0])
    return Val(F.datediff(local_date(c, b), local_date(c, a)).cast("long"), INT, errors(a, b))


def _part(f):
    def run(c, target, args):
        v, _ = subject(target, args)
        t = as_time(c, v)
        return Val(f(t.col).cast("long"), INT, t.err)

    return run


for _names, _f in (
    (("year", "getFullYear"), F.year), (("month",), F.month), (("day", "getDate"), F.dayofmonth),
    (("hour", "getHours"), F.hour), (("minute", "getMinutes"), F.minute), (("second", "getSeconds"), F.second),
):
    function("cel plain view", *_names)(_part(_f))
function("cel", "dayOfWeek")(_part(lambda d: F.weekday(d) + 1))  # Monday is 1
function("plain", "dayOfWeek")(_part(lambda d: F.dayofweek(d) - 1))  # Sunday is 0


@function("plain view", "time")
def time(c, target, args):
    v, _ = subject(target, args)
    t = as_time(c, v)
    return Val(F.date_format(t.col, "HH:mm:ss"), STRING, t.err)


@function("plain view", "format")
def format_(c, target, args):
    v, rest = subject(target, args)
    out = re.sub(r"\[([^\]]*)\]|YYYY|YY|MM|DD|HH|mm|SSS|ss|[A-Za-z]+", lambda m: f"'{m[1]}'" if m[1] is not None else FORMAT_TOKENS.get(m[0], f"'{m[0]}'"), str(rest[0].const))
    t = as_time(c, v)
    return Val(F.date_format(t.col, out), STRING, t.err)


@function("view", "relative")
def relative(c, target, args):
    """How long ago, in the largest whole unit."""
    v, _ = subject(target, args)
    t = as_time(c, v)
    ms = difference(now(c, None, []), t)
    size, out = F.abs(ms), F.lit("just now")
    for unit in ("minute", "hour", "day", "week"):
        n = F.floor(size / UNIT_MS[unit])
        words = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(size >= UNIT_MS[unit], F.when(ms >= 0, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words))).otherwise(out)
    return Val(F.when(t.col.isNotNull(), out), STRING, t.err)


@function("view", "humanize")
def humanize(c, target, args):
    v, _ = subject(target, args)
    if v.kind != DURATION:
        raise ExpressionError("a duration is expected")
    ms, out = F.abs(v.col["millis"]), F.lit("0 seconds")
    for unit in ("second", "minute", "hour", "day"):
        n = F.floor(ms / UNIT_MS[unit])
        out = F.when(ms >= UNIT_MS[unit], F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))).otherwise(out)
    return Val(out, STRING, v.err)


@function("cel plain view", "isDate")
def is_date(c, target, args):
    v, _ = subject(target, args)
    return Val(as_time(c, v).col.isNotNull(), BOOL, either(v.err, None))


@function("cel plain view", "milliseconds", "getMilliseconds")
def milliseconds(c, target, args):
    v, _ = subject(target, args)
    if v.kind == DURATION:
        return Val(v.col["millis"] + v.col["months"].cast("long") * (30 * UNIT_MS["d"]), INT, v.err)
    return literal(None)
