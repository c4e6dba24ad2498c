"""Time columns. Exact time is ``ts_ns``: nanoseconds since 1970 as LONG, NULL when an event is undated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainspan import model
from chainspan.functions.text import bound, trimmed

NS = 1_000_000_000
# Seconds that still fit a LONG of nanoseconds.
MAX_SECONDS = 9_223_372_035
# 100 ns ticks between 1601-01-01 and 1970-01-01.
FILETIME_EPOCH_TICKS = 116_444_736_000_000_000

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def whole_div(c: Column, n: int) -> Column:
    """Floor division that stays in LONG; ``/`` would go through DOUBLE and lose digits."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def epoch_ns(c: Column) -> Column:
    """Zone-less timestamp -> nanoseconds since 1970 (the session zone plays no part); NULL outside the years of a LONG."""
    return F.try_multiply(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c.cast("timestamp_ntz")), F.lit(1000))


def ns_to_timestamp(ns: Column) -> Column:
    """Nanoseconds -> zone-less timestamp, cut to the microsecond Spark can hold."""
    return F.timestamp_add("MICROSECOND", whole_div(ns, 1000), F.expr(_EPOCH))


_CLOCK = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?$"


def coerce_timestamp(c: Column) -> Column:
    """Text or number -> ``ts_ns``; NULL when it is not a time (or one outside the years 1678 to 2261).

    Whole numbers are seconds, or milliseconds above 1e11. Text is a date and a time parted by ``T`` or a blank,
    an optional fraction, and an optional zone (UTC when missing).
    """
    return bound(bound(c.cast("string"), trimmed), _text_ns)


def _text_ns(v: Column) -> Column:
    number = v.try_cast("long")
    unit = F.when(number > model.MILLIS_THRESHOLD, F.lit(1_000_000)).otherwise(F.lit(NS))
    zone = F.coalesce(F.nullif(F.regexp_extract(v, r"(Z|[+-]\d{2}:\d{2})$", 1), F.lit("")), F.lit("Z"))
    seconds = F.unix_seconds(F.concat(F.left(v, F.lit(19)), zone).try_cast("timestamp"))
    fraction = F.rpad(F.left(F.regexp_extract(v, r":\d{2}[.,](\d+)", 1), F.lit(9)), 9, "0").cast("long")
    clock = F.when(v.rlike(_CLOCK), F.try_add(F.try_multiply(seconds, F.lit(NS)), fraction))
    return F.coalesce(F.try_multiply(number, unit), clock)


def reads_as_time(c: Column) -> Column:
    """Whether text or a timestamp is well-formed, also where its nanoseconds do not fit a LONG."""
    def reads(v: Column) -> Column:
        day = F.left(v, F.lit(19)).try_cast("timestamp_ntz").isNotNull()
        return F.coalesce(v.try_cast("long").isNotNull() | (v.rlike(_CLOCK) & day), F.lit(False))

    return bound(bound(c.cast("string"), trimmed), reads)


def filetime_to_ns(c: Column) -> Column:
    """100 ns ticks since 1601 -> ``ts_ns``; zero means undated."""
    limit = MAX_SECONDS * 10_000_000
    in_range = (c != 0) & c.between(FILETIME_EPOCH_TICKS - limit, FILETIME_EPOCH_TICKS + limit)
    return (F.when(in_range, c) - F.lit(FILETIME_EPOCH_TICKS)) * F.lit(100)


OUT_OF_RANGE = "time out of range"


def filetime_problem(c: Column) -> Column:
    """Why ticks have no ``ts_ns`` although they are not zero; NULL where nothing is wrong."""
    return F.when(c.isNotNull() & (c != 0) & filetime_to_ns(c).isNull(), OUT_OF_RANGE)


def utc_text(ns: Column) -> Column:
    """``2024-01-02T03:04:05.000000006Z`` with nine digits: the rendering identity hashes are built on."""
    frac = F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0")
    return F.concat(F.date_format(ns_to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), frac, F.lit("Z"))


_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": NS, "m": 60 * NS, "h": 3600 * NS}
_PART = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"


def parse_duration(c: Column) -> Column:
    """``1h30m``, ``90s``, ``1.5h``, ``-5m`` -> nanoseconds; NULL when it is not a duration. Blank is 0."""
    v = trimmed(c)
    good = v.rlike(rf"^[+-]?(?:{_PART})+$")
    numbers = F.regexp_extract_all(v, F.lit(_PART), F.lit(1))
    units = F.regexp_extract_all(v, F.lit(_PART), F.lit(2))
    table = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    total = F.aggregate(
        F.arrays_zip(numbers.alias("n"), units.alias("u")),
        F.lit(0).cast("double"),
        lambda acc, x: acc
        + F.coalesce(F.concat(F.lit("0"), x["n"]).try_cast("double"), F.lit(0.0)) * F.element_at(table, x["u"]),
    )
    signed = F.when(v.startswith("-"), -total).otherwise(total)
    return F.when((v == "") | v.rlike(r"^[+-]?0$"), F.lit(0)).when(good & (total < 9.2e18), signed.try_cast("long"))


def duration_text(ns: Column) -> Column:
    """Nanoseconds in the form ``1h2m3.5s``, ``5m0s``, ``250ms``, ``0s``."""

    def decimal(value: Column, unit: int) -> Column:
        whole = whole_div(value, unit).cast("string")
        width = len(str(unit)) - 1
        frac = F.rtrim(F.lpad(F.pmod(value, F.lit(unit)).cast("string"), width, "0"), F.lit("0"))
        return F.when(frac == "", whole).otherwise(F.concat(whole, F.lit("."), frac))

    a = F.abs(ns)
    hours = whole_div(a, 3600 * NS)
    minutes = whole_div(F.pmod(a, F.lit(3600 * NS)), 60 * NS)
    seconds = F.concat(decimal(F.pmod(a, F.lit(60 * NS)), NS), F.lit("s"))
    text = (
        F.when(a == 0, F.lit("0s"))
        .when(a < 1_000, F.concat(a.cast("string"), F.lit("ns")))
        .when(a < 1_000_000, F.concat(decimal(a, 1_000), F.lit("µs")))
        .when(a < NS, F.concat(decimal(a, 1_000_000), F.lit("ms")))
        .when(a < 60 * NS, seconds)
        .when(a < 3600 * NS, F.concat(minutes.cast("string"), F.lit("m"), seconds))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds))
    )
    return F.when(ns < 0, F.concat(F.lit("-"), text)).otherwise(text)
