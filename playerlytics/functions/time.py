"""Time columns of game events: epoch milliseconds, player time zones, periods.

Every expression here is independent of ``spark.sql.session.timeZone``: the UTC wall
clock is built as a ``TIMESTAMP_NTZ`` from the epoch value, so the calendar date is the
UTC date and the hour of day is the player's local hour whatever zone the caller's
session runs in. All of it stays JVM-side (built-in functions, no UDFs).
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Time zone used when an event carries none, and the parts of the day on
# the player's local clock as [start hour, end hour) windows; "night" wraps past
# midnight. Their order gives the part-of-day number 0..3.
DEFAULT_TIMEZONE = "+00:00"
PART_OF_DAY_WINDOWS = (
    ("morning", 5, 12),
    ("afternoon", 12, 17),
    ("evening", 17, 21),
    ("night", 21, 5),
)
PARTS_OF_DAY = tuple(name for name, _, _ in PART_OF_DAY_WINDOWS)

MS_PER_DAY = 86_400_000

_OFFSET_RE = re.compile(r"^(?:UTC|GMT|UT)?[+-](?:(?:0?\d|1[0-7])(?::[0-5]\d)?|18(?::00)?)$")


def utc_wall_clock(epoch_ms: Column) -> Column:
    """Epoch milliseconds -> UTC wall clock as TIMESTAMP_NTZ (no session zone involved)."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_add("MILLISECOND", epoch_ms, epoch)


def date_of(wall_clock: Column) -> Column:
    """Calendar date of a TIMESTAMP_NTZ wall clock."""
    return wall_clock.cast("date")


def date_from_epoch_ms(epoch_ms: Column) -> Column:
    """UTC calendar date of an epoch-millisecond value."""
    return date_of(utc_wall_clock(epoch_ms))


def datetime_text(wall_clock: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a wall clock (sub-second part dropped)."""
    return F.date_format(wall_clock, "yyyy-MM-dd HH:mm:ss")


def clean_timezone(tz: Column) -> Column:
    """``+02.00`` -> ``+02:00``; a missing zone becomes UTC."""
    return F.coalesce(F.regexp_replace(tz, r"\.", ":"), F.lit(DEFAULT_TIMEZONE))


def valid_timezone(tz: Column) -> Column:
    """True when ``tz`` is a zone that Spark resolves: an offset up to 18 hours, or an id of its zone rules.

    Used only by the opt-in ``on_bad_timezone="utc"`` mode; the default mode lets Spark
    raise on an unknown zone, as the batch jobs always did.
    """
    zones = SparkSession.active()._jvm.java.time.ZoneId
    ids = sorted({*zones.getAvailableZoneIds(), *zones.SHORT_IDS.keySet(), "Z"})
    return tz.rlike(_OFFSET_RE.pattern) | tz.isin(ids)


def local_hour(utc_clock: Column, tz: Column) -> Column:
    """Hour of day on the player's local clock."""
    return F.hour(F.convert_timezone(F.lit("UTC"), tz, utc_clock))


def part_of_day(hour: Column) -> Column:
    """Local hour -> morning / afternoon / evening / night; null for null."""
    out = None
    for name, start, end in PART_OF_DAY_WINDOWS:
        if start < end:
            cond = (hour >= start) & (hour < end)
        else:
            cond = (hour >= start) | (hour < end)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def part_of_day_number(pod: Column) -> Column:
    """Part-of-day label -> 0..3 in ``PARTS_OF_DAY`` order; anything else -> null."""
    out = None
    for i, name in enumerate(PARTS_OF_DAY):
        cond = pod == F.lit(name)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def day_of_week(d: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(d)


def cod_month(d: Column) -> Column:
    """Date -> ``yyyyMM`` text."""
    return F.date_format(d, "yyyyMM")


# ---------------------------------------------------------------------------------------
# Month ranges (driver-side parameters, turned into literal predicates that prune).


def _parse_month(text: str) -> tuple[int, int]:
    text = str(text)
    if not re.fullmatch(r"\d{6}", text):
        raise ValueError(f"month must be yyyyMM, got {text!r}")
    year, month = int(text[:4]), int(text[4:])
    if not 1 <= month <= 12:
        raise ValueError(f"month must be 01..12, got {text!r}")
    return year, month


@dataclass(frozen=True)
class MonthRange:
    """Inclusive ``yyyyMM`` range, validated (month 01..12, from <= to)."""

    from_month: str
    to_month: str

    def __post_init__(self):
        a, b = _parse_month(self.from_month), _parse_month(self.to_month)
        if a > b:
            raise ValueError(f"empty month range {self.from_month}..{self.to_month}")

    @classmethod
    def one(cls, month: str) -> "MonthRange":
        return cls(str(month), str(month))

    @property
    def first_day(self) -> date:
        y, m = _parse_month(self.from_month)
        return date(y, m, 1)

    @property
    def last_day(self) -> date:
        y, m = _parse_month(self.to_month)
        return date(y, m, calendar.monthrange(y, m)[1])

    @property
    def codes(self) -> tuple[int, int]:
        return int(self.from_month), int(self.to_month)

    def epoch_ms_bounds(self) -> tuple[int, int]:
        """[first instant, first instant after) of the range, epoch ms (UTC)."""
        lo = datetime.combine(self.first_day, datetime.min.time(), tzinfo=timezone.utc)
        hi = datetime.combine(self.last_day + timedelta(days=1), datetime.min.time(), tzinfo=timezone.utc)
        return int(lo.timestamp()) * 1000, int(hi.timestamp()) * 1000

    def date_filter(self, d: Column) -> Column:
        """Inclusive month range on a date column (prunes ``date`` partitions)."""
        return d.between(F.lit(self.first_day), F.lit(self.last_day))

    def code_filter(self, code: Column) -> Column:
        """Inclusive month range on a ``yyyyMM`` column (int or text)."""
        lo, hi = self.codes
        return code.cast("int").between(lo, hi)


def days_in_month(month: str) -> int:
    y, m = _parse_month(month)
    return calendar.monthrange(y, m)[1]


def month_code(d: date) -> str:
    return f"{d.year:04d}{d.month:02d}"
