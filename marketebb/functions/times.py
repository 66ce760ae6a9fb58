"""Calendar arithmetic on TIMESTAMP_NTZ columns.

Buckets are wall-clock values of one market zone. All helpers work on TIMESTAMP_NTZ and DATE
only, so no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "Asia/Tokyo"
US_PER_SECOND = 1_000_000
US_PER_DAY = 86_400 * US_PER_SECOND


def ntz(value: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def day(value: date | str) -> Column:
    """A DATE literal."""
    return F.lit(str(value)).cast("date")


def hour_floor(ts: Column) -> Column:
    return day_floor(ts) + F.make_dt_interval(hours=F.hour(ts))


def hours_floor(ts: Column, width: int) -> Column:
    """Floor to a multiple of ``width`` hours counted from midnight."""
    return day_floor(ts) + F.make_dt_interval(hours=(F.floor(F.hour(ts) / width) * width).cast("int"))


def minutes_floor(ts: Column, width: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(width * 60 * US_PER_SECOND)))


def day_floor(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def monday_of(d: Column) -> Column:
    """Monday of the week of a date; Sunday belongs to the week before."""
    as_date = d.cast("date")
    return F.date_sub(as_date, F.weekday(as_date))


def month_start(d: Column) -> Column:
    return F.trunc(d.cast("date"), "month")


def same_day(a: Column, b: Column) -> Column:
    return a.cast("date") == b.cast("date")


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of the same wall clock."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * US_PER_SECOND).cast("long")
    return (
        F.unix_date(ts.cast("date")).cast("long") * F.lit(US_PER_DAY)
        + seconds.cast("long") * F.lit(US_PER_SECOND)
        + fraction
    )


def from_micros(us: Column) -> Column:
    """Inverse of :func:`micros`."""
    return plus_micros(ntz("1970-01-01 00:00:00"), us)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.expr("INTERVAL '1' SECOND") * seconds


def plus_micros(ts: Column, us: Column) -> Column:
    return ts + F.expr("INTERVAL '0.000001' SECOND") * us


def seconds_floor(ts: Column) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(US_PER_SECOND)))


def from_epoch(seconds: Column, zone: str = MARKET_ZONE) -> Column:
    """Unix seconds to the wall clock of ``zone``."""
    utc = plus_seconds(ntz("1970-01-01 00:00:00"), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def align_up(ts: Column, slot_minutes: int) -> Column:
    """Next multiple of the slot; a time already on a slot stays; 0 switches alignment off."""
    if slot_minutes <= 0:
        return ts
    slot = slot_minutes * 60 * US_PER_SECOND
    us = micros(ts)
    return from_micros(us + F.pmod(-us, F.lit(slot)))


def parse_time(text: Column) -> Column:
    """RFC 3339, or a date, or 'date time' (both read as UTC); anything else is NULL."""
    rfc = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    plain_day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    plain_time = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    return (
        F.when(rfc, text.try_cast("timestamp"))
        .when(plain_day, F.concat(text, F.lit(" 00:00:00Z")).try_cast("timestamp"))
        .when(plain_time, F.concat(text, F.lit("Z")).try_cast("timestamp"))
    )


def format_rfc3339(ts: Column, zone: str = MARKET_ZONE) -> Column:
    """TIMESTAMP_NTZ of ``zone`` to RFC 3339 text; the offset is that of the zone at that time."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    minutes = ((micros(ts) - micros(utc)) / (60 * US_PER_SECOND)).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.when(minutes == 0, F.lit("Z")).otherwise(
        F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), offset)


# --- bucket arguments for a given "now" (plain values, so partition filters stay constant) ---


def current_hour(now: datetime) -> datetime:
    return now.replace(minute=0, second=0, microsecond=0)


def yesterday(now: datetime) -> date:
    return now.date() - timedelta(days=1)


def monday(d: date | datetime) -> date:
    d = d.date() if isinstance(d, datetime) else d
    return d - timedelta(days=d.weekday())


def last_full_week(now: datetime) -> date:
    """Monday of the last week that is over."""
    return monday(now) - timedelta(days=7)


def last_month(now: datetime) -> date:
    return (now.date().replace(day=1) - timedelta(days=1)).replace(day=1)


def next_month(month: date) -> date:
    return (month.replace(day=28) + timedelta(days=4)).replace(day=1)
