"""Date and time columns. Wall-clock times carry no zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Start hours of the two daily slots.
SLOT_HOURS = (10, 15)


def wall_clock(raw: Column) -> Column:
    """Text to a timestamp; text that is no time gives NULL instead of failing the job."""
    return F.try_to_timestamp(raw)


def iso_time(raw: Column) -> Column:
    """ISO-8601 text, with Z or an offset allowed; NULL for anything else."""
    looks_iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}.*)?)?$")
    return F.when(looks_iso, F.try_to_timestamp(F.when(
        raw.rlike(r"[T ]\d{2}$"), F.concat(raw, F.lit(":00"))).otherwise(raw)))


def truncated_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hours(n) -> Column:
    """A day-time interval of n hours; n may be a column."""
    return F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def at_hour(day: Column, hour) -> Column:
    return day.cast("timestamp_ntz") + hours(hour)


def slot_time(start_date: Column, rank: Column, slot_hours: tuple[int, ...] = SLOT_HOURS) -> Column:
    """Start of the rank-th slot (1-based) when each day has len(slot_hours) slots."""
    per_day = len(slot_hours)
    index = ((rank - 1) % per_day).cast("int")
    day = ((rank - 1 - index) / per_day).cast("int")
    hour = F.element_at(F.array(*[F.lit(h) for h in slot_hours]), index + 1)
    return at_hour(F.date_add(start_date, day), hour)


def iso_text(ts: Column) -> Column:
    """ISO text of a timestamp, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
