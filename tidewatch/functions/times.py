"""Time column expressions. All timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds.cast("double") * 1_000_000).cast("bigint"))


def lenient(text: Column) -> Column:
    """Timestamp of a text, null when it cannot be read."""
    return F.try_to_timestamp(text.cast("string"))


def strict(text: Column) -> Column:
    """Timestamp of a text; unreadable text fails the job under ANSI mode."""
    return F.to_timestamp(text.cast("string"))


def iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), ISO_FORMAT)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def plus_hours(ts: Column, hours: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(int(round(hours * 3_600_000_000))))


def floor_div(number: Column, step: int) -> Column:
    """Integer floor division, also for negative numbers."""
    return ((number - F.pmod(number, F.lit(step))) / F.lit(step)).cast("bigint")


def grid_number(ts: Column, step_micros: int) -> Column:
    """Number of the first point of the calendar grid at or after ``ts``."""
    us = micros(ts)
    late = F.when(F.pmod(us, F.lit(step_micros)) > 0, F.lit(1)).otherwise(F.lit(0))
    return (floor_div(us, step_micros) + late).cast("bigint")


def grid_time(number: Column, step_micros: int) -> Column:
    return F.timestamp_micros(number * F.lit(step_micros))
