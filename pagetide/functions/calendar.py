"""Local calendar arithmetic for schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def midnight_utc(day: Column, zone: str) -> Column:
    """The moment a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def next_run(now: Column, frequency: Column, weekday: Column, time: Column, zone: str) -> Column:
    """The first moment after now that is the local time HH:MM, of any day or of that weekday (0: Monday)."""
    here = local(now, zone)
    day = F.to_date(here)
    at = lambda d: (F.unix_timestamp(d.cast("timestamp")) + F.split(time, ":")[0].cast("int") * 3600 + F.split(time, ":")[1].cast("int") * 60).cast("timestamp")
    first = F.when(frequency == "weekly", F.date_add(day, F.pmod(weekday - F.weekday(day), F.lit(7)))).otherwise(day)
    days = F.when(frequency == "weekly", F.lit(7)).when(frequency == "daily", F.lit(1)).otherwise(F.raise_error(F.lit("unknown frequency")).cast("int"))
    return F.to_utc_timestamp(F.when(at(first) > here, at(first)).otherwise(at(F.date_add(first, days))), zone)


def advanced(ts: Column, frequency: Column, zone: str, times: Column | int = 1) -> Column:
    """The same local time so many days or weeks later, whatever the clock did between."""
    days = F.when(frequency == "daily", F.lit(1)).otherwise(F.lit(7)) * times
    here = local(ts, zone)
    seconds = F.unix_timestamp(here) - F.unix_timestamp(F.to_date(here).cast("timestamp"))
    return F.to_utc_timestamp((F.unix_timestamp(F.date_add(F.to_date(here), days.cast("int")).cast("timestamp")) + seconds).cast("timestamp"), zone)


def missed_periods(next_run_at: Column, frequency: Column, now: Column, zone: str) -> Column:
    """How many periods from next_run_at on have begun by now: 0 if it lies ahead."""
    days = F.when(frequency == "daily", F.lit(1)).otherwise(F.lit(7))
    whole = F.floor((F.unix_timestamp(local(now, zone)) - F.unix_timestamp(local(next_run_at, zone))) / (days * 86400)).cast("int")
    guess = F.greatest(whole, F.lit(0))
    # A change of the clock can put the guess off by one.
    reached = F.when(advanced(next_run_at, frequency, zone, guess + 1) <= now, guess + 2).when(advanced(next_run_at, frequency, zone, guess) <= now, guess + 1).otherwise(guess)
    return F.when(next_run_at <= now, reached).otherwise(0)


def sync_window(now: Column, days: int) -> tuple[Column, Column]:
    """The closed period of dates that a sync asks for: it ends two days ago and begins so many days before."""
    end = F.date_sub(F.to_date(now), 2)
    return F.date_sub(end, days), end


def utc_iso(ts: Column) -> Column:
    """ISO 8601 with Z; microseconds only where there are any."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(""), F.lit("Z"))
