"""Checks of strict string formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import trimmed


def is_rfc3339_date(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & x.try_cast("date").isNotNull(), F.lit(False))


def is_rfc3339_time(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?\z"), F.lit(False))


def is_rfc3339(x: Column) -> Column:
    zone = r"(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])\z"
    return is_rfc3339_date(F.substring(x, 1, 10)) & F.coalesce(x.rlike(r"\A.{10}[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?" + zone), F.lit(False))


def is_bcp47(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A(?:[A-Za-z]{2,3}|[xi])(?:-[A-Za-z0-9]{1,8})*\z"), F.lit(False))


def normalize_utc_offset(x: Column) -> Column:
    """``UTC`` or ``±HH:MM``; null if it is no offset."""
    t = trimmed(x)
    pattern = r"\A([+-])([0-9]{1,2}?)(?::?([0-9]{2}))?\z"
    hour = F.coalesce(F.regexp_extract(t, pattern, 2).try_cast("int"), F.lit(99))
    minute = F.coalesce(F.regexp_extract(t, pattern, 3).try_cast("int"), F.lit(0))
    shaped = t.rlike(r"\A[+-](?:[0-9]{1,2}|[0-9]{4}|[0-9]{1,2}:[0-9]{2})\z")
    text = F.concat(F.substring(t, 1, 1), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    return F.when(F.lower(t).isin("utc", "z"), "UTC").when(shaped & (hour <= 23) & (minute <= 59), F.when((hour == 0) & (minute == 0), "UTC").otherwise(text))
