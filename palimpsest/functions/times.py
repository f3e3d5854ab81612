"""Instants as text: strict, lenient and offset forms, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_in_month(year: Column, month: Column) -> Column:
    """Days of a month; null for no month."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a date of the proleptic Gregorian calendar; days beyond a month run on into the next."""
    # years begin in March, so that the leap day comes last
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return (era * 146_097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719_468).cast("long")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("long")


_ZULU = r"\A(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})Z\z"


def lenient_epoch(text: Column) -> Column:
    """Seconds of ``YYYY-MM-DDTHH:MM:SSZ``; any day up to 31 and second up to 60 is taken, running on. Null for anything else."""
    y, mo, d, h, mi, s = (_number(text, _ZULU, k) for k in range(1, 7))
    ok = mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (s <= 60)
    return F.when(ok, days_from_civil(y, mo, d) * 86_400 + h * 3600 + mi * 60 + s)


_RFC3339 = r"\A(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(?:[Zz]|([+-])(\d{2}):(\d{2}))\z"


def rfc3339(text: Column) -> Column:
    """struct(seconds, nanos) of an RFC 3339 instant with offset and fraction; null for anything else, impossible dates included."""
    y, mo, d, h, mi, s = (_number(text, _RFC3339, k) for k in range(1, 7))
    oh, om = (F.coalesce(_number(text, _RFC3339, k), F.lit(0)) for k in (9, 10))
    offset = (oh * 3600 + om * 60) * F.when(F.regexp_extract(text, _RFC3339, 8) == "-", -1).otherwise(1)
    ok = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= days_in_month(y, mo)) & (h <= 23) & (mi <= 59) & (s <= 59) & (oh <= 23) & (om <= 59)
    nanos = F.rpad(F.regexp_extract(text, _RFC3339, 7), 9, "0").cast("int")
    return F.when(ok, F.struct((days_from_civil(y, mo, d) * 86_400 + h * 3600 + mi * 60 + s - offset).alias("seconds"), nanos.alias("nanos")))


def cutoff(text: Column) -> Column:
    """struct(revision_id, seconds, nanos): a run of digits is a revision's id, anything else an RFC 3339 instant; null for neither."""
    ident = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long"))
    at = rfc3339(text)
    return F.when(ident > 0, F.struct(ident.alias("revision_id"), F.lit(None).cast("long").alias("seconds"), F.lit(None).cast("int").alias("nanos"))).when(
        ident.isNull() & at.isNotNull(), F.struct(F.lit(None).cast("long").alias("revision_id"), at["seconds"].alias("seconds"), at["nanos"].alias("nanos"))
    )


def canonical(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of an instant; null outside the years 1 to 9999."""
    inside = seconds.between(-62_135_596_800, 253_402_300_799)
    return F.when(inside, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
