"""Date keys and schedules. Date keys are slices of ISO text, as in the stored documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(iso: Column) -> Column:
    return F.when(F.length(iso) < 10, F.lit("0000-00-00")).otherwise(F.substring(iso, 1, 10))


def iso_week_key(iso: Column) -> Column:
    day = F.to_date(F.substring(iso, 1, 10))
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-w"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def add_days(key: Column, days: int) -> Column:
    """A key that is no date stays as it is."""
    day = F.try_to_timestamp(key, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.date_format(F.date_add(day, days), "yyyy-MM-dd"), key)


def day_window(now: Column, offset: int = 0) -> tuple[Column, Column]:
    """[start, end) of the UTC day in epoch seconds; now is a timestamp."""
    start = F.unix_timestamp(F.date_trunc("day", now)) + 86400 * offset
    return start, start + 86400


def iso_seconds(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def deploy_quota(day: Column, monthly: Column) -> Column:
    """Deploys for a date: an even share of the month's, the first days taking the rest."""
    days = F.dayofmonth(F.last_day(day))
    share = F.floor(monthly / days)
    return (share + F.when(F.dayofmonth(day) - 1 < monthly % days, 1).otherwise(0)).cast("long")


def deploy_hours(quota: Column) -> Column:
    """Hours of a day for so many deploys, spread evenly."""
    return F.when(quota > 0, F.transform(F.sequence(F.lit(0).cast("long"), quota - 1), lambda i: F.floor(i * 24 / quota).cast("int"))).otherwise(F.array().cast("array<int>"))


def slot_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def human_date(iso: Column) -> Column:
    """The date and minute in words, in UTC; a dash for none, and text that is no time as it is."""
    at = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return F.when(iso.isNull() | iso.isin("", "—"), F.lit("—")).otherwise(F.coalesce(F.date_format(at, "MMMM dd, yyyy 'at' hh:mm a"), iso))
