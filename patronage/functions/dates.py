"""Business-calendar columns. Reporting runs on Asia/Bangkok days."""
import datetime as dt

from pyspark.sql import Column, functions as F

TZ = "Asia/Bangkok"


def local_date(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, TZ).cast("date")


def period_key(day: Column, unit: str) -> Column:
    """Text key of a date: ``day``, ``week`` (its Monday) or ``month``."""
    if unit == "month":
        return F.date_format(day, "yyyy-MM")
    if unit == "week":
        return F.date_format(F.date_trunc("week", day), "yyyy-MM-dd")
    return F.date_format(day, "yyyy-MM-dd")


def day_range(start: str, end: str, compat: bool = False) -> tuple:
    """Inclusive date bounds. ``compat`` widens the start by one day (cut of a UTC instant)."""
    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    return (lo - dt.timedelta(days=1) if compat else lo), hi


def previous_range(start: str, end: str, compat: bool = False) -> tuple:
    """The equally long range that ends the day before ``start``."""
    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    span = (hi - lo).days + 1
    prev_lo, prev_hi = lo - dt.timedelta(days=span), lo - dt.timedelta(days=1)
    return (prev_lo - dt.timedelta(days=2) if compat else prev_lo), prev_hi


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def valid_date_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def source_year_month(paid_at: Column, occurred_at: Column) -> tuple:
    local = local_date(occurred_at)
    return F.year(F.coalesce(paid_at, local)), F.month(F.coalesce(paid_at, local))


def utc_bounds(start: str, end: str) -> tuple:
    """Instants of the first and last millisecond of an inclusive Bangkok day range."""
    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if lo > hi:
        raise ValueError("start is after end")
    first = dt.datetime.combine(lo, dt.time()) - dt.timedelta(hours=7)
    last = dt.datetime.combine(hi, dt.time(23, 59, 59, 999000)) - dt.timedelta(hours=7)
    return first.isoformat(sep=" ") + "Z", last.isoformat(sep=" ") + "Z"
