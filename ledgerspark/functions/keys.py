"""Identifier and period keys: slug (F2), tx_id (F3), period keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.money import python_float_text


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(label, empty: str = "uncategorized") -> Column:
    """lower, runs of anything but [a-z0-9] -> '_', strip '_'; null/blank/empty -> ``empty``."""
    s = F.regexp_replace(F.lower(F.coalesce(_col(label), F.lit(""))), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


def tx_id(date="date", merchant="merchant", amount="amount", description="description") -> Column:
    """slug of ``date|merchant|amount|description`` cut to 64 characters.

    The amount is printed the way a Python float prints a two-decimal value (12.0, 45.5, 45.55).
    """
    raw = F.concat_ws(
        "|",
        F.date_format(_col(date), "yyyy-MM-dd"),
        F.coalesce(_col(merchant), F.lit("None")),
        python_float_text(_col(amount)),
        F.coalesce(_col(description), F.lit("None")),
    )
    return F.substring(slug(raw), 1, 64)


def month_key(date="date") -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def quarter_key(date="date") -> Column:
    return F.concat(F.date_format(_col(date), "yyyy"), F.lit("-Q"), F.quarter(_col(date)).cast("string"))


def year_key(date="date") -> Column:
    return F.date_format(_col(date), "yyyy")


def iso_week_key(date="date") -> Column:
    """ISO week ``YYYY-Www`` with the ISO week-numbering year."""
    d = _col(date)
    return F.concat(
        # the ISO year is the calendar year of the Thursday of the same ISO week
        F.year(F.date_add(d, F.lit(3) - F.weekday(d))).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def period_key(period: str, date="date") -> Column:
    """month ``YYYY-MM``, quarter ``YYYY-Qn``, year ``YYYY``, week ``YYYY-Www``."""
    if period == "month":
        return month_key(date)
    if period == "quarter":
        return quarter_key(date)
    if period == "year":
        return year_key(date)
    if period == "week":
        return iso_week_key(date)
    raise ValueError(f"unknown period {period!r}")


def month_label(date="date") -> Column:
    """F8: ``MMMM yyyy`` (e.g. ``January 2024``)."""
    return F.date_format(_col(date), "MMMM yyyy")
