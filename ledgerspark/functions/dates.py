"""Parameter date arithmetic: comparison ranges (F9), clamped month steps (F10) and the
dashboard's quick ranges (P14). These work on arguments, not on data."""

from __future__ import annotations

import calendar
from datetime import date, timedelta


def as_date(value) -> date | None:
    if value is None or value == "":
        return None
    if isinstance(value, date):
        return value
    return date.fromisoformat(str(value)[:10])


def add_months(d: date, months: int) -> date:
    """add calendar months, clamping the day to the target month's length."""
    idx = d.year * 12 + (d.month - 1) + months
    year, month = divmod(idx, 12)
    month += 1
    return date(year, month, min(d.day, calendar.monthrange(year, month)[1]))


def comparison_range(start, end, mode: str | None):
    """``previous_period`` = same number of days ending the day before ``start``;
    ``same_period_last_year`` = both ends one year back (Feb 29 clamps to Feb 28, D3)."""
    if not mode:
        return None
    ends = (as_date(start), as_date(end))
    if mode == "same_period_last_year":
        return tuple(add_months(d, -12) for d in ends)
    if mode == "previous_period":
        back = ends[1] - ends[0] + timedelta(days=1)  # shift both ends by the length of the range
        return tuple(d - back for d in ends)
    raise ValueError(f"invalid comparison mode {mode!r}")


def quick_range(name: str, as_of) -> tuple[date | None, date | None]:
    """Named ranges relative to ``as_of``."""
    today = as_date(as_of)
    if name == "all_time":
        return None, None
    if name == "last_week":
        return today - timedelta(days=7), today
    if name == "current_month":
        return today.replace(day=1), today
    if name == "ytd":
        return date(today.year, 1, 1), today
    months = {"last_1m": 1, "last_3m": 3, "last_6m": 6, "last_1y": 12}
    if name in months:
        return add_months(today, -months[name]), today
    if name.startswith("month_"):
        _, y, m = name.split("_")
        first = date(int(y), int(m), 1)
        return first, date(first.year, first.month, calendar.monthrange(first.year, first.month)[1])
    raise ValueError(f"unknown range {name!r}")
