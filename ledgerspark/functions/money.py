"""Money expressions: cents (F4), money (F5), amount cleaning (F11), currency text (F20),
amount buckets (F21), loose coercion (F22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.schema import MONEY


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_money(c) -> Column:
    """Any numeric or numeric text -> DECIMAL(18,2); unparsable -> NULL (ANSI-safe)."""
    return _col(c).try_cast(MONEY)


def cents(amount="amount") -> Column:
    """integer cents of a DECIMAL(18,2) amount; NULL -> 0. Exact (no float rounding)."""
    return F.coalesce((_col(amount) * 100).cast("bigint"), F.lit(0).cast("bigint"))


def money(cents_col) -> Column:
    """cents -> dollars as DOUBLE with two decimals."""
    return F.round(_col(cents_col).cast("double") / 100.0, 2)


def python_float_text(amount) -> Column:
    """Text of a DECIMAL(18,2) the way Python prints the equivalent float: 12.0, 45.5, 45.55."""
    return F.regexp_replace(_col(amount).cast(MONEY).cast("string"), r"(\.\d)0$", "$1")


def clean_amount(text, keep: str = "signed") -> Column:
    """amount text cleaning.

    ``signed``  keep digits, '-' and '.'                     (S1, S2, S4)
    ``parens``  keep digits and '.', '(...)' means negative (S3; a plain minus is lost)
    ``plain``   parse as is                                   (S5)
    Blank after cleaning -> NULL; unparsable -> NULL (callers decide skip vs. error).
    """
    t = _col(text)
    if keep == "signed":
        cleaned = F.regexp_replace(t, r"[^0-9.\-]", "")
    elif keep == "parens":
        digits = F.regexp_replace(t, r"[^0-9.]", "")
        neg = F.trim(t).startswith("(") & F.trim(t).endswith(")")
        cleaned = F.when(neg & (digits != ""), F.concat(F.lit("-"), digits)).otherwise(digits)
    elif keep == "plain":
        cleaned = F.trim(t)
    else:
        raise ValueError(keep)
    return F.when(cleaned == "", F.lit(None)).otherwise(cleaned).try_cast("double").try_cast(MONEY)


def currency_text(x) -> Column:
    """``$1,234.56``; NULL -> ``$0.00``."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(_col(x).cast("double"), F.lit(0.0)), 2))


def amount_bucket(amount="amount") -> Column:
    """bucket by absolute amount."""
    a = F.abs(_col(amount))
    return (F.when(a < 25, F.lit("under_25"))
            .when(a < 100, F.lit("under_100"))
            .when(a < 250, F.lit("under_250"))
            .otherwise(F.lit("250_plus")))


def loose_amount(text) -> Column:
    """strip '$' and ',', parse; bad -> 0.0."""
    cleaned = F.regexp_replace(F.trim(_col(text).cast("string")), r"[$,]", "")
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0))
