"""Column expressions (F1-F23). Everything here returns a ``Column`` and stays JVM-side,
except ``sanitize_metadata`` (X1), an Arrow-batched pandas UDF."""

from ledgerspark.functions.keys import (
    iso_week_key, month_key, month_label, period_key, quarter_key, slug, tx_id, year_key,
)
from ledgerspark.functions.money import (
    amount_bucket, cents, currency_text, loose_amount, money, python_float_text, to_money,
)
from ledgerspark.functions.text import (
    clean_text, is_sensitive_key, looks_sensitive_text, normalize_key, split_list,
)

__all__ = [
    "amount_bucket", "cents", "clean_text", "currency_text", "is_sensitive_key", "iso_week_key",
    "looks_sensitive_text", "loose_amount", "money", "month_key", "month_label", "normalize_key",
    "period_key", "python_float_text", "quarter_key", "slug", "split_list", "to_money", "tx_id",
    "year_key",
]
