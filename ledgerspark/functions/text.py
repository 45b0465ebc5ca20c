"""Text expressions for usage events and report inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------------------
# Key fragments that mark a metadata key as sensitive (case-insensitive substring search).
SENSITIVE_KEY_PATTERN = (
    r"(password|pass|token|secret|api[_-]?key|auth|credential|session|cookie|"
    r"card|cvv|pin|ssn|account|routing|iban|bank)"
)
# Six or more digits, optionally separated by spaces or dashes.
DIGIT_BLOB_PATTERN = r"\b(?:\d[ -]*?){6,}\b"
# Something shaped like an e-mail address.
EMAIL_PATTERN = r"\b[^@\s]+@[^@\s]+\.[^@\s]+\b"
# Control characters replaced by a space before whitespace is collapsed.
CONTROL_PATTERN = r"[\x00-\x1f\x7f]"
# Metadata keys holding a search term.
SEARCH_KEYS = ("query", "term", "search", "search_term")
REDACTED = "[redacted]"
# ---------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c, limit: int = 120) -> Column:
    """control chars -> space, collapse whitespace, trim, cut to ``limit`` characters."""
    s = F.regexp_replace(_col(c), CONTROL_PATTERN, " ")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.substring(s, 1, limit)


def normalize_key(c) -> Column:
    """clean(64), lower, [^a-z0-9_]+ -> '_', collapse '_', strip '_'."""
    s = F.lower(clean_text(c, 64))
    s = F.regexp_replace(s, r"[^a-z0-9_]+", "_")
    s = F.regexp_replace(s, r"_+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def is_sensitive_key(c) -> Column:
    """F16: substring match of a sensitive fragment (so `shipping`, `author` match too)."""
    return F.coalesce(_col(c).rlike("(?i)" + SENSITIVE_KEY_PATTERN), F.lit(False))


def looks_sensitive_text(c) -> Column:
    """a run of >= 6 digits (spaces/dashes allowed) or an e-mail address."""
    t = _col(c)
    return F.coalesce(t.rlike(DIGIT_BLOB_PATTERN) | t.rlike(EMAIL_PATTERN), F.lit(False))


def redact_text(c, limit: int = 120) -> Column:
    """Clean a free-text column and replace it by ``[redacted]`` when it looks sensitive."""
    cleaned = clean_text(c, limit)
    return F.when(looks_sensitive_text(cleaned), F.lit(REDACTED)).otherwise(cleaned)


def split_list(c) -> Column:
    """comma-split, trim, drop blanks, order-preserving dedupe."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def parse_list(value) -> list[str]:
    """F23 for an argument (driver-side parameter, not data)."""
    if value is None:
        return []
    items = value.split(",") if isinstance(value, str) else list(value)
    out: list[str] = []
    for item in items:
        text = str(item).strip()
        if text and text not in out:
            out.append(text)
    return out
