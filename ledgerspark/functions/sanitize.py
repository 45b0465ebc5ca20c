"""Metadata sanitizing, the one Python UDF (Arrow-batched ``pandas_udf``).

Nested JSON with per-depth limits, key-order-dependent truncation and type-dependent rules is
not expressible with Spark's JSON functions without losing key order or value types, so each
batch of JSON strings goes through this small helper and comes back as canonical JSON text
(sorted keys, compact separators, ASCII escapes).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, partial
from itertools import islice

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import (
    CONTROL_PATTERN, DIGIT_BLOB_PATTERN, EMAIL_PATTERN, REDACTED, SEARCH_KEYS, SENSITIVE_KEY_PATTERN,
)

# fixed values: structure limits
MAX_DEPTH = 3
MAX_KEYS = 16
MAX_ITEMS = 8
TEXT_LIMIT = 120
KEY_LIMIT = 64

_control = re.compile(CONTROL_PATTERN)
_spaces = re.compile(r"\s+")
_sensitive_key = re.compile(SENSITIVE_KEY_PATTERN, re.IGNORECASE)
_digits = re.compile(DIGIT_BLOB_PATTERN)
_email = re.compile(EMAIL_PATTERN)
_non_key = re.compile(r"[^a-z0-9_]+")
_underscores = re.compile(r"_+")


def tidy(text: str, limit: int = TEXT_LIMIT) -> str:
    if text.isprintable() and "  " not in text:
        # no control characters and no whitespace but single ASCII spaces: nothing to collapse
        return text.strip()[:limit]
    return _spaces.sub(" ", _control.sub(" ", text)).strip()[:limit]


@lru_cache(maxsize=8192)
def _key_info(raw: str) -> tuple[str, bool]:
    k = _non_key.sub("_", tidy(raw, KEY_LIMIT).lower())
    k = _underscores.sub("_", k).strip("_")
    return k, bool(k and _sensitive_key.search(k))


def key_name(raw) -> str:
    return _key_info(str(raw))[0]


_any_digit = re.compile(r"\d")


def _suspicious(text: str) -> bool:
    if "@" in text and _email.search(text):
        return True
    return bool(_any_digit.search(text) and _digits.search(text))


def _plain(key: str | None, value):
    """A leaf: numbers and booleans as they are, text tidied or redacted; None leaves it out."""
    if not isinstance(value, str):
        return value
    text = tidy(value)
    if key in SEARCH_KEYS:
        hide = len(text) > 2 and _suspicious(text)
    else:
        hide = _suspicious(text) or bool(key and _sensitive_key.search(key))
    return REDACTED if text and hide else text or None


def _fields(obj: dict):
    """(clean key, sensitive, value) of the first MAX_KEYS fields that keep a name."""
    for raw, value in islice(obj.items(), MAX_KEYS):
        name, sensitive = _key_info(raw)
        if name:
            yield name, sensitive, value


def clean_tree(root):
    """The sanitized tree, built level by level: each level's values are placed into the containers
    that the level above made, and what lies below MAX_DEPTH is never visited."""
    top: list = []
    level = [(top.append, None, root)]
    for _ in range(MAX_DEPTH + 1):
        below = []
        for place, key, value in level:
            if isinstance(value, dict):
                made: dict = {}
                for name, sensitive, inner in _fields(value):
                    if sensitive:
                        made[name] = REDACTED
                    else:
                        below.append((partial(made.__setitem__, name), name, inner))
            elif isinstance(value, list):
                made = []
                below += [(made.append, key, inner) for inner in value[:MAX_ITEMS]]
            else:
                made = _plain(key, value)
            if made is not None:
                place(made)
        level = below
    return top[0] if top else None


@lru_cache(maxsize=65536)
def sanitize_json_text(text) -> str:
    """Raw metadata (JSON text, or a bare string) -> canonical sanitized JSON object text."""
    try:
        value = json.loads(text) if text else {}
    except (TypeError, ValueError):
        value = text
    if not isinstance(value, (dict, list, str)) and _suspicious(text):
        value = text  # a bare card or phone number is text, whether or not it reads as a number
    cleaned = clean_tree(value or {})
    if not isinstance(cleaned, dict):
        cleaned = {"value": cleaned}
    return json.dumps(cleaned, separators=(",", ":"), sort_keys=True)


@F.pandas_udf(T.StringType())
def sanitize_metadata(raw: pd.Series) -> pd.Series:
    """Arrow-batched metadata sanitizer."""
    return raw.map(sanitize_json_text)
