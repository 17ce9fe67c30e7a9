"""Text helpers: descriptions, substring tests, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What text redaction replaces, in order, as (pattern, replacement).
# Paths are looked for in their JSON-escaped spelling, with doubled backslashes.
REDACTIONS = (
    (r"""[A-Za-z]:\\\\[^\s"']+""", "<REDACTED_PATH>"),
    (r"""\\\\\\\\[A-Za-z0-9_.-]+\\\\[^\s"']+""", "<REDACTED_PATH>"),
    (r"""https?://[^\s"']*(?i:streamlit|upload|file_id=|widget)[^\s"']*""", "<REDACTED_URL>"),
    (r"""(?i)\b(?:file[_-]?id|widget[_-]?id)\b\s*[:=]\s*[^\s,;]+""", "<REDACTED_ID>"),
)

# A column whose name holds one of these is dropped outright.
SENSITIVE_NAMES = (
    "absolute_path",
    "upload_url",
    "file_id",
    "widget_id",
    "username",
    "machine",
    "hostname",
)


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive literal substring test; null counts as no match."""
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def describe(name: Column, memo: Column) -> Column:
    """``name | memo`` without dangling separators."""
    return F.btrim(F.concat(name, F.lit(" | "), memo), F.lit(" |"))


def redact(column: Column) -> Column:
    out = column
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, "(?U)" + pattern, replacement)
    return out
