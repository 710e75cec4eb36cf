"""Timestamps and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed formats: ISO-8601, extended or basic. Spark's own cast also takes bare
# years, bare times and one-digit fields, which the span contract does not.
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{8})"
_CLOCK = r"(?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_ZONE = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
ISO_PATTERN = rf"^{_DATE}(?:[T ]{_CLOCK}{_ZONE}?)?$"
# What senders write nearly always, and Spark reads as it stands.
USUAL_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"

# Steps from any ISO form to the usual one, each a pattern and its replacement.
_TO_USUAL = (
    (r"^(\d{4})(\d{2})(\d{2})(?=[T ]|$)", "$1-$2-$3"),
    (r",", "."),
    (r"([T ])(\d{2})(\d{2})(\d{2})(?!\d)", "$1$2:$3:$4"),
    (r"([T ])(\d{2})(\d{2})(?!\d)", "$1$2:$3"),
    (r"([T ]\d{2})(?=[Z+-]|$)", "$1:00"),
    (r"([T ]\d{2}:\d{2})(?=[Z+-]|$)", "$1:00"),
    (r"^([0-9-]{10})$", "$1T00:00:00"),
    (r"^([^T ]+[T ][0-9:.]+)$", "$1Z"),
    (r"([T ][0-9:.]+[+-]\d{2})$", "$1:00"),
    (r"([T ][0-9:.]+[+-]\d{2})(\d{2})(\d{2})$", "$1:$2:$3"),
)

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to a UTC instant; NULL when it is not one.

    Text without an offset is UTC, whatever the session's time zone is.
    """

    usual = text
    for pattern, replacement in _TO_USUAL:
        usual = F.regexp_replace(usual, pattern, replacement)
    return F.when(text.rlike(USUAL_PATTERN), text.try_cast("timestamp")).when(
        text.rlike(ISO_PATTERN), usual.try_cast("timestamp")
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def own_duration_ms(duration: Column, start: Column, end: Column) -> Column:
    """A span's own time: the stored value, else end − start, else 0."""

    return F.coalesce(duration, (micros(end) - micros(start)) / F.lit(1000.0), F.lit(0.0))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)
