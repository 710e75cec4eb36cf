"""Blanking secrets in attribute values and attribute JSON."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

BLANK = "[REDACTED]"

# Attribute names that always hold secrets, and shapes of secrets.
SENSITIVE_KEYS = (
    "password",
    "passwd",
    "secret",
    "token",
    "api_key",
    "access_key",
    "secret_key",
    "authorization",
    "credential",
    "private_key",
    "session_id",
)
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9_\-]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)bearer\s+[A-Za-z0-9._\-]{8,}",
    r"AIza[0-9A-Za-z_\-]{20,}",
    r"ghp_[A-Za-z0-9]{20,}",
    r"xox[baprs]-[A-Za-z0-9\-]{10,}",
)

# Java's \s is ASCII and Python's is Unicode; (?U) makes them agree, and is
# confined to the one pattern that uses \s.
_JAVA_PATTERNS = tuple(
    f"(?:{p.replace('(?i)', '(?iU)')})" if r"\s" in p else f"(?:{p})" for p in SECRET_PATTERNS
)


def plain_key(key: str) -> str:
    return re.sub("[^a-z0-9]", "", key.lower())


def key_is_sensitive(key: Column, extra: Iterable[str] = ()) -> Column:
    """Whether an attribute name contains a denied word, punctuation ignored."""

    plain = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    words = sorted({plain_key(w) for w in (*SENSITIVE_KEYS, *extra)})
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(plain, w))


def looks_secret(value: Column, extra: Iterable[str] = ()) -> Column:
    """Whether a text contains a secret anywhere (``extra``: Java regexes)."""

    return value.rlike("|".join((*_JAVA_PATTERNS, *(f"(?:{p})" for p in extra))))


def redact_value(value: Column, extra: Iterable[str] = ()) -> Column:
    """The value, or the placeholder in place of all of it."""

    return F.when(looks_secret(value, extra), F.lit(BLANK)).otherwise(value)


def redact_map(attributes: Column, extra_keys: Iterable[str] = (), extra: Iterable[str] = ()) -> Column:
    """A flat ``map<string,string>`` with sensitive entries blanked."""

    keys, patterns = tuple(extra_keys), tuple(extra)
    return F.transform_values(
        attributes,
        lambda k, v: F.when(key_is_sensitive(k, keys), F.lit(BLANK)).otherwise(
            redact_value(v, patterns)
        ),
    )


def redact_json(
    attributes: Column,
    extra_keys: Iterable[str] = (),
    extra_patterns: Iterable[str] = (),
    nested_lists: bool = True,
) -> Column:
    """Attribute JSON of any nesting, with sensitive values blanked.

    JSON of unknown depth needs a walk, so this is an Arrow UDF; but a text that
    cannot contain anything sensitive is passed by on the JVM side and reaches
    Python as NULL. The test errs on the safe side: a denied key survives in the
    text stripped of punctuation, a secret value matches as it stands, and a
    backslash may hide either.

    ``nested_lists=False`` leaves a list directly inside a list alone, as
    stored data from older emitters had it. ``extra_patterns`` are Python
    regexes; they switch the JVM test off, since Java may read them differently.
    Numbers of any length stay as they are. A text that cannot be walked (nested
    too deeply, or not valid Unicode) is blanked whole, since it cannot be called
    clean, and so is one that begins like JSON, does not parse, and names a denied
    key: another reader may be less strict.
    """

    extra_keys, extra_patterns = tuple(extra_keys), tuple(extra_patterns)
    walk = _json_redactor(extra_keys, extra_patterns, nested_lists)
    if extra_patterns:
        return walk(attributes)
    words = sorted({plain_key(w) for w in (*SENSITIVE_KEYS, *extra_keys)})
    if "" in words:
        return walk(attributes)
    stripped = F.regexp_replace(F.lower(attributes), "[^a-z0-9]", "")
    suspect = (
        F.contains(attributes, F.lit("\\"))
        | stripped.rlike("|".join(words))
        | looks_secret(attributes)
    )
    done = walk(F.when(suspect, attributes))
    return F.when(suspect, done).otherwise(attributes)


def _json_redactor(extra_keys, extra_patterns, nested_lists):
    # The closure names nothing of this module but values, so workers can run it
    # without having the package installed.
    words = tuple(sorted({plain_key(w) for w in (*SENSITIVE_KEYS, *extra_keys)}))
    shapes = tuple(re.compile(p) for p in (*SECRET_PATTERNS, *extra_patterns))
    blank, dropped = BLANK, re.compile("[^a-z0-9]")

    def is_denied(key):
        plain = dropped.sub("", key.lower())
        return any(w in plain for w in words)

    def clean(value):
        if isinstance(value, str):
            return blank if any(s.search(value) for s in shapes) else value
        if isinstance(value, dict):
            return {k: blank if is_denied(k) else clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [v if isinstance(v, list) and not nested_lists else clean(v) for v in value]
        return value

    def clean_text(text):
        if text is None:
            return None
        # Python reads no more than so many digits as a number; longer ones stand aside.
        aside = {}

        def number(digits):
            if len(digits) <= 4000:
                return int(digits)
            name = uuid.uuid4().hex
            aside[name] = digits
            return name

        try:
            done = json.dumps(clean(json.loads(text, parse_int=number)), ensure_ascii=False)
            done.encode()  # a lone surrogate has no UTF-8
        except (RecursionError, UnicodeError):
            return blank
        except json.JSONDecodeError:
            if text.lstrip()[:1] in ("{", "[") and is_denied(text):
                return blank
            # Not JSON: treat it as one value.
            return clean(text)
        except ValueError:
            return blank
        for name, digits in aside.items():
            done = done.replace(f'"{name}"', digits)
        return done

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(clean_text, na_action="ignore")

    return redact
