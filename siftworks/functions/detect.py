"""Shape detectors: does a value look like an email, a date, a phone, a number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the detectors understand it, for Java patterns.
SPACE = r"[\s\x{FEFF}]"

#: The date shapes.
DATE_SHAPES = [
    r"\d{4}-\d{2}-\d{2}([T ].*)?",
    r"\d{4}/\d{1,2}/\d{1,2}",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{1,2}-\d{1,2}-\d{2,4}",
    r"\d{1,2}\.\d{1,2}\.\d{2,4}",
    r"\d{1,2}[-\s][A-Za-z]{3,}[-\s]\d{4}",
]

#: Digits of a phone number.
PHONE_DIGITS = (7, 15)

#: Spellings of an absent value.
EMPTY_TOKENS = ["", "n/a", "na", "#n/a", "-", "--", "null", "none", "unknown", "nil", "undefined"]


#: An email address, and what is taken for an attempt at one.
EMAIL = r"(?U)^[^\s@\x{FEFF}]+@[^\s@\x{FEFF}]+\.[^\s@\x{FEFF}]+\z"
EMAIL_ATTEMPT = r"(?U)^[^\s@\x{FEFF}]+@[^\s@\x{FEFF}]+\z"

#: Fixed value: the characters of a phone number.
PHONE = r"^[+()\-.\s\d]+\z"

#: Fixed value: a number, with a dollar sign before it, a percent sign behind it and commas anywhere.
NUMERIC = r"^(?:[+-]?\$)?,*[+-]?,*\d[\d,]*(?:\.,*\d[\d,]*)?%?\z"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(value: Column) -> Column:
    """Without white space, Unicode's included, at both ends; most values have none there and skip the pattern."""
    clean = F.ascii(value).between(33, 126) & F.ascii(F.right(value, F.lit(1))).between(33, 126)
    return F.when(clean, value).otherwise(F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+\z", ""))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def looks_like_email(value: Column) -> Column:
    return value.contains("@") & value.rlike(EMAIL)


def looks_like_email_attempt(value: Column) -> Column:
    return value.contains("@") & value.rlike(EMAIL_ATTEMPT)


def looks_like_date(value: Column) -> Column:
    return value.rlike("^(?:" + "|".join(DATE_SHAPES) + r")\z")


def looks_like_phone(value: Column) -> Column:
    return value.rlike(PHONE) & F.length(digits(value)).between(*PHONE_DIGITS) & ~looks_like_date(value)


def looks_like_numeric(value: Column) -> Column:
    return value.rlike(NUMERIC)


def is_empty_token(value: Column, tokens: list[str] | None = None) -> Column:
    return F.lower(trim(value)).isin(*(EMPTY_TOKENS if tokens is None else tokens))
