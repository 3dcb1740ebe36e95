"""One reason text per cell for each validation kind. Reasons starting with ``Valid``, and
``Allowed Domain``, mean the cell passed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domains import domain_reason
from .text import FLOAT_BARE, WS_CLASS, apart

_WORD = r"\p{L}\p{N}_"
# The user part starts with a word character.
EMAIL = rf"^[{_WORD}][{_WORD}.%+\-]{{0,63}}+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\z"
PHONE = rf"^\+?[0-9{WS_CLASS}\-()]{{7,20}}\z"
LETTERS = rf"^[\p{{L}}{WS_CLASS}]+\z"
URL = r"(?i)^[\x00-\x20]*https?://[^/?#]+"

# Date layouts accepted when the caller names none (a time of day may follow).
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
    "d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "M.d.yyyy", "d-M-yyyy", "M-d-yyyy",
    "d/M/yy", "M/d/yy", "d.M.yy", "d-M-yy",
    "d MMM yyyy", "d-MMM-yyyy", "MMM d yyyy", "MMM d, yyyy",
    "d MMMM yyyy", "MMMM d yyyy", "MMMM d, yyyy", "MMM yyyy", "MMMM yyyy",
    "yyyy-M", "d MMM, yyyy", "d MMMM, yyyy",
)
# Parts of a written date that layouts do without: the day of the week in front, "st" and the like after the
# day, the point after a month's short name, the fourth letter of "Sept".
_WEEKDAY = r"(?i)^(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.?,?[ ]+"
_ORDINAL = r"(?i)\b([0-9]{1,2})(?:st|nd|rd|th)\b"
_SHORT_MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:t\b)?\.(?= |,|\z)"
_SEPT = r"(?i)\bsept\b"
_TIME_OF_DAY = (
    r"(?i)[ T]+([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]{1,9})?)?"
    r"( ?[ap]m)?( ?(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?\z"
)


def is_good_reason(reason: Column) -> Column:
    return reason.startswith("Valid") | (reason == "Allowed Domain")


def checked(text: Column, bare: Column, name: str | None, reason: Column) -> Column:
    """``reason`` behind the tests every kind shares: header cell first, then empty."""
    empty = F.coalesce(bare, F.lit("")) == ""
    if name is None:
        return F.when(empty, "Empty").otherwise(reason)
    return F.when(text == F.lit(name), "Column Header").when(empty, "Empty").otherwise(reason)


# The checks below take text without white space at its ends.


def email_domain(bare: Column) -> Column:
    return F.lower(F.substring_index(bare, "@", -1))


def email_reason(
    bare: Column, domain: Column, hits: Sequence[Column], bad_format: str = "Invalid Format", *, generic: bool = True
) -> Column:
    """``hits``: is the domain's suffix known, is the domain allowed, is it blocked."""
    well_formed = ~F.contains(bare, F.lit("..")) & bare.rlike(EMAIL)
    return F.when(~well_formed, bad_format).otherwise(domain_reason(domain, *hits, generic=generic))


def phone_reason(bare: Column) -> Column:
    digits = F.length(F.regexp_replace(bare, r"\P{Nd}+", ""))
    return (
        F.when(~digits.between(7, 15), "Invalid Length")
        .when(~bare.rlike(PHONE), "Invalid Format")
        .otherwise("Valid")
    )


# What one or two digits of a layout letter may be.
_ONE_DIGIT_UP = {
    "d": "(0?[1-9]|[12][0-9]|3[01])", "M": "(0?[1-9]|1[0-2])",
    "H": "([01]?[0-9]|2[0-3])", "m": "[0-5]?[0-9]", "s": "[0-5]?[0-9]",
}
_TWO_DIGITS = {
    "d": "(0[1-9]|[12][0-9]|3[01])", "M": "(0[1-9]|1[0-2])",
    "H": "([01][0-9]|2[0-3])", "m": "[0-5][0-9]", "s": "[0-5][0-9]",
}


def _layout_shape(layout: str) -> str:
    """A pattern for the outline of text in a date layout. Text of another outline is never parsed:
    a failing parse costs far more than a failing match."""
    out = ""
    for part in re.finditer(r"([A-Za-z])\1*|'[^']*'|.", layout):
        token, letter, width = part.group(), part.group(1), len(part.group())
        if letter is None:
            out += re.escape(token.strip("'") if len(token) > 1 else token)
        elif letter in "aEG" or (letter in "ML" and width > 2):
            out += r"\p{L}+\.?"
        elif letter in "XxZzVO":
            out += r"[A-Za-z0-9:+\-/_]+"
        elif letter in "yu":
            out += "[0-9]{2}" if width == 2 else "[0-9]{4}"
        elif width == 1:
            out += _ONE_DIGIT_UP.get(letter, "[0-9]{1,2}")
        else:
            out += _TWO_DIGITS.get(letter, f"[0-9]{{{width}}}") if width == 2 else f"[0-9]{{{width}}}"
    return rf"^{out}\z"


def day_part(bare: Column) -> Column:
    """The text without a time of day at its end, and without what written dates add to a layout."""
    day = F.regexp_replace(bare, _TIME_OF_DAY, "")

    def written(text: Column) -> Column:
        text = F.regexp_replace(text, _WEEKDAY, "")
        text = F.regexp_replace(text, _ORDINAL, "$1")
        text = F.regexp_replace(text, _SHORT_MONTH, "$1")
        return F.regexp_replace(text, _SEPT, "Sep")

    # Dates in figures alone have no such parts.
    return F.when(day.rlike("[A-Za-z]"), apart(day, written)).otherwise(day)


def date_reason(day: Column, formats: Sequence[str]) -> Column:
    """Valid when one layout parses the whole text."""
    parsed = F.lit(False)
    for layout in formats:
        fits = day.rlike(_layout_shape(layout)) & F.try_to_timestamp(day, F.lit(layout)).isNotNull()
        parsed = parsed | fits
    return F.when(parsed, "Valid").otherwise("Invalid Format")


def numeric_reason(bare: Column) -> Column:
    return F.when(bare.rlike(FLOAT_BARE), "Valid").otherwise("Invalid Format")


def letters_reason(bare: Column, allow_digits: bool = False) -> Column:
    shape = LETTERS.replace(r"\p{L}", r"\p{L}\p{Nd}") if allow_digits else LETTERS
    return F.when(bare.rlike(shape), "Valid").otherwise("Invalid Character")


def url_reason(bare: Column) -> Column:
    return F.when(F.translate(bare, "\t\r\n", "").rlike(URL), "Valid").otherwise("Invalid Format")
