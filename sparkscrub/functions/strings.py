"""Masking, case, replacing, removing and word handling on one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, WS_CLASS, drop_point_zero_of_two

_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
_EMAIL_PARTS = r"^([^@]{1,2})[^@]*@([^@\n]+)\n?\z"


def mask(text: Column, normalize_ints: bool = True, strict_compat: bool = False) -> Column:
    """Stars between the outer two (short text: one) characters on each side."""
    size = F.length(text)

    def edges(k: int) -> Column:
        return F.concat(F.left(text, F.lit(k)), F.repeat(F.lit("*"), size - 2 * k), F.right(text, F.lit(k)))

    def tidy(c: Column) -> Column:
        return drop_point_zero_of_two(c) if normalize_ints else c

    single = tidy(F.concat(text, text)) if strict_compat else F.lit("*")
    return F.when(size > 4, edges(2)).when(size > 2, edges(1)).when(size == 1, single).otherwise(tidy(text))


def is_maskable_email(text: Column) -> Column:
    return text.rlike(_EMAIL_PARTS)


def mask_email(text: Column) -> Column:
    """First two characters of the user part and the whole domain; other text is unchanged."""
    return F.regexp_replace(text, _EMAIL_PARTS, "$1***@$2")


def _plain_spaces(text: Column) -> Column:
    """Every white-space character as a space. Words are then cut at this one character: Spark
    compiles the pattern of a ``split`` again for every row unless it is a single character."""
    return F.translate(text, WHITESPACE, " " * len(WHITESPACE))


def single_spaced(text: Column) -> Column:
    """Words with one space between them and none around."""
    return F.regexp_replace(F.trim(_plain_spaces(text)), "  +", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(_plain_spaces(text), " "), lambda w: w != "")


def mask_words(text: Column) -> Column:
    def one(w: Column) -> Column:
        return F.concat(F.left(w, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.length(w) - 2, F.lit(0))))

    return F.array_join(F.transform(words(text), one), " ")


def title(text: Column) -> Column:
    """A capital after every character that has no case, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def find_replace(text: Column, find: str, replacement: str) -> Column:
    if not find:
        raise ValueError("the text to find must not be empty")
    return F.replace(text, F.lit(find), F.lit(replacement))


def remove_characters(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "") if characters else text


def keep_numeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.\-]+", "")


def keep_letters(text: Column) -> Column:
    return F.regexp_replace(text, rf"[^\p{{L}}{WS_CLASS}]+", "")


def split_last_word(spaced: Column) -> tuple[Column, Column]:
    """(all words but the last, last word) of single-spaced text; one word alone comes first."""
    blank = F.coalesce((spaced == "") | (F.lower(spaced) == "nan"), F.lit(True))
    several = F.contains(spaced, F.lit(" "))
    last = F.substring_index(spaced, " ", -1)
    rest = F.left(spaced, F.length(spaced) - F.length(last) - 1)
    return (
        F.when(blank, "").when(several, rest).otherwise(spaced),
        F.when(blank | ~several, "").otherwise(last),
    )


def literal_regex(text: str) -> str:
    """``text`` as a Java pattern that matches exactly itself; one character needs no compiling."""
    if len(text) == 1:
        return "\\" + text if text in r".$|()[{^?*+\\" else text
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
