"""Text fields of the raw loan files -> typed values. Unusable text gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings.
NEW_WORDS = ("NEW BUSINESS", "STARTUP", "NEW", "2")
EXISTING_WORDS = ("EXISTING BUSINESS", "EXISTING", "1")
YES_WORDS = ("Y", "YES", "1", "TRUE", "REVOLVING")
MAX_EMPLOYEES = 9999


def _tidy(text: Column) -> Column:
    return F.upper(F.trim(text))


def trimmed(text: Column, length: int) -> Column:
    return F.substring(F.trim(text), 1, length)


def code2(text: Column) -> Column:
    """Two-letter code."""
    return F.upper(trimmed(text, 2))


def parse_date(text: Column) -> Column:
    """Month/day/year with a 4-digit year, or a text that starts with an ISO date.

    A 2-digit year has no certain century and gives NULL.
    """
    return F.when(
        text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\z"), F.try_to_date(text, "M/d/yyyy")
    ).when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
    )


def parse_year(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}\z"), text.try_cast("int"))


def _number(text: Column) -> Column:
    """Unsigned number, whole or with a decimal point."""
    return F.when(text.rlike(r"^[0-9]+(\z|\.)"), text.try_cast("decimal(28,8)"))


def _is_whole(text: Column) -> Column:
    return text.rlike(r"^[0-9]+\z")


def parse_term(text: Column) -> Column:
    """Months, rounded; 0 counts as missing."""
    return F.nullif(F.round(_number(text), 0).try_cast("int"), F.lit(0))


def parse_employees(text: Column) -> Column:
    number = F.round(_number(text), 0)
    return F.when(number.isNotNull(), F.least(number, F.lit(MAX_EMPLOYEES))).cast("int")


def parse_business_age(text: Column) -> Column:
    """2 = new, 1 = existing. Words decide first, then a plain number of years (new below 2)."""
    word = _tidy(text)
    years = F.trim(text).try_cast("decimal(28,8)")
    return (
        F.when(word.isin(*NEW_WORDS), 2)
        .when(word.isin(*EXISTING_WORDS), 1)
        .when(word.contains("NEW"), 2)
        .when(word.contains("EXIST"), 1)
        .when(text.rlike("^[0-9]") & (years < 2), 2)
        .when(text.rlike("^[0-9]") & (years >= 2), 1)
    )


def split_jobs(text: Column) -> Column:
    """Half of the supported jobs: whole numbers lose the odd job, decimals round; else 0."""
    number = _number(text)
    half = F.when(_is_whole(text), F.floor(number / 2)).otherwise(F.round(number / 2, 0))
    return F.coalesce(half.try_cast("int"), F.lit(0))


def parse_yes(text: Column) -> Column:
    return F.when(_tidy(text).isin(*YES_WORDS), "Y").otherwise("N")


def parse_low_doc(method: Column) -> Column:
    word = _tidy(method)
    return F.when(word.contains("LOWDOC") | word.contains("LOW DOC"), "Y").otherwise("N")


def parse_money(text: Column) -> Column:
    """Amount, perhaps with dollar signs and commas; a sign or any other text gives NULL.

    Charge-off amounts use the same rule: "0" is 0.00, and nothing but symbols is NULL.
    """
    digits = F.regexp_replace(text, "[$,]", "")
    return F.when(text.rlike(r"^[$,0-9.]+\z"), digits.try_cast("decimal(15,2)"))


def map_status(text: Column) -> Column:
    """PIF, CHGOFF, or NULL for loans that are open, cancelled or unknown; EXEMPT counts as PIF."""
    word = _tidy(text)
    return F.when(word.like("%PIF%") | word.like("%PAID%FULL%") | (word == "EXEMPT"), "PIF").when(
        word.like("%CHGOFF%") | word.like("%CHARGE%OFF%"), "CHGOFF"
    )
