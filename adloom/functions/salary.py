"""Salary clean-up and extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.text import collapse

# What is cut out of a salary text, in this order.
PHONE = r"(?U)\b0\d{9,10}\b"
CALL_OR_TEXT = r"(?iU)Call or Text[^.]*"
MAIL = r"(?U)\S+@\S+"

# Fixed value: what a text must contain to count as a salary.
PLAUSIBLE = r"(?iUd)[£$€]|\d+.*(?:per|/|hour|day|week|month|year|annum|shift)"

# Amount and pay period.
AMOUNT = r"£\s?(\d+(?:,\d{3})*(?:\.\d+)?)"
BARE_AMOUNT = r"(\d+(?:,\d{3})*(?:\.\d+)?)"
PERIOD = r"\s*(?:per|/)\s*(hour|hr|day|week|month|annum|year|shift)"

# Searched one after the other, each over the whole text.
RANGE = rf"(?iU){AMOUNT}\s*-\s*{AMOUNT}{PERIOD}"
HALF_RANGE = rf"(?iU){AMOUNT}\s*-\s*{BARE_AMOUNT}{PERIOD}"
SINGLE = rf"(?iU){AMOUNT}{PERIOD}"


def salary_clean(text: Column) -> Column:
    """Cut contact data out of a salary text; empty if nothing like a salary is left."""
    rest = F.regexp_replace(text, PHONE, "")
    rest = F.regexp_replace(rest, CALL_OR_TEXT, "")
    rest = F.regexp_replace(rest, MAIL, "")
    return F.when(rest.rlike(PLAUSIBLE), collapse(rest)).otherwise(F.lit(""))


def salary_in(text: Column) -> Column:
    """The salary named in a text as `£a - £b per unit` or `£a per unit`, else empty."""
    found = F.coalesce(
        *[F.nullif(F.regexp_extract(text, rule, 0), F.lit("")) for rule in (RANGE, HALF_RANGE, SINGLE)]
    )
    optional_sign = rf"(?iU)^{AMOUNT}\s*-\s*£?\s?{BARE_AMOUNT}{PERIOD}$"
    spelled = F.regexp_replace(found, optional_sign, "£$1 - £$2 per $3")
    spelled = F.regexp_replace(spelled, rf"(?iU)^{AMOUNT}{PERIOD}$", "£$1 per $2")
    return F.when(text.contains("£"), F.coalesce(spelled, F.lit(""))).otherwise(F.lit(""))


def salary_or_extracted(salary: Column, description: Column) -> Column:
    """The salary itself, or the one named in the description where it is empty."""
    return F.when((salary == "") & (description != ""), salary_in(description)).otherwise(salary)
