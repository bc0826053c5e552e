"""Removal of social security and payment card numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[ -]", "")


def cards(text: Column) -> Column:
    """Runs of 13 to 19 digits, blanks and dashes between allowed, that pass the Luhn check."""
    return F.filter(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), lambda m: F.length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m)))


def scrub(text: Column) -> Column:
    no_ssn = F.regexp_replace(text, SSN, "[REDACTED:ssn_pattern]")
    return F.aggregate(cards(no_ssn), no_ssn, lambda t, m: F.replace(t, m, F.lit("[REDACTED:credit_card_pattern]")))


def reasons(text: Column) -> Column:
    """Why a text would be redacted, in the order the checks run."""
    no_ssn = F.regexp_replace(text, SSN, "")
    return F.array_compact(F.array(F.when(text.rlike(SSN), "ssn_pattern"), F.when(F.size(cards(no_ssn)) > 0, "credit_card_pattern")))


def redact_quote(text: Column) -> Column:
    """A quote with any match is replaced whole, by the first reason."""
    why = reasons(text)
    return F.when(F.size(why) > 0, F.concat(F.lit("[REDACTED:"), F.element_at(why, 1), F.lit("]"))).otherwise(text)
