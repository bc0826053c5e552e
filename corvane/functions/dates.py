"""Date phrases of a closed world, half-life decay and date fit; as-of times are always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SEASON_START = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
TEMPLATES = ["in-month-year", "that-season-of-year", "before-year", "after-year", "in-year", "last-month", "around-month", "bare-month"]
PRODUCT_TEMPLATES = TEMPLATES[:-1]
_M, _S = "|".join(MONTHS), "|".join(SEASON_START)
PATTERNS = {
    "in-month-year": rf"\bin\s+({_M})\s+(\d{{4}})\b",
    "that-season-of-year": rf"\bthat\s+({_S})\s+of\s+(\d{{4}})\b",
    "before-year": r"\bbefore\s+(\d{4})\b",
    "after-year": r"\bafter\s+(\d{4})\b",
    "in-year": r"\bin\s+(\d{4})\b",
    "last-month": rf"\blast\s+({_M})\b",
    "around-month": rf"\baround\s+({_M})\b",
    "bare-month": rf"\b({_M})\b",
}


def _day(year: Column, month: Column) -> Column:
    """First of a month; month 0 and 13 are December and January next door."""
    return F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (month - 1).cast("int"))


def date_range(text: Column, as_of: Column, templates: list[str] = PRODUCT_TEMPLATES) -> Column:
    """struct(kind, from_date, to_date), half-open; the first template that matches wins, nulls for none."""
    text = F.lower(text)
    nothing = F.lit(None).cast("date")
    out = F.struct(F.lit(None).cast("string").alias("kind"), nothing.alias("from_date"), nothing.alias("to_date"))
    for kind in reversed([t for t in TEMPLATES if t in templates]):
        pattern = PATTERNS[kind]
        part = lambda i: F.regexp_extract(text, pattern, i)  # noqa: B023, E731
        month = F.array_position(F.array(*map(F.lit, MONTHS)), part(1)).cast("int")
        if kind in ("before-year", "after-year", "in-year"):
            year = part(1).cast("int")
            lo = {"before-year": nothing, "after-year": _day(year + 1, F.lit(1)), "in-year": _day(year, F.lit(1))}[kind]
            hi = {"before-year": _day(year, F.lit(1)), "after-year": nothing, "in-year": _day(year + 1, F.lit(1))}[kind]
        elif kind == "in-month-year":
            lo, hi = _day(part(2).cast("int"), month), _day(part(2).cast("int"), month + 1)
        elif kind == "that-season-of-year":
            start = F.element_at(F.create_map(*[F.lit(x) for kv in SEASON_START.items() for x in kv]), part(1))
            lo, hi = _day(part(2).cast("int"), start), _day(part(2).cast("int"), start + 3)
        else:
            year = F.year(as_of) - F.when(month >= F.month(as_of), 1).otherwise(0)
            wide = 1 if kind == "around-month" else 0
            lo, hi = _day(year, month - wide), _day(year, month + 1 + wide)
        out = F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), lo.alias("from_date"), hi.alias("to_date"))).otherwise(out)
    return out


def decay(distance_days: Column, half_life_days: float) -> Column:
    return F.when(distance_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), distance_days / half_life_days))


def date_fit(at: Column, lo: Column, hi: Column, half_life_days: float) -> Column:
    """1 inside the range, closed at both ends; a half for each half-life outside; 0 without a range or a date."""
    days = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000)
    outside = F.when(at < lo.cast("timestamp"), days(lo, at)).when(at > hi.cast("timestamp"), days(at, hi))
    return F.when((lo.isNull() & hi.isNull()) | at.isNull(), 0.0).otherwise(F.coalesce(decay(outside, half_life_days), F.lit(1.0)))


def in_range(at: Column, lo: Column, hi: Column, closed: bool) -> Column:
    """Inferred dates are half-open, explicit bounds closed; a null time never satisfies a bound."""
    after = lo.isNull() | (at >= lo)
    return after & (hi.isNull() | ((at <= hi) if closed else (at < hi)))


def basis(layer: Column, message_at: Column, created_at: Column, explicit: bool) -> Column:
    """The time that a date filter looks at. Explicit bounds see a message's own time only, inferred ones fall back to its episode's."""
    return F.when(layer == "node", created_at).otherwise(message_at if explicit else F.coalesce(message_at, created_at))


def local_date(at: Column, zone: str = "America/Los_Angeles") -> Column:
    """The day of an instant (UTC) on the owner's calendar."""
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM-dd")
