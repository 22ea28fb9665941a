"""Checks of generated sentences against the numbers they were made from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d[\d,]*(?:\.\d+)?)"
MULTIPLE = r"(\d[\d,]*(?:\.\d+)?)\s*x\b"


def _numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.regexp_replace(t, ",", ""))


def grounded(text: Column, facts: Column, multiples: Column | None = None) -> Column:
    """Every number of the text equals a fact rounded to the same decimals; multiples are held against multiples only."""

    def known(token: Column, pool: Column) -> Column:
        digits = F.length(F.regexp_extract(token, r"\.(\d+)", 1))
        scale = F.pow(F.lit(10.0), digits)
        return F.exists(pool, lambda f: F.rint(f * scale) == F.rint(token.cast("double") * scale))

    ok = F.forall(_numbers(text, NUMBER), lambda t: known(t, facts))
    return ok if multiples is None else ok & F.forall(_numbers(text, MULTIPLE), lambda t: known(t, multiples))


def trigger_ok(text: Column, price: Column) -> Column:
    """No clause says above a price that is not higher than now, or below one that is not lower."""

    def bad(clause: Column) -> Column:
        at = F.try_to_number(F.nullif(F.regexp_replace(F.regexp_extract(clause, r"\$([\d,]+(?:\.\d+)?)", 1), ",", ""), F.lit("")), F.lit("999999999.999999")).cast("double")
        up, down = clause.rlike("(?i)above|over|break|rise"), clause.rlike("(?i)below|under|fall|drop")
        return at.isNotNull() & ((up & ~down & (at <= price)) | (down & ~up & (at >= price)))

    return ~F.exists(F.split(text, ",(?!\\d)"), bad)


def tidy_sentences(text: Column, own: Column, verdicts: tuple[str, ...] = ("buy", "hold", "sell")) -> Column:
    """Sentences that talk of another verdict are dropped; if all would be, the text stays."""
    pattern = rf"(?i)\b({'|'.join(verdicts)})\s+(?:verdict|opinion|conclusion|signal)"
    keep = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.forall(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), lambda v: F.lower(v) == own))
    return F.when(F.size(keep) > 0, F.array_join(keep, " ")).otherwise(text)
