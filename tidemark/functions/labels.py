"""Words and short forms for people: risk, changed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Risk scores from which a word holds.
MEDIUM, HIGH = 50.0, 200.0


def risk(score: Column) -> Column:
    """none, low, medium or high; null stays null."""
    return F.when(score <= 0, "none").when(score < MEDIUM, "low").when(score < HIGH, "medium").when(score.isNotNull(), "high")


def chip(count: Column, word: str) -> Column:
    """A count with its word in the number it needs; empty for none."""
    return F.when(count == 1, f"1 {word}").when(count > 1, F.concat(count.cast("string"), F.lit(f" {word}s"))).otherwise("")


def same_field(kind: str, x: Column, y: Column) -> Column:
    """Whether two values of a field (text, email, phone or date) are the same to a reader; two missing ones are."""
    one = {
        "email": lambda c: F.lower(F.trim(c)), "phone": lambda c: F.right(F.regexp_replace(c, r"\D", ""), F.lit(10)),
        "date": lambda c: c.cast("date").cast("string"), "text": lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))),
    }[kind]
    return F.nullif(one(x), F.lit("")).eqNullSafe(F.nullif(one(y), F.lit("")))
