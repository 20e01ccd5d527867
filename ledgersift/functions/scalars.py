"""Scalar expressions. Undefined is null, never NaN: a null compares false and sorts by an explicit rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_base(amount: Column, currency: Column, rates: Mapping[str, float]) -> Column:
    """``amount`` at the currency's rate; null for a null or unknown currency."""
    pairs = [F.lit(x) for name, rate in rates.items() for x in (name, float(rate))]
    return amount * F.try_element_at(F.create_map(*pairs), currency)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where undefined."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where undefined."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def asymmetry(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 for 0 against 0."""
    return share((a - b).cast("double"), (a + b).cast("double"))


#: Upper bounds of a population stability index, and the words below them. Fixed values; anything above is a significant shift.
READINGS = ((0.10, "stable"), (0.25, "moderate shift"))


def psi_reading(value: Column) -> Column:
    """Words for a population stability index, by the usual cuts."""
    words = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in READINGS:
        words = words.when(value < bound, label)
    return words.otherwise("significant shift")


def thousands(value: Column, places: int = 0) -> Column:
    return F.format_number(value, places)


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.0f", value * 100), F.lit("%"))


def places(value: Column) -> Column:
    """Two decimals of the double itself: formatting its shortest decimal would turn 0.575, which is stored as less, into 0.58."""
    return F.format_string("%.2f", F.round(value * 100, 0) / 100)
