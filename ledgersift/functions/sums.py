"""Sums of doubles that come out the same whatever the order of their rows.

A plain sum's last bit depends on the order in which rows meet, so equal totals fall apart, and a total computed twice may not equal itself: ranks and
joins on values then differ from run to run. Here each value is split into two whole numbers (steps of 2**-12, and of 2**-64 below them), which are
summed exactly and rounded to a double once. Values from 2**50 up, NaN and infinities are summed as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH, _LOW = 1 << 12, 1 << 52
_KINDS = ("high", "low", "rest")


def sum_parts(value: Column, name: str) -> list[Column]:
    """Aggregates ``name_high, name_low, name_rest``; `exact_total` makes the sum of them."""
    small = F.abs(value) < float(1 << 50)
    steps = F.when(small, value * float(_HIGH))
    whole = F.floor(steps)
    below = ((steps - whole) * float(_LOW)).cast("long")
    return [F.sum(v).alias(f"{name}_{k}") for k, v in zip(_KINDS, (whole.cast("decimal(19,0)"), below.cast("decimal(19,0)"), F.when(~small, value)), strict=True)]


def merged_parts(name: str) -> list[Column]:
    """Aggregates that add up the parts of groups."""
    return [F.sum(f"{name}_{k}").alias(f"{name}_{k}") for k in _KINDS]


def exact_total(name: str) -> Column:
    """The sum of the parts' values; null where there is none."""
    high, low, rest = (F.col(f"{name}_{k}") for k in _KINDS)
    left = F.pmod(low, F.lit(_LOW))
    steps = high + F.expr(f"(`{name}_low` - pmod(`{name}_low`, {_LOW}L)) div {_LOW}L")
    exact = steps.cast("double") / float(_HIGH) + left.cast("double") / float(_HIGH * _LOW)
    return F.coalesce(exact + rest, exact, rest)


def part_names(*names: str) -> Sequence[str]:
    return [f"{n}_{k}" for n in names for k in _KINDS]
