"""Rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_up(value: Column, step: int) -> Column:
    """Smallest multiple of ``step`` that is not below ``value``."""
    return (F.ceil(value / F.lit(step)) * F.lit(step)).cast("long")


def round_up_from(value: Column, step: int) -> Column:
    """:func:`round_up`, and never less than ``step``."""
    return F.greatest(F.lit(step).cast("long"), round_up(value, step))


def context_width(value: Column, block: int = 128) -> Column:
    """A context length that is not whole blocks grows to the next whole block."""
    value = value.cast("long")
    return F.when(value % block == 0, value).otherwise((F.floor(value / block) + 1) * block)


def whole(value: Column, unit: int) -> Column:
    """How many times ``unit`` fits into a non-negative ``value``, in exact integer arithmetic."""
    return F.call_function("div", value.cast("long"), F.lit(unit).cast("long"))
