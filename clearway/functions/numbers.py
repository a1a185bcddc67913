"""Infinity is the "no answer" value of every distance; NULL only appears at a sink."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def inf() -> Column:
    return F.lit(float("inf"))


def or_inf(value: Column) -> Column:
    return F.coalesce(value, inf())


def finite_or_null(value: Column, digits: int = 6) -> Column:
    """Sink form of a distance: rounded, NULL when open."""
    return F.when(value < inf(), F.round(value, digits))


def or_false(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))
