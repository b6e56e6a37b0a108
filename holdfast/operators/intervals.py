"""Joining days to intervals of days without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

c = F.col

_BAND = "__band"


def _band(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")


def interval_join(
    intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, width: int,
    on: Sequence[str] = (),
) -> DataFrame:
    """Every pair with ``start <= point <= end`` and equal ``on`` columns, once.

    Time is cut into bands of ``width`` days. An interval stands in each band it touches, a point
    in one, so band and keys are an equality join, and the exact comparison is left to its few
    candidates. ``width`` should be about the length of the intervals: they then touch two bands.
    Without keys the bands alone deal the work out; with them a busy key is dealt out by band.
    An interval without a start or an end, or that ends before it starts, has no points.
    """
    inside = c(start) <= c(end)
    bands = F.sequence(_band(c(start), width), _band(c(end), width))
    spread = intervals.filter(inside).withColumn(_BAND, F.explode(bands))
    placed = points.filter(c(point).isNotNull()).withColumn(_BAND, _band(c(point), width))
    return spread.join(placed, [*on, _BAND]).filter(c(point).between(c(start), c(end))).drop(_BAND)
