"""Binning into right-closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from holdfast.config import Bins


def right_closed(value: str | Column, bins: Bins) -> Column:
    """Label of the interval (a, b] that holds ``value``; NULL outside all intervals.

    ``Bucketizer`` closes its intervals on the left, so the edges would land one bin off.
    """
    value = F.col(value) if isinstance(value, str) else value
    label = F.when(value <= F.lit(bins.edges[0]), F.lit(None).cast("string"))
    for upper, name in zip(bins.edges[1:], bins.labels):
        label = label.when(value <= F.lit(upper), F.lit(name))
    return label


def ordinal(label: str | Column, labels: tuple[str, ...]) -> Column:
    """Position of a label in its ordered label set, 0 first."""
    label = F.col(label) if isinstance(label, str) else label
    position = F.lit(None).cast("int")
    for index, name in reversed(list(enumerate(labels))):
        position = F.when(label == name, F.lit(index)).otherwise(position)
    return position
