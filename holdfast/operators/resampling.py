"""Intervals by resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.features import ratio

c = F.col

# Replicates read off one md5, each from 32 bits of it.
_PER_HASH = 4
_BITS = 32
# Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def poisson_steps() -> list[int]:
    """Where a 32-bit number passes the next value of the Poisson distribution of mean one."""
    steps, term, total = [], math.exp(-1.0), 0.0
    for k in range(64):
        total += term
        step = int(total * 2**_BITS)
        if steps and step <= steps[-1]:
            break
        steps.append(step)
        term /= k + 1
    return steps


def _parts(key: str, block: Column) -> list[Column]:
    """Eight hex digits of the key's md5 for each replicate of a block."""
    digest = F.md5(F.concat_ws(":", c(key).cast("string"), block.cast("string")))
    return [F.substring(digest, _BITS // 4 * i + 1, _BITS // 4) for i in range(_PER_HASH)]


def _weight(digits: Column) -> Column:
    """Steps that a number reaches; hex digits of one length are ordered like their numbers."""
    steps = [f"{step:0{_BITS // 4}x}" for step in poisson_steps() if step < 2**_BITS]
    weight = F.when(digits < steps[0], 0)
    for n, step in enumerate(steps[1:], 1):
        weight = weight.when(digits < step, n)
    return weight.otherwise(len(steps))


def _blocks(replicates: int) -> Column:
    if replicates % _PER_HASH:
        raise ValueError(f"replicates come {_PER_HASH} at a time")
    return F.sequence(F.lit(0), F.lit(replicates // _PER_HASH - 1))


def replicate_weights(key: str, replicates: int) -> Column:
    """``replicate, weight`` of a row: how often each replicate draws it.

    The weights come from the key's md5, so a rerun, another partitioning or another engine
    draws the same replicates.
    """

    def of_block(block: Column) -> Column:
        return F.array(
            *[
                F.struct((block * _PER_HASH + i).alias("replicate"), _weight(digits).alias("weight"))
                for i, digits in enumerate(_parts(key, block))
            ]
        )

    return F.flatten(F.transform(_blocks(replicates), of_block))


def bootstrap_rates(rows: DataFrame, key: str, by: Sequence[str], hit: Column, replicates: int) -> DataFrame:
    """Rate of ``hit`` per group and replicate, all replicates in one pass.

    The rows are dealt evenly to all tasks: they are few bytes, each with much work. There a row
    becomes one per md5, which holds the weights of :func:`replicate_weights`, and is summed;
    shuffled after that is one row per group, md5 and task.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*by, c(key).alias("__key"), F.coalesce(hit, F.lit(False)).alias("hit")).repartition(tasks)
    each = dealt.select(*by, "__key", "hit", F.explode(_blocks(replicates)).alias("block"))
    slots = range(_PER_HASH)
    # Step by step: an md5 and a weight are made once, not wherever they are named.
    digits = each.select(*by, "hit", "block", *[x.alias(f"digits{i}") for i, x in enumerate(_parts("__key", c("block")))])
    weights = digits.select(*by, "hit", "block", *[_weight(c(f"digits{i}")).alias(f"weight{i}") for i in slots])
    sums = weights.groupBy(*by, "block").agg(
        *[F.sum(f"weight{i}").alias(f"n{i}") for i in slots],
        *[F.sum(F.when(c("hit"), c(f"weight{i}")).otherwise(0)).alias(f"hits{i}") for i in slots],
    )
    drawn = F.array(
        *[
            F.struct(
                (c("block") * _PER_HASH + i).alias("replicate"), ratio(c(f"hits{i}"), c(f"n{i}")).alias("rate")
            )
            for i in slots
        ]
    )
    return sums.select(*by, F.inline(drawn))


def percentile_interval(rate: Column, level: float = 0.95) -> Column:
    """The middle ``level`` of the replicates; one value per replicate is gathered."""
    tail = (1.0 - level) / 2.0
    return F.percentile(rate, F.array(F.lit(tail), F.lit(1.0 - tail)))


def wilson_interval(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval of a rate. Unlike the normal one it has a width at 0 and 1 and stays
    between them."""
    p = ratio(hits, n)
    spread = F.lit(z * z) / n
    middle = (p + spread / F.lit(2.0)) / (F.lit(1.0) + spread)
    half = F.sqrt(p * (F.lit(1.0) - p) / n + spread / (F.lit(4.0) * n)) * F.lit(z) / (F.lit(1.0) + spread)
    return middle - half, middle + half
