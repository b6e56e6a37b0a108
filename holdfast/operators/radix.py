"""Exact quantiles by radix selection.

A number becomes a 64-bit integer of the same order: sign, exponent and mantissa as in its binary
form. The integer at a given rank is then found digit by digit, from the highest: count the rows
per digit (65,536 values), see which digit the rank falls into, and go on among the rows with that
digit. Four digits of 16 bits are four scans, whatever the table's size. Counts are made map side;
no value is sorted or sent, and what is broadcast are the digits found so far, one row for each
group and wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

c = F.col

_KEY, _DIGITS, _WANTED = "__key", "__digits", "__wanted"
_DIGIT_BITS = 16
# The binary form of a double.
_MANTISSA, _BIAS, _LEAST, _MOST = 52, 1023, -1074, 1023
_INFINITY = (_MOST + _BIAS + 1) << _MANTISSA
_TINY = 2.0**_LEAST


def _power(exponent: Column) -> Column:
    """2 to an integer power, exactly: looked up, as the platform's power function may round."""
    powers = ",".join(repr(2.0**e) for e in range(_LEAST, _MOST + 1))
    return F.get(F.split(F.lit(powers), ",").cast("array<double>"), exponent - F.lit(_LEAST))


def ordered_key(value: Column) -> Column:
    """A BIGINT that orders like the DOUBLE ``value``; both zeros are 0, NaN is the largest."""
    size = F.abs(value.cast("double"))
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LEAST)), F.lit(_MOST)).cast("int")
    # The logarithm may be one off beside a power of two.
    exponent = (
        guess
        - F.when(_power(guess) > size, 1).otherwise(0)
        + F.when(_power(guess + F.lit(1)) <= size, 1).otherwise(0)
    )
    mantissa = ((size / _power(exponent) - F.lit(1.0)) * F.lit(2.0**_MANTISSA)).cast("bigint")
    whole = F.shiftleft((exponent + F.lit(_BIAS)).cast("bigint"), _MANTISSA) + mantissa
    bits = (
        F.when(F.isnan(size), F.lit(2**63 - 1))
        .when(size == 0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), F.lit(_INFINITY))
        .when(exponent <= -_BIAS, (size / F.lit(_TINY)).cast("bigint"))
        .otherwise(whole)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def keyed_value(key: Column) -> Column:
    """The DOUBLE behind a key."""
    bits = F.abs(key)
    exponent = F.shiftright(bits, _MANTISSA).cast("int")
    mantissa = bits.bitwiseAND(F.lit(2**_MANTISSA - 1)).cast("double")
    size = (
        F.when(bits > _INFINITY, F.lit(float("nan")))
        .when(bits == _INFINITY, F.lit(float("inf")))
        .when(exponent == 0, mantissa * F.lit(_TINY))
        .otherwise((F.lit(1.0) + mantissa * F.lit(2.0**-_MANTISSA)) * _power(exponent - F.lit(_BIAS)))
    )
    return F.when(key < 0, -size).otherwise(size)


def _wanted_ranks(shares: Mapping[str, float], total: Column) -> Column:
    """For each share the two neighbouring ranks, and how far the quantile lies between them."""
    structs = []
    for name, share in shares.items():
        position = F.lit(float(share)) * (total - F.lit(1))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            structs.append(
                F.struct(
                    F.lit(f"{side}_{name}").alias("end"),
                    rank.cast("bigint").alias("rank"),
                    (position - F.floor(position)).alias("part"),
                )
            )
    return F.array(*structs)


def _digits(shift: int) -> Column:
    return F.shiftright(_KEY, shift).alias(_DIGITS)


def _found(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each wanted rank with the digits it falls into, and its rank among the rows that share
    them, from counts per ``by`` and digits. A window holds one digit's values of a group."""
    order = W.partitionBy(*by, "end").orderBy(_DIGITS).rowsBetween(W.unboundedPreceding, 0)
    reached = counts.withColumn("up_to", F.sum("n").over(order))
    before = c("up_to") - c("n")
    return reached.filter((c("rank") >= before) & (c("rank") < c("up_to"))).select(
        *by, _DIGITS, "end", (c("rank") - before).alias("rank"), "part"
    )


def radix_quantiles(
    df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``shares``.

    ``by`` must hold few distinct groups, such as classes or column names. Rows without a value or
    a group are left out. The plan is lazy: nothing runs while it is built.
    """
    by = list(by)
    known = c(value).isNotNull()
    for name in by:
        known = known & c(name).isNotNull()
    rows = df.filter(known).select(*by, ordered_key(c(value)).alias(_KEY))
    shift = 64 - _DIGIT_BITS
    first = rows.groupBy(*by, _digits(shift)).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    wanted = first.withColumn(_WANTED, _wanted_ranks(shares, total)).select(
        *by, _DIGITS, "n", F.inline(_WANTED)
    )
    found = _found(wanted, by)
    while shift:
        # One row for each digit found: a row of the table meets at most one.
        asked = found.groupBy(*by, _DIGITS).agg(
            F.collect_list(F.struct("end", "rank", "part")).alias(_WANTED)
        )
        among = rows.withColumn(_DIGITS, F.shiftright(_KEY, shift)).join(
            F.broadcast(asked), [*by, _DIGITS]
        )
        shift -= _DIGIT_BITS
        counts = among.groupBy(*by, _digits(shift)).agg(
            F.count(F.lit(1)).alias("n"), F.first(_WANTED).alias(_WANTED)
        )
        found = _found(counts.select(*by, _DIGITS, "n", F.inline(_WANTED)), by)
    ends = [
        F.max(F.when(c("end") == f"{side}_{name}", keyed_value(c(_DIGITS)))).alias(f"{side}_{name}")
        for name in shares
        for side in ("lo", "hi")
    ]
    parts = [F.max(F.when(c("end") == f"lo_{name}", c("part"))).alias(f"part_{name}") for name in shares]

    def between(name: str) -> Column:
        low, high, part = c(f"lo_{name}"), c(f"hi_{name}"), c(f"part_{name}")
        # Two equal infinities have no difference.
        return F.when(low == high, low).otherwise(low + (high - low) * part).alias(name)

    return found.groupBy(*by).agg(*ends, *parts).select(*by, *map(between, shares))
