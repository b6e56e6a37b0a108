"""Mix sources to target weights by systematic sampling.

Within a source every document expects ``target / source size`` copies. The documents stand in
a fixed order (nearly by size, so that the draw is stratified by it), their expected copies are
summed up from the left, one random offset per source is added, and a document is emitted once
for each integer its stretch of that line crosses.

Nothing needs a source in one task. Documents fall into small groups (source, size class, hash
of the id); groups are counted, running sums over a source's classes and over a class's hashes
give each group's first rank, and ranks inside a group come from a window over that group only.
A source has at most 32 x 62 classes and a class 256 hashes, however many documents they hold.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
repeated rows are documents of their own; a source without words gets target 0 and no copies;
equal sizes are ordered by hash of the id, then by the id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import stored, whole_text, word_count

# Weights of the sources in order, the share drawn, the most copies of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"

c = F.col
KEY, ORDER = "_mix_source", ("_mix_class", "_mix_salt")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from rows with ``source, size``.

    Targets are ``least(weight x level, most x size)`` with the one level at which they add up
    to the share. One row per source is sorted here, never one per document: sources are
    summed map side before.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(c("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    weighed = by_source.withColumn("weight", weight.cast("double")).withColumn(
        "cap", c("source_size") * F.lit(float(most))
    )
    # Sources whose cap is reached first stand first; each gets the level that holds if just
    # those before it are full.
    by_cap = Window.orderBy(c("cap") / c("weight"), c("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"),
    ).withColumn(
        "level", (c("total") * F.lit(float(share)) - c("full")) / (c("all_weight") - c("full_weight"))
    )
    # It rises from each full source to the next one and falls after the first that isn't full.
    chosen = levels.withColumn("level", F.max("level").over(everything))
    target = F.least(c("level") * c("weight"), c("cap"))
    return chosen.select("source", "source_size", "weight", target.alias("target"))


def _hash(value: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), first, digits), 16, 10).cast("long")


def _id_text(column: str) -> Column:
    return F.coalesce(c(column).cast("string"), F.lit(""))


def _placed(docs: DataFrame, id_col: str) -> DataFrame:
    """Adds the source key and the group of each row with ``source, size``."""
    bits = F.length(F.bin(c("size")))
    # The length in bits and the five bits after the first: 32 classes for each power of two.
    size_class = bits * 64 + F.expr("shiftright(shiftleft(size, 6), length(bin(size)))")
    return docs.withColumns(
        {
            KEY: F.coalesce(F.concat(F.lit("="), c("source")), F.lit("")),
            ORDER[0]: size_class.cast("long"),
            ORDER[1]: _hash(_id_text(id_col), 1, 2),
        }
    )


def with_copies(docs: DataFrame, targets: DataFrame, sizes: DataFrame, id_col: str = "doc_id",
                seed: str = SEED) -> DataFrame:
    """``docs`` (with ``source, size``) and ``source_size, target, copies`` (0, 1 or 2).

    ``sizes`` has the same ids, sources and sizes; it may be a narrower table.
    """
    groups = _placed(sizes, id_col).groupBy(KEY, *ORDER).agg(F.count("*").alias("_mix_n"))
    # Rows before a group: those of smaller size classes, and of smaller hashes in its class.
    in_source, in_class = Window.partitionBy(KEY).orderBy(ORDER[0]), Window.partitionBy(KEY, ORDER[0]).orderBy(ORDER[1])
    classes = groups.groupBy(KEY, ORDER[0]).agg(F.sum("_mix_n").alias("_mix_n")).select(
        KEY, ORDER[0], (F.sum("_mix_n").over(in_source) - c("_mix_n")).alias("_mix_smaller")
    )
    first = groups.withColumn("_mix_inside", F.sum("_mix_n").over(in_class) - c("_mix_n")).join(
        classes, [KEY, ORDER[0]]
    ).select(KEY, *ORDER, (c("_mix_smaller") + c("_mix_inside")).alias("_mix_before"))
    rates = targets.select(
        F.coalesce(F.concat(F.lit("="), c("source")), F.lit("")).alias(KEY),
        "source_size",
        "target",
        F.when(c("source_size") > 0, c("target") / c("source_size")).otherwise(0.0).alias("_mix_rate"),
        (_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(c("source"), F.lit("\x00"))), 1, 12)
         / F.lit(float(16**12))).alias("_mix_offset"),
    )
    inside = Window.partitionBy(KEY, *ORDER).orderBy("size", F.md5(_id_text(id_col)), id_col)
    placed = _placed(docs, id_col).withColumn("_mix_rank", F.row_number().over(inside))
    joined = placed.join(first.join(rates, KEY), [KEY, *ORDER])
    rank = c("_mix_before") + c("_mix_rank")
    crossed = F.floor(rank * c("_mix_rate") + c("_mix_offset")) - F.floor(
        (rank - 1) * c("_mix_rate") + c("_mix_offset")
    )
    # A rate of at most 2 crosses at most two integers; rounding of the product could add one.
    return joined.withColumn("copies", F.least(crossed, F.lit(int(MOST)))).drop(
        KEY, *ORDER, "_mix_before", "_mix_rank", "_mix_rate", "_mix_offset"
    )


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    return docs.select(c(id_col).alias("doc_id"), c(source_col).alias("source"),
                       word_count(whole_text(text_col)).alias("size"))


def mix_plan(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: one row per document.

    The texts are read once; sizes are written to the shared folder and used from there.
    """
    sizes = stored(sizes_of(docs, **columns), "mix-sizes")
    counted = with_copies(sizes, source_targets(sizes), sizes)
    return counted.withColumn("taken", c("copies") * c("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text, source`` and any others), each as often as drawn."""
    sizes = stored(sizes_of(docs), "mix-sizes")
    names = {name: f"_mix_own{i}" for i, name in enumerate(docs.columns)}
    own = docs.select(
        *[c(name).alias(alias) for name, alias in names.items()],
        c("doc_id").alias("doc_id"),
        c("source").alias("source"),
        word_count(whole_text()).alias("size"),
    )
    drawn = with_copies(own, source_targets(sizes), sizes).where(c("copies") > 0)
    repeated = drawn.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), c("copies").cast("int"))))
    return repeated.select(*[c(alias).alias(name) for name, alias in names.items()])
