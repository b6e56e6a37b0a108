"""CSV files of unknown types: types from all rows, and what doesn't fit beside the table.

A column's type is the narrowest that all of its cells fit. Each cell says which types it could
be; what a column could be is the AND over its cells, which merges in any order, so one aggregate
over all rows decides every column. With a tolerance, a type may miss a share of the cells; those
become NULL in the typed table and are kept, as written, in a column of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

c = F.col

BAD, RECORD = "_bad", "_record"

# The types tried, narrowest first, and how their cells are written.
TYPES = {
    "boolean": r"(?i)^(true|false)$",
    "int": r"^[+-]?[0-9]{1,10}$",
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$",
    "string": "",
}


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text under the header's names, and in ``_record`` a line whose number of cells
    isn't that of the header. An empty cell is NULL."""
    names = spark.read.option("header", True).csv(path).columns
    fields = ", ".join(f"`{name}` STRING" for name in (*names, RECORD))
    return (
        spark.read.schema(fields)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .csv(path)
    )


def _cell(name: str) -> Column:
    return F.trim(c(name))


def parsed(name: str, kind: str) -> Column:
    """The cell as ``kind``, NULL if it isn't one."""
    cell = _cell(name)
    if kind == "string":
        return c(name)
    return F.when(cell.rlike(TYPES[kind]), cell.try_cast(kind))


def column_types(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``column_name, type, n_values, n_null, n_bad``: one row per column.

    One pass over all rows. Lines with too few or too many cells have no say. A column without
    values is a string.
    """
    names = [name for name in cells.columns if name != RECORD]
    rows = cells.filter(c(RECORD).isNull()) if RECORD in cells.columns else cells
    wide = rows.agg(
        *[
            F.struct(
                F.count(name).alias("n_values"),
                F.count_if(c(name).isNull()).alias("n_null"),
                F.array(*[F.count(parsed(name, kind)) for kind in TYPES]).alias("fits"),
            ).alias(name)
            for name in names
        ]
    )
    tall = wide.unpivot([], names, "column_name", "found").select("column_name", "found.*")
    least = F.greatest(F.ceil(c("n_values") * F.lit(1.0 - tolerance)), F.lit(1))
    # The last type takes every cell.
    at = F.array_position(F.transform("fits", lambda n: n >= least), F.lit(True))
    place = F.when(at > 0, at).otherwise(F.lit(len(TYPES))).cast("int")
    kinds = F.array(*[F.lit(kind) for kind in TYPES])
    return tall.select(
        "column_name",
        F.get(kinds, place - 1).alias("type"),
        "n_values",
        "n_null",
        (c("n_values") - F.get("fits", place - 1)).alias("n_bad"),
    )


def typed(cells: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The table with the given types; ``_bad`` lists (column, cell) of what doesn't fit.

    A line with the wrong number of cells stays as a row of NULLs whose ``_bad`` holds the line.
    """
    whole = c(RECORD).isNull()
    bad = [
        F.when(whole & c(name).isNotNull() & parsed(name, kind).isNull(), _entry(F.lit(name), c(name)))
        for name, kind in types.items()
    ]
    line = F.when(~whole, _entry(F.lit(RECORD), c(RECORD)))
    return cells.select(
        *[F.when(whole, parsed(name, kind)).alias(name) for name, kind in types.items()],
        F.array_compact(F.array(*bad, line)).alias(BAD),
    )


def _entry(name: Column, cell: Column) -> Column:
    return F.struct(name.alias("column_name"), cell.alias("cell"))


def read_typed_csv(spark: SparkSession, path: str, tolerance: float = 0.0) -> DataFrame:
    """A CSV file with inferred types and the quarantine column; one row per column is collected."""
    cells = read_cells(spark, path)
    found = {row["column_name"]: row["type"] for row in column_types(cells, tolerance).collect()}
    return typed(cells, {name: found[name] for name in cells.columns if name != RECORD})


def quarantine(table: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell, or line, that didn't fit."""
    return table.filter(F.size(BAD) > 0).select(*keep, F.inline(BAD))

