"""Many tables of counts from one pass over the rows: every row gives the cells that it counts in, and one shuffle adds them up.

Rows that are equal in what a few of the tables look at can be counted first (grouped), so that cells are made once for each different kind of row.
A table of cells is (name, a, b, c, n). It is written once, so that all that is derived from it reads a table of counts and not the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators.ranking import bucket, ranked
from sediment.session import scratch

_TEXT = "string"


def _cell(name: str, a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    keys = ((F.lit(None) if x is None else x).cast(_TEXT) for x in (a, b, c))
    return F.struct(F.lit(name).alias("name"), *(k.alias(n) for k, n in zip(keys, "abc", strict=True)))


#: Columns of grouped(): the set that a row is of, and how many rows it stands for.
SET, WEIGHT = "_set", "_weight"
_CELLS = "array<struct<name:string,a:string,b:string,c:string>>"


def one(name: str, a: Column, b: Column | None = None, c: Column | None = None, where: Column | None = None) -> Column:
    """One cell for a row, or none where a condition doesn't hold."""
    cells = F.array(_cell(name, a, b, c))
    return cells if where is None else F.when(where, cells).otherwise(none())


def each(name: str, keys: Column, b: Column | None = None, c: Column | None = None) -> Column:
    """A cell for each different key of a row's array; a null array has none."""
    return F.coalesce(F.transform(F.array_distinct(keys), lambda k: _cell(name, k, b, c)), none())


def each_of(name: str, label: str, keys: Column) -> Column:
    """each() of several arrays under one name, told apart by a label before the key."""
    return F.coalesce(F.transform(F.array_distinct(keys), lambda k: _cell(name, F.lit(label), k)), none())


def none() -> Column:
    return F.array().cast(_CELLS)


def pairs(name: str, keys: Column) -> Column:
    """A cell for each two different keys of a row's array, the smaller first."""

    def of(s: Column) -> Column:
        return F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: _cell(name, a, b))))

    return F.coalesce(F.get(F.transform(F.array(F.array_sort(F.array_distinct(keys))), of), F.lit(0)), none())


def grouped(rows: DataFrame, sets: dict[str, list[str]], always: list[str]) -> DataFrame:
    """For each set of columns its different rows, with their number as WEIGHT and the set's name as SET; columns of other sets are null. The columns always are in every set."""
    columns = list(dict.fromkeys([*always, *(c for own in sets.values() for c in own)]))
    mark = F
    for name, own in sets.items():
        bits = "".join("0" if c in always or c in own else "1" for c in columns)
        mark = mark.when(F.grouping_id() == int(bits, 2), name)
    return rows.groupingSets([[F.col(c) for c in [*always, *own]] for own in sets.values()], *columns).agg(mark.alias(SET), F.count("*").alias(WEIGHT))


def of(**parts: list[Column]) -> Column:
    """The cells of a row of grouped(), by its set."""
    out = F
    for name, own in parts.items():
        out = out.when(F.col(SET) == name, F.concat(*own))
    return out.otherwise(none())


def counted(rows: DataFrame, *parts: Column) -> DataFrame:
    """The table of cells, written and read again. A row of grouped() counts as often as its weight says."""
    path = scratch(rows.sparkSession, "cells")
    weight = F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1)
    cells = rows.select(F.explode(F.concat(*parts)).alias("x"), weight.cast("long").alias("w")).groupBy("x.name", "x.a", "x.b", "x.c").agg(F.sum("w").alias("n"))
    cells.write.parquet(path)
    return rows.sparkSession.read.schema("name string, a string, b string, c string, n long").parquet(path)


def table(cells: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, n) of one name."""
    return cells.where(F.col("name") == name).select(*(F.col(c).alias(k) for c, k in zip("abc", keys, strict=False)), "n")


def crosstab(cells: DataFrame, cols: list[str], k: int) -> DataFrame:
    """ranking.crosstab() of a table (row, col, n)."""
    top = ranked(cells.groupBy("row").agg(F.sum("n").alias("t")), k, n="t", key="row").select("row")
    grid = top.crossJoin(F.broadcast(cells.sparkSession.createDataFrame([(c,) for c in cols], "col string")))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def last_months(months: DataFrame, k: int = 12) -> DataFrame:
    """series.last_months() of a table with a month column."""
    last = months.where("month is not null").select("month").distinct().orderBy(F.col("month").desc()).limit(k)
    return last.select("month", F.row_number().over(Window.orderBy(F.col("month").desc())).alias("ordinal"))


def monthly(cells: DataFrame, grid: DataFrame, top: int | None = None) -> DataFrame:
    """series.monthly() of a table (key, month, n) over the months of last_months()."""
    counts = cells.join(F.broadcast(grid.select("month")), "month")
    totals = counts.groupBy("key").agg(F.sum("n").alias("t"))
    totals = totals.orderBy(F.col("t").desc(), "key").limit(top) if top else totals
    full = totals.select("key").crossJoin(F.broadcast(grid))
    return full.join(counts, ["key", "month"], "left").select("key", "month", "ordinal", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def buckets(cells: DataFrame, value: Column, bounds: list[tuple[float, str]], last: str) -> DataFrame:
    """ranking.buckets() of a table of counts."""
    return cells.where(value.isNotNull()).groupBy(*bucket(value, bounds, last)).agg(F.sum("n").alias("n"))


def medians(cells: DataFrame, key: str, value: str, upper: bool = False) -> DataFrame:
    """(key, n, median) of a table (key, value, n) of whole values, exact: of two middle ones the mean, or with upper the larger."""
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(F.col(value).cast("long")).rowsBetween(Window.unboundedPreceding, 0))
    counts = cells.where(F.col(value).isNotNull()).select(key, F.col(value).cast("long").alias(value), "n").withColumn("upto", upto)
    sizes = counts.groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("total"))
    placed = counts.join(sizes, F.col(key).eqNullSafe(F.col("_k")))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col(value)))

    middle = placed.groupBy(key, F.col("total").alias("n")).agg(at(F.expr("(total - 1) div 2")).alias("low"), at(F.expr("total div 2")).alias("high"))
    median = F.col("high") if upper else 0.5 * F.col("low") + 0.5 * F.col("high")
    return middle.select(key, "n", median.alias("median"))
