"""Counts, shares and cross tables. Inputs are rows and key columns, outputs long tables with a total order where one is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.dates import age_days
from sediment.functions.numbers import quotient
from sediment.functions.patterns import java
from sediment.session import scratch

UNSPECIFIED = "Unspecified"


def stated(key: Column, default: str = UNSPECIFIED) -> Column:
    """A key, or the default for null and empty ones."""
    return F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit(default))


def ranked(counts: DataFrame, k: int | None = None, n: str = "n", key: str = "key") -> DataFrame:
    """By count downwards, then key; the first k."""
    out = counts.orderBy(F.col(n).desc(), F.col(key).asc())
    return out.limit(k) if k else out


def tally(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n)."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def tally_many(rows: DataFrame, keys: Column, distinct: bool = True) -> DataFrame:
    """(key, n) of an array of keys for each row; a row counts once for each different key, or with distinct=False once for each entry."""
    return rows.select(F.explode(F.array_distinct(keys) if distinct else keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def with_share(counts: DataFrame, total: DataFrame | None = None, n: str = "n") -> DataFrame:
    """Adds the share of all rows; total: a frame of one row and column, by default the sum of the counts."""
    total = counts.agg(F.sum(n).alias("total")) if total is None else total.toDF("total")
    return counts.crossJoin(F.broadcast(total)).withColumn("share", quotient(F.col(n), F.col("total"))).drop("total")


def breakdown(rows: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dim, key, n) of several keys in one pass and one shuffle."""
    melted = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), stated(k).alias("key")) for d, k in dims.items()))).alias("x"))
    return melted.groupBy("x.dim", "x.key").agg(F.count("*").alias("n"))


def conditional(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows hold each condition, and all (n)."""
    return rows.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def union_share(rows: DataFrame, keys: Column, wanted: list[str]) -> DataFrame:
    """One row: rows with any of the wanted keys, all rows, their ratio. Never the sum of the keys' own counts."""
    hit = F.count_if(F.arrays_overlap(keys, F.array(*map(F.lit, wanted))))
    return rows.agg(hit.alias("n"), F.count("*").alias("total")).withColumn("share", quotient(F.col("n"), F.col("total")))


def buckets(rows: DataFrame, value: Column, bounds: list[tuple[float, str]], last: str) -> DataFrame:
    """(ordinal, bucket, n): a value belongs to the first bucket whose bound it doesn't exceed. Nulls are left out."""
    return rows.where(value.isNotNull()).groupBy(*bucket(value, bounds, last)).agg(F.count("*").alias("n"))


def bucket(value: Column, bounds: list[tuple[float, str]], last: str) -> tuple[Column, Column]:
    """The ordinal and the name of a value's bucket."""
    label, ordinal = F, F
    for i, (bound, name) in enumerate(bounds):
        label, ordinal = label.when(value <= bound, name), ordinal.when(value <= bound, i)
    return ordinal.otherwise(len(bounds)).cast("int").alias("ordinal"), label.otherwise(last).alias("bucket")


def in_order(counts: DataFrame, order: list[str] | tuple[str, ...], key: str = "key") -> DataFrame:
    """By place in a list; unknown keys come first."""
    return counts.orderBy(F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(key)), F.lit(0)), key)


def upper_median(column: str) -> Column:
    """The middle value of a column, of two the larger. Holds a count for each different value of a group: for days, quantities and the like."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{column}` desc)")


def medians(rows: DataFrame, key: Column, value: Column, upper: bool = False) -> DataFrame:
    """(key, n, median) of stated values, exact; of two middle values the mean, or with upper the larger.

    Equal values are counted first, and the counts are written in order of key and value, dealt by ranges of both. The sums of these ranges tell which of them hold
    the middle of a key; only those are ranked. So no task gathers a key, however few keys there are and however many values one has.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "medians")
    found = rows.where(value.isNotNull()).select(key.alias("key"), value.cast("double").alias("v"))
    dealt = found.groupBy("key", "v").agg(F.count("*").alias("c")).repartitionByRange("key", "v").withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    counts = spark.read.schema(dealt.schema).parquet(path)
    sums = counts.groupBy("key", "part").agg(F.sum("c").alias("c"))
    of_key = Window.partitionBy("key")
    sums = sums.select(F.col("key").alias("of"), F.col("part").alias("_p"), F.sum("c").over(of_key).alias("n"), F.sum("c").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("end"), "c")
    middle = sums.where("end > (n - 1) div 2 and end - c <= n div 2").select("of", "_p", "n", (F.col("end") - F.col("c")).alias("before"))
    placed = counts.join(middle, (F.col("part") == F.col("_p")) & F.col("key").eqNullSafe(F.col("of")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("key", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))

    def at(rank: Column) -> Column:
        return F.min_by("v", F.when(F.col("upto") > rank, F.col("upto")))

    ranked_rows = placed.withColumn("upto", upto).groupBy("key", "n").agg(at(F.expr("(n - 1) div 2")).alias("a"), at(F.expr("n div 2")).alias("b"))
    return ranked_rows.select("key", "n", (F.col("b") if upper else 0.5 * F.col("a") + 0.5 * F.col("b")).alias("median"))


def median_by(rows: DataFrame, group: Column, value: Column, least: int = 5) -> DataFrame:
    """(key, n, median) of groups with so many values or more; of two middle values the mean."""
    return medians(rows, group, value).where(F.col("n") >= least)


def crosstab(rows: DataFrame, row: Column, col: Column, cols: list[str], k: int) -> DataFrame:
    """(row, col, n) of the k most frequent rows with all columns asked for, zeros too. Other columns count for a row's rank only."""
    cells = rows.select(stated(row).alias("row"), stated(col).alias("col")).groupBy("row", "col").agg(F.count("*").alias("n"))
    top = ranked(cells.groupBy("row").agg(F.sum("n").alias("t")), k, n="t", key="row").select("row")
    grid = top.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in cols], "col string")))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gradient(rows: DataFrame, keys: Column, band: Column) -> DataFrame:
    """(key, band, n, share): how many of a band's rows have a key. The denominator counts rows, not keys."""
    marked = rows.select(band.alias("band"), F.array_distinct(keys).alias("keys"))
    totals = marked.groupBy("band").agg(F.count("*").alias("total"))
    cells = marked.select("band", F.explode("keys").alias("key")).groupBy("key", "band").agg(F.count("*").alias("n"))
    return cells.join(totals, "band").select("key", "band", "n", quotient(F.col("n"), F.col("total")).alias("share"))


def pairs(rows: DataFrame, keys: Column) -> DataFrame:
    """(a, b, n): rows that hold both keys, a before b. Pairs are made inside each row's array."""
    sorted_keys = F.array_sort(F.array_distinct(keys))
    made = F.get(F.transform(F.array(sorted_keys), lambda s: F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b")))))), F.lit(0))
    return rows.select(F.explode(made).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def rollup(rows: DataFrame, parent: Column, child: Column) -> DataFrame:
    """(parent, child, n): counts of children, and of each parent with a null child."""
    marked = rows.select(parent.alias("parent"), child.alias("child"))
    return marked.rollup("parent", "child").agg(F.count("*").alias("n")).where("parent is not null")


def profile(rows: DataFrame, group: Column, measures: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """One row for each group: n, and for each measure the share of the rows that state it (a condition of its own; None: all rows)."""

    def of(hit: Column, given: Column | None) -> Column:
        return quotient(F.count_if(hit if given is None else hit & given), F.count("*") if given is None else F.count_if(given))

    return rows.groupBy(group.alias("key")).agg(F.count("*").alias("n"), *(of(h, g).alias(k) for k, (h, g) in measures.items()))


def breadth(rows: DataFrame, keys: Column) -> DataFrame:
    """One row: rows, keys of all rows, and keys for each row."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.size(keys)).alias("keys")).withColumn("mean", quotient(F.col("keys"), F.col("n")))


def category_tally(rows: DataFrame, keys: Column, category: dict[str, str]) -> DataFrame:
    """(key, n): rows with a key of each category. Unknown keys have none."""
    table = F.create_map(*(F.lit(x) for pair in category.items() for x in pair))
    return tally_many(rows, F.filter(F.transform(keys, lambda k: F.try_element_at(table, k)), lambda c: c.isNotNull()))


def labelled(counts: DataFrame, dimension: DataFrame, key: str = "key") -> DataFrame:
    """Adds the label of a dimension (key, label); without one the key itself. Spark broadcasts whichever side is small enough by its own bound."""
    return counts.join(dimension.select(F.col(key), "label"), key, "left").withColumn("label", F.coalesce("label", key))


def matching(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Rows in which a pattern is found in one of these columns, whatever its case; nulls hold nothing."""
    tests = [F.coalesce(F.col(c).rlike(java(pattern)), F.lit(False)) for c in columns]
    return rows.where(reduce(lambda a, b: a | b, tests))


def without_zeros(cells: DataFrame, row: str = "row", col: str = "col", n: str = "n") -> DataFrame:
    """Cells of a cross table without the rows and columns that are zero throughout."""
    rows = cells.groupBy(row).agg(F.sum(n).alias("_t")).where("_t <> 0").select(row)
    cols = cells.groupBy(col).agg(F.sum(n).alias("_t")).where("_t <> 0").select(col)
    return cells.join(rows, row, "left_semi").join(cols, col, "left_semi").select(*cells.columns)


def by_column_max(cells: DataFrame, col: str = "col", n: str = "n") -> DataFrame:
    """Adds each cell's part of its column's greatest (0 where that is 0)."""
    top = cells.groupBy(F.col(col).alias("_c")).agg(F.max(n).alias("_m"))
    return cells.join(top, F.col(col) == F.col("_c")).withColumn("part", F.coalesce(quotient(F.col(n), F.col("_m")), F.lit(0.0))).drop("_c", "_m")


def mean_age(rows: DataFrame, ts: Column, as_of: DataFrame) -> DataFrame:
    """One row: rows with a time, the sum of their ages in whole days, and the mean age. as_of: a frame of one row and column."""
    aged = rows.crossJoin(F.broadcast(as_of.toDF("_now"))).select(age_days(ts, F.col("_now")).alias("age")).where("age is not null")
    return aged.agg(F.count("*").alias("n"), F.coalesce(F.sum("age"), F.lit(0)).alias("days")).withColumn("mean", quotient(F.col("days"), F.col("n")))
