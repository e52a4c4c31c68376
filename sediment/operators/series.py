"""Series by day and month, shifts between periods, recency, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.dates import month_key
from sediment.functions.numbers import quotient
from sediment.operators.ranking import medians


def last_months(rows: DataFrame, ts: Column, k: int = 12) -> DataFrame:
    """(month, ordinal): the last k months that occur, the latest is 1. Months without rows are passed over."""
    months = rows.where(ts.isNotNull()).select(month_key(ts).alias("month")).distinct().orderBy(F.col("month").desc()).limit(k)
    return months.select("month", F.row_number().over(Window.orderBy(F.col("month").desc())).alias("ordinal"))


def monthly(rows: DataFrame, ts: Column, keys: Column, months: int = 12, top: int | None = None) -> DataFrame:
    """(key, month, ordinal, n) with zeros, for keys (an array for each row) that occur in these months; top: the most frequent there."""
    grid = last_months(rows, ts, months)
    marked = rows.select(month_key(ts).alias("month"), F.explode(F.array_distinct(keys)).alias("key"))
    counts = marked.join(F.broadcast(grid.select("month")), "month").groupBy("key", "month").agg(F.count("*").alias("n"))
    totals = counts.groupBy("key").agg(F.sum("n").alias("t"))
    if top:
        totals = totals.orderBy(F.col("t").desc(), "key").limit(top)
    full = totals.select("key").crossJoin(F.broadcast(grid))
    return full.join(counts, ["key", "month"], "left").select("key", "month", "ordinal", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def share_shift(series: DataFrame, window: int = 3) -> DataFrame:
    """(key, recent, prior, recent_share, prior_share, delta) of a monthly() table: the last months against those before. Denominators are sums over the series shown.

    No rows if there are under two windows of months, or nothing in one of them.
    """
    per_key = series.groupBy("key").agg(F.sum(F.when(F.col("ordinal") <= window, F.col("n")).otherwise(0)).alias("recent"), F.sum(F.when(F.col("ordinal").between(window + 1, 2 * window), F.col("n")).otherwise(0)).alias("prior"), F.max("ordinal").alias("months"))
    total = per_key.agg(F.sum("recent").alias("r"), F.sum("prior").alias("p"), F.max("months").alias("m"))
    shares = per_key.drop("months").crossJoin(F.broadcast(total)).where((F.col("m") >= 2 * window) & (F.col("r") > 0) & (F.col("p") > 0))
    shares = shares.withColumns({"recent_share": quotient(F.col("recent"), F.col("r")), "prior_share": quotient(F.col("prior"), F.col("p"))})
    return shares.select("key", "recent", "prior", "recent_share", "prior_share", (F.col("recent_share") - F.col("prior_share")).alias("delta"))


def most_changed(shifts: DataFrame, k: int) -> DataFrame:
    return shifts.orderBy(F.abs("delta").desc(), "key").limit(k)


def dense_days(rows: DataFrame, day: Column, days: int) -> DataFrame:
    """(day, n): each calendar day of the last so many up to the last one that occurs, zeros too."""
    return filled(rows.where(day.isNotNull()).groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n")), days)


def filled(counts: DataFrame, days: int) -> DataFrame:
    """dense_days() of a table (day, n)."""
    last = counts.agg(F.max("day").alias("last")).where("last is not null")
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def moving_average(daily: DataFrame, reach: int = 3, n: str = "n") -> DataFrame:
    """Adds the centred mean of 2 * reach + 1 days; null where that doesn't fit. daily has one row for each day, so one sort is enough."""
    frame = Window.orderBy("day").rowsBetween(-reach, reach)
    return daily.withColumn("mean", F.when(F.count("*").over(frame) == 2 * reach + 1, F.sum(n).over(frame) / (2 * reach + 1)))


def peak(daily: DataFrame, n: str = "n") -> DataFrame:
    """One row: the first day with the largest count."""
    return daily.agg(F.max(F.struct(F.col(n).alias("n"), (-F.unix_date("day")).alias("k"), F.col("day").alias("day"))).alias("m")).select("m.day", "m.n")


def recency(rows: DataFrame, ts: Column, keys: Column, as_of: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """(key, total, recent, index): a key's share of the last days against its share of all. as_of: a frame of one row and column.

    Denominators count rows with a key only. Keys with fewer rows than least are left out; without recent rows every index is 0.
    """
    marked = rows.crossJoin(F.broadcast(as_of.toDF("_now"))).select((ts >= F.col("_now") - F.make_dt_interval(F.lit(days))).alias("recent"), F.array_distinct(keys).alias("keys")).where(F.size("keys") > 0)
    recent = F.coalesce(F.col("recent"), F.lit(False))
    totals = marked.agg(F.count("*").alias("all_n"), F.count_if(recent).alias("recent_n"))
    counts = marked.select(recent.alias("recent"), F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("total"), F.count_if("recent").alias("recent"))
    return recency_of(counts, totals, least)


def recency_of(counts: DataFrame, totals: DataFrame, least: int = 3) -> DataFrame:
    """recency() of counts (key, total, recent) and their denominators (all_n, recent_n)."""
    index = F.coalesce(quotient(F.col("recent") * F.col("all_n"), F.col("recent_n") * F.col("total")), F.lit(0.0))
    return counts.where(F.col("total") >= least).crossJoin(F.broadcast(totals)).select("key", "total", "recent", index.alias("index"))


def rising(index: DataFrame, least: float = 1.15, k: int = 5) -> DataFrame:
    return index.where(F.col("index") >= least).orderBy(F.col("index").desc(), "key").limit(k)


def cooling(index: DataFrame, most: float = 0.85, k: int = 4) -> DataFrame:
    return index.where((F.col("index") <= most) & (F.col("index") > 0)).orderBy("index", "key").limit(k)


def both_ends(index: DataFrame, k: int = 6) -> DataFrame:
    """(end, key, ...): the k highest and the k lowest; below 2 k rows some are both."""
    high = index.orderBy(F.col("index").desc(), "key").limit(k).withColumn("end", F.lit("high"))
    return high.unionByName(index.orderBy("index", "key").limit(k).withColumn("end", F.lit("low")))


#: Rows that a month has to have for a figure of the market.
MARKET_LEAST = 25


def market_months(rows: DataFrame, ts: Column, conditions: dict[str, Column], value: Column, least: int = MARKET_LEAST) -> DataFrame:
    """(month, n, a count for each condition, median of value) of months with so many rows or more."""
    found = rows.where(ts.isNotNull()).groupBy(month_key(ts).alias("month")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items())).where(F.col("n") >= least)
    middle = medians(rows.where(ts.isNotNull()), month_key(ts), value).select(F.col("key").alias("month"), "median")
    return found.join(middle, "month", "left")


def history(rows: DataFrame, date: Column, dims: dict[str, Column]) -> DataFrame:
    """(date, dim, key, n) of each day; as_maps() makes it one row for a day."""
    melted = rows.select(date.alias("date"), F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), k.alias("key")) for d, k in dims.items()))).alias("x"))
    return melted.groupBy("date", "x.dim", "x.key").agg(F.count("*").alias("n"))


def as_maps(long: DataFrame, dims: list[str]) -> DataFrame:
    """One row for each date with a map from key to count for each dimension."""

    def of(dim: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dim") == dim, F.struct("key", "n"))))).alias(dim)

    return long.groupBy("date").agg(*map(of, dims))


def net_change(days: DataFrame) -> DataFrame:
    """One row of (date, total, added, removed): last total minus first, sums of the others; no change for under two days."""
    found = days.agg(F.count("*").alias("days"), (F.max_by("total", "date") - F.min_by("total", "date")).alias("net"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return found.withColumn("net", F.when(F.col("days") >= 2, F.col("net")))


def newness(rows: DataFrame, ts: Column, cohort: Column, as_of: DataFrame, days: int = 60) -> DataFrame:
    """One row: rows of the cohort and of the rest, how many of each are of the last days, their shares, and growth, the ratio of the shares (null if the rest has none)."""
    marked = rows.crossJoin(F.broadcast(as_of.toDF("_now"))).select(cohort.alias("inside"), F.coalesce(ts >= F.col("_now") - F.make_dt_interval(F.lit(days)), F.lit(False)).alias("recent"))
    found = marked.agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("rest_n"), F.count_if(F.col("inside") & F.col("recent")).alias("recent"), F.count_if(~F.col("inside") & F.col("recent")).alias("rest_recent"))
    found = found.withColumns({"share": quotient(F.col("recent"), F.col("n")), "rest_share": quotient(F.col("rest_recent"), F.col("rest_n"))})
    return found.withColumn("growth", quotient(F.col("share"), F.nullif("rest_share", F.lit(0.0))))


def retained(runs: DataFrame, by: str, k: int = 120) -> DataFrame:
    """The last k runs, the latest first."""
    return runs.orderBy(F.col(by).desc()).limit(k)


def recent_changes(changes: DataFrame, run: str, order: str, runs: int = 5, each: int = 40) -> DataFrame:
    """Of the last runs the first changes of each kind, in their order."""
    last = changes.select(run).distinct().orderBy(F.col(run).desc()).limit(runs)
    place = F.row_number().over(Window.partitionBy(run, "kind").orderBy(order))
    return changes.join(last, run, "left_semi").withColumn("_k", place).where(F.col("_k") <= each).drop("_k")


def stated_points(points: DataFrame, value: str) -> DataFrame:
    """Points of a line that have a value."""
    return points.where(F.col(value).isNotNull())
