"""Landed index pages: validation, complete and tolerant scans, rows by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.changes import latest_struct


class IncompleteIndex(ValueError):
    """Pages from which no closure may be inferred."""


#: The share of pages that may fail, and the passes that are tried.
MAX_FAILED, MAX_PASSES = 0.02, 3


def page_faults(sort: str = "timestamp") -> Column:
    """Why a page can't be used; null if it can."""
    blank = F.exists("positions", lambda p: p.isNull() | (F.trim(F.coalesce(p["id"].cast("string"), F.lit(""))) == ""))
    return F.when(F.coalesce(F.col("total"), F.lit(0)) <= 0, "no total").when(F.coalesce(F.size("positions"), F.lit(0)) <= 0, "no positions").when(~F.col("sortBy").eqNullSafe(F.lit(sort)), "another order").when(blank, "a position without an id")


def fingerprint() -> Column:
    """The sorted ids of a page."""
    return F.array_join(F.array_sort(F.transform("positions", lambda p: p["id"].cast("string"))), ",")


def positions(pages: DataFrame) -> DataFrame:
    """(pass, page, at, position's fields) of all pages."""
    return pages.select("pass", "page", F.posexplode("positions").alias("at", "p")).select("pass", "page", "at", "p.*")


def by_id(rows: DataFrame) -> DataFrame:
    """One row for each id: the last page's. at and page stay those of that row."""
    return latest_struct(rows, ["id"], ["page", "at"]).select(*rows.columns)


def tolerant(pages: DataFrame, expected: int, most: float = MAX_FAILED) -> DataFrame:
    """Rows by id of a scan in which few pages are missing or faulty."""
    good = pages.where(page_faults().isNull())
    n = good.select("page").distinct().count()
    if expected <= 0 or (expected - n) / expected > most:
        raise IncompleteIndex(f"{expected - n} of {expected} pages failed")
    return by_id(positions(good))


def complete(pages: DataFrame, most: int = MAX_PASSES) -> tuple[int, DataFrame]:
    """(pass, its rows by id) of the first whole pass: all pages good, one total, as many different ids, and its first and last page read again (column again) with the same ids.

    A pass whose first or last page wasn't read again isn't whole. Passes are never put together.
    """
    pages = pages.where(F.col("pass") <= most)
    faults = pages.groupBy("pass").agg(F.count_if(page_faults().isNotNull()).alias("faults"), F.min("total").alias("low"), F.max("total").alias("high"))
    ids = pages.where(~F.col("again")).select("pass", F.explode("positions").alias("p")).groupBy("pass").agg(F.count_distinct("p.id").alias("ids"))
    seen = pages.select("pass", "page", "again", fingerprint().alias("print"))
    first = seen.where(~F.col("again"))
    ends = first.groupBy("pass").agg(F.array_distinct(F.array(F.min("page"), F.max("page"))).alias("ends")).select("pass", F.explode("ends").alias("page"))
    # every page that was read again must be as before, and both ends must be among them
    again = seen.where("again").select("pass", "page", F.col("print").alias("second"))
    checked = ends.join(again, ["pass", "page"], "left").unionByName(again.join(ends, ["pass", "page"], "left_anti"))
    moved = checked.join(first.select("pass", "page", "print"), ["pass", "page"], "left").groupBy("pass").agg(F.count_if(F.col("second").isNull() | ~F.col("second").eqNullSafe(F.col("print"))).alias("moved"))
    verdict = faults.join(ids, "pass").join(moved, "pass").where("faults = 0 and low = high and ids = low and moved = 0")
    found = verdict.agg(F.min("pass")).first()[0]
    if found is None:
        raise IncompleteIndex("no pass is whole")
    return found, by_id(positions(pages.where((F.col("pass") == found) & ~F.col("again"))))
