"""Faceted browsing: conjunctive filters, search, sort orders, pages, values of facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.text import city_label, place
from sediment.operators.ranking import stated

#: Asks for rows without a value.
NONE = "__none"


def facets(rows: DataFrame, equal: dict[str, str | None] | None = None, holds: dict[str, str | None] | None = None) -> DataFrame:
    """Rows that meet all facets; one without a value asks for nothing. equal: scalar columns, where NONE asks for null; holds: arrays."""
    for column, value in (equal or {}).items():
        if value:
            rows = rows.where(F.col(column).isNull() if value == NONE else F.col(column) == value)
    for column, value in (holds or {}).items():
        if value:
            rows = rows.where(F.array_contains(column, value))
    return rows


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold the query in these columns, joined by spaces, whatever its case; nothing in it is a wildcard."""
    query = query.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query))) if query else rows


def ordered(rows: DataFrame, by: str, title: str = "title", ts: str = "creationTs", key: str = "id") -> DataFrame:
    """by: title, oldest or newest (a missing time is the oldest); ties by key."""
    at = F.coalesce(F.col(ts), F.lit(0))
    first = {"title": F.col(title).asc(), "oldest": at.asc(), "newest": at.desc()}[by]
    return rows.orderBy(first, key)


def page(rows: DataFrame, number: int, size: int = 40) -> DataFrame:
    """Page number (from 0) of ordered rows."""
    return rows.offset(number * size).limit(size)


def facet_values(rows: DataFrame, column: str, many: bool = False) -> DataFrame:
    """(value) of a facet, different and not empty, in order."""
    values = rows.select(F.explode(column).alias("value")) if many else rows.select(F.col(column).alias("value"))
    return values.where(F.coalesce(F.col("value"), F.lit("")) != "").distinct().orderBy("value")


def browse_rows(postings: DataFrame) -> DataFrame:
    """Open postings as the rows that are browsed: no descriptions, places joined, 320 characters of the overview."""
    places = F.transform(F.coalesce("locations", F.array().cast("array<string>")), lambda x, i: place(x, F.get("countryCodes", i)))
    rows = postings.where(F.col("status") == "open").withColumn("_places", places)

    def tags(column: str) -> Column:
        return F.coalesce(column, F.array().cast("array<string>")).alias(column)

    return rows.select(
        "id", "jobId", "title",
        *(stated(F.col(c)).alias(c) for c in ("profession", "discipline", "roleType", "employmentType")),
        "seniority",
        *(stated(F.col(c)).alias(c) for c in ("workSite", "travel")),
        F.array_distinct(F.transform("_places", lambda p: p["country"])).alias("countries"),
        F.array_join(F.array_distinct(F.transform("_places", lambda p: city_label(p["city"], p["country"]))), " | ").alias("location"),
        "postedTs", "creationTs", tags("themes"), tags("industries"), stated(F.col("archetype"), "other").alias("archetype"), tags("skills"), "requiredYears", tags("products"),
        F.nullif("org", F.lit("")).alias("org"), tags("solutionAreas"), tags("initiatives"), F.substring(F.coalesce("overview", F.lit("")), 1, 320).alias("overview"), "url",
    )


def facet_counts(rows: DataFrame, equal: dict[str, str | None], holds: dict[str, str | None]) -> DataFrame:
    """(facet, value, n): the values of every facet, each counted under the filters of all other ones, in one pass.

    A row that meets all filters counts for every facet, one that fails a single filter for that facet only, any other for none. Facets as in facets();
    NONE stands for rows without a value of a scalar one.
    """
    tests = {k: F.lit(True) if not v else F.col(k).isNull() if v == NONE else F.col(k) == v for k, v in equal.items()}
    tests |= {k: F.array_contains(k, v) if v else F.lit(True) for k, v in holds.items()}
    tests = {k: F.coalesce(t, F.lit(False)) for k, t in tests.items()}
    failed = sum(((~t).cast("int") for t in tests.values()), F.lit(0))

    def entries(facet: str) -> Column:
        values = F.array_distinct(F.coalesce(facet, F.array().cast("array<string>"))) if facet in holds else F.array(F.coalesce(F.col(facet).cast("string"), F.lit(NONE)))
        cells = F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))
        alone = F.col("_failed") == 0 if not (equal | holds)[facet] else (F.col("_failed") == 0) | ((F.col("_failed") == 1) & ~F.col(f"_meets_{facet}"))
        return F.when(alone, cells).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    marked = rows.withColumns({"_failed": failed} | {f"_meets_{k}": t for k, t in tests.items()})
    return marked.select(F.explode(F.concat(*map(entries, tests))).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
