"""Counts by dimension that are kept up to date from the changes of a log, instead of being counted again.

A changed row takes one from the cells that it was in and adds one to those that it is in. Only rows of changed keys are read, from the buckets of the
log that have them, and only cells whose count changes are written. What is counted up to which version is noted with the counts, in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.ranking import stated
from sediment.sources.log import Log

#: Columns of a log of counts; cell is the key: dim and value as JSON.
COUNTS = "cell string, dim string, value string, n long"


class Breakdowns:
    """dims: name to an SQL expression, a value or an array of values (a row counts once for each different one). where: the rows that count, as SQL."""

    def __init__(self, source: Log, counts: Log, dims: dict[str, str], where: str = "true"):
        self.source, self.counts, self.dims, self.where = source, counts, dims, where

    def cells(self, rows: DataFrame, sign: Column | int = 1) -> DataFrame:
        """(dim, value, n) of the rows that count."""
        kinds = dict(rows.selectExpr(*(f"{e} as `{d}`" for d, e in self.dims.items())).dtypes)

        def entries(dim: str) -> Column:
            own = F.expr(self.dims[dim])
            values = F.coalesce(F.array_distinct(own), F.array()) if kinds[dim].startswith("array") else F.array(stated(own))
            return F.transform(values, lambda v: F.struct(F.lit(dim).alias("dim"), v.cast("string").alias("value")))

        every = rows.where(self.where).select(F.explode(F.concat(*map(entries, self.dims))).alias("x"))
        return every.groupBy("x.dim", "x.value").agg((F.count("*") * sign).alias("n"))

    def recount(self) -> DataFrame:
        """(dim, value, n) by a scan of the whole source."""
        return self.cells(self.source.read())

    def refresh(self) -> int:
        """Brings the counts to the source's version, and returns theirs. If the version they stand at is gone, all is counted again."""
        at, top = self.counts.manifest()["notes"].get("upto", 0), self.source.version()
        if at == top:
            return self.counts.version()
        if at in self.source.versions():
            changed = self.source.changes(at, top).select(self.source.key).distinct()
            moved = self.cells(self.source.read_keys(changed, top)).unionByName(self.cells(self.source.read_keys(changed, at), -1))
        else:
            moved = self.recount()
            if self.counts.version():
                moved = moved.unionByName(self.read().withColumn("n", -F.col("n")))
        moved = moved.groupBy("dim", "value").agg(F.sum("n").alias("d")).where("d <> 0").withColumn("cell", F.to_json(F.struct("dim", "value")))
        held = self.counts.read() if self.counts.version() else moved.sparkSession.createDataFrame([], COUNTS)
        new = moved.join(held.select("cell", "n"), "cell", "left").select("cell", "dim", "value", (F.coalesce("n", F.lit(0)) + F.col("d")).cast("long").alias("n"))
        return self.counts.append(new.withColumn("gone", F.col("n") == 0), self.counts.version(), {"upto": top})

    def read(self) -> DataFrame:
        """(dim, value, n)."""
        return self.counts.read().select("dim", "value", "n")
