"""One run over a book of postings: from the landed pages of an index and the landed details to a published state, its history, counts and reports.

The state is a log (sediment.sources.log), of which a run writes the postings that changed. A run's own row goes with its version; what is derived from the
state notes up to which version it is, so that a run that dies between the two is caught up by the next one. Nothing is published unless the
index is whole, every listed posting has its detail, and the state that would come of it is valid.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sediment import schema
from sediment.functions import tables
from sediment.operators import browse, changes, classify, reports
from sediment.operators.maintained import Breakdowns
from sediment.operators.ranking import stated
from sediment.session import scratch
from sediment.sources import landing
from sediment.sources.log import Log
from sediment.sources.state import Store, validate, write_derived

#: Dimensions whose counts are kept from run to run.
DIMS = {"profession": "profession", "seniority": "seniority", "archetype": "archetype", "org": "org", "theme": "themes", "product": "products", "skill": "skills"}
#: Columns that the transition of a state adds, as postings call them.
_NAMES = {"first_seen": "firstSeenAt", "last_seen": "lastSeenAt", "closed_at": "closedAt", "days_open": "daysOpen"}
_STATE = "status string, first_seen timestamp, last_seen timestamp, closed_at timestamp, days_open long"


class IncompleteDetails(ValueError):
    """Listed postings have no usable detail, and an index read since still lists them."""


class Refused(ValueError):
    """A first run that isn't called one, or one that would begin anew over a state."""


class Book:
    """The state of a book under a root that all executors share: postings, runs, days of history, counts by dimension, and what is shown."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log, self.run_log, self.day_log, self.count_log = Log(spark, f"{self.root}/postings", "id"), Log(spark, f"{self.root}/runs", "date_at", 1), Log(spark, f"{self.root}/history", "date", 1), Log(spark, f"{self.root}/counts", "cell", 4)
        self.shown = Store(spark, f"{self.root}/shown")
        self.counts = Breakdowns(self.log, self.count_log, DIMS, "status = 'open'")

    def postings(self, version: int | None = None) -> DataFrame:
        """Postings as of sediment.schema. Open ones were last seen by the version's run."""
        return self._named(self.log.read(version=version), self.log.manifest(version)["notes"]["run"]["finishedAt"])

    def _named(self, rows: DataFrame, at: str) -> DataFrame:
        rows = rows.drop("kind", "changed", "version", "gone").withColumn("last_seen", F.when(F.col("status") == "open", F.lit(at).cast("timestamp")).otherwise(F.col("last_seen")))
        return rows.withColumnsRenamed(_NAMES)

    def state(self, live: DataFrame) -> DataFrame:
        if self.log.version():
            return self.log.read().drop("kind", "changed").select(*live.columns, *StructType.fromDDL(_STATE).names)
        return self.spark.createDataFrame([], StructType(live.schema.fields + StructType.fromDDL(_STATE).fields))

    def runs(self) -> DataFrame:
        return self.run_log.read().drop("date_at")

    def history(self) -> DataFrame:
        return self.day_log.read()

    def changes(self, after: int = 0) -> DataFrame:
        """(id, kind, changed, version) of all versions after one."""
        return self.log.changes(after).select("id", "title", "kind", "changed", "version")

    def day(self, postings: DataFrame, run: dict) -> DataFrame:
        """The history's row of a run."""
        is_open = F.col("status") == "open"
        entries = {"themes": F.coalesce("themes", F.array().cast("array<string>")), "professions": F.array(stated(F.col("profession"))), "orgs": F.array_compact(F.array("org"))}
        cells = F.concat(*(_entries(d, v) for d, v in entries.items()))
        long = postings.where(is_open).select(F.explode(cells).alias("x")).groupBy("x.dim", "x.key").agg(F.count("*").alias("n"))
        none = F.create_map().cast("map<string,bigint>")
        maps = long.agg(*(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dim") == d, F.struct("key", "n"))))), none).alias(d) for d in entries))
        return maps.select(F.lit(run["date"]).alias("date"), F.lit(run["finishedAt"]).cast("timestamp").alias("at"), *(F.lit(run[a]).cast("long").alias(b) for a, b in (("openCount", "totalOpen"), ("added", "added"), ("removed", "removed"), ("updated", "updated"))), *entries)

    def run_row(self, run: dict) -> DataFrame:
        fields = StructType.fromDDL(schema.RUN)
        values = [dt.datetime.fromisoformat(run[f.name]) if f.name.endswith("At") else run[f.name] for f in fields]
        return self.spark.createDataFrame([tuple(values)], fields)

    def catch_up(self) -> None:
        """Brings runs, history, counts and what is shown to the version of the postings; does nothing if they are."""
        top = self.log.version()
        if not top:
            return
        run = self.log.manifest()["notes"]["run"]
        if self.run_log.manifest()["notes"].get("upto", 0) < top:
            self.run_log.append(self.run_row(run).withColumn("date_at", F.lit(run["finishedAt"])), self.run_log.version(), {"upto": top})
        if self.day_log.manifest()["notes"].get("upto", 0) < top:
            self.day_log.append(self.day(self.postings(), run), self.day_log.version(), {"upto": top})
        self.counts.refresh()
        noted = self.shown.read("upto").first()[0] if self.shown.version() else 0
        if noted < top:
            as_of = F.lit(run["finishedAt"]).cast("timestamp")
            found = self.postings()
            stats = reports.document({k: v for k, v in reports.overview(found, as_of).items() if k != "breakdowns"})
            write_derived(self.shown, {"run": run, **stats}, browse.browse_rows(found), {"upto": self.spark.createDataFrame([(top,)], "version long")})


def _entries(dim: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(dim).alias("dim"), x.alias("key")))


def records(rows: DataFrame, details: DataFrame, state: DataFrame) -> DataFrame:
    """Listed rows (of landing) with their details, classified. details: schema.DETAIL, fetchedAt, and error, which is null for those that can be used."""
    good = details.where(F.col("error").isNull() & (F.trim(F.coalesce("jobDescription", F.lit(""))) != ""))
    good = changes.latest_struct(good.drop("error"), ["id"], ["fetchedAt"])
    found = classify.record(rows, good.drop("fetchedAt"), state)
    found = found.join(rows.select("id", "isHot", "workLocationOption"), "id").join(good.select("id", "fetchedAt"), "id", "left").join(state.select("id", F.col("detailFetchedAt").alias("_before")), "id", "left")
    found = found.withColumn("detailFetchedAt", F.coalesce("fetchedAt", "_before")).drop("fetchedAt", "_before")
    return classify.classified(found)


def run(book: Book, pages: DataFrame, details: DataFrame, now: dt.datetime, baseline: bool = False, refreshed: DataFrame | None = None, started: dt.datetime | None = None, compact_every: int = 8) -> dict:
    """One strict run; returns its row. pages: schema.PAGE with again. baseline: the first run, whose postings count as no additions.

    refreshed: (id) of an index that was read after details had failed; failed ones that it doesn't list have closed meanwhile.
    """
    if baseline and book.log.version():
        raise Refused("there is a state already")
    if not baseline and not book.log.version():
        raise Refused("a first run must be called one")
    book.catch_up()
    base = book.log.version()
    number, rows = landing.complete(pages)
    listed = rows.count()
    if refreshed is not None:
        failed = details.where("error is not null").select("id").distinct()
        gone = changes.gone_or_failed(failed, refreshed, "id").where("not listed").select("id")
        rows = rows.join(gone, "id", "left_anti")
    spark = book.spark
    fields = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema.POSTING)}
    known = book.log.read() if base else spark.createDataFrame([], StructType.fromDDL(schema.POSTING))
    live = records(rows, details, known.select(*(F.col(c) if c in known.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items())))
    live = live.select(*(F.col(c).cast(fields[c]).alias(c) for c in fields if c not in ("status", *_NAMES.values())))
    path = scratch(spark, "live")
    live.write.parquet(path)
    live = spark.read.schema(live.schema).parquet(path)
    missing = live.where(~F.col("hasDetail") | (F.trim(F.coalesce("descriptionHtml", F.lit(""))) == "")).count()
    if missing:
        raise IncompleteDetails(f"{missing} of {listed} listed postings have no detail")

    at = F.lit(now)
    path = scratch(spark, "found")
    state = book.state(live)
    changes.transition(state, live, "id", tables.TRACKED, at).write.parquet(path)
    found = spark.read.parquet(path)
    n = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    row = {
        "status": "baseline" if baseline else "success", "date": f"{now:%Y-%m-%d}", "startedAt": (started or now).isoformat(), "finishedAt": now.isoformat(), "mode": f"pass {number}", "openCount": live.count(), "missingDetail": 0, "searchErrors": 0, "detailErrors": 0,
        "added": 0 if baseline else n.get("added", 0), "removed": n.get("removed", 0), "updated": n.get("updated", 0),
    }
    after = state.join(found.select("id"), "id", "left_anti").unionByName(found.drop("kind", "changed"))
    after = book._named(after, row["finishedAt"])
    history = book.day(after, row)
    if base:
        history = changes.upsert(book.history(), history, ["date"])
    validate(after, book.runs().unionByName(book.run_row(row)) if base else book.run_row(row), history)
    book.log.append(found, base, {"run": row})
    if len(book.log.manifest()["changes"]) >= compact_every:
        book.counts.refresh()
        book.log.compact()
    book.catch_up()
    return row
