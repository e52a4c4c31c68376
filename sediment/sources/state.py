"""Versioned state: documents written whole or not at all, tables in version folders, one pointer that moves by compare-and-swap."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidState(ValueError):
    """State that must not be written or restored."""


class Moved(RuntimeError):
    """Another writer has published meanwhile."""


#: Files of the state and of what is derived from it.
FILES = {"postings": "jobs", "changes": "changes", "history": "history", "last_run": "last-run", "stats": "stats", "browse": "jobs.min"}


def layout(root: str) -> dict[str, str]:
    """Where each table and document of a root is."""
    return {name: f"{root.rstrip('/')}/{file}" for name, file in FILES.items()}


def read_document(path: str, default: Any = None) -> Any:
    """A JSON document; the default only if there is none. A broken one raises."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() else default


def write_document(path: str, value: Any, pretty: bool = False) -> None:
    """Written beside, then put in place in one step. For the small documents of the driver; tables are written by Spark."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_name(f".{file.name}.{uuid.uuid4().hex}")
    with part.open("w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2 if pretty else None)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, file)


def broken(rules: dict[str, Column], rows: DataFrame) -> list[str]:
    """Names of the rules that some row breaks; null is broken. One aggregation."""
    counts = rows.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items())).first().asDict()
    return [k for k, n in counts.items() if n]


def validate(postings: DataFrame, runs: DataFrame, history: DataFrame) -> None:
    """All rules of a state that may be published, or InvalidState with those that it breaks. Columns as in sediment.schema."""
    c = F.col
    faults = broken(
        {
            "id": F.length("id") > 0,
            "status": c("status").isin("open", "closed") & c("title").isNotNull(),
            "seen": c("firstSeenAt").isNotNull() & c("lastSeenAt").isNotNull(),
            "locations": c("locations").isNotNull(),
            "closed": (c("status") != "closed") | c("closedAt").isNotNull(),
            "detail": (c("status") != "open") | (c("hasDetail") & (F.length(F.trim("descriptionHtml")) > 0) & c("detailFetchedAt").isNotNull()),
        },
        postings,
    )
    counters = ("added", "removed", "updated")
    success = c("status").isin("success", "baseline")
    whole = (c("missingDetail") == 0) & (c("searchErrors") == 0) & (c("detailErrors") == 0)
    faults += broken(
        {
            "run": success & c("date").rlike(r"^\d{4}-\d{2}-\d{2}\z") & c("finishedAt").isNotNull(),
            "run coverage": (c("openCount") > 0) & whole,
            "run counts": (c("added") >= 0) & (c("removed") >= 0) & (c("updated") >= 0),
            "baseline": (c("status") != "baseline") | ((c("added") == 0) & (c("removed") == 0) & (c("updated") == 0)),
        },
        runs,
    )
    not_negative = [F.forall(F.map_values(m), lambda v: v >= 0) for m in ("themes", "professions", "orgs")]
    faults += broken({"history": c("date").rlike(r"^\d{4}-\d{2}-\d{2}\z") & c("at").isNotNull() & (c("totalOpen") >= 0) & not_negative[0] & not_negative[1] & not_negative[2]}, history)

    sizes = postings.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(c("status") == "open").alias("open")).first()
    days = history.agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates")).first()
    last = runs.orderBy(c("finishedAt").desc()).limit(1).first()
    if not sizes.n or not days.n or last is None:
        faults.append("an empty table")
    else:
        if sizes.n != sizes.ids:
            faults.append("repeated ids")
        if days.n != days.dates:
            faults.append("repeated dates")
        if last.openCount != sizes.open:
            faults.append("open count")
        day = history.where(c("date") == last.date).first()
        if day is None or day.at != last.finishedAt or day.totalOpen != last.openCount or any(day[k] != last[k] for k in counters):
            faults.append("history of the latest run")
    if faults:
        raise InvalidState(", ".join(faults))


class Store:
    """Tables in <root>/data-<unique>/<name>, and pointers <root>/versions/<N>, each of which holds the name of its version's folder.

    A pointer is written beside and renamed into place, which fails if another writer's is there: that one step both claims the version and
    publishes it. A writer that dies before leaves a folder that nobody reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        """Those that can be read."""
        place = self._path("versions")
        names = [s.getPath().getName() for s in self.files.listStatus(place)] if self.files.exists(place) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """0 before the first publication."""
        return max(self.versions(), default=0)

    def _folder(self, version: int) -> str:
        found = self.files.open(self._path(f"versions/{version}"))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folder(version or self.version())}/{name}")

    def restore(self) -> dict[str, DataFrame]:
        """The tables of the current version, validated before anyone sees them."""
        found = {name: self.read(name) for name in ("postings", "runs", "history")}
        validate(**found)
        return found

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A folder with these tables, which no version names yet."""
        folder = f"data-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        if {"postings", "runs", "history"} <= tables.keys():
            validate(*(self.spark.read.parquet(f"{self.root}/{folder}/{n}") for n in ("postings", "runs", "history")))
        return folder

    def point(self, version: int, folder: str) -> None:
        """Makes a folder this version, or raises Moved if the version is another's. Nothing that is read has changed then."""
        part = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self.files.create(part, True)
        out.write(bytearray(folder.encode()))
        out.close()
        target = self._path(f"versions/{version}")
        # a local file system's rename would replace an existing file
        if self.files.exists(target) or not self._claimed(part, target):
            self.files.delete(part, False)
            raise Moved(f"version {version} is another's")

    def _claimed(self, part, target) -> bool:
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, none)
            return True
        except Exception as error:
            if "FileAlreadyExists" in str(error) or "already exist" in str(error):
                return False
            raise

    def publish(self, tables: dict[str, DataFrame], base: int) -> int:
        """Writes the tables whole, then points version base + 1 at them. If anyone else has published meanwhile, Moved is raised."""
        if base != self.version():
            raise Moved(f"version {self.version()} is current, not {base}")
        folder = self.write(tables)
        try:
            self.point(base + 1, folder)
        except Moved:
            self.files.delete(self._path(folder), True)
            raise
        return base + 1


def write_derived(store: Store, stats: Any, browse: DataFrame, more: dict[str, DataFrame] | None = None) -> int:
    """What is derived from a state: the document of statistics (a table of one JSON text) and the rows that are browsed, as one version, so that nobody sees one of them without the other."""
    document = store.spark.createDataFrame([(json.dumps(stats, ensure_ascii=False, default=str),)], "document string")
    return store.publish({FILES["stats"]: document, FILES["browse"]: browse, **(more or {})}, store.version())


def read_stats(store: Store, version: int | None = None) -> Any:
    return json.loads(store.read(FILES["stats"], version).first()[0])
