"""Change capture on a stream of snapshots that come in pages, in any number of micro-batches.

Rows wait in a table of pending pages until all rows of their snapshot have come; then the snapshot is compared with the state, and what changed is
appended to the log (sediment.sources.log), so that what is written follows the changes and not the state. Snapshots are applied in the order of their times. One that
isn't complete holds back later ones until `wait` has passed between their times; then it is refused and put aside.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from sediment.operators.changes import latest_struct, transition
from sediment.sources import log as logs

_FORMAT = "yyyyMMdd'T'HHmmssSSSSSS"
_STATE = "status string, first_seen timestamp, last_seen timestamp, closed_at timestamp, days_open long"


class LateRows(RuntimeError):
    """Rows of a snapshot that is in the state already, or of an older one."""


class Capture:
    """For foreachBatch. Columns of the stream: snapshot (timestamp), total (how many rows the snapshot has), page, the key, and others.

    fields: those whose changes count. order: the place of a row in its page; page and order tell the rows of a snapshot apart, so that one that comes twice counts once, and of rows with one key the
    last wins. late: raise LateRows, or keep them "aside".
    A batch that is run again changes nothing: its pending pages are written over, and the log says with which batch its last snapshot came.
    """

    def __init__(self, log: logs.Log, fields: list[str], order: list[str], wait: dt.timedelta = dt.timedelta(days=1), late: str = "raise", every: int = logs.EVERY, keep: int = 2, grace: float = 86_400):
        self.log, self.fields, self.order, self.wait, self.late, self.every, self.keep, self.grace = log, fields, order, wait, late, every, keep, grace
        self.pending = f"{log.root}/pending"

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("at", F.date_format("snapshot", _FORMAT))
        rows.write.mode("overwrite").partitionBy("at").parquet(f"{self.pending}/batch={number}")
        self.advance(StructType.fromJson(batch.schema.jsonValue()).add("batch", "long").add("at", "string"), number)

    def _rows(self, schema: StructType) -> DataFrame:
        return self.log.spark.read.schema(schema).option("basePath", self.pending).parquet(self.pending)

    def _forget(self, at: str) -> None:
        for s in self.log.files.globStatus(self.log._path(f"pending/batch=*/at={at}")) or []:
            self.log.files.delete(s.getPath(), True)

    def advance(self, schema: StructType, number: int) -> None:
        """Applies all snapshots that are complete, as far as none before them is awaited."""
        rows = self._rows(schema)
        whole = (F.count_distinct("page", *self.order) == F.max("total")) & (F.min("total") == F.max("total"))
        # one row for each snapshot that waits
        waiting = rows.groupBy("at").agg(F.max("snapshot").alias("snapshot"), F.max("batch").alias("batch"), whole.alias("whole")).orderBy("at").collect()
        for w in waiting:
            done = self.log.manifest()["notes"]
            if w.at <= done.get("snapshot", ""):
                if w.batch > done["batch"]:
                    self._put_aside_late(rows.where(F.col("at") == w.at), w.at, number)
                self._forget(w.at)  # else a batch that is run again
            elif w.whole:
                self.apply(rows.where(F.col("at") == w.at), w.at, w.snapshot, number)
                self._forget(w.at)
            elif waiting[-1].snapshot - w.snapshot > self.wait:
                rows.where(F.col("at") == w.at).write.mode("overwrite").parquet(f"{self.log.root}/refused/at={w.at}")
                self._forget(w.at)
            else:
                break

    def _put_aside_late(self, rows: DataFrame, at: str, number: int) -> None:
        if self.late == "raise":
            raise LateRows(f"rows of {at} came with batch {number}, after it was applied")
        rows.write.mode("overwrite").parquet(f"{self.log.root}/late/at={at}/batch={number}")

    def apply(self, rows: DataFrame, at: str, snapshot: dt.datetime, number: int) -> None:
        key = self.log.key
        live = latest_struct(rows.drop("snapshot", "total", "batch", "at"), [key], ["page", *self.order]).drop("page")
        base = self.log.version()
        now = F.to_timestamp(F.lit(at), _FORMAT)
        state = self.state() if base else self.log.spark.createDataFrame([], StructType(live.schema.fields + StructType.fromDDL(_STATE).fields))
        found = transition(state, live, key, self.fields, now).withColumn("changed_at", now)
        self.log.append(found, base, {"snapshot": at, "batch": number})
        if len(self.log.manifest()["changes"]) >= self.every:
            self.log.compact()
            self.log.vacuum(self.keep, self.grace)

    def state(self, version: int | None = None) -> DataFrame:
        """All rows by key. Open ones were last seen in the latest snapshot, which is noted once and not in each row."""
        seen = F.to_timestamp(F.lit(self.log.manifest(version)["notes"]["snapshot"]), _FORMAT)
        return self.log.read(version=version).drop("kind", "changed", "changed_at").withColumn("last_seen", F.when(F.col("status") == "open", seen).otherwise(F.col("last_seen")))

    def changes(self, after: int = 0) -> DataFrame:
        """(key, kind, changed, changed_at, version) of the versions after one."""
        return self.log.changes(after).select(self.log.key, "kind", "changed", "changed_at", "version")

    def refused(self) -> list[str]:
        """Times of the snapshots that never became complete; their rows are kept in refused."""
        return sorted(s.getPath().getName().removeprefix("at=") for s in self.log.files.globStatus(self.log._path("refused/at=*")) or [])


def start(stream: DataFrame, capture: Capture, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """trigger: as of DataStreamWriter.trigger; all that is there, and then an end, if none is given."""
    return stream.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(stream: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """(window, key, n) of calendar days, for rows up to so late."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
