"""A keyed table as a log: base files by bucket of the key, the changes of each version beside them, merged when read.

A version is a small document that names, for each bucket, the folder with its base rows, and the folders of the changes since. To publish a version only
its changes are written. compact() rewrites the buckets that have changes, and no others, and moves the changes to the archive, whose
folders are merged level by level; vacuum() removes what no kept version names. Folders are written first and named by one step that
fails if another writer has taken the version (see Store), so a writer that dies leaves a folder that nobody reads.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sediment.operators.changes import latest_struct
from sediment.sources.state import InvalidState, Moved, Store

#: Buckets of the base; versions between compactions; folders of a level of the archive that are merged.
BUCKETS, EVERY, FAN = 16, 8, 4


class Log(Store):
    """Rows by key. Columns version (long) and gone (boolean, null is false) belong to the log: a row that is gone deletes its key."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.key, self.buckets = key, buckets

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """What a version consists of: base (bucket to folder), changes and archive (folders), notes, and the columns."""
        at = self.version() if version is None else version
        if not at:
            return {"version": 0, "base": {}, "changes": [], "archive": [], "notes": {}, "schema": None}
        return json.loads(self._folder(at)) | {"version": at}

    def _claim(self, manifest: dict[str, Any], version: int, folders: list[str]) -> int:
        """Makes the manifest this version; else removes the new folders and raises Moved."""
        try:
            self.point(version, json.dumps({k: v for k, v in manifest.items() if k != "version"}))
        except Moved:
            for folder in folders:
                self.files.delete(self._path(folder), True)
            raise
        return version

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _parquet(self, schema: StructType, paths: list[str]) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, changes: DataFrame, base: int, notes: dict[str, Any] | None = None) -> int:
        """Publishes version base + 1: the rows of changes take the place of those of their keys. One row for each key, or InvalidState.

        notes: a few values kept with the version; those of before stay. The first version settles the columns.
        """
        old = self.manifest()
        if old["version"] != base:
            raise Moved(f"version {old['version']} is current, not {base}")
        if "gone" not in changes.columns:
            changes = changes.withColumn("gone", F.lit(False))
        changes = changes.withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("version", F.lit(base + 1).cast("long"))
        schema = StructType.fromJson(old["schema"]) if old["schema"] else StructType.fromJson(json.loads(changes.schema.json()))
        folder = f"data-{uuid.uuid4().hex}"
        changes.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{self.root}/{folder}")
        sizes = self._parquet(schema, [folder]).agg(F.count("*").alias("n"), F.count_distinct(self.key).alias("keys")).first()
        if sizes.n != sizes["keys"]:
            self.files.delete(self._path(folder), True)
            raise InvalidState("repeated or missing keys in one version")
        new = old | {"schema": json.loads(schema.json()), "changes": old["changes"] + [folder] * bool(sizes.n), "notes": old["notes"] | (notes or {})}
        return self._claim(new, base + 1, [folder])

    def _merged(self, m: dict[str, Any], only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        held = self._parquet(schema, [f"{folder}/bucket={b}" for b, folder in m["base"].items() if only is None or int(b) in only])
        changes = self._parquet(schema, m["changes"])
        if only is not None:
            changes = changes.where(self._bucket().isin(only))
        newest = latest_struct(changes, [self.key], ["version"])
        return held.join(newest.select(self.key), self.key, "left_anti").unionByName(newest.where(~F.col("gone")))

    def read(self, name: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, merged: those of the base whose key has no change, and the last change of each key that isn't gone."""
        m = self.manifest(version)
        if not m["schema"]:
            raise InvalidState("nothing is published")
        return self._merged(m).drop("version", "gone")

    def read_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of a version whose key is in keys; only the buckets that these are in are read."""
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # self.buckets at most
        return self._merged(self.manifest(version), touched).join(keys.select(self.key).distinct(), self.key, "left_semi").drop("version", "gone")

    def changes(self, after: int = 0, version: int | None = None) -> DataFrame:
        """All changes of the versions after one, with their version and gone."""
        m = self.manifest(version)
        folders = [f for level in m["archive"] for f in level] + m["changes"]
        return self._parquet(StructType.fromJson(m["schema"]), folders).where(F.col("version") > after)

    def compact(self) -> int:
        """Publishes a version with the same rows, whose base has the changes in it. Only the buckets of changed keys are written."""
        m = self.manifest()
        if not m["changes"]:
            return m["version"]
        schema = StructType.fromJson(m["schema"])
        changes = self._parquet(schema, m["changes"])
        touched = sorted(r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # self.buckets at most
        folder, moved = f"data-{uuid.uuid4().hex}", f"data-{uuid.uuid4().hex}"
        self._merged(m, touched).withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        full = [s.getPath().getName().removeprefix("bucket=") for s in self.files.listStatus(self._path(folder)) if s.isDirectory()]
        base = {b: f for b, f in m["base"].items() if int(b) not in touched} | {b: folder for b in full}
        changes.write.parquet(f"{self.root}/{moved}")
        archive, written = [list(level) for level in m["archive"]], [folder, moved]
        depth = 0
        while True:
            if depth == len(archive):
                archive.append([])
            archive[depth].append(moved)
            if len(archive[depth]) < FAN:
                break
            rows, moved = self._parquet(schema, archive[depth]), f"data-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{moved}")
            written.append(moved)
            archive[depth], depth = [], depth + 1
        return self._claim(m | {"base": base, "changes": [], "archive": archive}, m["version"] + 1, written)

    def vacuum(self, keep: int = 2, grace: float = 86_400) -> list[str]:
        """Forgets all but the newest versions, and removes the folders that none of these names. Folders younger than grace seconds may be a writer's, and stay."""
        top = self.version()
        kept = [self.manifest(v) for v in range(max(1, top - keep + 1), top + 1)] if top else []
        named = {f for m in kept for f in [*m["base"].values(), *m["changes"], *(x for level in m["archive"] for x in level)]}
        for version in self.versions():
            if version <= top - keep:
                self.files.delete(self._path(f"versions/{version}"), False)
        gone = []
        for s in self.files.listStatus(self._path("")):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in named and s.getModificationTime() <= (time.time() - grace) * 1000:
                self.files.delete(s.getPath(), True)
                gone.append(name)
        return gone
