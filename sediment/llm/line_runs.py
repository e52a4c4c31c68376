"""Lines that repeat across documents, by levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The keys of a batch's lines (128 bits of hash) are grouped, and a merge anti-join with each run leaves those that no earlier
document holds; these become a run of their own. A run is a table bucketed and sorted by the hash, so that the joins shuffle the batch alone. `fan`
runs of a level are compacted to one of the next, so that there are about fan * log(batches) runs. A key that some run holds is dropped from all documents of the batch, a new
one from all but the smallest doc_id. Keys that hold much of a batch's lines are joined by a broadcast of proven size (common.spread_join).

A null or empty text is one empty line, which is never dropped. Rows of one doc_id are one document, of which a line is kept in all rows; a null doc_id
is the smallest one. Lines of any length are hashed whole. Very long texts become an array of lines in their task. Repeated rows are returned as often as they come. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import common

#: Code points of the shortest key that counts.
SHORTEST = 10
#: Batches; runs of a level that are compacted; lines for each bucket.
BATCHES, FAN, PER_BUCKET = 6, 3, 16_000_000
#: The most buckets that Spark allows by default; beyond it buckets grow.
MOST_BUCKETS = 100_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Runs:
    """The keys (h1, h2) of all documents so far: levels of tables, each bucketed and sorted by its hash."""

    def __init__(self, spark: SparkSession, buckets: int, fan: int = FAN):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def table(self, keys: DataFrame) -> str:
        """Name of a new table with these rows, bucketed and sorted. Its files lie in the shared folder."""
        name = f"run_{uuid.uuid4().hex}"
        parts = keys.repartition(self.buckets, "h1", "h2")
        parts.write.option("path", common.scratch(self.spark, "run")).option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables.append(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run holds."""
        for level in self.levels:
            for name in level:
                keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, name: str) -> None:
        """A table of keys that no run holds becomes a run; full levels are compacted."""
        depth = 0
        while True:
            if depth == len(self.levels):
                self.levels.append([])
            self.levels[depth].append(name)
            if len(self.levels[depth]) < self.fan:
                return
            whole = self.spark.table(self.levels[depth][0]).select("h1", "h2")
            for other in self.levels[depth][1:]:
                whole = whole.unionAll(self.spark.table(other).select("h1", "h2"))
            name, self.levels[depth], depth = self.table(whole), [], depth + 1

    def drop(self) -> None:
        """Forgets the tables; their files go when the application ends."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.tables = []


def key(line: Column) -> Column:
    """What two lines have in common if they count as one."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def lines(docs: DataFrame, least: int = SHORTEST) -> DataFrame:
    """(doc, row, at, h1, h2): a row for each line that counts. doc and row (hash of the text) tell the rows of docs apart."""
    known = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NO_ID)).alias("doc"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    each = known.select("doc", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc", "row", "at", key(F.col("line")).alias("key"))
    return each.where(F.char_length("key") >= least).select("doc", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def repeats(docs: DataFrame, batches: int = BATCHES, fan: int = FAN, least: int = SHORTEST, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc, row, at) of every line that is to go, a written table."""
    spark = docs.sparkSession
    found = lines(docs, least)
    ids = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NO_ID)).alias("doc"))
    cuts = sorted(set(ids.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    batch = sum(((F.col("doc") > F.lit(int(c))).cast("int") for c in cuts), F.lit(0))
    path = common.scratch(spark, "lines")
    found.withColumn("batch", batch).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    schema = found.schema.add("batch", "integer")
    everything = spark.read.schema(schema).parquet(path)
    sizes = {r.batch: r.n for r in everything.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # one for each batch
    gone = spark.createDataFrame([], "doc long, row long, at int")
    runs = Runs(spark, min(MOST_BUCKETS, max(8, -(-sum(sizes.values()) // per_bucket))), fan)
    try:
        for number in sorted(sizes):
            here = everything.where(F.col("batch") == number).drop("batch")
            own = here.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
            own = common.written(own, "keys")
            new = runs.table(runs.unseen(own).select("h1", "h2", "first"))
            runs.add(new)
            # null: an earlier batch holds it; keys of one document that no run holds are left out
            stays = own.join(spark.table(new).select("h1", "h2", F.col("first").alias("keeper")).hint("merge"), ["h1", "h2"], "left").where("keeper is null or first < last")
            told = common.written(stays.select("h1", "h2", "n", "keeper"), "told")
            dropped = common.spread_join(here, told, ["h1", "h2"], "n", sizes[number]).where("keeper is null or doc <> keeper")
            gone = gone.unionByName(common.written(dropped.select("doc", "row", "at"), "gone"))
    finally:
        runs.drop()
    return gone


def dedup(docs: DataFrame, batches: int = BATCHES, fan: int = FAN, least: int = SHORTEST, per_bucket: int = PER_BUCKET) -> DataFrame:
    """docs with kept, the text without the lines that go, n_lines before, and n_dropped."""
    gone = repeats(docs, batches, fan, least, per_bucket).groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))
    doc, row, a, b, ats, parts, kept, n_lines, n_dropped = common.fresh(docs, "own_doc", "own_row", "gone_doc", "gone_row", "gone_at", "parts", "kept", "n_lines", "n_dropped")
    gone = gone.select(F.col("doc").alias(a), F.col("row").alias(b), F.col("gone").alias(ats))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    both = common.keyed(docs, doc, row).join(gone, (F.col(doc) == F.col(a)) & (F.col(row) == F.col(b)), "left")
    both = both.withColumn(parts, F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(ats))
    joined = F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    return both.select(*common.all_of(docs), F.when(F.col(ats).isNull(), text).otherwise(joined).alias(kept), F.size(parts).cast("long").alias(n_lines), F.coalesce(F.size(ats), F.lit(0)).cast("long").alias(n_dropped))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return dedup(own).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
