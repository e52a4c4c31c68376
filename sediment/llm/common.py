"""What the training-data operators share: reading tables, scratch tables, batching."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, \n, \v, \f, \r. Everything else is part of a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null doc_id where rows are told apart by doc_id and the hash of their text.
NO_ID = -(1 << 63)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a documents table; a null text becomes the empty one. Other columns are left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Set here only where the session has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sediment-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/sediment-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with marks before it until no column of df is called so, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keyed(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """docs with two more columns, which together tell its rows apart: the doc_id (NO_ID for null), and the hash of the text (a null is the empty one)."""
    return docs.withColumns({doc: F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), key: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))})


def one_row_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each of wanted (doc_id, key) one row of docs that has these, with all columns of docs."""
    a, b, x, y, rows = fresh(docs, "own_id", "own_key", "wanted_id", "wanted_key", "rows")
    wanted = wanted.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(x), F.col("key").alias(y))
    found = keyed(docs, a, b).join(wanted, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_semi")
    several = written(found.groupBy(a, b).agg(F.count("*").alias(rows)).where(F.col(rows) > 1).select(a, b), "several")
    if not several.isEmpty():  # equal rows
        found = found.dropDuplicates([a, b])
    return found.select(*all_of(docs))


def give_back() -> None:
    """Freed memory, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), whose tasks give memory back at their end: workers are kept for later tasks, of other operators too."""
    return df.mapInArrow(_tidied(run), schema)


#: A key with over 1 / HOT of all rows is joined by a broadcast; there are HOT such keys at most, whatever the data.
HOT = 4096


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows with the columns of groups, inner, by keys that are never null. groups has one row for each key, and in weight how many of the total rows have it.

    The at most HOT keys with more than total / HOT rows are broadcast, so that none of them meets in one task; all others are shuffled.
    """
    (mark,) = fresh(rows.join(groups.limit(0), keys), "is_hot")
    hot = F.col(weight) * HOT > total
    marked = rows.join(F.broadcast(groups.where(hot).withColumn(mark, F.lit(True))), keys, "left")
    own = [F.col(c) for c in rows.columns]
    cold = marked.where(F.col(mark).isNull()).select(*own).join(groups.where(~hot), keys)
    return marked.where(F.col(mark)).drop(mark).unionByName(cold)
