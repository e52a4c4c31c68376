"""Token files: whole texts as ids, range-coded in checksummed blocks, in ascending doc_id order.

A file set is a folder of Parquet files, one for each range of doc_ids, whose rows are blocks of
sediment.llm.rangecoder (column payload) with their part, number, ids and ids before them in their part. Spark's
committer writes them, so that a lost executor or a repeated task leaves no half block, and any store
that Spark can reach will do. Each block is read without any other.

Nulls and empty texts give the end id alone. A null doc_id comes first and stays null. Repeated rows
are all kept; rows of one doc_id lie in the order of their texts' hashes. An empty table gives an
empty file set. Other columns are ignored. A block whose checksum is wrong stops the read. A very long text
and its ids, four bytes each, are held whole by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm import common, rangecoder
from sediment.llm.tokens import chunks, encoder

END = 1
#: Ids after which a block ends; documents are not cut.
BLOCK_IDS = 1 << 21
BLOCKS = "part int, block int, before long, tokens long, documents int, payload binary"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(tokenizer: str, spaced: bool, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer, spaced), TaskContext.get().partitionId()
        vocab = max(coder.vocab, end + 1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = before = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, before, block
            doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(counts)], pa.int32()), pa.array([rangecoder.pack_block(doc_ids, nulls, counts, ids, vocab)], pa.binary())],
                names=["part", "block", "before", "tokens", "documents", "payload"],
            )
            before, block, waiting, held = before + len(ids), block + 1, 0, []
            return row

        for batch in batches:
            for x in chunks(batch):
                ids, counts = coder.encode(x.column("text"))
                ends, inner = np.cumsum(counts + 1) - 1, np.ones(len(ids) + len(counts), bool)
                inner[ends] = False
                whole = np.full(len(inner), end, np.uint32)
                whole[inner] = ids
                doc_id = x.column("doc_id")
                held.append((doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), counts + 1, whole))
                waiting += len(whole)
                if waiting >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, spaced: bool = False, end: int = END) -> None:
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = common.documents(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.transform(common.in_arrow, _write(tokenizer, spaced, end), BLOCKS).write.option("compression", "none").parquet(path)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, nulls, counts, ids = rangecoder.unpack_block(batch.column("payload")[r].as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                first = batch.column("base")[r].as_py() + batch.column("before")[r].as_py()
                raw = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(first + starts), pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    out.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids the ids as little-endian 32-bit integers."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("total"))  # a row for each partition of the write
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = blocks.join(F.broadcast(base), "part").select("before", "base", "payload")
    return placed.transform(common.in_arrow, _read(with_ids), _READ + (", ids binary" if with_ids else ""))
