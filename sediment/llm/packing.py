"""Concatenate and cut: documents as one long row of tokens, cut into windows of a fixed width.

Pass 1 encodes every text once and writes, for each document, its ids and the tokens before it in its
partition. The totals of the partitions give, by a prefix sum, the place of every partition in the
whole row; pass 2 adds the two numbers and cuts at the multiples of the width. No text or id is
shuffled, and all that meets in one task is one row for each partition.

Nulls and empty texts give a document of the end id alone. Repeated rows, also of one doc_id, are
packed one by one. A null doc_id stays null. An empty table gives no rows. Other columns are ignored. A very long
text and its ids, four bytes each, are held whole by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.tokens import chunks, encoder

END = 1
WIDTH = 2048
_CODED = "part int, before long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(tokenizer: str, spaced: bool, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0
        for batch in batches:
            for x in chunks(batch):
                ids, counts = coder.encode(x.column("text"))
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                tail = np.uint32(end).tobytes()
                n = counts + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n), x.column("doc_id"), pa.array(n), pa.array([ids[a:b].tobytes() + tail for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["part", "before", "doc_id", "n", "ids"],
                )
                before += int(n.sum())

    return run


def encoded(docs: DataFrame, tokenizer: str, spaced: bool = True, end: int = END) -> DataFrame:
    """A written table (part, before, doc_id, n, ids): little-endian 32-bit ids of each document with its end id, and the number of ids before it in its part."""
    return common.written(common.documents(docs).transform(common.in_arrow, _encode(tokenizer, spaced, end), _CODED), "ids")


def offsets(coded: DataFrame) -> DataFrame:
    """(part, base): the ids before each part. One row for each partition of the input, whatever its size."""
    totals = coded.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))


def _cut(width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            g = batch.column("before").to_numpy() + batch.column("base").to_numpy()
            first = g // width
            count = (g + n - 1) // width - first + 1
            row = np.repeat(np.arange(len(n)), count)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(window * width - g[row], 0)
            stop = np.minimum((window + 1) * width - g[row], n[row])
            ids = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            parts = [ids[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
            out = [batch.column("doc_id").take(pa.array(row)), start, stop - start, [zlib.crc32(p) for p in parts], n[row], window, g[row] + start - window * width]
            names = _PIECES.replace(" long", "").split(", ")
            if with_ids:
                out, names = [*out, pa.array([p.tobytes() for p in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, spaced: bool = True, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: its place in the document and in its sequence. with_ids: also the ids, 32-bit little-endian. Sequences are full but for the last, which a reader pads."""
    coded = encoded(docs, tokenizer, spaced, end)
    placed = coded.join(F.broadcast(offsets(coded)), "part").select("before", "base", "doc_id", "n", "ids")
    return placed.transform(common.in_arrow, _cut(width, with_ids), _PIECES + (", ids binary" if with_ids else ""))
