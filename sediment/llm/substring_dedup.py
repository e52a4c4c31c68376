"""Removal of every byte that a repeated string of SIZE bytes covers, over all documents, by sorted suffixes.

A suffix array of all bytes would not do at scale, so suffixes are sorted only at anchors. The anchor
of a window of SIZE bytes is its gram of GRAM bytes with the least hash, so equal windows
have their anchors at equal places. Windows next to each other mostly share one; a run of
such windows, cut in two blocks by the distance d of window and anchor, is a context. All windows of a block share a core
of bytes around the anchor, so contexts with a repeated window have equal cores.

1. One pass makes a row of hashes for each context (about one for 115 bytes). Those whose core no other has are done.
2. Contexts that are equal as wholes, in whatever number, are repeated in all of their windows: counted, never gathered.
3. Where a core is left with several different contexts, one of each kind brings its bytes. Their suffixes and reversed prefixes at
   the anchors are ordered by deep-shallow sorting, and neighbours' common lengths tell which windows are repeated.
   Cores with more than CROWD kinds go another way: the windows of each are counted by hash, so that no task gathers them.
4. Repeated windows become spans of bytes of each document, which are merged and cut out.

Hashes are 64-bit polynomials over the bytes; contexts are equal where core and context agree in both.

Texts are joined with what is asked of them, and with their spans, by shuffles at any size: no broadcast grows with the input. Null texts are empty. Documents are rows: an equal row is another document, so both lose all from SIZE bytes on. A null doc_id
stays null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common, suffix_sort

SIZE, GRAM = 400, 32
#: Kinds of contexts of one core that a task may sort together.
CROWD = 2000
#: Windows that are hashed at once; longer texts are cut, with an overlap.
SEGMENT = 1 << 20
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
_ROWS = "core long, context long, doc long, key long, lo long, n int, anchor int"
_SPANS = "doc long, key long, start long, stop long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            x = np.full(n + 1, base, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


class _Hashes:
    """Hashes of all strings of one buffer."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data))
        self.before = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=self.before[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.before[stop] - self.before[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.before) - size
        return (self.before[size:] - self.before[:n]) * self.inverse[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~_U(0), _U)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of the documents data[starts:stops]: core, context, first window, windows, anchor in the context."""
    width = size - gram + 1
    half = -(-width // 2)
    none = np.zeros(0, np.int64)
    if len(data) < size or not (stops - starts >= size).any():
        return none.view(_U), none.view(_U), none, none, none
    hashes = _Hashes(data)
    grams = (_mix(hashes.grams(gram)) & ~_U(0xFFFFFFFF)) | np.arange(len(data) - gram + 1, dtype=_U)
    anchor = (_least(grams, width) & _U(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(stops - starts - size + 1, 0)
    p = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    x = anchor[p]
    block = (x - p) // half
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(x) != 0) | (np.diff(block) != 0)
    new[(np.cumsum(counts) - counts)[counts > 0]] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p)))
    lo, x, block = p[first], x[first], block[first]
    far = np.minimum((block + 1) * half, width) - 1
    core = _mix(hashes.of(x - block * half, x - far + size) + block.astype(_U) * _U(0x632BE59BD9B4E019))
    own = _mix(hashes.of(lo, lo + n - 1 + size) ^ ((x - lo).astype(_U) << _U(32)) ^ n.astype(_U))
    return core, own, lo, n, x - lo


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def segments(raw: list[memoryview], keys: list[tuple[int, int]]) -> Iterator[list[tuple[tuple[int, int], int, memoryview]]]:
        held, size = [], 0
        for key, x in zip(keys, raw, strict=True):
            for a in range(0, max(1, len(x) - SIZE + 1), SEGMENT):
                part = x[a : a + SEGMENT + SIZE - 1]
                if len(part) < SIZE:
                    continue
                if size + len(part) > 2 * SEGMENT and held:
                    yield held
                    held, size = [], 0
                held.append((key, a, part))
                size += len(part)
        if held:
            yield held

    for batch in batches:
        raw = [memoryview(x.as_buffer()) for x in batch.column("raw")]
        for held in segments(raw, list(zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), strict=True))):
            data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
            stops = np.cumsum([len(x) for _, _, x in held])
            starts = stops - np.array([len(x) for _, _, x in held])
            core, own, lo, n, anchor = contexts(data, starts, stops)
            which = np.searchsorted(starts, lo, side="right") - 1
            doc, key = np.array([k for k, _, _ in held], np.int64).reshape(-1, 2).T[:, which]
            at = np.array([a for _, a, _ in held], np.int64)[which]
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(own.view(np.int64)), pa.array(doc), pa.array(key), pa.array(lo - starts[which] + at), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int32))], names=["core", "context", "doc", "key", "lo", "n", "anchor"])


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a core come together, as they are sorted by it; several cores are put into one sort."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        texts = [x.as_buffer().to_pybytes() for c in rows.column("bytes").chunks for x in c]
        anchors, counts = rows.column("anchor").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
        groups = np.unique(rows.column("core").to_numpy(), return_inverse=True)[1]
        found = suffix_sort.repeated_windows(groups, texts, anchors, counts, SIZE)
        docs, keys, los = (rows.column(k).to_pylist() for k in ("doc", "key", "lo"))
        out = [(d, k, lo + a, lo + b - 1 + SIZE) for d, k, lo, f, single in zip(docs, keys, los, found, rows.column("single").to_pylist(), strict=True) if single for a, b in _runs(f)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["doc", "key", "start", "stop"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 20_000:
            continue
        rows = pa.Table.from_batches(held)
        cores = rows.column("core").to_numpy()
        cut = int(np.searchsorted(cores, cores[-1]))  # the last core may go on
        if cut:
            yield done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def _hashed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of crowded cores, each with two hashes."""
    for batch in batches:
        for r in range(batch.num_rows):
            data = np.frombuffer(batch.column("bytes")[r].as_buffer(), np.uint8)
            n = batch.column("n")[r].as_py()
            a = np.arange(n)
            h = _Hashes(data).of(a, a + SIZE)
            lo = batch.column("lo")[r].as_py()
            whole = [pa.array(np.full(n, batch.column(k)[r].as_py())) for k in ("core", "doc", "key", "single")]
            yield pa.RecordBatch.from_arrays([pa.array(_mix(h).view(np.int64)), pa.array(lo + a), *whole], names=["window", "start", "core", "doc", "key", "single"])


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are asked for in each document."""
    for batch in batches:
        out: list[tuple] = []
        for r in range(batch.num_rows):
            raw = memoryview(batch.column("raw")[r].as_buffer())
            doc, key = batch.column("doc")[r].as_py(), batch.column("key")[r].as_py()
            for x in batch.column("asked")[r].as_py():
                out.append((x["core"], doc, key, x["lo"], x["n"], x["anchor"], x["single"], bytes(raw[x["lo"] : x["lo"] + x["n"] - 1 + SIZE])))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["core", "doc", "key", "lo", "n", "anchor", "single", "bytes"])


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, key, start, stop) of repeated bytes; spans may overlap. texts: doc, key, raw.

    What is joined by a key that may be hot is a table of its own on both sides, so that Spark can deal out a large partition."""
    rows = common.written(texts.where(F.octet_length("raw") >= SIZE).select("doc", "key", "raw").transform(common.in_arrow, _emit, _ROWS), "contexts")
    twice = common.written(rows.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), "cores")
    rows = common.written(rows.join(twice.hint("merge"), "core", "left_semi"), "shared")

    kinds = rows.groupBy("core", "context").agg(F.count("*").alias("c"), F.min(F.struct("doc", "key", "lo", "n", "anchor")).alias("one"))
    kinds = common.written(kinds, "kinds")
    repeated = common.written(kinds.where("c > 1").select("core", "context"), "repeated")
    whole = rows.join(repeated.hint("merge"), ["core", "context"], "left_semi")
    spans = whole.select("doc", "key", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + SIZE).alias("stop"))

    several = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("core", (F.col("kinds") > CROWD).alias("crowded"))
    several = common.written(several, "several")
    asked = kinds.join(several.hint("merge"), "core").select("core", "one.*", (F.col("c") == 1).alias("single"))
    by_text = common.written(asked.groupBy("doc", "key").agg(F.collect_list(F.struct("core", "lo", "n", "anchor", "single")).alias("asked")), "asked")
    crowded = common.written(several.where("crowded").select("core"), "crowded")
    one_each = texts.select("doc", "key", "raw").join(by_text.hint("merge"), ["doc", "key"])
    brought = common.written(one_each.transform(common.in_arrow, _cut_bytes, "core long, doc long, key long, lo long, n int, anchor int, single boolean, bytes binary"), "brought")

    calm = brought.join(_bounded(crowded), "core", "left_anti").repartition("core").sortWithinPartitions("core")
    spans = spans.unionByName(calm.transform(common.in_arrow, _sorted_groups, _SPANS))
    windows = common.written(brought.join(_bounded(crowded), "core", "left_semi").transform(common.in_arrow, _hashed_windows, "window long, start long, core long, doc long, key long, single boolean"), "windows")
    again = common.written(windows.groupBy("core", "window").agg(F.count("*").alias("c")).where("c > 1").select("core", "window"), "again")
    more = windows.where("single").join(again.hint("merge"), ["core", "window"], "left_semi").select("doc", "key", "start", (F.col("start") + SIZE).alias("stop"))
    return spans.unionByName(more)


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, number, digest, kept = [], [], [], [], []
            for r in range(batch.num_rows):
                raw, spans = batch.column("raw")[r].as_buffer().to_pybytes(), batch.column("spans")[r].as_py() or []
                out, at, gone, runs = [], 0, 0, 0
                for s in sorted((s["start"], s["stop"]) for s in spans):
                    start, stop = s
                    if start > at or not runs:
                        out.append(raw[at:start])
                        runs += 1
                        gone += stop - start
                    else:
                        gone += max(0, stop - at)
                    at = max(at, stop)
                out.append(raw[at:])
                rest = b"".join(out)
                n_bytes.append(len(raw))
                removed.append(gone)
                number.append(runs)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            arrays = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each document: bytes, bytes removed, runs removed, SHA-256 of what is left; with_text: what is left (bytes, as a cut may fall inside a character)."""
    texts = common.documents(docs).select("doc_id", F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("raw"))
    spans = common.written(repeated_spans(texts), "spans")
    by_key = common.written(spans.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "by_text")
    joined = texts.join(by_key.hint("merge"), ["doc", "key"], "left").select("doc_id", "raw", "spans")
    return joined.transform(common.in_arrow, _remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
