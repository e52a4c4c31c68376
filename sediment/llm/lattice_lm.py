"""Document probability by a subword lattice, beside add-one word counts.

A document is its words (between white space, A-Z lowered), each behind the mark of a word's start, then one end. The model is a
unigram over the pieces of an existing vocabulary, which includes all bytes. All segmentations of a word count: its probability
is the sum over them, by a forward recursion in log space, and that of a document is the product over its words and the end, as no piece
crosses a word's start. The piece weights begin as the vocabulary's scores (ranks, taken as 1 / (rank + SHIFT)) and are
learned by ROUNDS of expectation-maximisation over the counts of all training words.

Texts pass once: each batch of them becomes rows of its vocabulary and, for each document, rows of numbers of words. No row has more than ROW_WORDS
words, as Spark reads, writes and gathers thousands of rows at once. Vocabularies
are counted and scored as distinct words, never for each document, and come back to their batch, whose size is fixed, and which one call of a cogroup scores. Words of one length go through
numpy together; one of LONG characters or more goes alone, its pieces looked up for all of its places at once, in time and memory proportional to its length.

Null and empty texts are the end alone. A null doc_id is not held out. Repeated rows are scored one by one, and all are counted if they
are for training. Without training documents N and V are 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common

FOLDS, HELD_OUT = 7, 2
#: Bytes of text in one batch.
BATCH_BYTES = 8 << 20
#: Words in one row of a batch's vocabulary, or of a document.
ROW_WORDS = 1_000
#: Distinct words whose lattices are built at once.
WORDS_AT_ONCE = 30_000
#: Characters from which a word is gone over alone; the sums are the same.
LONG = 400
SHIFT, ROUNDS, PRIOR = 10, 2, 1000.0
START = "▁"
_U = np.uint64
_NEVER = -1e30

#: Rows of documents: row numbers them within the batch, and those behind a document's first have no n_words. Rows of the vocabulary have no held, and their row is the number of the first word.
_BATCH = "batch long, row int, doc_id long, held boolean, n_words long, word array<int>, times array<int>, vocab array<binary>, train array<long>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _mix(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    x = (h ^ code.astype(_U)) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


class Lattice:
    """The pieces of a vocabulary, and log weights for them (natural logarithms)."""

    def __init__(self, pieces: list[str], byte_of: list[int | None], weights: np.ndarray):
        """pieces without those for control; byte_of: the byte that a piece stands for, if it is one."""
        self.weights = weights
        self.bytes = np.zeros(256, np.int64)
        keys, ids = [], []
        self.longest = 1
        for i, (piece, byte) in enumerate(zip(pieces, byte_of, strict=True)):
            if byte is not None:
                self.bytes[byte] = i
                continue
            h = np.zeros(1, _U)
            for c in piece:
                h = _mix(h, np.array([ord(c)]))
            keys.append(int(h[0]))
            ids.append(i)
            self.longest = max(self.longest, len(piece))
        order = np.argsort(np.array(keys, _U))
        self.keys, self.ids = np.array(keys, _U)[order], np.array(ids, np.int64)[order]

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words that have a piece there, the pieces) of words of one length, by from, then to."""
        n, size = codes.shape
        for i in range(size):
            h = np.zeros(n, _U)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                h = _mix(h, codes[:, j - 1])
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                rows = np.flatnonzero(self.keys[at] == h)
                if len(rows):
                    yield i, j, rows, self.ids[at[rows]]

    def _single(self, codes: np.ndarray) -> np.ndarray:
        """Log weight of each character as bytes."""
        flat, back = np.unique(codes, return_inverse=True)
        log = np.array([self.weights[self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in flat.tolist()])
        return log[back].reshape(codes.shape)

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        n, size = codes.shape
        alpha = np.full((size + 1, n), _NEVER)
        alpha[0] = 0.0
        single, edges, at = self._single(codes), list(self._edges(codes)), 0
        for i in range(size):
            alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i] + single[:, i])
            while at < len(edges) and edges[at][0] == i:
                _, j, rows, piece = edges[at]
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.weights[piece])
                at += 1
        return alpha, edges

    def _line(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all pieces of one word, by from."""
        n, h, found = len(codes), np.zeros(len(codes), _U), []
        for size in range(1, min(self.longest, n) + 1):
            h = _mix(h[: n - size + 1], codes[size - 1 :])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            rows = np.flatnonzero(self.keys[at] == h)
            found.append((rows, rows + size, self.ids[at[rows]]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order]

    @staticmethod
    def _walk(n: int, single: list[float], start: list[int], end: list[int], weight: list[float]) -> list[float]:
        """Log sums over all ways from place 0 to each place; steps come by their start, and single leads from each place to the next."""
        alpha, at, steps = [_NEVER] * (n + 1), 0, len(start)
        alpha[0] = 0.0
        for i in range(n):
            here = alpha[i]
            x, y = alpha[i + 1], here + single[i]
            alpha[i + 1] = x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
            while at < steps and start[at] == i:
                j, y = end[at], here + weight[at]
                x = alpha[j]
                alpha[j] = x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
                at += 1
        return alpha

    def forward_long(self, codes: np.ndarray) -> float:
        """forward()'s last value for one word."""
        start, end, piece = self._line(codes)
        return self._walk(len(codes), self._single(codes).tolist(), start.tolist(), end.tolist(), self.weights[piece].tolist())[-1]

    def expected_long(self, codes: np.ndarray, times: float) -> np.ndarray:
        """expected() of one word."""
        n, single = len(codes), self._single(codes)
        start, end, piece = self._line(codes)
        weight = self.weights[piece]
        alpha = np.array(self._walk(n, single.tolist(), start.tolist(), end.tolist(), weight.tolist()))
        order = np.argsort(n - end, kind="stable")
        beta = np.array(self._walk(n, single[::-1].tolist(), (n - end)[order].tolist(), (n - start)[order].tolist(), weight[order].tolist()))[::-1]
        uses = np.bincount(piece, weights=np.exp(alpha[start] + weight + beta[end] - alpha[n]) * times, minlength=len(self.weights))
        kinds, back = np.unique(codes, return_inverse=True)
        by_char = np.bincount(back, weights=np.exp(alpha[:-1] + single + beta[1:] - alpha[n]) * times, minlength=len(kinds))
        self._add_bytes(uses, kinds, by_char)
        return uses

    def _add_bytes(self, uses: np.ndarray, kinds: np.ndarray, by_char: np.ndarray) -> None:
        for c, total in zip(kinds.tolist(), by_char.tolist(), strict=True):
            if total > 1e-12:
                np.add.at(uses, self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))], total)

    def expected(self, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur so many times."""
        n, size = codes.shape
        if size >= LONG:
            return sum(self.expected_long(c, t) for c, t in zip(codes, times.tolist(), strict=True))
        alpha, edges = self.forward(codes)
        single = self._single(codes)
        beta = np.full((size + 1, n), _NEVER)
        beta[size] = 0.0
        uses = np.zeros(len(self.weights))
        kinds, back = np.unique(codes, return_inverse=True)
        back, by_char = back.reshape(codes.shape), np.zeros(len(kinds))
        at = len(edges) - 1
        for i in range(size - 1, -1, -1):
            beta[i] = single[:, i] + beta[i + 1]
            first = at
            while at >= 0 and edges[at][0] == i:
                _, j, rows, piece = edges[at]
                beta[i, rows] = np.logaddexp(beta[i, rows], self.weights[piece] + beta[j, rows])
                at -= 1
            for _, j, rows, piece in edges[at + 1 : first + 1]:
                share = np.exp(alpha[i, rows] + self.weights[piece] + beta[j, rows] - alpha[size, rows]) * times[rows]
                uses += np.bincount(piece, weights=share, minlength=len(uses))
            share = np.exp(alpha[i] + single[:, i] + beta[i + 1] - alpha[size]) * times
            by_char += np.bincount(back[:, i], weights=share, minlength=len(kinds))
        self._add_bytes(uses, kinds, by_char)
        return uses

    def last(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        if codes.shape[1] >= LONG:
            return np.array([self.forward_long(c) for c in codes])
        return self.forward(codes)[0][-1]


def _by_length(words: list[bytes], rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their code points with the mark of a start) for words of one length."""
    texts = [START + w.decode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        for k in range(a, b, rows):
            own = order[k : min(b, k + rows)]
            joined = "".join([texts[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass")
            yield own, np.frombuffer(joined, "<u4").reshape(len(own), -1)


def vocabulary(model: str) -> tuple[list[str], list[int | None], np.ndarray]:
    """Pieces, the bytes that some stand for, and log weights by rank, of a sentencepiece model. Pieces that cross a word's start are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, byte_of, scores = [], [], []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or START in p[1:]:
            continue
        pieces.append(p)
        byte_of.append(int(p[3:5], 16) if sp.is_byte(i) else None)
        scores.append(0.0 if sp.is_byte(i) else sp.get_score(i))
    plain = np.array([b is None for b in byte_of])
    rank = np.zeros(len(pieces))
    rank[plain] = np.argsort(np.argsort(-np.array(scores)[plain], kind="stable"), kind="stable")
    rank[~plain] = plain.sum() + 256
    weight = 1.0 / (rank + SHIFT)
    return pieces, byte_of, np.log(weight / weight.sum())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema([("batch", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_words", pa.int64()), ("word", ints), ("times", ints), ("vocab", pa.list_(pa.binary())), ("train", longs)])

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["batch"] = pa.array(np.full(size, (part << 32) + number))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    def whole(ids: list, words: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        held = np.array([held_out(i) for i in ids], bool)
        n = np.array(counts, np.int64)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        index, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        doc = np.repeat(np.arange(len(n)), n)
        pair, times = np.unique(doc * max(size, 1) + index, return_counts=True)
        train = np.bincount(index[~held[doc]], minlength=size)
        number += 1
        kinds = np.bincount(pair // max(size, 1), minlength=len(n))
        cuts = np.maximum(1, -(-kinds // ROW_WORDS))
        own = np.repeat(np.arange(len(n)), cuts)
        later = np.arange(len(own)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        edges = pa.array(np.append((np.cumsum(kinds) - kinds)[own] + later * ROW_WORDS, len(pair)).astype(np.int32))
        lists = {k: pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32))) for k, v in (("word", pair % max(size, 1)), ("times", times))}
        yield rows(len(own), row=pa.array(np.arange(len(own), dtype=np.int32)), doc_id=pa.array(ids, pa.int64()).take(pa.array(own)), held=pa.array(held[own]), n_words=pa.array(n[own], mask=later > 0), **lists)
        if size:
            first = np.arange(0, size, ROW_WORDS, dtype=np.int32)
            edges = pa.array(np.append(first, size).astype(np.int32))
            yield rows(len(first), row=pa.array(first), vocab=pa.ListArray.from_arrays(edges, coded.dictionary), train=pa.ListArray.from_arrays(edges, pa.array(train)))

    ids: list = []
    words: list[bytes] = []
    counts: list[int] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
            raw = text.as_buffer().to_pybytes()
            if size + len(raw) > BATCH_BYTES and ids:
                yield from whole(ids, words, counts)
                ids, words, counts, size = [], [], [], 0
            own = raw.lower().split()
            ids.append(i)
            words += own
            counts.append(len(own))
            size += len(raw)
    if ids:
        yield from whole(ids, words, counts)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of about so many words: words of one length run together, and few of them would hardly use numpy."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _count_pieces(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(len(lattice.weights))
        for batch in _gathered(batches):
            times = batch.column("c").to_numpy().astype(float)
            for own, codes in _by_length(batch.column("word").to_pylist()):
                uses += lattice.expected(codes, times[own])
        some = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(uses[some])], names=["piece", "uses"])

    return run


def _score_words(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            log = np.zeros(batch.num_rows)
            for own, codes in _by_length(batch.column("word").to_pylist()):
                log[own] = lattice.last(codes)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array((log / np.log(10)).astype(np.float32))], names=["word", "c", "log10"])

    return run


def _score_documents(n: int, v: int, end: int, end_log10: float):
    floor = np.log10(n + v + 1)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs, at = docs.sort_by("row"), words.column("i").to_numpy()
        c, log = np.zeros(len(at)), np.zeros(len(at))
        c[at], log[at] = words.column("c").to_numpy(), words.column("log10").to_numpy()
        first = docs.filter(pc.field("n_words").is_valid())
        n_words = first.column("n_words").to_numpy()
        own = np.cumsum(docs.column("n_words").is_valid().to_numpy()) - 1
        doc = np.repeat(own, pc.list_value_length(docs.column("word")).to_numpy())
        word, times = (pc.list_flatten(docs.column(k)).to_numpy() for k in ("word", "times"))
        total = lambda w: np.bincount(doc, weights=w, minlength=len(n_words))
        base = total(times * np.log10(c[word] + 1)) + np.log10(end + 1) - (n_words + 1) * floor
        known = total(times * (c[word] > 0)).astype(np.int64) + (end > 0)
        score = total(times * log[word]) + end_log10
        common.give_back()
        return pa.table([first.column("doc_id"), first.column("held"), pa.array(n_words + 1), pa.array(known), pa.array(np.full(len(n_words), n)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scores(docs: DataFrame, model: str) -> DataFrame:
    """One row for each document: what the contract asks, with the lattice's log10 probability as score."""
    texts = common.documents(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))
    batches = common.written(texts.transform(common.in_arrow, _batches, _BATCH), "batches")
    own = batches.where("held is not null").select(F.col("batch").alias("own_batch"), "row", "doc_id", "held", "n_words", "word", "times")
    vocabularies = batches.where("held is null").select("batch", "row", F.posexplode(F.arrays_zip("vocab", "train")).alias("i", "x"))
    entries = vocabularies.select("batch", (F.col("row") + F.col("i")).alias("i"), F.col("x.vocab").alias("word"), F.col("x.train").alias("t"))
    counts = common.written(entries.groupBy("word").agg(F.sum("t").alias("c")), "counts")
    known = counts.where("c > 0")
    words, kinds = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = own.where("n_words is not null and not held").count()
    n, v = words + end, kinds + (end > 0)

    pieces, byte_of, prior = vocabulary(model)
    lattice = Lattice(pieces, byte_of, prior)
    end_log = np.log(0.01)
    for _ in range(ROUNDS if words else 0):
        counted = known.transform(common.in_arrow, _count_pieces(lattice), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = PRIOR * np.exp(prior)
        uses[counted.column("piece").to_numpy()] += counted.column("uses").to_numpy()
        total = uses.sum() + end
        lattice.weights, end_log = np.log(uses / total), np.log(end / total)
    scored = common.written(counts.transform(common.in_arrow, _score_words(lattice), "word binary, c long, log10 float"), "words")
    back = entries.select("batch", "i", "word").join(scored, "word").select("batch", "i", "c", "log10")
    score = _score_documents(int(n), int(v), int(end), float(end_log / np.log(10)))
    return own.groupBy("own_batch").cogroup(back.groupBy("batch")).applyInArrow(score, _SCORES)
