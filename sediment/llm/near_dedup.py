"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is its set of shingles of SHINGLE words, each weighted by its number in the document and the mean inverse document
frequency of its words. Document frequencies are counted by word over all documents. A frequency under FLOOR of the documents
counts as FLOOR, so that the table of the other words is bounded whatever the corpus: at most the mean number of distinct words of a document,
divided by FLOOR. Consistent weighted sampling draws SAMPLES samples from each document such that two agree
with the probability of their weighted Jaccard similarity; ROWS samples make a band.

Candidates come from a ladder of bands (LADDER). On its first step a bucket is one band; documents of a bucket are compared
with its hubs, the members that share the most buckets with others (of all, or of each of a few parts by hash), by their exact weighted Jaccard similarity, and links join documents in components.
Members of a bucket that is left with several components go on to the next step, where a bucket is two bands that agree together, then
three: a crowd that only shares a passage falls apart into ever purer buckets, while two documents as similar as the threshold share
several buckets on every step (of step 1: 7 of 14, on average). Each step makes at most a fixed number of pairs for each document and bucket, so work
grows with the documents, never with the square of a group, and no bucket is capped or left out.

What the ladder leaves is compared exactly: in each bucket of one band that still holds several components, all pairs of members of different ones (REST). A pair is first held to an upper bound of its
similarity, from the weights that each text has in PARTS classes of shingles; only pairs whose bound reaches the threshold are verified. So two texts that share any band and are similar enough are in one class, always. These
pairs grow with the square of a bucket that stays mixed; they are dealt in blocks of BLOCK members by BLOCK, so memory doesn't.

Words are lower-case runs of letters and digits, told apart by 32-bit hashes (shingles by 64 bits of five of them). Texts of 1 to 4 words are one shingle; texts without words (null, empty, only marks)
are linked with none, and are classes of their own. Texts with equal words are one text from the start, told apart by 128 bits.
Rows are told apart by doc_id and text, so rows of one doc_id may be in several classes. A null doc_id has the class of its text, named by the least doc_id there, null if there is none.
Very long texts are sampled like others; one text is held in one task. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.components import components
from sediment.llm.native import let, tokens

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
#: Bands that agree together in a bucket, such buckets of a document, and hubs of a bucket.
LADDER = ((1, 14, 1), (2, 28, 4), (3, 28, 8))
#: Document frequencies are told apart from this share of the documents on.
FLOOR = 2.0**-12
#: Words that are counted at once, and words whose shingles are made at once.
CHUNK, SAMPLED = 400_000, 1 << 16
#: Members that one task compares with a copy of their hub.
MEMBERS = 500
#: Classes of shingles by whose weights similarities are bounded, and members of a mixed bucket that are compared at once.
PARTS, BLOCK = 128, 1000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Draws:
    """The random numbers of consistent weighted sampling, tabulated: shingle and sample choose a place by a multiplicative hash."""

    BITS = 16

    def __init__(self):
        rng = np.random.default_rng(20240601)
        n = 1 << self.BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.r = np.maximum(self.r, np.float32(1e-3))
        self.beta = rng.uniform(0.0, 1.0, n).astype(np.float32)
        self.ln_c = np.log(np.maximum(rng.gamma(2.0, 1.0, n), 1e-9)).astype(np.float32)
        self.by = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)


class Idf:
    """Inverse document frequencies by word: a sorted table of hashes with their values, and the value of all words that aren't in it, whose frequency is least."""

    def __init__(self, words: np.ndarray, df: np.ndarray, total: int, least: float = 1.0):
        order = np.argsort(words)
        self.words = words[order]
        self.values = np.append(np.log((total + 1) / (df[order] + 1)) + 1, np.log((total + 1) / (least + 1)) + 1).astype(np.float32)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        own, back = np.unique(words, return_inverse=True)
        if not len(self.words):
            return np.full(len(words), self.values[-1])
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        return self.values[np.where(self.words[at] == own, at, len(self.words))][back]


def shingles(words: np.ndarray, sizes: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of all documents, sorted by document and shingle. words: 32-bit hashes of all documents' words."""
    h = words.astype(np.int64).view(_U)
    weight = idf(words)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    p = np.repeat(ends - sizes - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    code, mean = np.zeros(len(p), _U), np.zeros(len(p), np.float32)
    for j in range(SHINGLE):
        code = _mix(code + h[p + j] * _U(2 * j + 3))
        mean += weight[p + j]
    mean /= np.float32(SHINGLE)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        more, means = [], []
        for i in short.tolist():
            own = h[ends[i] - sizes[i] : ends[i]]
            x = np.zeros(1, _U)
            for j, w in enumerate(own):
                x = _mix(x + np.full(1, w) * _U(2 * j + 3))
            more.append(x[0] ^ _U(len(own)))
            means.append(weight[ends[i] - sizes[i] : ends[i]].mean())
        doc, code, mean = np.concatenate([doc, short]), np.concatenate([code, np.array(more, _U)]), np.concatenate([mean, np.array(means, np.float32)])
    order = np.lexsort((code, doc))
    doc, code, mean = doc[order], code[order], mean[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(doc))).astype(np.float32)
    return doc[first], code[first], mean[first] * number


def signatures(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, draws: _Draws) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have shingles, and the BANDS band hashes of each."""
    who, start = np.unique(doc, return_index=True)
    if not len(who):
        return who, np.zeros((0, BANDS), _U)
    number = np.repeat(np.arange(len(who)), np.diff(np.append(start, len(doc))))
    ln_s = np.log(weight)
    bands = np.zeros((len(who), BANDS), _U)
    for k in range(SAMPLES):
        at = ((code * draws.by[k]) >> _U(64 - draws.BITS)).astype(np.int32)
        r, beta = draws.r[at], draws.beta[at]
        t = np.floor(ln_s / r + beta)
        a = draws.ln_c[at] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == least[number])
        first = hit[np.unique(number[hit], return_index=True)[1]]
        band = k // ROWS
        bands[:, band] = _mix(bands[:, band] + code[first] + _mix(t[first].astype(np.int64).view(_U) + _U(k)))
    return who, bands


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two documents, each its sorted shingles and their weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64)
    return float(both / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - both))


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.hash(w))


def _spans(sizes: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Runs of documents with about so many words each; one document is never cut."""
    part = (np.cumsum(sizes) - sizes) // words
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): documents of each word, summed over CHUNK words."""
    for batch in batches:
        sizes = np.diff(batch.column("h").offsets.to_numpy()).astype(np.int64)
        for a, b in _spans(sizes, CHUNK):
            word, at = np.unique(batch.column("h").slice(a, b - a).flatten().to_numpy(), return_inverse=True)
            own = np.unique(np.repeat(np.arange(b - a), sizes[a:b]) * max(len(word), 1) + at)
            n = np.bincount(own % max(len(word), 1), minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["w", "n"])


def _idf(hashed: DataFrame) -> Idf:
    """Inverse document frequency of each word, over all texts; 8 bytes for each word of more than FLOOR of them, a bounded number."""
    total = hashed.count()
    least = max(1.0, FLOOR * total)
    counted = hashed.select("h").transform(common.in_arrow, _count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    return Idf(counted.column("w").to_numpy(), counted.column("n").to_numpy(), total, least)


def _sign(idf: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _Draws()
        for batch in batches:
            sizes = np.diff(batch.column("h").offsets.to_numpy()).astype(np.int64)
            for a, b in _spans(sizes, SAMPLED):
                own = batch.column("h").slice(a, b - a)
                bands = signatures(*shingles(own.flatten().to_numpy(), sizes[a:b], idf), draws)[1]  # all texts here have words
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), batch.column("doc_id").slice(a, b - a), lists], names=["node", "doc_id", "bands"])

    return run


def _compare(idf: Idf, threshold: float):
    """Rows sorted by hub and part, the hub's own first, then the members to compare it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for whole in batches:
            for a, b in _spans(np.diff(whole.column("h").offsets.to_numpy()).astype(np.int64), SAMPLED):
                batch = whole.slice(a, b - a)
                lists = batch.column("h")
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                doc, code, weight = shingles(lists.flatten().to_numpy(), sizes, idf)
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                u, v, s = [], [], []
                for i, (h, part, node) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("part").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                    x = (code[edges[i] : edges[i + 1]], weight[edges[i] : edges[i + 1]])
                    if node == h:
                        hub, own = (h, part), x
                    elif (h, part) == hub:
                        found = similarity(own, x)
                        if found >= threshold:
                            u.append(node)
                            v.append(h)
                            s.append(found)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "similarity"])

    return run


def _verified(pairs: DataFrame, words: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """The pairs (id, hub) that are similar enough, as links (u, v, similarity). A hub's members are dealt in parts of about MEMBERS, each with a copy of the hub."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("id"))
    rows = dealt.unionByName(hubs).join(words, "id")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", (F.col("id") != F.col("hub")))
    return common.written(rows.select("hub", "part", "id", "h").transform(common.in_arrow, _compare(idf, threshold), "u long, v long, similarity double"), "similar")


def joint_bands(depth: int, number: int) -> list[tuple[int, ...]]:
    """number sets of depth bands, each band in about as many of them: patterns that go round all bands."""
    patterns = list(itertools.combinations(range(1, BANDS), depth - 1))
    found: dict[tuple[int, ...], None] = {}
    step = max(1, len(patterns) * BANDS // (number * 2))
    for k in itertools.chain.from_iterable(range(a, len(patterns), step) for a in range(step)):
        for i in range(BANDS):
            found[tuple(sorted({i, *((i + x) % BANDS for x in patterns[k])}))] = None
        if len(found) >= number:
            break
    return list(found)[:number]


def _members(nodes: DataFrame, depth: int, number: int) -> DataFrame:
    """(bucket, id, n) of all buckets with more than one of nodes (id, bands)."""
    sets = F.array(*(F.array(*map(F.lit, x)) for x in joint_bands(depth, number)))
    own = F.transform(sets, lambda x, i: F.xxhash64(F.lit(depth), i, F.transform(x, lambda j: F.get("bands", j))))
    banded = nodes.select("id", F.explode(own).alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return banded.join(crowded, "bucket").select("bucket", "id", "n")


def _placed(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members with their components so far."""
    if found is None:
        return members.withColumn("component", F.col("id"))
    return members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _sketch(idf: Idf):
    """(id, weights): the weight that a text has in each of PARTS classes of shingles, as float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _spans(np.diff(whole.column("h").offsets.to_numpy()).astype(np.int64), SAMPLED):
                lists = whole.column("h").slice(a, b - a)
                doc, code, weight = shingles(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), idf)
                at = doc * PARTS + (_mix(code) % _U(PARTS)).astype(np.int64)
                sums = np.bincount(at, weights=weight, minlength=(b - a) * PARTS).astype(np.float32).reshape(b - a, PARTS)
                yield pa.RecordBatch.from_arrays([whole.column("id").slice(a, b - a), pa.array([x.tobytes() for x in sums], pa.binary())], names=["id", "weights"])

    return run


def bounded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarity of one text, by its weights, with each of several: the sum of the lesser weights is no less than what the two have in common."""
    both = np.minimum(a, b).sum(axis=1, dtype=np.float64)
    return both / np.maximum(a.sum(dtype=np.float64) + b.sum(axis=1, dtype=np.float64) - both, 1e-30)


def _near(threshold: float):
    """Rows of one pair of blocks follow each other: pairs (id, hub) of different components, one of each block, whose bound reaches the threshold. A block with itself: each pair once."""

    def pairs(rows: pa.Table, i: int, j: int) -> pa.RecordBatch:
        weights = np.frombuffer(b"".join(rows.column("weights").to_pylist()), np.float32).reshape(rows.num_rows, PARTS)
        own, node, of = (rows.column(c).to_numpy() for c in ("block", "id", "component"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        left, right = (x[np.argsort(node[x])] for x in (left, right))
        u, v = [], []
        for k in left:
            other = right[(of[right] != of[k]) & ((node[right] > node[k]) if i == j else True)]
            near = other[bounded(weights[k], weights[other]) >= threshold - 1e-4]
            u.append(np.maximum(node[near], node[k]))
            v.append(np.minimum(node[near], node[k]))
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or none)), pa.array(np.concatenate(v or none))], names=["id", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), strict=True))
            start = 0
            for n in range(1, len(keys) + 1):
                if n < len(keys) and keys[n] == keys[start]:
                    continue
                if at is not None and keys[start] != at:
                    yield pairs(pa.Table.from_batches(held), *at[1:])
                    held = []
                at = keys[start]
                held.append(batch.slice(start, n - start))
                start = n
        if held:
            yield pairs(pa.Table.from_batches(held), *at[1:])

    return run


def _rest(members: DataFrame, hubs: DataFrame, found: DataFrame | None, words: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """All pairs (id, hub) that may be similar, of members of different components in buckets of one band whose hub both were compared with already."""
    rest = _placed(members.where("n > 2"), found).join(hubs.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti")
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high")
    rest = common.written(rest.join(mixed.select("bucket", "blocks"), "bucket").select("bucket", "id", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "rest")
    sketched = words.join(rest.select("id").distinct(), "id", "left_semi").transform(common.in_arrow, _sketch(idf), "id long, weights binary")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = rest.select("bucket", "id", "component", "block", F.explode(every).alias("x")).withColumns({"i": F.least("block", "x"), "j": F.greatest("block", "x")}).drop("x")
    rows = dealt.join(common.written(sketched, "sketched"), "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.select("bucket", "i", "j", "block", "id", "component", "weights").transform(common.in_arrow, _near(threshold), "id long, hub long").distinct()


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, key, id, class_id): key is the hash of the text; id tells classes apart, null for a text without words."""
    texts = common.documents(docs)

    def parts(words: Column) -> Column:
        return F.struct(F.when(F.size(words) > 0, F.unhex(F.md5(F.array_join(words, " ").cast("binary")))).alias("node"), F.transform(words, lambda w: F.hash(w)).alias("h"))

    hashed = texts.select("doc_id", F.xxhash64("text").alias("key"), let(tokens(F.col("text")), parts).alias("x"))
    hashed = common.written(hashed.select("doc_id", "key", "x.node", "x.h"), "hashed")
    idf = _idf(hashed)
    some = hashed.where("node is not null")
    signed = some.select("node", "doc_id", "h").transform(common.in_arrow, _sign(idf), "node binary, doc_id long, bands array<long>")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = common.written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    base, found, links, compared, words, first = nodes.select("id", "bands"), None, None, None, None, None
    for depth, number, width in LADDER:
        members = common.written(_members(base, depth, number), "members")
        if words is None:  # of all that can become candidates, one text for each
            lone = F.coalesce("doc_id", F.lit(-1))
            asked = nodes.join(members.select("id").distinct(), "id", "left_semi").select("node", lone.alias("by"), "id")
            words = some.select("node", lone.alias("by"), "h").join(asked.hint("merge"), ["node", "by"]).dropDuplicates(["node", "by"])
            words = common.written(words.select("id", "h"), "words")
        score = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("score"))
        placed = _placed(members, found).join(score, "id")
        hubs = placed.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(width)).alias("k")).agg(F.max(F.struct("score", "id", "component")).alias("x"))
        hubs = hubs.select("bucket", F.col("x.id").alias("hub"), F.col("x.component").alias("of"))
        hubs = common.written(hubs, "hubs")
        first = first or (members, hubs)
        pairs = _placed(members, found).join(hubs, "bucket").where("component <> of").select("id", "hub").distinct()
        pairs = common.written(pairs if compared is None else pairs.join(compared, ["id", "hub"], "left_anti"), "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        more = _verified(pairs, words, idf, threshold)
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            found = common.written(components(links), "components")
        if depth == LADDER[-1][0]:
            break
        rest = _placed(members.where("n > 2"), found).join(hubs.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti")
        mixed = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        left = common.written(members.where("n > 2").join(mixed.select("bucket"), "bucket", "left_semi").select("id").distinct(), "left")
        if left.isEmpty():
            break
        base = nodes.join(left, "id", "left_semi").select("id", "bands")

    pairs = _rest(*first, found, words, idf, threshold).join(compared, ["id", "hub"], "left_anti").join(compared.select(F.col("id").alias("hub"), F.col("hub").alias("id")), ["id", "hub"], "left_anti")
    pairs = common.written(pairs, "pairs")
    if not pairs.isEmpty():
        more = _verified(pairs, words, idf, threshold)
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            found = common.written(components(links), "components")

    own = _placed(nodes.select("id", "node", "doc_id"), found)
    least = own.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = common.written(own.join(least, "component").select("node", F.col("component").alias("id"), "class_id"), "named")
    with_words = some.select("doc_id", "key", "node").join(named, "node").select("doc_id", "key", "id", "class_id")
    without = hashed.where("node is null").select("doc_id", "key", F.lit(None).cast("long").alias("id"), F.col("doc_id").alias("class_id"))
    return with_words.unionByName(without)


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, representative) of every row: class_id is the least doc_id of the class, and the row that has it represents the class."""
    return _classes(docs, threshold).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("representative"))


def deduplicated(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, with all its columns: the representative, or with several rows of the least doc_id one of them; for a class without any doc_id, too. Texts without words are each kept once for a doc_id."""
    found = _classes(docs, threshold).where("doc_id <=> class_id")
    one = found.groupBy("id", F.when(F.col("id").isNull(), F.col("doc_id")).alias("of"), F.when(F.col("id").isNull(), F.col("key")).alias("alone")).agg(F.min(F.struct("doc_id", "key")).alias("x"))
    one = common.written(one.select("x.*").distinct(), "representatives")
    return common.one_row_of_each(docs, one)
