"""Benchmark decontamination by spaced seeds, as DataFrame expressions only.

A seed is the hash of a window's tokens at the positions that a mask keeps; the others are ignored, so
that a substituted token leaves the seeds around it whole. The seeds of all documents are joined with
those of the benchmark. Where a seed repeats at even steps, as in a text of one repeated token, its places are one row (first, step, count) on
either side, so that the join doesn't multiply them. A hit names a document, an item and a shift between their tokens; of the shifts
at which the document shows the same tokens to the item, one is compared, token by token. They overlap if any segment holds MIN_MATCHES equal tokens that are
at least MIN_SHARE of its tokens; the one with the most equal tokens is reported. Documents with hits are cut into overlapping chunks of CHUNK tokens, so
that the shifts of a long one are spread over tasks.

Tokens are lower-case runs of letters and digits. An item under MIN_MATCHES tokens must be in the document whole; under
SPAN tokens, its seed is the hash of all its tokens. Nulls and empty texts have no seeds and are never reported. Documents are told apart by doc_id and text, so
rows that share a doc_id are each compared, and equal rows are reported once. An empty table on either
side gives no rows. Other columns are ignored. Items with equal texts are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm import common
from sediment.llm.native import indices, let, running, tokens

#: Positions kept by each mask, of a window of SPAN tokens.
MASKS = ("1101101001", "1010110011", "1100010111")
SPAN = 10
MIN_MATCHES, MIN_SHARE = 12, 0.8
#: A side is broadcast up to so many rows, counted before; beyond it Spark shuffles both.
BROADCAST_ROWS = 1_000_000
#: Shifts of a document that one task takes at a time; no fewer than the tokens of the longest item.
CHUNK = 8192


def _seeds(hashes: Column) -> Column:
    """One hash for each mask and window, mask by mask."""

    def of(mask: str) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        return F.transform(indices(F.size(hashes) - (SPAN - 1)), lambda i: F.xxhash64(F.lit(mask), *(F.get(hashes, i + k) for k in kept)))

    return F.concat(*map(of, MASKS))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _positions(df: DataFrame, ids: list[str], hashes: Column) -> DataFrame:
    """(ids, at, seed): at is the first token of the window."""
    seeds = df.select(*ids, let(hashes, lambda h: F.struct(F.greatest(F.size(h) - (SPAN - 1), F.lit(1)).alias("n"), _seeds(h).alias("seeds"))).alias("s"))
    return seeds.select(*ids, F.col("s.n").alias("n"), F.posexplode("s.seeds").alias("p", "seed")).select(*ids, (F.col("p") % F.col("n")).alias("at"), "seed")


def _whole(df: DataFrame, ids: list[str], hashes: Column, sizes: list[int]) -> DataFrame:
    """(ids, at, seed) of the windows of so many tokens each, of items that are shorter than a mask."""

    def windows(h: Column, m: int) -> Column:
        return F.transform(indices(F.size(h) - (m - 1)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(f"whole {m}"), *(F.get(h, i + k) for k in range(m))).alias("seed")))

    def of(h: Column) -> Column:
        return F.concat(*(windows(h, m) for m in sizes))

    return df.select(*ids, F.explode(let(hashes, of)).alias("s")).select(*ids, "s.at", "s.seed")


def _best(equal: Column) -> Column:
    """struct<n, from, to> of the segment with the most equal tokens, of those with MIN_SHARE; its ends match. Null where fewer than MIN_MATCHES tokens are equal, or all of a shorter item.

    A segment from the p-th equal token to the q-th has q - p + 1 equal ones. Its share is enough if and only if height(q) >= height(p) - (whole - part),
    where height(k) rises by whole with k and falls by part with the token's place. Two pointers find the widest such pair: p moves over the
    least heights up to it, q over the greatest heights from it on."""
    whole, part = 100, round(100 * MIN_SHARE)

    def widest(at: Column) -> Column:
        heights = F.transform(at, lambda e, k: k * whole - e * part)

        lows, highs = running(heights, F.least), F.reverse(running(F.reverse(heights), F.greatest))

        def walk(low: Column, high: Column) -> Column:
            zero = F.struct(*(F.lit(0).alias(k) for k in ("p", "q", "n", "first")))

            def step(a: Column, _: Column) -> Column:
                def moved(fits: Column) -> Column:
                    more = fits & (a["q"] - a["p"] + 1 > a["n"])
                    values = (a["p"] + F.when(fits, 0).otherwise(1), a["q"] + F.when(fits, 1).otherwise(0), F.when(more, a["q"] - a["p"] + 1).otherwise(a["n"]), F.when(more, a["p"]).otherwise(a["first"]))
                    return F.struct(*(v.cast("int").alias(k) for k, v in zip(("p", "q", "n", "first"), values, strict=True)))

                return let((a["p"] < F.size(at)) & (a["q"] < F.size(at)) & F.coalesce(F.get(high, a["q"]) >= F.get(low, a["p"]) - (whole - part), F.lit(False)), moved)

            return F.aggregate(indices(2 * F.size(at)), zero, step)

        done = let(lows, lambda low: let(highs, lambda high: walk(low, high)))
        return let(done, lambda d: F.struct(d["n"].alias("n"), F.get(at, d["first"]).alias("from"), (F.get(at, d["first"] + d["n"] - 1) + 1).alias("to")))

    places = F.filter(F.transform(equal, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    return let(places, lambda at: F.when(F.size(at) >= F.least(F.size(equal), F.lit(MIN_MATCHES)), widest(at)))


def _steps(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, step, count): the places (at) of each seed as even steps; a lone place has step 0. A group holds places of one text only."""
    order = Window.partitionBy(*by).orderBy("at")
    gaps = hits.withColumn("gap", F.col("at") - F.lag("at").over(order))
    turn = F.when(F.col("gap").eqNullSafe(F.lag("gap").over(order)), 0).otherwise(1)
    runs = gaps.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*by, "run").agg(F.min("at").alias("first"), F.count("*").cast("int").alias("count"), F.max("gap").alias("gap"))
    return found.select(*by, "first", F.when(F.col("count") > 1, F.col("gap")).otherwise(0).cast("int").alias("step"), "count")


def _shifts(first: Column, step: Column, count: Column, item_first: Column, item_step: Column, item_count: Column) -> Column:
    """All differences of a place on the left and one on the right, some twice."""
    last = item_first + item_step * (item_count - 1)
    wide = F.greatest(step, item_step)
    even = F.transform(indices(count + item_count - 1), lambda i: first - last + i * wide)
    left, right = F.transform(indices(count), lambda i: first + i * step), F.transform(indices(item_count), lambda i: item_first + i * item_step)
    every = let(left, lambda a: F.flatten(F.transform(right, lambda b: F.transform(a, lambda x: x - b))))
    return F.when((count == 1) | (item_count == 1) | (step == item_step), even).otherwise(every)


def hits_of(texts: DataFrame, items: DataFrame) -> DataFrame:
    """A written table of the distinct (doc, key, entry, shift) at which a seed of both agrees."""
    seeds = _positions(items, ["entry"], F.col("item"))
    found = _positions(texts, ["doc", "key"], _hashes(F.col("text")))
    short = sorted(r[0] for r in items.select(F.size("item")).where(F.size("item").between(1, SPAN - 1)).distinct().collect())
    if short:
        for m in short:
            seeds = seeds.unionByName(_whole(items.where(F.size("item") == m), ["entry"], F.col("item"), [m]))
        found = found.unionByName(_whole(texts, ["doc", "key"], _hashes(F.col("text")), short))
    seeds = common.written(_steps(seeds, ["entry", "seed"]).select("entry", "seed", *(F.col(c).alias(f"item_{c}") for c in ("first", "step", "count"))), "seeds")
    places = common.written(found.join(_small(seeds.select("seed").distinct()), "seed", "left_semi").distinct(), "places")
    pairs = _steps(places, ["doc", "key", "seed"]).join(_small(seeds), "seed")
    shifts = _shifts(*(F.col(c) for c in ("first", "step", "count", "item_first", "item_step", "item_count")))
    return common.written(pairs.select("doc", "key", "entry", F.explode(shifts).alias("shift")).distinct(), "hits")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that share a verified overlap: its equal tokens, its length, their share, its first token in both. key tells documents of one doc_id apart."""
    texts = common.documents(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(common.NO_ID)), "key": F.xxhash64("text")})
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), _hashes(F.coalesce(benchmark["text"].cast("string"), F.lit(""))).alias("item")).distinct()
    items = common.written(items.withColumn("entry", F.xxhash64("item_id", "item")), "items")
    longest = items.agg(F.max(F.size("item"))).first()[0] or 1
    width = max(CHUNK, longest)
    hits = hits_of(texts, items)

    # chunk c holds the tokens that shifts from c * width - longest on need; places outside of the text are null
    def cut(h: Column) -> Column:
        def chunk(c: Column) -> Column:
            start = c * width - longest
            return F.struct(c.alias("chunk"), F.transform(indices(F.least(F.lit(width + longest), F.size(h) - start)), lambda i: F.get(h, i + start)).alias("part"))

        return F.transform(indices(F.ceil((F.size(h) + longest) / width)), chunk)

    known = hits.select("doc", "key").distinct()
    own = texts.join(_small(known), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    chunks = common.written(own.select("doc_id", "doc", "key", F.explode(let(_hashes(F.col("text")), cut)).alias("c")).select("doc_id", "doc", "key", "c.*"), "chunks")

    sizes = items.select("entry", F.size("item").alias("m"))
    at = F.col("shift") + longest
    placed = hits.join(_small(sizes), "entry").select("doc", "key", "entry", "m", F.floor(at / width).cast("int").alias("chunk"), (at % width).cast("int").alias("at"))
    lists = placed.groupBy("doc", "key", "chunk", "entry", "m").agg(F.collect_list("at").alias("ats"))  # width places at most

    def window(at: Column) -> Column:
        return F.slice("part", at + 1, F.col("m"))

    # what a window holds: two hashes, which pass over nulls, with its length, and the places before the text
    def held(at: Column) -> Column:
        before = F.greatest(longest - F.col("chunk") * width - at, F.lit(0))
        return let(window(at), lambda w: F.struct(at.alias("at"), F.xxhash64(w).alias("w"), F.xxhash64(F.lit(1), w, F.size(w)).alias("v"), before.alias("before")))

    seen = chunks.join(lists, ["doc", "key", "chunk"]).select("doc", "key", "chunk", "entry", "m", F.explode(F.transform("ats", held)).alias("s"))
    one = seen.groupBy("doc", "key", "entry", "m", "s.w", "s.v", "s.before").agg(F.min(F.struct("chunk", "s.at")).alias("f")).select("doc", "key", "entry", "m", "f.chunk", "f.at")
    compared = chunks.join(common.written(one, "windows"), ["doc", "key", "chunk"]).select("doc_id", "key", "entry", (F.col("chunk") * width + F.col("at") - longest).alias("shift"), window(F.col("at")).alias("own")).join(_small(items), "entry")
    # a window that reaches beyond the text is shorter than its item: zip_with gives nulls there, which no token of an item is
    best = compared.select("doc_id", "key", "item_id", "shift", F.size("item").alias("item_tokens"), _best(F.zip_with("own", "item", lambda a, b: a.eqNullSafe(b))).alias("b"))
    good = best.where(F.col("b.n") >= F.least(F.col("item_tokens"), F.lit(MIN_MATCHES)))
    top = good.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct(F.col("b.n").alias("n"), -F.col("b.from"), -F.col("shift"), F.col("b.from").alias("from"), F.col("b.to").alias("to"), "shift", "item_tokens")).alias("t"))
    length = (F.col("t.to") - F.col("t.from")).cast("long")
    return top.select("doc_id", "key", "item_id", F.col("t.n").cast("long").alias("n_equal"), length.alias("n_tokens"), (F.col("t.n") / length).alias("similarity"), F.col("t.item_tokens").cast("long").alias("item_tokens"), (F.col("t.from") + F.col("t.shift")).cast("long").alias("doc_token"), F.col("t.from").cast("long").alias("item_token"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no verified overlap with an item, with all their columns."""
    a, b, x, y = common.fresh(docs, "own_id", "own_key", "bad_id", "bad_key")
    bad = common.written(leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias(x), F.col("key").alias(y)).distinct(), "leaks")
    return common.keyed(docs, a, b).join(_small(bad), (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_anti").select(*common.all_of(docs))
