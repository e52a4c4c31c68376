"""Column helpers of the operators that run as DataFrame expressions only.

A lambda sees an outer column by re-evaluating its expression, so that words[i] inside transform()
would split the text again for each i. let() binds a value once, as the element of an array of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans that are placed one after the other; larger lists are put together from such blocks.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def indices(n: Column) -> Column:
    """0 to n - 1; none for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def running(values: Column, pick: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's ints the pick (least or greatest) of it and all before: within blocks first, then with what the blocks before them have."""
    none = F.array().cast("array<int>")

    def inner(block: Column) -> Column:
        return F.aggregate(block, none, lambda a, x: F.concat(a, F.array(F.coalesce(pick(x, F.get(a, F.size(a) - 1)), x))))

    def carried(blocks: Column) -> Column:
        ends = inner(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: F.coalesce(pick(x, F.get(e, k - 1)), x)))))

    cut = let(values, lambda v: F.transform(indices(F.ceil(F.size(v) / BLOCK)), lambda k: inner(F.slice(v, k * BLOCK + 1, BLOCK))))
    return let(cut, carried)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, hit string>> of a pattern's matches, left to right, in code points, end exclusive.

    What lies between the matches comes from split(), which uses the same matcher.
    """
    spans = "array<struct<start:int,end:int,hit:string>>"
    none = F.array().cast(spans)

    def place(gaps: Column, hits: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("hit")))

        def inner(block: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), none.alias("xs"))
            return F.aggregate(block, zero, lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["xs"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"), x["hit"].alias("hit")))).alias("xs")))

        blocks = let(both, lambda b: F.transform(indices(F.ceil(F.size(b) / BLOCK)), lambda k: inner(F.slice(b, k * BLOCK + 1, BLOCK))))
        zero = F.struct(F.lit(0).alias("at"), none.alias("xs"))
        joined = F.aggregate(blocks, zero, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["xs"], F.transform(b["xs"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["hit"].alias("hit")))).alias("xs")))
        return joined["xs"]

    def found(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) > 0, let(F.split(t, pattern, -1), lambda gaps: place(gaps, hits))).otherwise(none))

    return let(text, found)
