"""Quarantine and cascading release of the turns of conversations: DuckDB inside Arrow batches of whole conversations.

A task gets whole conversations, sorted. For each batch of them a recursive query goes from the turns without a parent to their children, one
step of the tree at a time, and windows number what is delivered and sum the checksums. A conversation of more than `width` turns is cut into
pieces of so many turns; a turn whose ancestors lie in the piece before waits, and is resolved with the last two turns of that piece, again and
again until none waits (one more step, unless an unbroken line of parents crosses a whole piece). Its releases are numbered within
spans of time, by the same windows, and prefix sums over the spans, which are taken level by level with at most `width` rows in a group, give
the numbers before each. So no conversation, however long, meets in one task. Tables are joined by merging, whatever their size: nothing that grows is broadcast.

Rows with the same conv_id and turn are one turn: it is returned once, with their number in copies, and the smallest checksum of their texts
counts. Rows without conv_id or turn cannot be placed; they are returned, grouped likewise, with nothing else known. Turns may be negative or
have gaps: their order counts. A null text is the empty one. A state beyond 64 bits is given modulo 2^64, as a long. Texts of any length leave only their checksum.
Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm import common

#: Seconds between arrivals, attempts of a faulty turn, seconds of the first wait: fixed values.
STEP, ATTEMPTS, WAIT = 7, 5, 10
#: Turns in a piece, spans in a group of the prefix sums; rows that one query of a task takes.
WIDTH, ROWS = 4096, 32_768

_AFTER = [WAIT * (2**a - 1) for a in range(ATTEMPTS)]  # seconds from the first attempt to each
_TRIES = " ".join(f"when s + {after} >= repaired and fails & {1 << a} = 0 then {a + 1}" for a, after in enumerate(_AFTER))


def _tried(source: str) -> str:
    """What comes of the turns of source, whose s is the second of the first attempt, null if the parent blocks it."""
    return f"""
  select conv_id, p, case when k > 0 then 'delivered' when k = 0 then 'blocked' else 'dead' end as status, coalesce(k, {ATTEMPTS}) as attempts,
         s as first_at, case when k = 0 then null else s + {_AFTER!r}[coalesce(k, {ATTEMPTS})] end as last_at
  from (select conv_id, p, s, case when s is null then 0 when not faulty then 1 {_TRIES} end as k from ({source}))"""


_RESOLVE = f"""
with recursive done as (
  select * from (
    select conv_id, p, status, attempts, first_at, last_at from turns where status is not null
    union all {_tried(f"select conv_id, p, faulty, fails, repaired, {STEP} * p as s from turns where status is null and parent is null")}
  )
  union all {_tried(f"""
    select c.conv_id, c.p, c.faulty, c.fails, c.repaired, case when d.status = 'delivered' then greatest({STEP} * c.p, d.last_at) end as s
    from done d join turns c on c.conv_id = d.conv_id and c.parent = d.p where c.status is null""")}
)"""

_NUMBER = """
select *, row_number() over w as n, sum(crc) over w as crcs, sum(n * crc) over w as state
from (select *, row_number() over (partition by {by} order by last_at, turn) as n from released)
window w as (partition by {by} order by n rows unbounded preceding)"""


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that end where a group ends; the rows come sorted by group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.slice(n - 1, 1).select(by).to_pylist()[0]
        same = pc.equal(t[by[0]], last[by[0]])
        for name in by[1:]:
            same = pc.and_(same, pc.equal(t[name], last[name]))
        cut = pc.index(same, True).as_py()
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _in_duckdb(by: list[str], view: str, query: str, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": "1", "memory_limit": "512MB"})
        try:
            for table in _groups(batches, by, rows):
                con.register(view, table)
                found = con.sql(query).to_arrow_table()
                con.unregister(view)
                yield from found.to_batches()
        finally:
            con.close()

    return run


def _wrapped(x: str) -> str:
    """A sum of DuckDB as the long that is equal to it modulo 2^64."""
    return f"((({x})::hugeint % 18446744073709551616 + 27670116110564327424) % 18446744073709551616 - 9223372036854775808)::bigint"


def _wrap(x: Column) -> Column:
    """The same of a Spark decimal."""
    top, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(F.pmod(x, top) + half, top) - half).cast("long")


def running(cells: DataFrame, key: str, at: str, values: dict[str, str], width: int) -> DataFrame:
    """(key, at, and for each new name: the sum of a column over the key's rows with a smaller at). One row for each key and at.

    Groups of `width` neighbours are summed, then groups of those, until one group holds all of a key; each level is a table, and each window sees
    the rows of one group only.
    """
    d = "decimal(38,0)"
    cells = common.written(cells.select(key, at, *(F.coalesce(F.col(v).cast(d), F.lit(0).cast(d)).alias(n) for n, v in values.items())), "cells")
    low, high = cells.agg(F.min(at), F.max(at)).first()
    up = F.expr(f"(`{at}` - {low or 0}L) div {width}L")
    levels = [cells.withColumn("up", up)]
    size = (high or 0) - (low or 0)
    while size >= width:
        size //= width
        above = levels[-1].groupBy(key, "up").agg(*(F.sum(n).cast(d).alias(n) for n in values)).withColumnRenamed("up", at)
        levels.append(common.written(above, "cells").withColumn("up", F.expr(f"`{at}` div {width}L")))
    total = None
    for level in reversed(levels):
        before = Window.partitionBy(key, "up").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(key, at, "up", *(F.coalesce(F.sum(n).over(before).cast(d), F.lit(0).cast(d)).alias(n) for n in values))
        if total is not None:
            above = total.select(F.col(key).alias("_key"), F.col(at).alias("_at"), *(F.col(n).alias(f"_{n}") for n in values))
            level = level.join(above.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("up") == F.col("_at")))
            level = level.select(key, at, *((F.col(n) + F.col(f"_{n}")).cast(d).alias(n) for n in values))
        total = level
    return total.select(key, at, *values)


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, copies, distance, faulty, delay, fails, crc) by turn: what the replay needs of it; bit a - 1 of fails: attempt a fails after repair too."""
    conv, turn = F.col("conv_id"), F.col("turn")
    h = [F.crc32(F.concat_ws(":", F.lit(k), conv.cast("string"), turn.cast("string"))) for k in range(ATTEMPTS + 3)]
    fails = sum(((h[a + 3] % 3 == 0).cast("int") * (1 << a) for a in range(ATTEMPTS)), F.lit(0))
    one = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.crc32(F.coalesce(turns["text"].cast("string"), F.lit(""))).alias("crc"))
    one = one.groupBy("conv_id", "turn").agg(F.count("*").alias("copies"), F.min("crc").alias("crc"))
    return one.select("conv_id", "turn", "copies", (h[0] % 3).cast("int").alias("distance"), (h[1] % 101 < 35).alias("faulty"), (h[2] % 101).cast("int").alias("delay"), fails.cast("int").alias("fails"), "crc")


def placed(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """A written table of hashed() with p, the turn's number in its conversation, and long, whether that has more than width turns."""
    rows = common.written(hashed(turns), "turns")
    known = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    block = F.floor(F.col("turn") / F.lit(width)) if width & (width - 1) else F.shiftright("turn", width.bit_length() - 1)
    known = known.withColumn("block", block.cast("long"))
    cells = common.written(known.groupBy("conv_id", "block").agg(F.count("*").alias("n")), "blocks")
    before = running(cells, "conv_id", "block", {"first": "n"}, width)
    before = common.written(before.join(cells.hint("merge"), ["conv_id", "block"]).select("conv_id", "block", F.col("first").cast("long").alias("first"), "n"), "firsts")
    longs = before.where(F.col("first") + F.col("n") > width).select("conv_id").distinct().withColumn("long", F.lit(True))
    before = before.drop("n").join(longs.hint("merge"), "conv_id", "left").withColumn("long", F.coalesce("long", F.lit(False)))
    p = F.col("first") + F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn")) - 1
    found = known.join(before.hint("merge"), ["conv_id", "block"]).withColumn("p", p.cast("long")).drop("block", "first")
    lost = rows.where(F.col("conv_id").isNull() | F.col("turn").isNull()).withColumns({"long": F.lit(False), "p": F.lit(None).cast("long")})
    return common.written(found.unionByName(lost), "placed")


def _sorted(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def replay(turns: DataFrame, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(conv_id, turn, status, attempts, first_at, last_at, release_no, state, copies) of every turn."""
    rows_of = placed(turns, width)
    kind = rows_of.schema["conv_id"].dataType.simpleString()
    parent = F.when((F.col("distance") > 0) & (F.col("p") >= F.col("distance")), F.col("p") - F.col("distance"))
    nothing = {"status": "string", "attempts": "int", "first_at": "long", "last_at": "long"}
    ready = rows_of.where("p is not null").select("conv_id", "turn", "copies", "crc", "long", "p", parent.alias("parent"), "faulty", (F.col("p") * STEP + F.col("delay")).alias("repaired"), "fails", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    piece = F.expr(f"p div {width}L")
    kept = "conv_id, turn, copies, crc, p, status, attempts, first_at, last_at"
    schema = f"conv_id {kind}, turn long, copies long, crc long, p long, status string, attempts int, first_at long, last_at long"

    # whole conversations: resolved and numbered in one go
    numbered = _NUMBER.format(by="conv_id").strip()
    whole_query = f"""{_RESOLVE}, released as (select t.conv_id, t.turn, d.p, d.last_at, t.crc from done d join turns t on t.conv_id = d.conv_id and t.p = d.p where d.status = 'delivered')
    , releases as ({numbered})
    select t.conv_id, t.turn, t.copies, d.status, d.attempts::integer as attempts, d.first_at::bigint as first_at, d.last_at::bigint as last_at, r.n::bigint as release_no, {_wrapped("r.state")} as state
    from turns t join done d on t.conv_id = d.conv_id and t.p = d.p left join releases r on r.conv_id = t.conv_id and r.p = t.p"""
    out = f"conv_id {kind}, turn long, copies long, status string, attempts int, first_at long, last_at long, release_no long, state long"
    result = _sorted(ready.where(~F.col("long")).drop("long"), ["conv_id"], "p").transform(common.in_arrow, _in_duckdb(["conv_id"], "turns", whole_query, rows), out)

    # pieces of long ones
    pieces = ready.where("long").drop("long").withColumn("piece", piece)
    if not pieces.isEmpty():
        result = result.unionByName(_long(pieces, schema, kept, width, rows))
    lost = rows_of.where("p is null").select("conv_id", "turn", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()), *(F.lit(None).cast("long").alias(n) for n in ("release_no", "state")), "copies")
    return result.select(*lost.columns).unionByName(lost)


def _long(waiting: DataFrame, schema: str, kept: str, width: int, rows: int) -> DataFrame:
    """The result for the pieces of long conversations."""
    step = f"""{_RESOLVE} select {", ".join("t." + x if x in ("conv_id", "turn", "copies", "crc", "p") else f"d.{x}" + ("::integer as attempts" if x == "attempts" else f"::bigint as {x}" if x.endswith("_at") else "") for x in kept.split(", "))},
        t.piece, t.parent, t.faulty, t.repaired, t.fails from turns t left join done d on t.conv_id = d.conv_id and t.p = d.p where t.status is null"""
    wide = schema + ", piece long, parent long, faulty boolean, repaired long, fails int"
    resolved, known, short = None, None, kept.split(", ")
    while True:
        given = waiting
        if known is not None:
            # the last two turns of a piece, as known, beside the turns of the next one
            given = waiting.unionByName(known.withColumn("piece", F.expr(f"p div {width}L") + 1).withColumns({"parent": F.lit(None).cast("long"), "faulty": F.lit(False), "repaired": F.lit(0).cast("long"), "fails": F.lit(0)}))
        found = common.written(_sorted(given.select(*waiting.columns), ["conv_id", "piece"], "p").transform(common.in_arrow, _in_duckdb(["conv_id", "piece"], "turns", step, rows), wide), "pieces")
        new = found.where("status is not null").select(*short)
        resolved = new if resolved is None else resolved.unionByName(new)
        known = resolved.where(F.col("p") % width >= width - 2)
        waiting = found.where("status is null").select(*waiting.columns)
        if waiting.isEmpty():
            break
    resolved = common.written(resolved, "resolved")
    span = F.expr(f"last_at div {STEP * width}L")
    delivered = resolved.where("status = 'delivered'").select("conv_id", "turn", "p", "last_at", "crc", span.alias("span"))
    kind = schema.split(",")[0]
    number = f"with released as (select * from moments) select conv_id, turn, span, n::bigint as n, crcs::decimal(38,0) as crcs, state::decimal(38,0) as state from ({_NUMBER.format(by='conv_id, span')})"
    local = common.written(_sorted(delivered, ["conv_id", "span"], "last_at", "turn").transform(common.in_arrow, _in_duckdb(["conv_id", "span"], "moments", number, rows), f"{kind}, turn long, span long, n long, crcs decimal(38,0), state decimal(38,0)"), "local")
    spans = local.groupBy("conv_id", "span").agg(F.max("n").alias("n"), F.max("crcs").alias("crcs"), F.max("state").alias("state"))
    spans = common.written(spans, "spans")
    firsts = running(spans, "conv_id", "span", {"first": "n"}, width)
    placed_spans = common.written(spans.join(firsts.hint("merge"), ["conv_id", "span"]).withColumn("sum", F.pmod((F.col("first") * F.col("crcs")).cast("decimal(38,0)") + F.col("state"), F.lit("18446744073709551616").cast("decimal(38,0)"))), "spans")
    states = running(placed_spans, "conv_id", "span", {"before": "sum"}, width)
    placed_spans = placed_spans.join(states.hint("merge"), ["conv_id", "span"]).select("conv_id", "span", "first", "before")
    d = "decimal(38,0)"
    numbers = local.join(placed_spans.hint("merge"), ["conv_id", "span"]).select("conv_id", "turn", (F.col("first") + F.col("n")).cast("long").alias("release_no"), _wrap((F.col("before") + (F.col("first") * F.col("crcs")).cast(d) + F.col("state")).cast(d)).alias("state"))
    # both sides are spread by turn, so a long conversation is too
    return resolved.join(numbers.hint("merge"), ["conv_id", "turn"], "left").select("conv_id", "turn", "copies", "status", "attempts", "first_at", "last_at", "release_no", "state")
