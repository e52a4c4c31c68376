"""Snapshots: what opened, closed, reopened and changed, and the state that follows. One full outer join on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The last row of each key; by must order rows of a key totally."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*(c.desc() for c in by)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_struct(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """latest() as an aggregation, which combines before the shuffle; rows of a key may be very many."""
    others = [c for c in rows.columns if c not in key and c not in by]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*by, *others), F.struct(*by)).alias("_top"))
    return top.select(*key, "_top.*").select(*rows.columns)


def field_changes(before: str, after: str, fields: list[str] | tuple[str, ...]) -> Column:
    """array<struct<field, before, after>> of fields that differ, nulls alike. Arrays differ by their order, too."""

    def text(side: str, f: str) -> Column:
        c = F.col(f"{side}.{f}")
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))

    parts = [F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), F.struct(F.lit(f).alias("field"), F.get_json_object(text(before, f), "$.v").alias("before"), F.get_json_object(text(after, f), "$.v").alias("after"))) for f in fields]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def diff(state: DataFrame, live: DataFrame, key: str, fields: list[str] | tuple[str, ...], status: str = "status") -> DataFrame:
    """(key, kind, changed): kind is added (new or closed before), removed, updated, same, or closed (and still so).

    state has a status of open or closed; live has the rows that are listed now.
    """
    both = state.alias("a").join(live.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    known, listed, closed = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull(), F.col(f"a.{status}") == "closed"
    changed = F.when(known & listed & ~closed, field_changes("a", "b", fields)).otherwise(F.array().cast("array<struct<field:string,before:string,after:string>>"))
    marked = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), changed.alias("changed"), known.alias("_known"), listed.alias("_listed"), F.coalesce(closed, F.lit(False)).alias("_closed"))
    known, listed, closed = F.col("_known"), F.col("_listed"), F.col("_closed")
    kind = F.when(listed & (~known | closed), "added").when(~listed & closed, "closed").when(~listed, "removed").when(F.size("changed") > 0, "updated").otherwise("same")
    return marked.select(key, kind.alias("kind"), "changed")


def next_state(state: DataFrame, live: DataFrame, key: str, now: Column) -> DataFrame:
    """The state after a snapshot. Both have the same columns but for status, first_seen, last_seen, closed_at and days_open, which only the state has.

    Rows no longer listed close, with their days since first seen, rounded; closed ones stay as they are; listed ones take the new
    values, and one that was closed is first seen now.
    """
    own = [c for c in live.columns if c != key]
    both = state.alias("a").join(live.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    listed, closed = F.col(f"b.{key}").isNotNull(), F.coalesce(F.col("a.status") == "closed", F.lit(False))
    closing = ~listed & ~closed
    days = F.floor((F.unix_micros(now) - F.unix_micros("a.first_seen")) / 86_400_000_000 + 0.5).cast("long")
    return both.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(F.when(listed, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in own),
        F.when(listed, "open").otherwise("closed").alias("status"),
        F.when(listed & (closed | F.col("a.first_seen").isNull()), now).otherwise(F.col("a.first_seen")).alias("first_seen"),
        F.when(listed, now).otherwise(F.col("a.last_seen")).alias("last_seen"),
        F.when(listed, None).when(closing, now).otherwise(F.col("a.closed_at")).alias("closed_at"),
        F.when(listed, None).when(closing, days).otherwise(F.col("a.days_open")).cast("long").alias("days_open"),
    )


def transition(state: DataFrame, live: DataFrame, key: str, fields: list[str] | tuple[str, ...], now: Column) -> DataFrame:
    """next_state() of the rows that a snapshot changes, with kind (added, removed or updated) and changed, by one join. Rows that stay as they are, or are only seen again, are left out."""
    own = [c for c in live.columns if c != key]
    both = state.alias("a").join(live.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    known, listed, closed = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull(), F.coalesce(F.col("a.status") == "closed", F.lit(False))
    changed = F.when(known & listed & ~closed, field_changes("a", "b", fields)).otherwise(F.array().cast("array<struct<field:string,before:string,after:string>>"))
    kind = F.when(listed & (~known | closed), "added").when(~listed & ~closed, "removed").when(listed & (F.size(changed) > 0), "updated")
    days = F.floor((F.unix_micros(now) - F.unix_micros("a.first_seen")) / 86_400_000_000 + 0.5).cast("long")
    rows = both.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(F.when(listed, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in own),
        F.when(listed, "open").otherwise("closed").alias("status"),
        F.when(listed & (closed | F.col("a.first_seen").isNull()), now).otherwise(F.col("a.first_seen")).alias("first_seen"),
        F.when(listed, now).otherwise(F.col("a.last_seen")).alias("last_seen"),
        F.when(~listed, now).alias("closed_at"),
        F.when(~listed, days).cast("long").alias("days_open"),
        kind.alias("kind"),
        changed.alias("changed"),
    )
    return rows.where(F.col("kind").isNotNull())


def closures(state: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Open rows that are listed no longer."""
    return state.where(F.col("status") == "open").join(live.select(key), key, "left_anti")


def additions(state: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Listed rows that are unknown or closed."""
    return live.join(state.where(F.col("status") == "open").select(key), key, "left_anti")


def stale(live: DataFrame, state: DataFrame, key: str, now: Column, days: int = 14, budget: int | None = None) -> DataFrame:
    """Listed rows whose detail is missing, older than so many days, or of another posting time; never fetched ones first, then by key. budget: how many of them."""
    known = state.select(key, F.col("posted").alias("_posted"), F.col("has_detail").alias("_has"), F.col("fetched").alias("_fetched"))
    old = ~F.coalesce("_has", F.lit(False)) | ~F.col("posted").eqNullSafe(F.col("_posted")) | F.col("_fetched").isNull() | (F.col("_fetched") < now - F.make_dt_interval(F.lit(days)))
    found = live.join(known, key, "left").where(old).orderBy(F.coalesce("_has", F.lit(False)), key).select(*live.columns, F.coalesce("_has", F.lit(False)).alias("had_detail"))
    return found.limit(budget) if budget else found


def gone_or_failed(failed: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Adds to failed details whether a fresh index still lists them; those it doesn't have closed meanwhile."""
    return failed.join(live.select(key, F.lit(True).alias("_l")).distinct(), key, "left").withColumn("listed", F.coalesce("_l", F.lit(False))).drop("_l")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, and what table has of other keys."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def run_summary(found: DataFrame, state: DataFrame, errors: DataFrame) -> DataFrame:
    """One row on a run: counts of each kind of change (found: diff()), open rows without a detail in the new state (status, has_detail), and errors by kind (kind)."""
    kinds = found.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "updated")))
    is_open = F.col("status") == "open"
    rows = state.agg(F.count_if(is_open).alias("open"), F.count_if(is_open & ~F.coalesce("has_detail", F.lit(False))).alias("missing_detail"))
    failed = errors.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_errors") for k in ("search", "detail", "blocked")))
    return kinds.crossJoin(rows).crossJoin(failed)
