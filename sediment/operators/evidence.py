"""Passages that say a topic and an action together, as evidence for signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import tables
from sediment.functions.keywords import matches
from sediment.functions.numbers import share
from sediment.functions.text import normalised
from sediment.session import scratch


def _fitting(passages: Column, signals: list[tuple[str, str, str]], negation: str) -> Column:
    """array<struct<signal, p>>: the first passage of each signal that has one. The passages and their lower case are made once."""

    def of(ps: Column) -> Column:
        def first(topic: str, action: str) -> Column:
            fits = F.filter(ps, lambda p: matches(p["text"], topic, p["low"]) & matches(p["text"], action, p["low"]) & ~matches(p["text"], negation, p["low"]))
            return F.get(F.transform(fits, lambda p: p.dropFields("low")), F.lit(0))

        return F.filter(F.array(*(F.struct(F.lit(s).alias("signal"), first(t, a).alias("p")) for s, t, a in signals)), lambda x: x["p"].isNotNull())

    lowered = F.transform(passages, lambda p: F.struct(p["section"].alias("section"), p["text"].alias("text"), F.lower(p["text"]).alias("low")))
    return F.get(F.transform(F.array(lowered), of), F.lit(0))


def evidence(rows: DataFrame, passages: Column, signals: list[tuple[str, str, str]] | None = None, negation: str = tables.NEGATION) -> DataFrame:
    """rows' columns, signal, section, excerpt: for each row and signal the first passage with topic and action, and no negation."""
    found = rows.select("*", F.explode(_fitting(passages, signals or tables.SIGNALS, negation)).alias("_e"))
    return found.select(*rows.columns, F.col("_e.signal").alias("signal"), F.col("_e.p.section").alias("section"), F.col("_e.p.text").alias("excerpt"))


def counted(rows: DataFrame, passages: Column, by: tuple[str, ...] = (), key: str = "id", signals: list[tuple[str, str, str]] | None = None, negation: str = tables.NEGATION) -> DataFrame:
    """(by's columns, signal, words, n, one): how many rows show a signal in the same words, and the least key that does with its passage. Without a signal: the rows that have passages at all.

    The texts are read once; the table is written, so that all that is derived from it reads counts.
    """
    both = F.struct(passages.alias("ps"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("signal"), F.lit(None).cast("struct<section:string,text:string>").alias("p")))
    found = F.get(F.transform(F.array(both), lambda x: F.when(F.size(x["ps"]) > 0, F.concat(none, _fitting(x["ps"], signals or tables.SIGNALS, negation)))), F.lit(0))
    rows = rows.select(*by, F.col(key).alias("id"), F.explode(found).alias("_e"))
    rows = rows.select(*by, "id", F.col("_e.signal").alias("signal"), F.col("_e.p.text").alias("excerpt"))
    one = F.min(F.when(F.col("signal").isNotNull(), F.struct("id", "excerpt"))).alias("one")
    counts = rows.groupBy(*by, "signal", normalised(F.col("excerpt")).alias("words")).agg(F.count("*").alias("n"), one)
    path = scratch(counts.sparkSession, "evidence")
    counts.write.parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def level(n: Column, different: Column) -> Column:
    return F.when(n == 0, "Not observed").when(n == 1, "One advert").when(different == 1, "Repeated wording").otherwise("Multiple passages")


def summary(counts: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """(signal, n, share, passages, level, excerpts) of all signals, from a table of counted(). The share is of the rows that have passages; without any it is null.

    Passages are told apart by their words; the first three are shown, by the least key that has them.
    """
    spark = counts.sparkSession
    names = spark.createDataFrame([(i, s) for i, s in enumerate(signals or [x[0] for x in tables.SIGNALS])], "ordinal int, signal string")
    readable = counts.where("signal is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_readable"))
    per_text = counts.where("signal is not null")
    # the first three of a signal by bounded aggregation
    top = F.expr("slice(array_sort(collect_list(one)), 1, 3)")
    firsts = per_text.withColumn("_k", F.expr("row_number() over (partition by signal order by one)")).where("_k <= 3").groupBy("signal").agg(top.alias("excerpts"))
    totals = per_text.groupBy("signal").agg(F.sum("n").alias("n"), F.count("*").alias("passages"))
    out = F.broadcast(names).join(totals, "signal", "left").join(firsts, "signal", "left").crossJoin(F.broadcast(readable))
    n, different = F.coalesce("n", F.lit(0)), F.coalesce("passages", F.lit(0))
    return out.select("ordinal", "signal", n.cast("long").alias("n"), share(n, F.col("_readable")).alias("share"), different.cast("long").alias("passages"), level(n, different).alias("level"), "excerpts")
