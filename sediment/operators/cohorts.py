"""A cohort against the rest: shares, distinctive terms, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.numbers import pct, quotient, ratio
from sediment.functions.text import terms
from sediment.operators.ranking import matching
from sediment.session import scratch


def inside(key: Column, members: list[str]) -> Column:
    """Whether a row is of the cohort; rows without a key are of the rest."""
    return F.coalesce(key.isin(*members), F.lit(False))


def compare(rows: DataFrame, cohort: Column, keys: Column, least: int = 1) -> DataFrame:
    """(key, n, rest_n, share, rest_share, index) of keys with so many rows of the cohort. The index is the ratio of the two shares, null where the rest has none."""
    marked = rows.select(cohort.alias("inside"), F.array_distinct(keys).alias("keys"))
    sizes = marked.agg(F.count_if("inside").alias("in_n"), F.count_if(~F.col("inside")).alias("out_n"))
    counts = marked.select("inside", F.explode("keys").alias("key")).groupBy("key").agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("rest_n"))
    shares = counts.where(F.col("n") >= least).crossJoin(F.broadcast(sizes)).withColumns({"share": quotient(F.col("n"), F.col("in_n")), "rest_share": quotient(F.col("rest_n"), F.col("out_n"))})
    return shares.select("key", "n", "rest_n", "share", "rest_share", quotient(F.col("share"), F.nullif("rest_share", F.lit(0.0))).alias("index"), "in_n", "out_n")


def published(compared: DataFrame) -> DataFrame:
    """compare() with rounded figures: shares in percent, and the index as the ratio of the rounded shares."""
    share, rest = pct(F.col("n"), F.col("in_n")), pct(F.col("rest_n"), F.col("out_n"))
    return compared.select("key", "n", share.alias("share"), rest.alias("rest_share"), F.when(rest != 0, ratio(share, rest)).alias("index"))


def mentions(rows: DataFrame, cohort: Column, pattern: str, *columns: str) -> DataFrame:
    """Rows outside the cohort whose texts speak of it."""
    return matching(rows.where(~cohort), pattern, *columns)


def term_counts(texts: DataFrame, cohort: Column, text: Column) -> DataFrame:
    """(term, n, rest_n): documents with each word or pair of words."""
    marked = texts.select(cohort.alias("inside"), F.explode(terms(text)).alias("term"))
    return marked.groupBy("term").agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("rest_n"))


def distinctive(texts: DataFrame, cohort: Column, text: Column, least: int = 5, lift: float = 1.6, word_lift: float = 3.0) -> DataFrame:
    """(term, n, rest_n, share, rest_share, lift) of terms that the cohort uses more: lift is its share against that of the rest, which half a document is added to.

    A single word must have word_lift, and goes where a pair with it is kept.
    """
    sizes = texts.select(cohort.alias("inside")).agg(F.greatest(F.count_if("inside"), F.lit(1)).alias("in_n"), F.greatest(F.count_if(~F.col("inside")), F.lit(1)).alias("out_n"))
    counted = term_counts(texts, cohort, text).where(F.col("n") >= least).crossJoin(F.broadcast(sizes))
    share = F.col("n") / F.col("in_n")
    rows = counted.select("term", "n", "rest_n", share.alias("share"), (F.col("rest_n") / F.col("out_n")).alias("rest_share"), (share / ((F.col("rest_n") + 0.5) / F.col("out_n"))).alias("lift")).where(F.col("lift") >= lift)
    path = scratch(texts.sparkSession, "terms")  # written, as both kinds of terms and what covers them are made of it
    rows.write.parquet(path)
    rows = texts.sparkSession.read.schema(rows.schema).parquet(path)
    phrase = F.contains(F.col("term"), F.lit(" "))
    covered = rows.where(phrase).select(F.explode(F.split("term", " ")).alias("term")).distinct()
    words = rows.where(~phrase & (F.col("lift") >= word_lift)).join(covered, "term", "left_anti")
    return rows.where(phrase).unionByName(words)


def chained(found: list[dict], longest: int = 7) -> list[dict]:
    """Overlapping pairs of the same frequency joined to the phrase they are pieces of. Works on the report's few rows.

    Pairs are taken by lift, then frequency, then text; a phrase grows on its right, then on its left, until nothing fits.
    """
    order = sorted(found, key=lambda r: (-r["lift"], -r["n"], r["term"]))
    open_pairs = {r["term"]: r for r in order if " " in r["term"]}
    out = []
    for row in order:
        if " " not in row["term"]:
            out.append(row)
            continue
        if open_pairs.pop(row["term"], None) is None:
            continue
        phrase = row["term"].split(" ")
        while len(phrase) < longest:
            same = [t.split(" ") for t, r in open_pairs.items() if r["n"] == row["n"]]
            behind = next((p for p in same if p[0] == phrase[-1]), None)
            if behind:
                phrase.append(behind[1])
                del open_pairs[" ".join(behind)]
                same.remove(behind)
            before = next((p for p in same if p[1] == phrase[0]), None)
            if before:
                phrase.insert(0, before[0])
                del open_pairs[" ".join(before)]
            if not behind and not before:
                break
        out.append({**row, "term": " ".join(phrase)})
    return sorted(out, key=lambda r: (-r["lift"], -r["n"], r["term"]))


def quotable(phrases: list[dict], most: int = 4) -> list[str]:
    """Phrases of two words, then of three, that share no word."""
    said: set[str] = set()
    out: list[str] = []
    for size in (2, 3):
        for p in phrases:
            words = p["term"].split(" ")
            if len(out) < most and len(words) == size and not said & {*words}:
                said |= {*words}
                out.append(p["term"])
    return out
