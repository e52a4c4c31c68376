"""Exact medians against the standard library: few and many values, ties, one hot group, null keys and values, no rows."""

import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.operators import ranking, series


def test_medians(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=30_001)] + [("even", float(x)) for x in rng.integers(0, 10**6, 20_000)]
    rows += [("ties", float(x)) for x in rng.integers(0, 3, 5000)] + [("one", 7.5), ("two", 1.0), ("two", 2.0), (None, 4.0), (None, 9.0), ("skewed", 1e300)]
    rows += [("skewed", float(x)) for x in range(3)] + [("two", None), ("none", None)]
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    found = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.key: (r.n, r.median) for r in ranking.medians(found, F.col("k"), F.col("v")).collect()}
    assert got.keys() == values.keys()
    for k, xs in values.items():
        assert got[k][0] == len(xs) and got[k][1] == pytest.approx(statistics.median(xs), rel=1e-15)
    upper = {r.key: r.median for r in ranking.medians(found, F.col("k"), F.col("v"), upper=True).collect()}
    assert upper == {k: statistics.median_high(xs) for k, xs in values.items()}
    assert {r.key for r in ranking.median_by(found, F.col("k"), F.col("v"), 4).collect()} == {"hot", "even", "ties", "skewed"}
    assert ranking.medians(found.limit(0), F.col("k"), F.col("v")).collect() == []


def test_market_months_without_values(spark):
    rows = spark.sql("select timestamp'2024-01-05' as ts, cast(null as double) as v union all select timestamp'2024-02-05', 3.0 union all select timestamp'2024-02-06', null union all select null, 9.0")
    got = series.market_months(rows, F.col("ts"), {"dear": F.col("v") > 2}, F.col("v"), 1).orderBy("month").collect()
    assert [tuple(r) for r in got] == [("2024-01", 1, 0, None), ("2024-02", 2, 1, 3.0)]


def test_medians_gather_no_key(spark):
    rows = spark.range(300_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).cast("double").alias("v"))
    plan = ranking.medians(rows, F.col("k"), F.col("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "percentile" not in plan  # it reads counts of equal values only
    many = rows.select(F.lit("hot").alias("k"), F.rand(5).alias("v"))
    own = sorted(r.v for r in many.collect())
    held = spark.createDataFrame([("hot", x) for x in own], "k string, v double").repartition(5)
    assert [tuple(r) for r in ranking.medians(held, F.col("k"), F.col("v")).collect()] == [("hot", 300_000, 0.5 * own[149_999] + 0.5 * own[150_000])]
