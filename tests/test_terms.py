"""Tokens and distinctive terms: what was made cheaper gives what it gave, on odd texts too, and terms are counted once."""

from pyspark.sql import functions as F

from sediment.functions import text
from sediment.operators import cohorts

c = F.col


def test_tokens(spark):
    odd = ["-.-", "--a--b-. .net c++ - x.", "a-.b -a .", "", None, "  A/B  node.js. 12 345 data-driven -- sets", "é.-x-"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    raw = F.split(F.regexp_replace(F.lower("t"), "[^a-z0-9+#&./ -]+", " "), " +")
    before = F.filter(F.transform(raw, lambda w: F.regexp_replace(w, r"^[-.]+|[-.]+$", "")), lambda w: w != "")
    assert df.where(~text.tokens(c("t")).eqNullSafe(before)).count() == 0


def test_distinctive_terms_are_counted_once(spark):
    rows = spark.createDataFrame([(i % 2 == 0, f"alpha beta gamma{i % 3}" if i % 2 == 0 else "delta words here") for i in range(60)], "own boolean, t string")
    found = cohorts.distinctive(rows, c("own"), c("t"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Union")[0] and "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "alpha beta" in {r.term for r in found.collect()}
