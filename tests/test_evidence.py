"""Evidence is made of each text once: what a plan repeats, it does again for every repetition."""

from pyspark.sql import functions as F

from sediment import adverts
from sediment.functions import text
from sediment.operators import evidence
from sediment.registry import Tables

BREAKS = r"(?i)<br\s*/?>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_made_once(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert plan(adverts.passages_evidence(t)).count(BREAKS) == 1
    for query in (adverts.evidence_summary, adverts.strategy_evidence):
        assert BREAKS not in plan(query(t)), query.__name__


def test_sections_are_cut_once(spark):
    rows = spark.createDataFrame([("Overview\nOne.\nBenefits\nTwo.\nResponsibilities\nThree.",)], "t string")
    found = rows.select(text.sections(F.col("t")).alias("s"))
    assert plan(found).count("split(") == 1
    assert [(s["section"], s["text"].strip()) for s in found.first()["s"]] == [("Overview", "One."), ("Responsibilities", "Three.")]


def test_entities_are_decoded_only_where_there_are_some(spark):
    rows = spark.createDataFrame([(1, "a<br>b"), (2, "<p>R&amp;D &lt;x&gt; &bogus; y</p>z"), (3, None), (4, "AT&T")], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(text.plain_text(F.col("t"))).collect()] == ["a\nb", "R&D <x> y\nz", None, "AT&T"]


def test_counts_and_rows_without_passages(spark):
    made = [(1, "Build an agentic thing now."), (2, "build an AGENTIC thing, now!"), (3, "Never build an agentic thing."), (4, None)]
    rows = spark.createDataFrame(made, "id long, t string")
    parts = F.when(F.col("t").isNotNull(), F.array(F.struct(F.lit("overview").alias("section"), F.col("t").alias("text")))).otherwise(F.array().cast("array<struct<section:string,text:string>>"))
    found = {r["signal"]: r for r in evidence.summary(evidence.counted(rows, parts)).collect()}
    one = found["production-ai"]
    assert (one["n"], one["share"], one["passages"], one["level"], [x["id"] for x in one["excerpts"]]) == (2, 66.7, 1, "Repeated wording", [1])
    assert (found["adoption"]["n"], found["adoption"]["share"], found["adoption"]["level"]) == (0, 0.0, "Not observed")
    assert evidence.summary(evidence.counted(rows.where("id = 4"), parts)).first()["share"] is None
