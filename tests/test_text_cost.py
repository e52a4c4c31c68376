"""Steps over texts that were made cheaper give what they gave, on odd texts too, and don't do their work twice."""

import re
import time

from pyspark.sql import functions as F

from sediment.functions import patterns, tables, text

c = F.col


def test_starting():
    assert patterns.starting(r"\bazure\b") == "(?=[Aa])" and patterns.starting(r"\bc#|\.net") == r"(?=[\x2eCc])" and patterns.starting("(?:the )?unit") == "(?=[TUtu])"
    for unknown in (r"^\s+", "", "x?", "é", "[^a]b", r"\w", "(?:a|)"):
        assert patterns.starting(unknown) == ""


def test_words_are_passed_over(spark):
    assert all(patterns.java(p).startswith("(?i)(?=[") for _, p in tables.SOLUTION_AREAS + tables.INITIATIVES)


def test_sections_and_removals(spark):
    own = "typical base pay range for this role"
    odd = ["", "Overview", "Overview\n", "Overview \n \n\n  a\n\nResponsibilities\nx", "OVERVIEW\n\na\nQualificationsx\nQ\nqualifications: z\nOverview\nb", f"a\n{own} b {own}\nc\n\nd {own} e", "Microsoft https://x.y will accept applications now\nz", " \t a \tb  c\t", "Overview\n" + "x " * 3000 + "\nResponsibilities", "a\r\n\n\n\nb"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    space = "[\\s\u00a0\ufeff]"
    got = [r.o for r in df.select(text.overview(c("t")).alias("o")).collect()]
    want = []
    for x in odd:
        m = re.search(rf"(?ai)Overview{space}*\n+([\s\S]*?)(?:\n{space}*(?:{tables.OVERVIEW_ENDS})(?![A-Za-z0-9_])|\Z)", x)
        want.append((m.group(1) if m else x[:2500])[:4000])
    assert got == want
    plain = c("t")
    for p in tables.REMOVALS:
        plain = F.regexp_replace(plain, p, " ")
    squeezed = text._trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    assert df.where(~text.without(c("t"), tables.REMOVALS).eqNullSafe(squeezed)).count() == 0


def test_a_long_line_with_a_range_of_pay(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("word "), 200_000), F.lit("the typical base pay "), F.lit("range for this role is x")).alias("t"), F.concat(F.repeat(F.lit("word "), 200_000), F.lit("typical base pay range for this rolx, role")).alias("u"))
    assert df.select(text.without(c("t"), tables.REMOVALS)).first()[0] == "" and len(df.select(text.without(c("u"), tables.REMOVALS)).first()[0]) > 1_000_000


def test_the_work_of_planning_does_not_double(spark):
    df = spark.range(1).select(F.lit("x").alias("t"))
    plans = [len(df.select(text.without(c("t"), tables.REMOVALS[:n] * k))._jdf.queryExecution().optimizedPlan().toString()) for n, k in ((15, 1), (15, 2))]
    assert plans[1] < 3 * plans[0]
    started = time.monotonic()
    assert df.select(text.without(c("t"), tables.REMOVALS * 3)).first()[0] == "x" and time.monotonic() - started < 60
