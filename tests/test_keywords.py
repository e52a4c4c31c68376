"""Keywords by one pass and patterns behind literals: the same as each pattern alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sediment.functions import keywords, patterns, rules, tables

ALL = sorted({w for t in (tables.THEMES, tables.INDUSTRIES) for words in t.values() for w in words})


@pytest.fixture(scope="module")
def texts(spark):
    """Keywords between other words, at both ends, against letters, digits and underscores, with other separators, and cut short."""
    rng = random.Random(8)
    around = [" ", "", "x", "9", "_", "-", "\n", "é", "İ", ".", "  ", "(", ")", "\u0085", "ß"]
    said = [*ALL, *tables.COUNTRIES, "MICROSOFT 365", "windows of ", "windows x", "JavaScript", "java", "Power BI", "powerbi", "C#", "c sharp", "SFI", "sfi", "open ai", "ISD team", "joining the ISD", "multi-agent", "5 years", "ſecurity", "Kubernetes"]
    rows = ["", " ", None, "a", "azure", "ci/cd", ".net", "x.net", "asp.net .NET", "k-12"]
    rows += ["".join(rng.choice(around) + (w.upper() if rng.random() < 0.2 else w[: -1 if rng.random() < 0.1 else None]) + rng.choice(around) for w in rng.sample(said, rng.randrange(1, 9))) for _ in range(400)]
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string").cache()


def test_found(texts):
    """By one pass, against a pattern for each keyword."""
    low = F.lower(F.coalesce("t", F.lit("")))
    rows = texts.select(keywords.found(low, ALL).alias("got"), F.filter(F.array(*(F.when(low.rlike(patterns.keyword(w)), F.lit(w)) for w in ALL)), lambda x: x.isNotNull()).alias("want")).collect()
    assert all(sorted(r.got) == sorted(r.want) for r in rows) and sum(len(r.want) for r in rows) > 400


def test_topics(texts):
    """Of two tiers: one keyword of the structured text, or two different ones of the free text."""
    rows = texts.select("t", rules.two_tier(F.substring("t", 1, 12), F.col("t"), tables.THEMES).alias("got")).collect()
    has = lambda w, t: re.search(patterns.keyword(w).replace(r"\z", r"\Z"), t) is not None
    low = lambda t: "".join(c.lower() for c in t or "")
    for r in rows:
        whole = low(r.t)
        want = [k for k, words in tables.THEMES.items() if any(has(w, low((r.t or "")[:12])) for w in words) or sum(has(w, whole) for w in words) >= 2]
        assert r.got == want, r.t


@pytest.mark.parametrize("table", ["PRODUCTS", "SOLUTION_AREAS", "INITIATIVES", "SENIORITY", "ARCHETYPES", "DEGREES", "SKILLS", "SIGNALS"])
def test_literals(texts, table):
    """A pattern behind its literals matches where it does alone."""
    own = [x[-1] for x in getattr(tables, table)]
    t = F.coalesce("t", F.lit(""))
    rows = texts.select(*(keywords.matches(t, p, F.lower(t)).alias(f"a{i}") for i, p in enumerate(own)), *(t.rlike(patterns.java(p)).alias(f"b{i}") for i, p in enumerate(own))).collect()
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in rows for i in range(len(own)))


def test_what_a_match_must_hold():
    assert keywords.literals(r"\bazure\b") == ("azure",)
    assert keywords.literals(r"\bpre[- ]?sales\b|\bsolution selling\b") == ("sales", "solution selling")
    assert keywords.literals(r"\b(senior|sr\.?)\b") in ((), ("senior", "sr"))
    assert keywords.literals(r"[ab]+|x") == () and keywords.literals(r"(?:ab)?c") == () and keywords.literals(r"(?:ab)+c") == ("ab",)
    assert keywords.literals(r"\bjava\b(?!script)") == ("java",)
