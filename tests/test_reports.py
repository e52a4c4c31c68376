"""Reports of one pass: how often their plans read the rows, and tables of counts against the operators that count rows."""

import pytest
from pyspark.sql import functions as F

from sediment import catalogue
from sediment.functions import tables, text
from sediment.operators import cells, classify, ranking, reports, series
from sediment.registry import Tables


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, "abc"[i % 3] if i % 7 else None, ["x", "y", "y", "z"][: i % 5] if i % 4 else None, f"2024-{1 + i * 5 % 9:02d}-{1 + i % 28:02d}" if i % 11 else None, i % 6 if i % 5 else None) for i in range(300)]
    return spark.createDataFrame(made, "id int, k string, tags array<string>, day string, v int").withColumn("day", F.to_timestamp("day"))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_cells_are_what_the_operators_count(rows):
    tags, month = F.coalesce("tags", F.array().cast("array<string>")), F.date_format("day", "yyyy-MM")
    found = cells.counted(rows, cells.one("cross", ranking.stated(F.col("k")), ranking.stated(F.col("v"))), cells.each("month", tags, month), cells.one("posted", month, where=month.isNotNull()), cells.pairs("pair", tags), cells.one("v", ranking.stated(F.col("k")), F.col("v"), where=F.col("v").isNotNull()), cells.each_of("tag", "label", tags))
    same(ranking.crosstab(rows, F.col("k"), F.col("v"), ["0", "1", "9"], 2), cells.crosstab(cells.table(found, "cross", "row", "col"), ["0", "1", "9"], 2))
    same(ranking.pairs(rows, tags), cells.table(found, "pair", "a", "b"))
    grid = cells.last_months(cells.table(found, "posted", "month"), 4)
    same(series.last_months(rows, F.col("day"), 4), grid)
    same(series.monthly(rows, F.col("day"), tags, 4, 2), cells.monthly(cells.table(found, "month", "key", "month"), grid, 2))
    same(ranking.medians(rows, ranking.stated(F.col("k")), F.col("v")), cells.medians(cells.table(found, "v", "key", "v"), "key", "v"))
    same(rows.where("v is not null").groupBy(ranking.stated(F.col("k")).alias("key")).agg(F.count("*").alias("n"), ranking.upper_median("v").cast("long").alias("median")), cells.medians(cells.table(found, "v", "key", "v"), "key", "v", upper=True))
    same(ranking.tally_many(rows, tags), cells.table(found, "tag", "label", "key").drop("label"))


def test_cells_of_nothing(rows):
    found = cells.counted(rows.limit(0), cells.one("v", F.col("k")))
    assert found.collect() == [] and cells.last_months(found.withColumnRenamed("a", "month")).collect() == []


def test_the_overview_reads_its_rows_once(spark, sf_dir, monkeypatch):
    """All its tables are made of one table of cells, whose plan scans the orders once."""
    plans = []
    real = cells.counted
    monkeypatch.setattr(cells, "counted", lambda rows, *parts: plans.append(rows.select(F.explode(F.concat(*parts)))._jdf.queryExecution().optimizedPlan().toString()) or real(rows, *parts))
    found = reports.overview(catalogue._postings(Tables(spark, sf_dir)), F.to_timestamp(F.lit("2001-08-01")))
    assert len(plans) == 1 and plans[0].count("o_orderpriority#") > 0 and plans[0].count("Relation [o_orderkey") == 1
    for name, df in found.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan, name


def book(spark, copies: int = 1):
    """Postings with nulls, empty lists, repeated tags and values of every kind that reports look at."""

    def pick(i: int, *values):
        return values[i % len(values)]

    made = []
    for i in range(120):
        tags, skills = pick(i, ["b", "a"], ["a", "b", "b"], [], None, ["c"]), pick(i, ["python", "sql"], None, ["sql", "any_lang", "python"], [], ["any_lang"], ["copilot", "sql", "sql"], ["rag"])
        made.append((str(i), pick(i, "Lead Data Scientist", "", None, "Data Engineer II"), pick(i, "d1", None), pick(i, "p1", "p2", "", None), pick(i, "x", "y", None), pick(i, "People Manager", "Individual Contributor", None), pick(i, "Full-Time", None), pick(i, "Senior", "Principal", None, "Manager", "odd"), pick(i, "engineer", "", None), pick(i, "Up to 100% remote", None, "office"),
            pick(i, None, "Remote"), pick(i, "0-25%", None), pick(i, "o1", None, "o2"), pick(i, "department", None, "self", "profession"), pick(i, ["Europe, Paris"], ["a", "b"], None, []), pick(i, ["FR"], None, [], [None]), tags, pick(i, ["i"], None), pick(i, None, ["q", "r"]), pick(i, ["s", "s"], []), pick(i, [], ["agentic"], None), skills,
            pick(i, "open", "open", "open", "closed", None, "odd"), pick(i, 0, 990_000_000 + i * 86_400, None, 950_000_000 + i * 2_592_000), pick(i, 3, None, 0, 7, 12), pick(i, "PhD", None, "other"), pick(i, True, True, None, False, True), pick(i, 5, 9, None, -1), pick(i, "speaks", None)))
    names = "id string, title string, department string, profession string, discipline string, roleType string, employmentType string, seniority string, archetype string, workSite string, workLocationOption string, travel string, org string, orgSource string, locations array<string>, countryCodes array<string>, themes array<string>, industries array<string>, products array<string>, solutionAreas array<string>, initiatives array<string>, skills array<string>, status string, creationTs long, requiredYears int, degree string, hasQualifications boolean, daysOpen long, descriptionHtml string"
    return spark.createDataFrame(made * copies, names)


def as_of():
    return F.to_timestamp(F.lit("2001-08-01"))


def made_of(monkeypatch, report, *args):
    """A report, and the numbers of rows that cells are made of."""
    found, real = [], cells.counted
    with monkeypatch.context() as m:
        m.setattr(cells, "counted", lambda rows, *parts: found.append(rows.count()) or real(rows, *parts))
        return report(*args), found


def test_the_overview_makes_cells_once_for_equal_rows(spark, monkeypatch):
    """five times the rows give as many different rows to make cells of, and five times the counts."""
    one, few = made_of(monkeypatch, reports.overview, book(spark), as_of())
    five, more = made_of(monkeypatch, reports.overview, book(spark, 5), as_of())
    assert few == more
    for name in ("breakdowns", "themePairs", "crosstabs", "timeline", "trend"):
        same(one[name].withColumn("n", 5 * F.col("n")), five[name])


def test_the_overview_is_what_the_operators_count(spark):
    """All dimensions, marks and months, held to operators on the open rows."""
    rows = book(spark)
    found, own = reports.overview(rows, as_of()), reports.is_open(rows)
    none, posted = F.array().cast("array<string>"), F.when(F.col("creationTs") != 0, F.timestamp_seconds("creationTs"))

    def of(dim):
        return found["breakdowns"].where(F.col("dim") == dim).select("key", "n")

    for dim in ("profession", "discipline", "department", "roleType", "employmentType", "seniority", "workSite", "travel"):
        same(ranking.tally(own, ranking.stated(F.col(dim))), of(dim))
    same(ranking.tally(own, ranking.stated(F.col("archetype"), "other")), of("archetype"))
    same(ranking.tally(own, ranking.stated(F.col("org"), "not_stated")), of("org"))
    for dim, column in {"theme": "themes", "product": "products", "industry": "industries", "solutionArea": "solutionAreas", "initiative": "initiatives"}.items():
        same(ranking.tally_many(own, F.coalesce(column, none)), of(dim))
    same(ranking.tally_many(own, text.title_words(F.col("title"))), of("titleWord"))
    same(ranking.pairs(own, F.coalesce("themes", none)).orderBy(F.col("n").desc(), "a", "b").limit(15), found["themePairs"])
    same(series.dense_days(own, posted, 180), found["trend"])
    for dim, keys in {"theme": F.coalesce("themes", none), "org": F.array_compact(F.array("org")), "profession": F.array(ranking.stated(F.col("profession")))}.items():
        same(series.monthly(own, posted, keys, 12, 8), found["timeline"].where(F.col("dim") == dim).drop("dim"))
    meta = {r.key: r.n for r in found["meta"].collect()}
    kept = [r for r in rows.collect() if r.status == "open"]
    aged = [r for r in kept if r.creationTs]
    assert meta["open"] == len(kept) and meta["closed"] == rows.where("status = 'closed'").count() and meta["tracked"] == rows.count()
    assert meta["untagged"] == sum(not r.themes for r in kept) and meta["multiLocation"] == sum(len(r.locations or []) > 1 for r in kept)
    assert meta["remoteEligible"] == sum("remote" in f"{r.workSite} {r.workLocationOption}".lower() for r in kept) and meta["orgIdentified"] == sum(r.org is not None for r in kept)
    assert [meta[f"orgFrom_{s}"] for s in ("department", "profession", "self")] == [sum(r.org is not None and (r.orgSource or "self") == s for r in kept) for s in ("department", "profession", "self")]
    assert meta["aged"] == len(aged) and meta["ageDays"] == sum((996_624_000 - r.creationTs) // 86_400 for r in aged)
    closed = sorted(r.daysOpen for r in rows.collect() if r.status == "closed" and r.daysOpen is not None)
    assert meta["medianDaysToClose"] == closed[len(closed) // 2]


CATEGORY = {"python": "code", "sql": "data", "rag": "ai"}


def asked(postings, now):
    """The tables of requirements() by operators that each count the rows."""
    none, posted = F.array().cast("array<string>"), F.when(F.col("creationTs") != 0, F.timestamp_seconds("creationTs"))
    marks = F.array(*map(F.lit, tables.OPEN_LIST_SKILLS))
    own, all_open = F.coalesce("skills", none), reports.is_open(postings)
    rows = all_open.where("hasQualifications").withColumns({"openList": F.array_intersect(own, marks), "skills": F.array_except(own, marks), "band": classify.band(F.col("seniority"))})
    category = F.create_map(*(F.lit(x) for pair in CATEGORY.items() for x in pair))
    kinds = F.array_distinct(F.filter(F.transform("skills", lambda k: F.try_element_at(category, k)), lambda c: c.isNotNull()))
    total, ai = rows.agg(F.count("*").alias("total")), classify.asks_for_ai(F.col("skills"))
    market = series.market_months(rows, posted, {"ai": ai, "degree": F.col("degree").isNotNull()}, F.col("requiredYears"))
    recent = F.coalesce(posted >= now - F.expr("interval 90 days"), F.lit(False))
    return {
        "coverage": all_open.agg(F.count("*").alias("open"), F.count_if("hasQualifications").alias("n")).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("open"))),
        "breadth": ranking.breadth(rows, F.col("skills")),
        "skills": ranking.with_share(ranking.tally_many(rows, F.col("skills")), total),
        "categories": ranking.with_share(ranking.tally_many(rows, kinds), total),
        "openList": ranking.with_share(ranking.tally_many(rows, F.col("openList")), total),
        "years": ranking.buckets(rows, F.col("requiredYears"), reports._YEARS, "9+ years"),
        "bands": ranking.median_by(rows, F.col("band"), F.col("requiredYears")),
        "degrees": ranking.tally(rows, F.coalesce("degree", F.lit("Not stated"))),
        "demand": series.recency(rows, posted, F.col("skills"), rows.sparkSession.range(1).select(now.alias("now")), 90, 12),
        "aiStack": rows.agg(F.count("*").alias("n"), F.count_if(ai).alias("ai"), F.count_if(recent).alias("recent"), F.count_if(recent & ai).alias("recent_ai")),
        "pairs": ranking.pairs(rows, F.col("skills")).orderBy(F.col("n").desc(), "a", "b").limit(12),
        "gradient": ranking.gradient(rows, kinds, F.col("band")),
        "market": market.join(series.last_months(rows, posted).select("month"), "month"),
        "timeline": reports._union(rows_of.select(F.lit(d).alias("dim"), "*") for d, rows_of in (("skill", series.monthly(rows, posted, F.col("skills"), 12, 8)), ("category", series.monthly(rows, posted, kinds)))),
    }


@pytest.mark.parametrize("copies", [0, 30])
def test_the_requirements_are_what_the_operators_count(spark, copies):
    rows = book(spark, copies or 1).where(F.lit(bool(copies)))
    found, expected = reports.requirements(rows, as_of(), CATEGORY), asked(rows, as_of())
    assert list(found) == list(expected)
    for name, df in found.items():
        df = df.drop("base_share", "recent_share", "index") if name == "aiStack" else df
        assert dict(df.dtypes) == dict(expected[name].dtypes), name
        same(expected[name], df)
    assert not copies or all(df.count() for df in expected.values())


def test_the_requirements_make_cells_once_for_equal_rows(spark, sf_dir, monkeypatch):
    """all tables are of one table of cells, and no plan goes back to the orders; more equal rows make no more cells."""
    _, few = made_of(monkeypatch, reports.requirements, book(spark), as_of(), CATEGORY)
    _, more = made_of(monkeypatch, reports.requirements, book(spark, 5), as_of(), CATEGORY)
    assert len(few) == 1 and few == more
    for name, df in reports.requirements(catalogue._postings(Tables(spark, sf_dir)), as_of(), CATEGORY).items():
        assert "o_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString(), name
