"""Scalar functions, classifiers, evidence, records and landed pages over rows whose answers were worked out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sediment import schema
from sediment.functions import dates, numbers, patterns, text
from sediment.operators import classify, evidence
from sediment.sources import landing

c = F.col
CASES = {}


def query(sql):
    return lambda f: CASES.setdefault(f.__name__, (f, sql))[0]


#: Adverts, and what is evidence in them.
_ADVERTS = [
    (1, "Overview\nWe deploy agentic systems in production for banks. We never build copilot demos.\nResponsibilities\nDeliver measurable business outcomes for customers.\nBenefits\nWe build AI for fun, and drive adoption of it."),
    (2, "Overview\n\nResponsibilities\nYou will not deploy AI to production here at all. Accelerate adoption across the whole group."),
    (3, "Responsibilities:\nBuild reusable accelerators.\nImplement governance, security and responsible AI controls."),
    (4, ""),
    (5, "Nothing of the kind is said in this advert, whatever you read."),
]

#: Postings whose classes can be read off the rule tables.
_CLASSED = [
    (1, "Senior Software Engineer", "Software Engineering", "Software Engineering", "CO+I", "<p>Overview</p><p>Join the Cloud Operations + Innovation team. We run Azure datacenters and critical environment work.</p><p>Qualifications</p><p>Bachelor's degree. 5+ years of Python, Kubernetes and distributed systems.</p><p>Responsibilities</p><p>Build things.</p>"),
    (2, "Principal Consultant", "Technology Consulting", "Consulting", "Technology Consulting", "<p>Overview</p><p>Deliver agentic solutions for banking and insurance customers.</p><p>Qualifications</p><p>Master's degree or 8 years of experience. Security clearance. Java, not JavaScript alone.</p>"),
    (3, "Partner Director of Sales", "Sales", "Sales", "", "<p>The Xbox team sells games.</p>"),
    (4, "Executive Assistant", "", "", "", ""),
    (5, "Intern, Digital Sales", "Digital Sales and Solutions", "Sales", "unknown", "<p>Overview</p><p>We mention the Customer Success Unit only.</p><p>Qualifications</p><p>PhD. 12 years or 3 years.</p>"),
    (6, "Manager of éa", "Finance", "", "Account Management", "<p>Qualifications</p><p>Languages including, but not limited to, C#, Java or Python. PMP.</p>"),
]


@query(
    """select * from (values (1, 'production-ai', 'Overview', 'We deploy agentic systems in production for banks.'), (1, 'business-outcomes', 'Responsibilities', 'Deliver measurable business outcomes for customers.'),
    (2, 'adoption', 'Responsibilities', 'Accelerate adoption across the whole group.'), (3, 'production-ai', 'Responsibilities', 'Implement governance, security and responsible AI controls.'),
    (3, 'reusable-delivery', 'Responsibilities', 'Build reusable accelerators.'), (3, 'trusted-delivery', 'Responsibilities', 'Implement governance, security and responsible AI controls.')) v(id, signal, section, excerpt)"""
)
def passages_evidence(t):
    rows = t.spark.createDataFrame(_ADVERTS, "id int, text string").select("id", text.passages(text.sections(c("text"))).alias("parts"))
    return evidence.evidence(rows, c("parts")).drop("parts")


@query("select * from (values (1, 5), (2, 2), (3, null), (4, 3)) v(id, years)")
def required_years(t):
    rows = t.spark.createDataFrame([(1, "5+ years of Java, 10 years in all"), (2, "2 YEARS or 30 years"), (3, "many yearsome things"), (4, "8 years; 3years")], "id int, text string")
    return rows.select("id", text.required_years(c("text")).alias("years"))


@query("select * from (values (1, 'Oslo', 'Norway', 'NO'), (2, 'Reading', 'United Kingdom', 'GB'), (3, 'Japan', 'Japan', null), (4, 'Unknown', 'Unknown', null)) v(id, city, country, code)")
def parse_location(t):
    rows = t.spark.createDataFrame([(1, "Norway, Oslo, Oslo", "Oslo, NO"), (2, "Reading, UK", "Reading, GB"), (3, "Japan", ""), (4, "", None)], "id int, l string, s string")
    return rows.select("id", text.place(c("l"), c("s")).alias("p")).select("id", "p.*")


@query(
    """select * from (values (1, 'Senior', 'engineer', 'coi', 'self', 'Azure,Kubernetes', '', '', 'python,k8s,distributed', 5, 'Bachelor''s', true, 'senior', 'build'),
    (2, 'Principal', 'consultant', 'isd', 'department', '', '', 'agentic', 'java,js,consulting,clearance', 8, 'Master''s', true, 'principal', 'gtm'),
    (3, 'Partner (Distinguished)', 'leadership', 'gaming', 'self', 'Xbox', '', '', '', null, null, false, 'principal', 'gtm'),
    (4, 'Mid / Unspecified', 'business_support', null, null, '', '', '', '', null, null, false, 'mid', 'other'),
    (5, 'Intern / University', 'sales', 'digitalsales', 'profession', '', '', '', '', 3, 'PhD', true, 'entry', 'gtm'),
    (6, 'Manager', 'manager', 'atu', 'department', '', '', '', 'any_lang,pm_cert', null, null, true, 'manager', 'run'))
    v(id, seniority, archetype, org, source, products, areas, initiatives, skills, years, degree, asks, band, function)"""
)
def classified_postings(t):
    rows = t.spark.createDataFrame(_CLASSED, "id int, title string, profession string, discipline string, department string, descriptionHtml string")
    out = classify.classified(rows)
    joined = [F.array_join(c(k), ",").alias(n) for k, n in (("products", "products"), ("solutionAreas", "areas"), ("initiatives", "initiatives"), ("skills", "skills"))]
    return out.select("id", "seniority", "archetype", "org", c("orgSource").alias("source"), *joined, c("requiredYears").alias("years"), "degree", c("hasQualifications").alias("asks"), classify.band(c("seniority")).alias("band"), classify.function(c("profession")).alias("function"))


@query(
    """select * from (values (1, 'cloud_azure', ''), (2, '', 'finserv'), (3, 'gaming', ''), (4, '', ''), (5, '', ''), (6, '', '')) v(id, themes, industries)"""
)
def classified_topics(t):
    rows = t.spark.createDataFrame([(i, x, p, d, "", h) for i, x, p, d, _, h in _CLASSED], "id int, title string, profession string, discipline string, department string, descriptionHtml string")
    rows = rows.withColumn("title", F.when(c("id") == 3, "Partner Director of Xbox Sales").otherwise(c("title")))
    return classify.classified(rows).select("id", F.array_join("themes", ",").alias("themes"), F.array_join("industries", ",").alias("industries"))


@query("select * from (values ('share', '33.3'), ('no share', null), ('pct', '0.0'), ('ratio', '1.01'), ('relative', 'yesterday'), ('months', '3 months ago'), ('city', 'Norway — multiple sites'), ('town', 'Oslo, Norway'), ('label', 'Unit of work (not ABC)'), ('unit', 'Unit of work'), ('normalised', 'we build it'), ('keyword', 'true'), ('no keyword', 'false'), ('count', '1,234 adverts'), ('one', '1 advert'), ('lift', '2.5×'), ('great lift', '13×'), ('no lift', 'only in this cohort'), ('level', 'Repeated wording'), ('tokens', 'c++|net|ci/cd|node.js'), ('clean', 'a b')) v(name, value)")
def scalar_functions(t):
    one = t.spark.range(1)
    lit = F.lit
    values = {
        "share": numbers.share(lit(1), lit(3)), "no share": numbers.share(lit(1), lit(0)), "pct": numbers.pct(lit(1), lit(0)), "ratio": numbers.ratio(lit(1.0075), lit(1.0)), "relative": dates.relative(lit(1)), "months": dates.relative(lit(95)),
        "city": text.city_label(lit("Multiple Locations"), lit("Norway")), "town": text.city_label(lit("Oslo"), lit("Norway")), "label": text.short_label(lit("Unit of work (UOW) (not ABC)")), "unit": text.short_unit(lit("Unit of work (UOW)")),
        "normalised": text.normalised(lit("  We BUILD, it! ")), "keyword": lit("we use .net here").rlike(patterns.keyword(".NET")), "no keyword": lit("dotnet.net5").rlike(patterns.keyword("net5x")),
        "count": numbers.counted(lit(1234), "advert"), "one": numbers.counted(lit(1), "advert"), "lift": numbers.lift_note(lit(2.5)), "great lift": numbers.lift_note(lit(12.5)), "no lift": numbers.lift_note(lit(None).cast("double")),
        "level": evidence.level(lit(3), lit(1)), "tokens": F.array_join(text.tokens(lit("C++, -.NET- (CI/CD) Node.js.")), "|"), "clean": text.without(lit("a  x9 b"), ["x9"]),
    }
    return one.select(F.explode(F.array(*(F.struct(lit(k).alias("name"), v.cast("string").alias("value")) for k, v in values.items()))).alias("x")).select("x.*")


@query("select * from (values (1, 'A1', 'new title', 'Sales', 'Selling', '<p>new</p>', 7, true, 'Norway', 'Oslo, Norway'), (2, 'B2', 'kept title', 'Support', 'Helping', '<p>kept</p>', 8, true, 'Unknown', 'Unknown, Unknown'), (3, 'C3', 'only listed', null, null, null, 9, false, 'Unknown', 'Unknown, Unknown')) v(id, jobId, title, department, profession, html, posted, detail, countries, location)")
def joined_records(t):
    spark, texts = t.spark, "array<string>"
    summary = spark.createDataFrame([("1", "listed", "A1", "Sales", ["Norway, Oslo, Oslo"], ["Oslo, NO"], 7, 70), ("2", "listed two", None, None, None, None, 8, 80), ("3", "only listed", "C3", None, None, None, 9, 90)], f"id string, name string, displayJobId string, department string, locations {texts}, standardizedLocations {texts}, postedTs long, creationTs long")
    detail = spark.createDataFrame([("1", "new title", None, "Other", "u", "<p>new</p>", ["Selling", "second"], None, None, None, None, None, None, None)], schema.DETAIL)
    # what was known before of 2, whose index row still has its old name
    previous = spark.createDataFrame([("2", "B2", "kept title", "Support", "Helping", "<p>kept</p>", True)], "id string, jobId string, title string, department string, profession string, descriptionHtml string, hasDetail boolean")
    previous = previous.withColumns({k: F.lit(None).cast("string") for k in ("discipline", "roleType", "employmentType", "workSite", "travel", "url")}).withColumns({"locations": F.lit(None).cast(texts), "countryCodes": F.lit(None).cast(texts)})
    rows = classify.record(summary.withColumn("name", F.when(c("id") == "2", None).otherwise(c("name"))), detail, previous)
    places = F.when(F.size("locations") > 0, c("locations")).otherwise(F.array(F.lit("")))
    rows = rows.withColumn("p", F.get(F.transform(places, lambda x, i: text.place(x, F.get("countryCodes", i))), F.lit(0)))
    return rows.select(c("id").cast("int").alias("id"), "jobId", "title", "department", "profession", c("descriptionHtml").alias("html"), c("postedTs").cast("int").alias("posted"), c("hasDetail").alias("detail"), c("p.country").alias("countries"), text.city_label(c("p.city"), c("p.country")).alias("location"))


@query("select * from (values ('whole pass', '2'), ('ids', '1,2,3,4'), ('tolerated', '98'), ('last page', '1'), ('fingerprint', '1,10,2'), ('faults', '0')) v(name, value)")
def landed_index(t):
    kinds = "pass int, page int, again boolean, total long, sortBy string, positions array<struct<id:string,name:string>>"

    def made(rows):
        return t.spark.createDataFrame([(p, n, a, total, "timestamp", [(str(i), "x") for i in ids]) for p, n, a, total, ids in rows], kinds)

    good = [(2, 0, False, 4, [1, 2]), (2, 1, False, 4, [3, 4]), (2, 0, True, 4, [1, 2]), (2, 1, True, 4, [3, 4])]
    number, rows = landing.complete(made([(1, 0, False, 4, [1, 2]), (1, 1, False, 4, [2, 3]), *good]))
    many = made([(1, n, False, 100, [2 * n, 2 * n + 1]) for n in range(1, 50)])
    last = landing.by_id(landing.positions(made([(1, 0, False, 2, [7, 8]), (1, 1, False, 2, [8])]))).where("id = '8'")
    one = made([(1, 0, False, 3, [2, 10, 1])])
    parts = [
        t.spark.createDataFrame([("whole pass", str(number))], "name string, value string"),
        rows.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("value")).select(F.lit("ids").alias("name"), "value"),
        landing.tolerant(many, 50).agg(F.count("*").cast("string").alias("value")).select(F.lit("tolerated").alias("name"), "value"),
        last.select(F.lit("last page").alias("name"), c("page").cast("string").alias("value")),
        one.select(F.lit("fingerprint").alias("name"), landing.fingerprint().alias("value")),
        one.agg(F.count_if(landing.page_faults().isNotNull()).cast("string").alias("value")).select(F.lit("faults").alias("name"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out



@pytest.mark.parametrize("name", sorted(CASES))
def test_fixed_rows(spark, name):
    class Rows:
        pass

    Rows.spark = spark
    make, sql = CASES[name]
    found, out = make(Rows), duckdb.connect().execute(sql)
    columns = [d[0] for d in out.description]
    assert sorted(map(str, (tuple(r[k] for k in columns) for r in found.collect()))) == sorted(map(str, out.fetchall()))
