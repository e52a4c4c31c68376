"""Reports on a book of postings (columns as in sediment.schema.POSTING), put together from the operators.

Each report is a dict of long tables. Those that grow with the book are aggregates; what document() brings to the driver are
tables bounded by top-k, fixed lists, months or days. as_of is a timestamp column: the moment that ages and windows are counted from.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import dates, tables, text
from sediment.functions.numbers import pct, quotient, ratio
from sediment.operators import cells, classify, cohorts, evidence, ranking, series

NOT_STATED = "not_stated"
_NONE = "array<string>"
_AGES = [(7, "0-7 days"), (30, "8-30 days"), (60, "31-60 days"), (90, "61-90 days"), (180, "91-180 days")]
_YEARS = [(1, "0-1 years"), (3, "2-3 years"), (5, "4-5 years"), (8, "6-8 years")]


def is_open(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("status") == "open")


def _array(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(_NONE))


def _places() -> Column:
    some = F.when(F.size(_array("locations")) > 0, F.col("locations")).otherwise(F.array(F.lit("Unknown")))
    return F.transform(some, lambda x, i: text.place(x, F.get("countryCodes", i)))


def _countries() -> Column:
    return F.array_distinct(F.transform(_places(), lambda p: p["country"]))


def _posted() -> Column:
    return dates.moment(F.col("creationTs"))


def _now(rows: DataFrame, as_of: Column) -> DataFrame:
    """A frame of the one moment."""
    return rows.sparkSession.range(1).select(as_of.alias("now"))


def _labelled(dim: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(dim).alias("dim"), "*")


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


#: Columns of a posting that tables of the overview look at together.
_FACETS = {
    "work": ["profession", "discipline", "department"],
    "people": ["profession", "roleType", "employmentType", "seniority", "archetype"],
    "unit": ["org", "parent", "orgSource", "seniority"],
    "place": ["locations", "countryCodes"],
    "site": ["workSite", "workLocationOption", "travel"],
    "title": ["title"],
    "tags": ["products", "industries", "solutionAreas", "initiatives"],
    "themes": ["themes", "month"],
    "month": ["month", "org", "profession"],
    "day": ["day", "age"],
    "status": ["status", "daysOpen"],
}


def _facets(rows: DataFrame, as_of: Column) -> DataFrame:
    """The columns of _FACETS and whether a posting is open; what isn't open has status and daysOpen only. The month is its first day, and the order of tags is dropped."""
    is_open = F.coalesce(F.col("status") == "open", F.lit(False))
    made = {k: F.sort_array(_array(k)) for k in ("themes", "products", "industries", "solutionAreas", "initiatives")}
    made |= {"month": F.trunc(F.to_date(_posted()), "month"), "day": F.to_date(_posted()), "age": dates.age_days(_posted(), as_of)}
    names = dict.fromkeys(c for k, own in _FACETS.items() if k != "status" for c in own)
    return rows.select(is_open.alias("open"), *(F.when(is_open, made.get(c, F.col(c))).alias(c) for c in names), *_FACETS["status"])


def overview(postings: DataFrame, as_of: Column, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Totals, breakdowns, pairs of themes, cross tables, days and months of the open book.

    One pass over the postings counts those that are equal in each of some sets of columns; of these counts the cells of all tables
    are made and added up (operators.cells), and of the cells the tables.
    """
    rows = postings if "parent" in postings.columns else postings.withColumn("parent", classify.parent(F.col("org")))
    remote = F.coalesce(F.concat_ws(" ", "workSite", "workLocationOption").rlike("(?i)remote"), F.lit(False))
    scalars = {k: F.col(k) for k in ("profession", "discipline", "department", "roleType", "employmentType", "seniority", "workSite", "travel")}
    scalars |= {"archetype": ranking.stated(F.col("archetype"), "other"), "org": ranking.stated(F.col("org"), NOT_STATED), "division": F.when(F.col("org").isNull(), NOT_STATED).otherwise(F.coalesce("parent", "org"))}
    cities = F.transform(_places(), lambda p: text.city_label(p["city"], p["country"]))
    arrays = {"country": _countries(), "city": cities, "theme": F.col("themes"), "product": F.col("products"), "industry": F.col("industries"), "solutionArea": F.col("solutionAreas"), "initiative": F.col("initiatives"), "titleWord": text.title_words(F.col("title"))}
    conditions = {
        "multiLocation": F.size(_array("locations")) > 1,
        "remoteEligible": remote,
        "untagged": F.size("themes") == 0,
        "orgIdentified": F.col("org").isNotNull(),
        **{f"orgFrom_{s}": F.col("org").isNotNull() & (F.coalesce("orgSource", F.lit("self")) == s) for s in ("department", "profession", "self")},
    }
    crossed = {"profession by roleType": ("profession", "roleType"), "profession by seniority": ("profession", "seniority"), "org by seniority": ("org", "seniority")}
    series_of = {"theme": F.col("themes"), "org": F.array_compact(F.array("org")), "profession": F.array(ranking.stated(F.col("profession")))}
    month = dates.month_key(F.col("month"))

    def tally(*dims: str) -> list[Column]:
        return [cells.one("breakdown", F.lit(d), ranking.stated(scalars[d])) if d in scalars else cells.each_of("breakdown", d, arrays[d]) for d in dims]

    def marks(*keys: str) -> list[Column]:
        return [cells.one("meta", F.lit(k), where=F.coalesce(conditions[k], F.lit(False))) for k in keys]

    def cross(*keys: str) -> list[Column]:
        return [cells.one(k, *(ranking.stated(F.col(x)) for x in crossed[k]), where=F.col("org").isNotNull() if crossed[k][0] == "org" else None) for k in keys]

    def by_month(*keys: str) -> list[Column]:
        return [cells.each(f"month {k}", series_of[k], month) for k in keys]

    own = cells.of(
        work=tally("profession", "discipline", "department"),
        people=[*tally("roleType", "employmentType", "seniority", "archetype"), *cross("profession by roleType", "profession by seniority")],
        unit=[*tally("org", "division"), *marks(*(k for k in conditions if k.startswith("org"))), *cross("org by seniority")],
        place=[*tally("country", "city"), *marks("multiLocation")],
        site=[*tally("workSite", "travel"), *marks("remoteEligible")],
        title=tally("titleWord"),
        tags=tally("product", "industry", "solutionArea", "initiative"),
        themes=[*tally("theme"), *marks("untagged"), *by_month("theme"), cells.pairs("pair", F.col("themes"))],
        month=[*by_month("org", "profession"), cells.one("posted", month, where=F.col("month").isNotNull())],
        day=[cells.one("age", F.col("age"), where=F.col("age").isNotNull()), cells.one("day", F.col("day"), where=F.col("day").isNotNull())],
    )
    is_closed = F.col("status") == "closed"
    whole = cells.of(status=[cells.one("status", F.col("status")), cells.one("closing", F.lit("all"), F.col("daysOpen"), where=F.coalesce(is_closed, F.lit(False)) & F.col("daysOpen").isNotNull())])
    found = cells.counted(cells.grouped(_facets(rows, as_of), _FACETS, ["open"]), F.when(F.col("open"), own).otherwise(cells.none()), whole)

    aged = cells.table(found, "age", "days").withColumn("days", F.col("days").cast("long"))
    by_age = F.coalesce(*(F.when(F.col("days") <= bound, name) for bound, name in _AGES), F.lit("180+ days"))
    ages = aged.groupBy(by_age.alias("key")).agg(F.sum("n").alias("n")).select(F.lit("age").alias("dim"), "key", "n")
    status = cells.table(found, "status", "key")
    none = F.lit(0).cast("long")
    totals = status.agg(F.coalesce(F.sum(F.when(F.col("key") == "open", F.col("n"))), none).alias("open"), F.coalesce(F.sum(F.when(F.col("key") == "closed", F.col("n"))), none).alias("closed"), F.coalesce(F.sum("n"), none).alias("tracked"))
    marked = cells.table(found, "meta", "key").agg(*(F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), none).alias(k) for k in conditions))
    meta = totals.crossJoin(marked).crossJoin(aged.agg(F.coalesce(F.sum("n"), none).alias("aged"), F.coalesce(F.sum(F.col("n") * F.col("days")), none).alias("ageDays")))
    closing = cells.medians(cells.table(found, "closing", "key", "days"), "key", "days", upper=True).agg(F.max("median").alias("medianDaysToClose"))
    meta = meta.crossJoin(closing)
    meta = meta.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("n")) for c in meta.columns))).alias("x")).select("x.*")
    seniority = list(tables.SENIORITY_ORDER)
    grid = cells.last_months(cells.table(found, "posted", "month"))
    monthly = {k: cells.monthly(cells.table(found, f"month {k}", "key", "month"), grid, 8) for k in series_of}
    days = cells.table(found, "day", "day").withColumn("day", F.col("day").cast("date"))
    out = {
        "meta": meta,
        "breakdowns": cells.table(found, "breakdown", "dim", "key").unionByName(ages),
        "themePairs": cells.table(found, "pair", "a", "b").orderBy(F.col("n").desc(), "a", "b").limit(15),
        "crosstabs": _union(_labelled(k, cells.crosstab(cells.table(found, k, "row", "col"), ["Individual Contributor", "People Manager", ranking.UNSPECIFIED] if b == "roleType" else seniority, 12)) for k, (_, b) in crossed.items()),
        "trend": series.filled(days, 180),
        "timeline": _union(_labelled(k, m) for k, m in monthly.items()),
        "shift": _union(_labelled(k, series.share_shift(monthly[k])) for k in ("theme", "org")),
    }
    if runs is not None:
        out["runs"] = series.retained(runs, "startedAt", 30)
    return out


#: Columns of a posting that tables of the requirements look at together.
_ASKED = {"skills": ["skills", "month", "recent"], "bands": ["skills", "band"], "years": ["band", "month", "requiredYears", "degree"], "openList": ["openList"]}


def requirements(postings: DataFrame, as_of: Column, categories: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """What postings with qualifications ask for: skills, years, degrees, bands, months. categories: of skills, by default the rule table's.

    As in overview(), one pass counts equal rows, and all tables are made of cells; what states no qualifications counts for the coverage only.
    """
    category = {s: c for s, c, _ in tables.SKILLS} if categories is None else categories
    has = F.coalesce("hasQualifications", F.lit(False))
    listed = F.array(*map(F.lit, tables.OPEN_LIST_SKILLS))
    recent = F.coalesce(_posted() >= as_of - F.make_dt_interval(F.lit(90)), F.lit(False))
    made = {"skills": F.sort_array(F.array_except(_array("skills"), listed)), "openList": F.sort_array(F.array_intersect(_array("skills"), listed)), "band": classify.band(F.col("seniority"))}
    made |= {"month": F.trunc(F.to_date(_posted()), "month"), "recent": recent, "requiredYears": F.col("requiredYears"), "degree": F.col("degree")}
    rows = is_open(postings).select(has.alias("stated"), *(F.when(has, x).alias(k) for k, x in made.items()))

    table = F.create_map(*(F.lit(x) for pair in category.items() for x in pair)) if category else F.create_map().cast("map<string,string>")
    kinds = F.array_distinct(F.filter(F.transform("skills", lambda k: F.try_element_at(table, k)), lambda c: c.isNotNull()))
    asks_ai, month, band = F.coalesce(classify.asks_for_ai(F.col("skills")), F.lit(False)), dates.month_key(F.col("month")), F.col("band")
    dated, keyed = F.col("month").isNotNull(), F.size("skills") > 0
    own = cells.of(
        skills=[
            *(cells.each(k, x) for k, x in (("skill", F.col("skills")), ("category", kinds))),
            *(cells.each(f"month {k}", x, month) for k, x in (("skill", F.col("skills")), ("category", kinds))),
            cells.each("demand", F.col("skills"), F.col("recent")),
            cells.one("keyed", F.col("recent"), where=keyed),
            cells.one("ai", asks_ai, F.col("recent")),
            cells.one("market", month, F.lit("n"), where=dated),
            cells.one("market", month, F.lit("ai"), where=dated & asks_ai),
            cells.pairs("pair", F.col("skills")),
        ],
        bands=[cells.one("band", band), cells.each("gradient", kinds, band)],
        years=[
            cells.one("market", month, F.lit("degree"), where=dated & F.col("degree").isNotNull()),
            cells.one("degree", F.coalesce("degree", F.lit("Not stated"))),
            cells.one("years", band, F.col("requiredYears"), where=F.col("requiredYears").isNotNull()),
            cells.one("month years", month, F.col("requiredYears"), where=dated & F.col("requiredYears").isNotNull()),
        ],
        openList=[cells.each("openList", F.col("openList"))],
    )
    coverage = cells.of(openList=[cells.one("coverage", F.col("stated"))])
    found = cells.counted(cells.grouped(rows, _ASKED, ["stated"]), F.when(F.col("stated"), own).otherwise(cells.none()), coverage)

    def summed(where: Column | None = None) -> Column:
        return F.coalesce(F.sum("n" if where is None else F.when(where, F.col("n"))), F.lit(0).cast("long"))

    yes = F.lit("true")
    covered = cells.table(found, "coverage", "stated").agg(summed().alias("open"), summed(F.col("stated") == yes).alias("n"))
    total = covered.select(F.col("n").alias("total"))
    skills, kind = cells.table(found, "skill", "key"), cells.table(found, "category", "key")
    breadth = skills.agg(summed().alias("keys")).crossJoin(F.broadcast(total)).select(F.col("total").alias("n"), F.when(F.col("total") > 0, F.col("keys")).alias("keys"))
    years = cells.table(found, "years", "band", "years").withColumn("years", F.col("years").cast("int"))
    demand = cells.table(found, "demand", "key", "recent").groupBy("key").agg(summed().alias("total"), summed(F.col("recent") == yes).alias("recent"))
    keyed_rows = cells.table(found, "keyed", "recent").agg(summed().alias("all_n"), summed(F.col("recent") == yes).alias("recent_n"))
    is_ai, is_recent = F.col("ai") == yes, F.col("recent") == yes
    ai = cells.table(found, "ai", "ai", "recent").agg(summed().alias("n"), summed(is_ai).alias("ai"), summed(is_recent).alias("recent"), summed(is_ai & is_recent).alias("recent_ai"))
    base, latest = pct(F.col("ai"), F.col("n")), pct(F.col("recent_ai"), F.col("recent"))
    market = cells.table(found, "market", "month", "k").groupBy("month").agg(*(summed(F.col("k") == k).alias(k) for k in ("n", "ai", "degree"))).where(F.col("n") >= series.MARKET_LEAST)
    market = market.join(cells.medians(cells.table(found, "month years", "month", "years"), "month", "years").select("month", "median"), "month", "left")
    grid = cells.last_months(cells.table(found, "market", "month").select("month"))
    bands = cells.table(found, "band", "band").withColumnRenamed("n", "total")
    timelines = {k: cells.monthly(cells.table(found, f"month {k}", "key", "month"), grid, top) for k, top in (("skill", 8), ("category", None))}
    return {
        "coverage": covered.withColumn("share", quotient(F.col("n"), F.col("open"))),
        "breadth": breadth.withColumn("mean", quotient(F.col("keys"), F.col("n"))),
        "skills": ranking.with_share(skills, total),
        "categories": ranking.with_share(kind, total),
        "openList": ranking.with_share(cells.table(found, "openList", "key"), total),
        "years": cells.buckets(years, F.col("years"), _YEARS, "9+ years"),
        "bands": cells.medians(years, "band", "years").where(F.col("n") >= 5).withColumnRenamed("band", "key"),
        "degrees": ranking.in_order(cells.table(found, "degree", "key"), tables.DEGREE_ORDER),
        "demand": series.recency_of(demand, keyed_rows, 12),
        "aiStack": ai.select("*", base.alias("base_share"), latest.alias("recent_share"), F.when(base != 0, ratio(latest, base)).alias("index")),
        "pairs": cells.table(found, "pair", "a", "b").orderBy(F.col("n").desc(), "a", "b").limit(12),
        "gradient": cells.table(found, "gradient", "key", "band").join(bands, "band").select("key", "band", "n", quotient(F.col("n"), F.col("total")).alias("share")),
        "market": market.join(F.broadcast(grid.select("month")), "month"),
        "timeline": _union(_labelled(k, t) for k, t in timelines.items()),
    }


def cohort(postings: DataFrame, members: list[str], as_of: Column, mention: str | None = None) -> dict[str, DataFrame]:
    """The postings of some units against the rest of the open book. mention: a pattern that speaks of the cohort, looked for in what others write (descriptionHtml)."""
    rows = is_open(postings)
    inside = cohorts.inside(F.col("org"), members)
    shape = ranking.stated(F.col("archetype"), "other")
    dims = {"org": (F.array_compact(F.array("org")), 1), "industry": (_array("industries"), 1), "archetype": (F.array(shape), 1), "product": (_array("products"), 3), "theme": (_array("themes"), 3), "initiative": (_array("initiatives"), 2), "solutionArea": (_array("solutionAreas"), 2)}
    dims |= {"seniority": (F.array("seniority"), 1), "country": (_countries(), 1), "travel": (F.array(ranking.stated(F.col("travel"))), 1)}
    own = rows.where(inside)
    windows = {d: series.newness(rows, _posted(), inside, _now(rows, as_of), d).withColumn("days", F.lit(d)) for d in (30, 60, 90)}
    in_group = F.when(inside, "cohort").otherwise(F.coalesce("parent", F.lit("none"))) if "parent" in rows.columns else F.when(inside, "cohort").otherwise(F.coalesce(classify.parent(F.col("org")), F.lit("none")))
    role, travels = F.col("roleType").isin("People Manager", "Individual Contributor"), F.coalesce(~F.col("travel").rlike("(?i)unspecified"), F.lit(False))
    measures: dict[str, tuple[Column, Column | None]] = {
        "industry": (F.size(_array("industries")) > 0, None),
        "manager": (F.col("roleType") == "People Manager", role),
        "travel": (F.col("travel").rlike("^(25|50|75)"), travels),
        "agentic": (F.array_contains(_array("initiatives"), "agentic"), None),
        "senior": (classify.is_senior(F.col("seniority")), None),
        "delivery": (classify.is_delivery(shape), None),
        "consulting": (classify.is_consulting(shape), None),
        "selling": (classify.is_demand(shape), None),
    }
    monthly = {"org": F.array_compact(F.array("org")), "industry": _array("industries"), "archetype": F.array(shape)}
    out = {
        "compared": _union(_labelled(d, cohorts.compare(rows, inside, keys, least)) for d, (keys, least) in dims.items()),
        "shape": own.agg(F.count("*").alias("n"), F.count_if(classify.is_delivery(shape)).alias("delivery"), F.count_if(classify.is_demand(shape)).alias("demand"), F.count_if(classify.is_leader(F.col("seniority"))).alias("leaders")).withColumn("delivery_to_demand", ratio(F.col("delivery"), F.col("demand"))),
        "newness": _union(windows.values()),
        "momentum": _union(_labelled(d, series.recency(own, _posted(), k, _now(rows, as_of))) for d, k in (("industry", _array("industries")), ("archetype", F.array(shape)))),
        "timeline": _union(_labelled(d, series.monthly(own, _posted(), k)) for d, k in monthly.items()),
        "profile": ranking.profile(rows, in_group, measures),
        "pipeline": own.orderBy(F.coalesce("creationTs", F.lit(0)).desc(), "id").limit(24).select("id", "title", "org", "archetype", "seniority", "creationTs", "url"),
    }
    if mention is not None:
        others = rows.where(~inside)
        speaks = F.coalesce(F.col("descriptionHtml").rlike(f"(?i){mention}"), F.lit(False))
        out["surface"] = cohorts.mentions(rows, inside, mention, "descriptionHtml").agg(F.count("*").alias("n"))
        out["surfaceProfessions"] = cohorts.compare(others, speaks, F.array(ranking.stated(F.col("profession"))), 2)
    return out


def brief(postings: DataFrame, as_of: Column, days: DataFrame | None = None, together: tuple[str, ...] = ("ai_copilot", "datacenter", "silicon")) -> dict[str, DataFrame]:
    """Leading figures of the open book: the mix of functions, how work is done, what rises and cools. days: (date, total, added, removed) of the history; together: themes whose union counts."""
    rows = is_open(postings)
    mix = ranking.with_share(ranking.tally(rows, classify.function(F.col("profession"))))
    site = F.col("workSite")
    kpis = ranking.conditional(
        rows,
        {
            **{f: classify.function(F.col("profession")) == f for f in ("build", "capacity", "gtm", "run")},
            "leadership": classify.is_leader(F.col("seniority")),
            "early": F.col("seniority").isin("Intern / University", "Associate / Entry"),
            "managers": F.col("roleType") == "People Manager",
            "contributors": F.col("roleType") == "Individual Contributor",
            "office": F.coalesce(site.rlike("(?i)^[3-5] days|fully on-site"), F.lit(False)),
            "remote": F.coalesce(site.rlike("(?i)remote"), F.lit(False)),
            "site_stated": F.coalesce(site, F.lit("")) != "",
            "posted30": F.coalesce(_posted() >= as_of - F.make_dt_interval(F.lit(30)), F.lit(False)),
            "together": F.arrays_overlap(_array("themes"), F.array(*map(F.lit, together))),
        },
    )
    kpis = kpis.withColumns({"build_to_sell": ratio(F.col("build"), F.col("gtm")), "remote_share": pct(F.col("remote"), F.col("site_stated")), "together_share": pct(F.col("together"), F.col("n"))})
    skew = {"theme": (rows, _array("themes"), 25), "country": (rows, _countries(), 25), "org": (rows.where("org is not null"), F.array("org"), 20)}
    skews = {d: series.recency(r, _posted(), k, _now(rows, as_of), 30, least) for d, (r, k, least) in skew.items()}
    out = {"functions": mix, "kpis": kpis, "skew": _union(_labelled(d, s) for d, s in skews.items()), "rising": series.rising(skews["theme"]), "cooling": series.cooling(skews["theme"])}
    if days is not None:
        out["net"] = series.net_change(days)
    return out


def strategy(postings: DataFrame, unit: str, against: str) -> dict[str, DataFrame]:
    """Evidence for each signal in the passages of a unit's postings, and of another's beside it. The postings are read once for both."""
    plain = text.plain_text(F.coalesce("descriptionHtml", F.lit("")))
    whole = F.when(F.coalesce("descriptionHtml", F.lit("")) != "", text.sections(plain)).otherwise(text.excerpt(F.coalesce("overview", F.lit(""))))
    rows = is_open(postings).where(F.col("org").isin(unit, against)).select("id", "org", text.passages(whole).alias("parts"))
    counts = evidence.counted(rows, F.col("parts"), ("org",))
    return {name: evidence.summary(counts.where(F.col("org") == org)) for name, org in (("evidence", unit), ("comparison", against))}


def change_log(changes: DataFrame, run: str = "run", opened: int = 8, closed: int = 6) -> DataFrame:
    """(run, added, removed, updated, opened, closed): of each run its counts and the first titles, by id. changes: run, id, kind, title."""
    counts = changes.groupBy(run).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "updated")))
    first = series.recent_changes(changes.where(F.col("kind").isin("added", "removed")), run, "id", 1 << 30, max(opened, closed))

    def titles(kind: str, k: int) -> Column:
        return F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "title")))), 1, k), lambda x: x["title"])

    shown = first.groupBy(run).agg(titles("added", opened).alias("opened"), titles("removed", closed).alias("closed"))
    none = F.array().cast(_NONE)
    return counts.join(shown, run, "left").withColumns({"opened": F.coalesce("opened", none), "closed": F.coalesce("closed", none)})


def document(report: dict[str, DataFrame], most: int = 1000) -> dict[str, list[dict]]:
    """A report as plain lists for a JSON document; tables of more rows than most raise."""
    out = {}
    for name, df in report.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return out
