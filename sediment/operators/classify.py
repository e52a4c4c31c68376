"""The columns that are derived from a posting's texts, in one projection. Idempotent: stored texts give the same columns again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import keywords, rules, tables, text
from sediment.functions.patterns import java


def skills(strong: Column, qualifications: Column) -> Column:
    """Skills that the qualifications ask for; what open lists name doesn't count, but that there is one does. None without qualifications."""
    trimmed = qualifications
    for clause in tables.OPEN_LISTS:
        trimmed = F.regexp_replace(trimmed, java(clause), " ")

    def hits(t: Column) -> Column:
        def has(side: str, pattern: str) -> Column:
            return keywords.matches(t[side], pattern, t[f"{side}_lower"])

        return F.filter(F.array(*(F.when(has("full" if s in tables.OPEN_LIST_SKILLS else "cut", p), F.lit(s)) for s, _, p in tables.SKILLS)), lambda x: x.isNotNull())

    full, cut = F.concat_ws("\n", strong, qualifications), F.concat_ws("\n", strong, trimmed)
    texts = F.transform(F.array(F.struct(full.alias("full"), cut.alias("cut"))), lambda t: F.struct(t["full"].alias("full"), t["cut"].alias("cut"), F.lower(t["full"]).alias("full_lower"), F.lower(t["cut"]).alias("cut_lower")))
    return F.when(qualifications != "", F.get(F.transform(texts, hits), F.lit(0))).otherwise(F.array().cast("array<string>"))


def classified(postings: DataFrame, themes: dict[str, list[str]] = tables.THEMES, industries: dict[str, list[str]] = tables.INDUSTRIES) -> DataFrame:
    """postings with seniority, archetype, themes, industries, products, unit, solution areas, initiatives, skills, years, degree, overview and fingerprint.

    Texts are put in columns of their own first, so that each is made once.
    """
    out = postings.withColumn("_plain", text.plain_text(F.coalesce("descriptionHtml", F.lit(""))))
    out = out.withColumn("_clean", text.without(F.col("_plain"), tables.REMOVALS))
    out = out.withColumns({"_overview": text.overview(F.col("_clean")), "_asked": text.qualifications(F.col("_clean")), "_strong": F.concat_ws(" ", "title", "profession", "discipline", "department")})
    out = out.withColumn("_all", F.concat_ws("\n", "_strong", "_clean")).withColumn("_lower", F.lower("_all"))
    every = [w for topics in (themes, industries) for words in topics.values() for w in words]
    out = out.withColumns({f"_words_{n}": keywords.found(F.lower(F.coalesce(f"_{n}", F.lit(""))), every) for n in ("strong", "clean")})
    strong, title, everything, lower = F.col("_strong"), F.col("title"), F.col("_all"), F.col("_lower")
    unit, _ = rules.unit(strong, F.col("_overview"), F.col("department"), F.col("profession"), [(u, p, h) for u, _, p, h in tables.UNITS], tables.DEPARTMENTS, tables.PROFESSIONS)
    derived = {
        "seniority": rules.first_match(title, tables.SENIORITY, "Mid / Unspecified"),
        "archetype": rules.first_match(title, tables.ARCHETYPES, "other"),
        "themes": rules.of_topics(F.col("_words_strong"), F.col("_words_clean"), themes) if themes else F.array().cast("array<string>"),
        "industries": rules.of_topics(F.col("_words_strong"), F.col("_words_clean"), industries) if industries else F.array().cast("array<string>"),
        "products": rules.any_match(everything, tables.PRODUCTS, lower),
        "org": unit,
        "orgSource": rules.unit_source(F.col("org"), F.col("department"), F.col("profession"), tables.DEPARTMENTS, tables.PROFESSIONS),
        "solutionAreas": rules.any_match(everything, tables.SOLUTION_AREAS, lower),
        "initiatives": rules.any_match(everything, tables.INITIATIVES, lower),
        "skills": skills(strong, F.col("_asked")),
        "requiredYears": text.required_years(F.col("_asked")),
        "degree": rules.first_match(F.col("_asked"), tables.DEGREES, None),
        "hasQualifications": F.col("_asked") != "",
        "overview": text.short_overview(F.col("_plain")),
        "descriptionHash": text.fingerprint(F.col("_plain")),
    }
    for name, column in derived.items():
        out = out.withColumn(name, column)
    return out.drop("_plain", "_clean", "_overview", "_asked", "_strong", "_all", "_lower", "_words_strong", "_words_clean")


def band(seniority: Column) -> Column:
    return rules.member(seniority, tables.BANDS, "mid")


def function(profession: Column) -> Column:
    return rules.first_match(profession, tables.FUNCTIONS, "other")


def is_delivery(archetype: Column) -> Column:
    return archetype.isin(*tables.DELIVERY)


def is_demand(archetype: Column) -> Column:
    return archetype.isin(*tables.DEMAND)


def is_consulting(archetype: Column) -> Column:
    return archetype.isin(*tables.CONSULTING)


def is_senior(seniority: Column) -> Column:
    """Senior as an individual contributor."""
    return seniority.isin(*tables.SENIOR_PLUS)


def is_leader(seniority: Column) -> Column:
    return seniority.isin(*tables.LEADERSHIP)


def asks_for_ai(skills: Column) -> Column:
    """Whether one of the skills is of the stack of language models."""
    return F.arrays_overlap(F.coalesce(skills, F.array().cast("array<string>")), F.array(*map(F.lit, tables.AI_STACK)))


def parent(unit: Column) -> Column:
    """The division of a unit."""
    return rules.lookup(unit, {u: p for u, p, _, _ in tables.UNITS})


def record(summary: DataFrame, detail: DataFrame, previous: DataFrame) -> DataFrame:
    """One row for each listed summary: values of its detail, else its own, else what was known before. All three have id; texts that may come as arrays count by their first entry."""
    s, d, p = summary.alias("s"), detail.alias("d"), previous.alias("p")
    joined = s.join(d, F.col("s.id") == F.col("d.id"), "left").join(p, F.col("s.id") == F.col("p.id"), "left")

    def first(c: str) -> Column:
        return F.coalesce(F.get(f"d.{c}", F.lit(0)), F.col(f"p.{c}")).alias(c)

    return joined.select(
        F.col("s.id").alias("id"),
        F.coalesce("d.displayJobId", "s.displayJobId", "p.jobId").alias("jobId"),
        F.coalesce("d.name", "s.name", "p.title").alias("title"),
        F.coalesce("s.department", "d.department", "p.department").alias("department"),
        *(first(c) for c in ("profession", "discipline", "roleType", "employmentType", "workSite", "travel")),
        F.coalesce("d.publicUrl", "p.url").alias("url"),
        F.coalesce("d.locations", "s.locations", "p.locations").alias("locations"),
        F.coalesce("d.standardizedLocations", "s.standardizedLocations", "p.countryCodes").alias("countryCodes"),
        F.coalesce("d.jobDescription", "p.descriptionHtml").alias("descriptionHtml"),
        F.col("s.postedTs").alias("postedTs"),
        F.col("s.creationTs").alias("creationTs"),
        (F.col("d.id").isNotNull() | F.coalesce("p.hasDetail", F.lit(False))).alias("hasDetail"),
    )
