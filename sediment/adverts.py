"""Queries of the classifiers, sections, evidence, records and scalar functions over the driver's tables, and their SQL.

Adverts are played by documents: a document's whole text stands between phrases that are dealt to it by its id. The SQL is made of the same rule tables, whose
patterns are fixed values, in the dialect of another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import dates, numbers, patterns, tables, text
from sediment.operators import classify, evidence, reports
from sediment.registry import Tables, query

c = F.col

TITLES = ["Senior Software Engineer", "Principal Consultant", "Partner Director of Sales", "Executive Assistant", "Intern, Digital Sales", "Manager of Engagement", "Lead Cloud Solution Architect", "Junior Data Scientist", "Corporate Vice President", "General Manager", "Technical Fellow", "Customer Success Account Manager", "Technical Program Manager", "Support Engineer", "Security Analyst, Xbox", "Staff Quantum Researcher", "Team Coordinator"]
PROFESSIONS = ["Software Engineering", "Technology Consulting", "Sales", "", "Digital Sales and Solutions", "Finance", "Data Center Operations"]
DEPARTMENTS = ["Technology Consulting", "", "Account Management", "unknown", "CO+I", " Cloud Solution Architecture ", "Partner Solution Sales", "Data & AI", "Azure Data", "Consulting Project Management", "Legal"]
OVERVIEWS = [
    "Join the Cloud Operations + Innovation team. We run Azure datacenters and critical environment work.", "Deliver agentic solutions for banking and insurance customers in production, and measure business outcomes.", "The Xbox team sells games on Windows 11, not windows of opportunity.",
    "We mention the Customer Success Unit only.", "Welcome to the Microsoft Digital organisation. Power BI, Power Apps and Microsoft Fabric are in use.", "Here at Industry Solutions Delivery we build reusable accelerators for public sector and government agencies.", "ISD is hiring. Frontier Firm and frontier AI, sovereign cloud, SFI and sfi.",
    "Our CE&S group (the first) drives adoption of Copilot across the whole company.", "Data residency and data sovereignty matter. We never deploy AI in production here.", "Semiconductor chip design with FPGA, RTL and firmware; thermal limits of a SoC.", "Nothing of the kind is said here at all, whatever you read in it.",
    "Quota, pipeline and territory. Renewal of every deal with the partner ecosystem.", "Machine learning, deep learning and computer vision with PyTorch. .NET and ASP.NET too.",
]
DUTIES = ["Deliver measurable business outcomes for customers.", "You will not deploy AI to production here at all. Accelerate adoption across the whole group.", "Build reusable accelerators. Implement governance, security and responsible AI controls!", "Build things.", "Improve time to value and drive consumption of what was bought? Yes, all of it.", "Operationalise machine learning that was in production before. ROI is measured, and return on investment realised."]
ASKED = ["Bachelor's degree. 5+ years of Python, Kubernetes and distributed systems.", "Master's degree or 8 years of experience. Security clearance. Java, not JavaScript alone.", "PhD. 12 years or 3 years.", "Languages including, but not limited to, C#, Java or Python. PMP.", "Experience in Terraform, Ansible or related fields; SQL and Spark. 30 years, 1 year.", "degree in Rust, Linux and statistics AND 2 yearsome things; CISSP", "Microsoft is an equal opportunity employer. 7 years of Python.", "Prompt engineering, embeddings and AI agents\nMicrosoft Cloud Background Check: 4 years."]


def _piece(values: list[str], by: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.floor(c("doc_id") / by) % len(values)).cast("int"))


def adverts(t: Tables) -> DataFrame:
    """(id, title, profession, discipline, department, descriptionHtml). Every fifth has no qualifications."""
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    asked = F.when(c("doc_id") % 5 != 0, F.concat(F.lit("<p>Qualifications</p><p>"), _piece(ASKED, 1), F.lit(" "), _piece(ASKED, 13), F.lit("</p>"))).otherwise("")
    html = F.concat(F.lit("<p>Overview</p><p>"), _piece(OVERVIEWS, 1), F.lit(" "), _piece(OVERVIEWS, 17), F.lit("</p><p>"), raw, F.lit("</p><p>Responsibilities</p><p>"), _piece(DUTIES, 1), F.lit(" "), _piece(DUTIES, 11), F.lit("</p>"), asked)
    return t.documents.where("doc_id is not null").select(c("doc_id").alias("id"), _piece(TITLES, 1).alias("title"), _piece(PROFESSIONS, 3).alias("profession"), _piece(PROFESSIONS, 5).alias("discipline"), _piece(DEPARTMENTS, 1).alias("department"), html.alias("descriptionHtml"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _deal(values: list[str], by: int) -> str:
    return f"[{', '.join(map(_text, values))}][1 + (doc_id // {by}) % {len(values)}]"


def re2(pattern: str) -> str:
    """A pattern of the rule tables for RE2: the wider white space, no nested classes, an end that is the text's, and a consumed character in place of a negative look-ahead."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r"\s\x{a0}\x{feff}" if inside else r"[\s\x{a0}\x{feff}]")
        elif two[0] == "\\":
            out.append(two)
        elif pattern.startswith("(?!", i):
            end = pattern.index(")", i)
            word = pattern[i + 3 : end]
            out.append("(?:" + "|".join(f"{word[:k]}(?:[^{word[k]}]|\\z)" for k in range(len(word))) + ")")
            i = end + 1
            continue
        else:
            out.append({"[": r"\["}.get(pattern[i], pattern[i]) if inside else {"$": r"\z"}.get(pattern[i], pattern[i]))
            inside = pattern[i] != "]" if inside else pattern[i] == "["
            i += 1
            continue
        i += 2
    return "".join(out)


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_text('(?i)' + re2(pattern))})"


def _first(x: str, rule_table: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {_has(x, p)} then {_text(label)}" for label, p in rule_table) + f" else {default} end"


def _any(pairs: list[tuple[str, str]]) -> str:
    """Labels whose condition holds, joined."""
    return "array_to_string(list_filter([" + ", ".join(f"case when {test} then {_text(label)} end" for label, test in pairs) + "], lambda x: x is not null), ',')"


def _cut(x: str, removal: str) -> str:
    """A removal, whose look-ahead is kept as a group."""
    own = re.sub(r"\(\?=(.*)\)$", r"(\1)", removal)
    return f"regexp_replace({x}, {_text(own)}, {_text(' ' + chr(92) + '1') if own != removal else _text(' ')}, 'g')"


_SPACE = r"[\s\x{a0}\x{feff}]"


def _trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _squeezed(x: str) -> str:
    return _trimmed(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _plain(x: str) -> str:
    for pattern, by in tables.MARKUP:
        x = f"regexp_replace({x}, {_text(pattern)}, {_text(by)}, 'g')"
    return _squeezed(x)


def _clean(x: str) -> str:
    for removal in tables.REMOVALS:
        x = _cut(x, removal)
    return _squeezed(x)


def _between(heading: str, ends: str, otherwise: str, size: int) -> str:
    body = f"regexp_extract(clean, {_text('(?i)' + re2(heading + chr(92) + 's*' + chr(92) + 'n+'))} || '([\\s\\S]*?)' || {_text('(?:' + chr(92) + 'n' + _SPACE + '*(?:' + ends + ')' + chr(92) + 'b|' + chr(92) + 'z)')}, 1)"
    return f"substring(case when {_has('clean', heading + chr(92) + 's*' + chr(92) + 'n')} then {body} else {otherwise} end, 1, {size})"


_MADE = f"""made as (select doc_id as id, {_deal(TITLES, 1)} as title, {_deal(PROFESSIONS, 3)} as profession, {_deal(PROFESSIONS, 5)} as discipline, {_deal(DEPARTMENTS, 1)} as department,
  '<p>Overview</p><p>' || {_deal(OVERVIEWS, 1)} || ' ' || {_deal(OVERVIEWS, 17)} || '</p><p>' || regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g') || '</p><p>Responsibilities</p><p>' || {_deal(DUTIES, 1)} || ' ' || {_deal(DUTIES, 11)} || '</p>'
  || case when doc_id % 5 <> 0 then '<p>Qualifications</p><p>' || {_deal(ASKED, 1)} || ' ' || {_deal(ASKED, 13)} || '</p>' else '' end as html from documents where doc_id is not null),
plained as materialized (select *, {_plain("html")} as plain, concat_ws(' ', title, profession, discipline, department) as strong from made),
cleaned as materialized (select *, {_clean("plain")} as clean from plained),
parted as materialized (select *, strong || chr(10) || clean as everything,
  {_between("Overview", tables.OVERVIEW_ENDS, "substring(clean, 1, 2500)", 4000)} as overview,
  {_between(tables.QUALIFICATIONS, tables.QUALIFICATIONS_ENDS, "''", 6000)} as asked from cleaned)"""


def _unit_names(high: bool) -> str:
    own = "strong || chr(10) || overview"
    named = [f"when {_has(own, f'{tables.OWN_BEFORE}(?:{p})')} or {_has(own, f'(?:{p}){tables.OWN_BEHIND}')} then {_text(u)}" for u, _, p, h in tables.UNITS if h is high]
    return "case " + " ".join(named) + " end"


def _looked_up(x: str, table: dict[str, str]) -> str:
    return f"case lower(trim({x})) " + " ".join(f"when {_text(k)} then {_text(v)}" for k, v in table.items()) + " end"


def _open_lists_cut(x: str) -> str:
    for clause in tables.OPEN_LISTS:
        x = _cut(x, "(?i)" + re2(clause))
    return x


_SKILLED = _any([(s, _has("strong || chr(10) || " + ("asked" if s in tables.OPEN_LIST_SKILLS else "trimmed"), p)) for s, _, p in tables.SKILLS])


@query(
    f"""with {_MADE}, named as materialized (select *, {_unit_names(True)} as high, {_looked_up("department", tables.DEPARTMENTS)} as by_department, {_looked_up("profession", tables.PROFESSIONS)} as by_profession, {_unit_names(False)} as low, {_open_lists_cut("asked")} as trimmed from parted),
    found as (select *, coalesce(high, by_department, by_profession, low) as org from named)
    select id, {_first("title", tables.SENIORITY, "'Mid / Unspecified'")} as seniority, {_first("title", tables.ARCHETYPES, "'other'")} as archetype, org,
    case when org is null then null when org = by_department then 'department' when org = by_profession then 'profession' else 'self' end as source,
    {_any([(k, _has("everything", p)) for k, p in tables.PRODUCTS])} as products, {_any([(k, _has("everything", p)) for k, p in tables.SOLUTION_AREAS])} as areas, {_any([(k, _has("everything", p)) for k, p in tables.INITIATIVES])} as initiatives,
    case when asked = '' then '' else {_SKILLED} end as skills,
    list_min(list_filter(list_transform(regexp_extract_all(asked, '(?i)([0-9]{{1,2}})\\+?\\s*years?(?:[^A-Za-z0-9_]|\\z)', 1), lambda x: x::integer), lambda x: x between 1 and 20)) as years,
    {_first("asked", tables.DEGREES, "null")} as degree, asked <> '' as asks, {_first("profession", tables.FUNCTIONS, "'other'")} as function,
    case {" ".join(f"when seniority in ({', '.join(map(_text, own))}) then {_text(b)}" for b, own in tables.BANDS)} else 'mid' end as band from found"""
)
def classified_postings(t: Tables) -> DataFrame:
    """Classes, skills, years and units of all adverts."""
    out = classify.classified(adverts(t), {}, {})
    joined = [F.array_join(c(k), ",").alias(n) for k, n in (("products", "products"), ("solutionAreas", "areas"), ("initiatives", "initiatives"), ("skills", "skills"))]
    return out.select("id", "seniority", "archetype", "org", c("orgSource").alias("source"), *joined, c("requiredYears").alias("years"), "degree", c("hasQualifications").alias("asks"), classify.function(c("profession")).alias("function"), classify.band(c("seniority")).alias("band"))


def _two_tier(words: list[str]) -> str:
    hits = " + ".join(f"regexp_matches(body, {_text(patterns.keyword(w))})::integer" for w in words)
    return f"(regexp_matches(lower(strong), {_text(patterns.any_keyword(words))}) or {hits} >= 2)"


@query(f"with {_MADE}, lowered as materialized (select id, strong, lower(clean) as body from cleaned) select id, {_any([(k, _two_tier(w)) for k, w in tables.THEMES.items()])} as themes, {_any([(k, _two_tier(w)) for k, w in tables.INDUSTRIES.items()])} as industries from lowered")
def classified_topics(t: Tables) -> DataFrame:
    """Themes and industries of all adverts."""
    return classify.classified(adverts(t)).select("id", F.array_join("themes", ",").alias("themes"), F.array_join("industries", ",").alias("industries"))


_SHORT = f"""substring({_trimmed(f"regexp_replace(case when regexp_extract(plain, '(?i)Overview{_SPACE}*\\n+([\\s\\S]{{40,900}}?)(?:\\n{_SPACE}*(?:{tables.SHORT_OVERVIEW_ENDS})\\b|\\z)', 1) <> '' then regexp_extract(plain, '(?i)Overview{_SPACE}*\\n+([\\s\\S]{{40,900}}?)(?:\\n{_SPACE}*(?:{tables.SHORT_OVERVIEW_ENDS})\\b|\\z)', 1) else substring(plain, 1, 600) end, '{_SPACE}+', ' ', 'g')")}, 1, 700)"""


@query(f"with {_MADE} select id, substr(sha1(clean), 1, 16) as clean, substr(sha1(overview), 1, 16) as overview, substr(sha1(asked), 1, 16) as asked, {_SHORT} as short from parted")
def advert_sections(t: Tables) -> DataFrame:
    """Texts without legal passages, their overview and qualifications (by their hashes), and the short overview."""
    plain = adverts(t).select("id", text.plain_text(c("descriptionHtml")).alias("plain")).withColumn("clean", text.without(c("plain"), tables.REMOVALS))
    prints = [text.fingerprint(x).alias(n) for n, x in (("clean", c("clean")), ("overview", text.overview(c("clean"))), ("asked", text.qualifications(c("clean"))))]
    return plain.select("id", *prints, text.short_overview(c("plain")).alias("short"))


def _signal(name: str, topic: str, action: str) -> str:
    return f"select id, {_text(name)} as signal, section, excerpt, k, i from lines where {_has('excerpt', topic)} and {_has('excerpt', action)} and not {_has('excerpt', tables.NEGATION)}"


_EVIDENCE = f"""{_MADE}, marked as (select id, string_split(regexp_replace(plain, {_text(f"(?im)^[ {chr(92)}t]*({tables.HEADINGS})[ {chr(92)}t]*:?[ {chr(92)}t]*{chr(92)}r?$")}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) as parts from plained),
secs as (select id, k, parts[2 * k] as section, parts[2 * k + 1] as body from (select id, parts, unnest(range(1, 1 + len(parts) // 2)) as k from marked)),
cuts as (select id, k, section, string_split_regex(regexp_replace(body, '([.!?]){_SPACE}+', '\\1' || chr(10), 'g'), '\\n+') as own from secs where lower(section) in ('overview', 'responsibilities')),
lines as materialized (select * from (select id, k, i, section, {_trimmed(f"regexp_replace(line, '{_SPACE}+', ' ', 'g')")} as excerpt from (select id, k, section, unnest(own) as line, unnest(range(len(own))) as i from cuts)) where length(excerpt) >= 25),
found as materialized (select id, signal, section, excerpt from ({" union all ".join(_signal(*s) for s in tables.SIGNALS)}) qualify row_number() over (partition by id, signal order by k, i) = 1)"""


def _passages(t: Tables) -> DataFrame:
    return adverts(t).select("id", text.passages(text.sections(text.plain_text(c("descriptionHtml")))).alias("parts"))


@query(f"with {_EVIDENCE} select * from found")
def passages_evidence(t: Tables) -> DataFrame:
    """The first passage of each advert for each signal."""
    rows = _passages(t)
    return evidence.evidence(rows, c("parts")).drop("parts")


def _summed(found: str, lines: str) -> str:
    """evidence.summary() of the rows of found; lines: those that can be read."""
    percent = f"coalesce(n, 0)::double / nullif((select count(distinct id) from {lines}), 0) * 100"
    return f"""select ordinal, signal, coalesce(n, 0)::bigint as n, {_fixed(percent, 1)} as share, coalesce(passages, 0)::bigint as passages,
      case when n is null then 'Not observed' when n = 1 then 'One advert' when passages = 1 then 'Repeated wording' else 'Multiple passages' end as level, ids
      from (select unnest([{", ".join(_text(s[0]) for s in tables.SIGNALS)}]) as signal, unnest(range({len(tables.SIGNALS)}))::integer as ordinal) left join (
        select signal, sum(n)::bigint as n, count(*) as passages, string_agg(one[1]::varchar, ',' order by one) filter (k <= 3) as ids from (
          select *, row_number() over (partition by signal order by one) as k from (
            select signal, trim(regexp_replace(lower(excerpt), '[^A-Za-z0-9_]+', ' ', 'g')) as words, count(*) as n, min((id, excerpt)) as one from {found} group by 1, 2)) group by 1) using (signal)"""


def _fixed(x: str, digits: int) -> str:
    return f"case when ({x}) * {2 ** (digits + 1)} = floor(({x}) * {2 ** (digits + 1)}) then round({x}, {digits}) else format('{{:.{digits}f}}', {x})::double end"


def _ids() -> Column:
    return F.array_join(F.transform("excerpts", lambda x: x["id"].cast("string")), ",").alias("ids")


@query(f"with {_EVIDENCE} {_summed('found', 'lines')}")
def evidence_summary(t: Tables) -> DataFrame:
    """How many adverts show each signal, in how many wordings, and whose they are."""
    return evidence.summary(evidence.counted(_passages(t), c("parts"))).withColumn("ids", _ids()).drop("excerpts")


#: Every third advert is a unit's, every third another's; of the rest some are closed and some have no text.
_UNIT_OF = "case id % 3 when 0 then 'isd' when 1 then 'csu' end"


def _own(name: str, unit: str) -> str:
    live = f"id % 3 = {0 if unit == 'isd' else 1} and id % 5 <> 4"
    return f"select '{name}' as cohort, * from ({_summed(f'(select * from found where {live})', f'(select * from lines where {live})')})"


@query(f"with {_EVIDENCE} {_own('evidence', 'isd')} union all {_own('comparison', 'csu')} union all select 'unreadable', unnest(range({len(tables.SIGNALS)}))::integer, unnest([{', '.join(_text(s[0]) for s in tables.SIGNALS)}]), 0, null, 0, 'Not observed', null")
def strategy_evidence(t: Tables) -> DataFrame:
    """Evidence of a unit beside another's, and of one that has no texts, whose shares are null."""
    rows = adverts(t).select("id", "descriptionHtml", F.lit(None).cast("string").alias("overview"), F.expr(_UNIT_OF).alias("org"), F.when(c("id") % 5 == 4, "closed").otherwise("open").alias("status"))
    mute = rows.select("id", F.lit("").alias("descriptionHtml"), "overview", F.lit("mute").alias("org"), F.lit("open").alias("status"))
    found, none = reports.strategy(rows, "isd", "csu"), reports.strategy(mute, "mute", "none")
    parts = [("evidence", found["evidence"]), ("comparison", found["comparison"]), ("unreadable", none["evidence"])]
    out = [df.select(F.lit(name).alias("cohort"), "ordinal", "signal", "n", "share", "passages", "level", _ids()) for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_PLACES = """where_ as (select c_custkey as id, case c_custkey % 6 when 0 then n_name || ', ' || r_name || ' , ' || c_name when 1 then c_name || ', ' || n_name when 2 then n_name when 3 then '' when 4 then c_name || ', UK' else 'USA, ' || r_name || ', Any, ' || c_name end as place,
  case c_custkey % 4 when 0 then c_name || ', N' || n_nationkey when 1 then null when 2 then 'N' || n_nationkey || ', ' else '' end as code from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
_PARTS = "list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(
    f"""with {_PLACES}, cut as (select id, {_PARTS.format(x="place")} as p, {_PARTS.format(x="code")} as q from where_),
    named as (select *, case len(p) when 0 then 'Unknown' when 2 then p[2] else p[1] end as raw from cut)
    select id, case when len(p) = 0 then 'Unknown' when len(p) >= 3 then p[-1] else p[1] end as city, case raw when 'USA' then 'United States' when 'UK' then 'United Kingdom' else raw end as country, case when len(p) > 0 then q[-1] end as code from named"""
)
def parse_location(t: Tables) -> DataFrame:
    """City, country and code of customers' places, written in six ways."""
    k, n = c("c_custkey"), F.concat(F.lit("N"), c("n_nationkey"))
    place = F.when(k % 6 == 0, F.concat("n_name", F.lit(", "), "r_name", F.lit(" , "), "c_name")).when(k % 6 == 1, F.concat("c_name", F.lit(", "), "n_name")).when(k % 6 == 2, c("n_name")).when(k % 6 == 3, "").when(k % 6 == 4, F.concat("c_name", F.lit(", UK"))).otherwise(F.concat(F.lit("USA, "), "r_name", F.lit(", Any, "), "c_name"))
    code = F.when(k % 4 == 0, F.concat("c_name", F.lit(", "), n)).when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, F.concat(n, F.lit(", "))).otherwise("")
    rows = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return rows.select(k.alias("id"), text.place(place, code).alias("p")).select("id", "p.*")


_SHARE, _LIFT = "p_size::double / nullif(p_partkey % 4, 0) * 100", "p_retailprice / 300"


@query(
    f"""select p_partkey as id, {_fixed(_SHARE, 1)} as share, coalesce({_fixed("p_size::double / nullif(p_partkey % 3, 0) * 100", 1)}, 0) as pct, {_fixed("p_retailprice / nullif(p_partkey % 5, 0)", 2)} as ratio,
    case p_partkey % 100 when 0 then 'today' when 1 then 'yesterday' else case when p_partkey % 100 < 60 then (p_partkey % 100) || ' days ago' else ((p_partkey % 100) // 30) || ' months ago' end end as ago,
    case p_partkey % 3 when 0 then p_type || ' — multiple sites' when 1 then p_type || ' — multiple sites' else p_name || ', ' || p_type end as city,
    p_name || ' (not ABC)' as label, p_name || ' of' as unit, regexp_replace(lower(p_name), ' +', ' ', 'g') || ' ' || replace(lower(p_brand), '#', ' ') as normalised,
    regexp_matches(p_name, '(^|[^a-z0-9])red([^a-z0-9]|$)') as keyword, format('{{:,}}', p_size * 977) || case when p_size * 977 = 1 then ' advert' else ' adverts' end as counted,
    case when {_LIFT} >= 10 then floor({_LIFT} + 0.5)::bigint::varchar else format('{{:.1f}}', {_fixed(_LIFT, 1)}) end || '×' as lift,
    case when p_size % 4 = 0 then 'Not observed' when p_size % 4 = 1 then 'One advert' when p_size % 2 + 1 = 1 then 'Repeated wording' else 'Multiple passages' end as level,
    replace(lower(p_name), ' ', '|') || '|c++|net|ci/cd|' || lower(p_brand) as tokens, replace(p_name, ' ', '') as clean, p_name like '% %' and p_name not like 'new %' as content from part"""
)
def scalar_functions(t: Tables) -> DataFrame:
    """Figures and labels of parts by each scalar function."""
    k, size, lit = c("p_partkey"), c("p_size"), F.lit
    values = {
        "share": numbers.share(size, k % 4), "pct": numbers.pct(size, k % 3), "ratio": numbers.ratio(c("p_retailprice"), k % 5), "ago": dates.relative(k % 100),
        "city": text.city_label(F.when(k % 3 == 0, "Multiple Locations").when(k % 3 == 2, c("p_name")), c("p_type")), "label": text.short_label(F.concat("p_name", lit(" (ABC) (not ABC)"))), "unit": text.short_unit(F.concat("p_name", lit(" of (not ABC)"))),
        "normalised": text.normalised(F.concat(lit("  "), F.upper("p_name"), lit(", "), "p_brand", lit("! "))), "keyword": c("p_name").rlike(patterns.keyword("Red")), "counted": numbers.counted(size * 977, "advert"), "lift": numbers.lift_note(c("p_retailprice") / 300),
        "level": evidence.level(size % 4, size % 2 + 1), "tokens": F.array_join(text.tokens(F.concat("p_name", lit(" C++, -.NET- (CI/CD) "), "p_brand")), "|"), "clean": F.regexp_replace(text.without(c("p_name"), [r"\s"]), " ", ""),
        "content": F.exists(text.terms(c("p_name")), lambda w: w.contains(" ")),
    }
    return t.part.select(k.alias("id"), *(v.alias(n) for n, v in values.items()))


@query(
    """select o_orderkey::varchar as id, coalesce(case when d and o_orderkey % 3 = 0 then 'D' || o_orderkey end, case when o_orderkey % 4 <> 0 then 'S' || o_orderkey end, case when p then 'P' || o_orderkey end) as jobId,
    coalesce(case when d then 'detail ' || o_orderpriority end, case when o_orderkey % 6 <> 0 then 'listed ' || o_orderpriority end, case when p then 'kept' end) as title,
    coalesce(case when o_orderkey % 8 <> 0 then o_orderstatus end, case when d then 'other' end, case when p then 'old' end) as department, coalesce(case when d and o_orderkey % 9 <> 0 then 'first' end, case when p then 'known' end) as profession,
    coalesce(case when d then '<p>new</p>' end, case when p then '<p>kept</p>' end) as html, date_part('epoch', o_orderdate)::bigint as posted, d or (p and o_orderkey % 10 = 0) as detail
    from (select *, o_orderkey % 5 = 0 as d, o_orderkey % 2 = 0 as p from orders)"""
)
def joined_records(t: Tables) -> DataFrame:
    """One record of each listed row: its detail's values, else its own, else what was known before."""
    k, texts, none = c("o_orderkey"), "array<string>", F.lit(None)
    name = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    summary = t.orders.select(
        k.cast("string").alias("id"), F.when(k % 6 != 0, F.concat(F.lit("listed "), "o_orderpriority")).alias("name"), F.when(k % 4 != 0, name("S")).alias("displayJobId"), F.when(k % 8 != 0, c("o_orderstatus")).alias("department"),
        none.cast(texts).alias("locations"), none.cast(texts).alias("standardizedLocations"), F.unix_seconds(c("o_orderdate").cast("timestamp")).alias("postedTs"), F.lit(1).cast("long").alias("creationTs"),
    )
    arrays = {x: none.cast(texts) for x in ("discipline", "roleType", "employmentType", "workSite", "travel", "locations", "standardizedLocations")}
    detail = t.orders.where(k % 5 == 0).select(k.cast("string").alias("id"), F.concat(F.lit("detail "), "o_orderpriority").alias("name"), F.when(k % 3 == 0, name("D")).alias("displayJobId"), F.lit("other").alias("department"), F.lit("u").alias("publicUrl"), F.lit("<p>new</p>").alias("jobDescription"), F.when(k % 9 != 0, F.array(F.lit("first"), F.lit("second"))).alias("profession")).withColumns(arrays)
    previous = t.orders.where(k % 2 == 0).select(k.cast("string").alias("id"), name("P").alias("jobId"), F.lit("kept").alias("title"), F.lit("old").alias("department"), F.lit("known").alias("profession"), F.lit("<p>kept</p>").alias("descriptionHtml"), (k % 10 == 0).alias("hasDetail"))
    previous = previous.withColumns({x: none.cast("string") for x in ("discipline", "roleType", "employmentType", "workSite", "travel", "url")} | {x: none.cast(texts) for x in ("locations", "countryCodes")})
    return classify.record(summary, detail, previous).select("id", "jobId", "title", "department", "profession", c("descriptionHtml").alias("html"), c("postedTs").alias("posted"), c("hasDetail").alias("detail"))
