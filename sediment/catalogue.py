"""Queries of the library's own operators over the driver's tables, and the SQL that each must agree with.

Postings are played by orders (open unless their status is F), their tags by the part types of their items, units by nations and regions.
Each query reads whole tables; limits are those of top-k reports and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment import adverts, ingestion, registry
from sediment.functions import dates, rules, tables, text
from sediment.functions.numbers import quotient
from sediment.operators import browse, changes, cohorts, ranking, reports, series
from sediment.registry import Tables, query

c = F.col

_KEYS = "keys as (select distinct l_orderkey as id, p_type as key from lineitem join part on l_partkey = p_partkey)"
_PLACED = "placed as (select * from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query("select coalesce(nullif(o_orderpriority, ''), 'Unspecified') as key, count(*)::bigint as n, count(*)::double / (select count(*) from orders) as share from orders group by 1")
def rank_share(t: Tables) -> DataFrame:
    return ranking.ranked(ranking.with_share(ranking.tally(t.orders, ranking.stated(c("o_orderpriority")))))


@query(f"with {_KEYS} select key, count(*)::bigint as n from keys join orders on id = o_orderkey group by 1")
def rank_multivalued(t: Tables) -> DataFrame:
    return ranking.ranked(ranking.tally_many(t.tagged(), c("tags")))


@query("select n_name as key, count(distinct l_orderkey)::bigint as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")
def distinct_within_row(t: Tables) -> DataFrame:
    places = t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey"))
    return ranking.ranked(ranking.tally_many(places.groupBy("l_orderkey").agg(F.collect_list("n_name").alias("places")), c("places")))


@query(
    """with o as (select o_custkey, count(*) as k from orders group by 1)
    select count(*)::bigint as n, count(*) filter (k is null)::bigint as not_stated, count(*) filter (k >= 10)::bigint as many, count(*) filter (c_acctbal < 0)::bigint as negative
    from customer left join o on c_custkey = o_custkey"""
)
def conditional_counts(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("k")), c("c_custkey") == c("o_custkey"), "left")
    return ranking.conditional(rows, {"not_stated": c("k").isNull(), "many": c("k") >= 10, "negative": c("c_acctbal") < 0})


@query(
    f"""with {_KEYS} select count(distinct id)::bigint as n, (select count(*) from orders)::bigint as total, count(distinct id)::double / (select count(*) from orders) as share
    from keys join orders on id = o_orderkey where key in ('PROMO', 'ECONOMY')"""
)
def union_share(t: Tables) -> DataFrame:
    return ranking.union_share(t.tagged(), c("tags"), ["PROMO", "ECONOMY"])


@query(
    """select r_name as parent, n_name as child, count(*)::bigint as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    group by grouping sets ((r_name, n_name), (r_name))"""
)
def rollup_parent(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return ranking.rollup(rows, c("r_name"), c("n_name"))


@query(
    """select 'priority' as dim, o_orderpriority as key, count(*)::bigint as n from orders group by 2
    union all select 'status', o_orderstatus, count(*)::bigint from orders group by 2"""
)
def breakdowns(t: Tables) -> DataFrame:
    return ranking.breakdown(t.orders, {"priority": c("o_orderpriority"), "status": c("o_orderstatus")})


@query(
    """with a as (select date_diff('day', o_orderdate, (select max(o_orderdate) from orders)) as d from orders), b as (
    select case when d <= 7 then 0 when d <= 30 then 1 when d <= 90 then 2 when d <= 365 then 3 else 4 end as ordinal from a)
    select ordinal::int as ordinal, ['week', 'month', 'quarter', 'year', 'older'][ordinal + 1] as bucket, count(*)::bigint as n from b group by 1, 2"""
)
def age_buckets(t: Tables) -> DataFrame:
    rows = t.orders.crossJoin(F.broadcast(t.as_of()))
    return ranking.buckets(rows, dates.age_days(c("o_orderdate"), c("now")), [(7, "week"), (30, "month"), (90, "quarter"), (365, "year")], "older")


@query(
    """select case when p_size <= 2 then 0 when p_size <= 5 then 1 when p_size <= 10 then 2 else 3 end::int as ordinal,
    case when p_size <= 2 then '0-2' when p_size <= 5 then '3-5' when p_size <= 10 then '6-10' else '11+' end as bucket, count(*)::bigint as n from part group by 1, 2"""
)
def year_buckets(t: Tables) -> DataFrame:
    return ranking.buckets(t.part, c("p_size"), [(2, "0-2"), (5, "3-5"), (10, "6-10")], "11+")


@query("select quantile_disc(l_quantity, 0.5 order by l_quantity desc)::double as median from lineitem")
def median_upper(t: Tables) -> DataFrame:
    return ranking.medians(t.lineitem, F.lit("all"), c("l_quantity"), upper=True).select("median")


@query("select l_returnflag as key, count(*)::bigint as n, median(l_quantity)::double as median from lineitem group by 1 having count(*) >= 5")
def median_interp(t: Tables) -> DataFrame:
    return ranking.median_by(t.lineitem, c("l_returnflag"), c("l_quantity"))


@query("select c_mktsegment as key, count(*)::bigint as n, median(l_quantity)::double as median from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1 having count(*) >= 5")
def median_by_band(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    return ranking.median_by(rows, c("c_mktsegment"), c("l_quantity"))


@query(
    f"""with {_PLACED}, cells as (select n_name as row, o_orderstatus as col, count(*) as n from placed group by 1, 2), top as (select row, sum(n) as s from cells group by 1 order by s desc, row limit 12)
    select top.row, g.col, coalesce(n, 0)::bigint as n from top cross join (values ('O'), ('P'), ('X')) g(col) left join cells on cells.row = top.row and cells.col = g.col"""
)
def crosstab(t: Tables) -> DataFrame:
    return ranking.crosstab(t.placed(), c("n_name"), c("o_orderstatus"), ["O", "P", "X"], 12)


@query(
    f"""with {_KEYS}, r as (select o_orderkey, c_mktsegment as band from orders join customer on o_custkey = c_custkey), b as (select band, count(*) as total from r group by 1)
    select key, r.band, count(*)::bigint as n, count(*)::double / any_value(total) as share from r join keys on id = o_orderkey join b on b.band = r.band group by 1, 2"""
)
def gradient(t: Tables) -> DataFrame:
    return ranking.gradient(t.tagged().join(t.customer, c("o_custkey") == c("c_custkey")), c("tags"), c("c_mktsegment"))


@query(f"with {_KEYS} select x.key as a, y.key as b, count(*)::bigint as n from keys x join keys y on x.id = y.id and x.key < y.key join orders on x.id = o_orderkey group by 1, 2 order by n desc, a, b limit 12")
def pairs_topk(t: Tables) -> DataFrame:
    return ranking.pairs(t.tagged(), c("tags")).orderBy(c("n").desc(), "a", "b").limit(12)


@query(
    f"""with {_KEYS}, {_PLACED}, r as (select o_orderkey, r_name = 'EUROPE' as inside from placed), s as (select count(*) filter (inside) as in_n, count(*) filter (not inside) as out_n from r)
    select key, count(*) filter (inside)::bigint as n, count(*) filter (not inside)::bigint as rest_n, in_n::bigint as in_n, out_n::bigint as out_n, count(*) filter (inside)::double / in_n as share, count(*) filter (not inside)::double / out_n as rest_share,
    (count(*) filter (inside)::double / in_n) / nullif(count(*) filter (not inside)::double / out_n, 0) as index from r join keys on id = o_orderkey cross join s group by key, in_n, out_n having count(*) filter (inside) >= 1"""
)
def compare_cohort(t: Tables) -> DataFrame:
    return cohorts.compare(t.placed(t.tagged()), cohorts.inside(c("r_name"), ["EUROPE"]), c("tags"))


def _recency_sql(days: int) -> str:
    return f"""with {_KEYS}, r as (select o_orderkey, o_orderdate >= (select max(o_orderdate) from orders) - interval {days} day as recent from orders where o_orderkey in (select id from keys)),
    s as (select count(*) as all_n, count(*) filter (recent) as recent_n from r), k as (select key, count(*) as total, count(*) filter (recent) as recent from r join keys on id = o_orderkey group by 1 having count(*) >= 3)
    select key, total::bigint as total, recent::bigint as recent, coalesce((recent * all_n)::double / nullif(recent_n * total, 0)::double, 0) as index from k cross join s"""


@query(_recency_sql(30))
def recency_index_30(t: Tables) -> DataFrame:
    return series.recency(t.tagged(), c("o_orderdate"), c("tags"), t.as_of(), 30)


@query(_recency_sql(90))
def demand_index_90(t: Tables) -> DataFrame:
    return series.recency(t.tagged(), c("o_orderdate"), c("tags"), t.as_of(), 90)


@query(f"with x as ({_recency_sql(90)}) (select 'high' as \"end\", * from x order by index desc, key limit 6) union all (select 'low', * from x order by index, key limit 6)")
def both_ends(t: Tables) -> DataFrame:
    return series.both_ends(series.recency(t.tagged(), c("o_orderdate"), c("tags"), t.as_of(), 90))


_MONTHLY = """m as (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as key from orders), g as (select month, row_number() over (order by month desc) as ordinal from (select distinct month from m) order by month desc limit 12),
    k as (select distinct key from m semi join g using (month)), series as (select k.key, g.month, g.ordinal::int as ordinal, (select count(*) from m where m.key = k.key and m.month = g.month)::bigint as n from k cross join g)"""


def _monthly(t: Tables) -> DataFrame:
    return series.monthly(t.orders, c("o_orderdate"), F.array("o_orderpriority"))


@query(f"with {_MONTHLY} select key, month, ordinal, n from series")
def monthly_series(t: Tables) -> DataFrame:
    return _monthly(t)


@query(
    f"""with {_MONTHLY}, p as (select key, sum(n) filter (ordinal <= 3)::bigint as recent, sum(n) filter (ordinal between 4 and 6)::bigint as prior from series group by 1), s as (select sum(recent) as r, sum(prior) as q from p)
    select key, recent, prior, recent::double / r as recent_share, prior::double / q as prior_share, recent::double / r - prior::double / q as delta from p cross join s"""
)
def share_shift(t: Tables) -> DataFrame:
    return series.share_shift(_monthly(t))


_DAILY = """d as (select ts::date as day, count(*) as n from events group by 1), dense as (
    select day, coalesce(n, 0)::bigint as n from (select unnest(generate_series(max(day) - 29, max(day), interval 1 day))::date as day from d) left join d using (day))"""


def _daily(t: Tables) -> DataFrame:
    return series.dense_days(t.events, c("ts"), 30)


@query(f"with {_DAILY} select strftime(day, '%Y-%m-%d') as day, n from dense")
def daily_dense(t: Tables) -> DataFrame:
    return _daily(t).withColumn("day", dates.day_key(c("day")))


@query(
    f"""with {_DAILY}, w as (select *, count(*) over f as k, sum(n) over f as s from dense window f as (order by day rows between 3 preceding and 3 following))
    select strftime(day, '%Y-%m-%d') as day, n, case when k = 7 then s::double / 7 end as mean from w"""
)
def moving_avg_7(t: Tables) -> DataFrame:
    return series.moving_average(_daily(t)).withColumn("day", dates.day_key(c("day")))


@query(f"with {_DAILY} select strftime(day, '%Y-%m-%d') as day, n from dense order by n desc, day limit 1")
def peak_day(t: Tables) -> DataFrame:
    return series.peak(_daily(t)).withColumn("day", dates.day_key(c("day")))


_FUNCTIONS = [("now", r"urgent|high"), ("soon", r"medium")]


@query("select case when o_orderpriority ilike '%urgent%' or o_orderpriority ilike '%high%' then 'now' when o_orderpriority ilike '%medium%' then 'soon' else 'other' end as key, count(*)::bigint as n, count(*)::double / (select count(*) from orders) as share from orders group by 1")
def function_mix(t: Tables) -> DataFrame:
    return ranking.with_share(ranking.tally(t.orders, rules.first_match(c("o_orderpriority"), _FUNCTIONS, "other")))


@query(
    f"""with {_PLACED} select r_name as key, count(*)::bigint as n, count(*) filter (o_orderstatus <> 'F')::double / count(*) as open, count(*) filter (o_orderpriority = '1-URGENT' and o_orderstatus <> 'F')::double / nullif(count(*) filter (o_orderstatus <> 'F'), 0) as urgent
    from placed group by 1"""
)
def profile_divisions(t: Tables) -> DataFrame:
    is_open = c("o_orderstatus") != "F"
    return ranking.profile(t.placed(), c("r_name"), {"open": (is_open, None), "urgent": (c("o_orderpriority") == "1-URGENT", is_open)})


@query(f"with {_KEYS} select count(distinct o_orderkey)::bigint as n, count(id)::bigint as keys, count(id)::double / count(distinct o_orderkey) as mean from orders left join keys on id = o_orderkey")
def breadth_mean(t: Tables) -> DataFrame:
    return ranking.breadth(t.tagged(), c("tags"))


_CATEGORY = {"PROMO": "cheap", "ECONOMY": "cheap", "LARGE": "sized", "MEDIUM": "sized", "SMALL": "sized"}


@query(f"with {_KEYS} select case when key in ('PROMO', 'ECONOMY') then 'cheap' else 'sized' end as key, count(distinct id)::bigint as n from keys join orders on id = o_orderkey where key <> 'STANDARD' group by 1")
def category_rollup(t: Tables) -> DataFrame:
    return ranking.category_tally(t.tagged(), c("tags"), _CATEGORY)


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*)::bigint as n, count(*) filter (o_orderstatus <> 'F')::bigint as open, median(o_totalprice)::double as median from orders group by 1 having count(*) >= 25")
def market_months(t: Tables) -> DataFrame:
    return series.market_months(t.orders, c("o_orderdate"), {"open": c("o_orderstatus") != "F"}, c("o_totalprice"))


@query("select strftime(o_orderdate, '%Y-%m-%d') as date, 'priority' as dim, o_orderpriority as key, count(*)::bigint as n from orders group by 1, 3 union all select strftime(o_orderdate, '%Y-%m-%d'), 'status', o_orderstatus, count(*)::bigint from orders group by 1, 3")
def history_long(t: Tables) -> DataFrame:
    return series.history(t.orders, dates.day_key(c("o_orderdate")), {"priority": c("o_orderpriority"), "status": c("o_orderstatus")})


@query(
    """with d as (select strftime(o_orderdate, '%Y-%m-%d') as date, count(*) as total, count(*) filter (o_orderstatus = 'O') as added, count(*) filter (o_orderstatus = 'F') as removed from orders group by 1)
    select count(*)::bigint as days, (arg_max(total, date) - arg_min(total, date))::bigint as net, sum(added)::bigint as added, sum(removed)::bigint as removed from d"""
)
def net_change(t: Tables) -> DataFrame:
    days = t.orders.groupBy(dates.day_key(c("o_orderdate")).alias("date")).agg(F.count("*").alias("total"), F.count_if(c("o_orderstatus") == "O").alias("added"), F.count_if(c("o_orderstatus") == "F").alias("removed"))
    return series.net_change(days)


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(state, live): yesterday and today."""
    key = c("o_orderkey")
    base = t.orders.select(key.alias("id"), c("o_orderpriority").alias("priority"), c("o_orderdate").alias("posted"), "o_totalprice")
    state = base.where(c("id") % 10 != 0).withColumn("priority", F.when(c("id") % 7 == 0, "9-OTHER").otherwise(c("priority"))).withColumn("status", F.when(c("id") % 11 == 0, "closed").otherwise("open"))
    return state, base.where(c("id") % 13 != 0)


_SNAPSHOTS = """a as (select o_orderkey as id, case when o_orderkey % 7 = 0 then '9-OTHER' else o_orderpriority end as priority, o_orderdate as posted, case when o_orderkey % 11 = 0 then 'closed' else 'open' end as status from orders where o_orderkey % 10 <> 0),
    b as (select o_orderkey as id, o_orderpriority as priority, o_orderdate as posted from orders where o_orderkey % 13 <> 0),
    f as (select coalesce(a.id, b.id) as id, a.id is not null as known, b.id is not null as listed, coalesce(a.status = 'closed', false) as closed, a.priority as p1, b.priority as p2 from a full join b on a.id = b.id)"""


@query(
    f"""with {_SNAPSHOTS} select id, case when listed and (not known or closed) then 'added' when not listed and closed then 'closed' when not listed then 'removed' when p1 is distinct from p2 then 'updated' else 'same' end as kind,
    (known and listed and not closed and p1 is distinct from p2)::int as n_changed from f"""
)
def snapshot_diff(t: Tables) -> DataFrame:
    state, live = _snapshots(t)
    return changes.diff(state, live, "id", ["priority", "posted"]).select("id", "kind", F.size("changed").alias("n_changed"))


@query(f"with {_SNAPSHOTS} select id, 'priority' as field, p1 as before, p2 as after from f where known and listed and not closed and p1 is distinct from p2")
def field_diff(t: Tables) -> DataFrame:
    state, live = _snapshots(t)
    return changes.diff(state, live, "id", ["priority", "posted"]).select("id", F.explode("changed").alias("x")).select("id", "x.*")


@query(
    f"""with {_SNAPSHOTS} select id, case when listed then 'open' else 'closed' end as status, case when listed then p2 else p1 end as priority,
    case when listed and (closed or not known) then '2002-01-01' else '2001-12-22' end as first_seen, case when listed then '2002-01-01' else '2001-12-31' end as last_seen,
    case when listed then null when closed then '2001-12-31' else '2002-01-01' end as closed_at, case when listed then null when closed then 9 else 10 end::bigint as days_open from f"""
)
def scd_transition(t: Tables) -> DataFrame:
    state, live = _snapshots(t)
    closed = c("status") == "closed"
    day = F.to_timestamp(F.lit("2001-12-31"))
    state = state.withColumns({"first_seen": F.to_timestamp(F.lit("2001-12-22")), "last_seen": day, "closed_at": F.when(closed, day), "days_open": F.when(closed, F.lit(9)).cast("long")})
    out = changes.next_state(state, live, "id", F.to_timestamp(F.lit("2002-01-01")))
    return out.select("id", "status", "priority", *(dates.day_key(c(d)).alias(d) for d in ("first_seen", "last_seen", "closed_at")), "days_open")


@query(f"with {_SNAPSHOTS} select a.id, a.priority from a anti join b using (id) where a.status = 'open'")
def closures(t: Tables) -> DataFrame:
    return changes.closures(*_snapshots(t), "id").select("id", "priority")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return changes.latest_struct(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("select n_regionkey::varchar as key, r_name as label, count(*)::bigint as n from nation join region on n_regionkey = r_regionkey group by 1, 2")
def dim_lookup(t: Tables) -> DataFrame:
    names = t.region.select(c("r_regionkey").cast("string").alias("key"), c("r_name").alias("label"))
    return ranking.labelled(ranking.tally(t.nation, c("n_regionkey").cast("string")), names)


@query(
    f"""with {_KEYS}, {_PLACED} select o_orderkey, c_name, o_orderpriority from placed where r_name = 'EUROPE' and o_orderkey in (select id from keys where key = 'PROMO') and contains(lower(c_name || ' ' || o_orderpriority), 'urgent')
    order by o_orderdate desc, o_orderkey limit 40 offset 40"""
)
def facet_browse(t: Tables) -> DataFrame:
    rows = t.placed(t.tagged()).withColumn("creationTs", F.unix_seconds(c("o_orderdate").cast("timestamp")))
    found = browse.search(browse.facets(rows, {"r_name": "EUROPE"}, {"tags": "PROMO"}), " Urgent", ["c_name", "o_orderpriority"])
    return browse.page(browse.ordered(found, "newest", key="o_orderkey"), 1).select("o_orderkey", "c_name", "o_orderpriority")


@query("select o_orderkey, o_orderpriority from orders order by o_orderdate desc, o_orderkey limit 20")
def newest_k(t: Tables) -> DataFrame:
    return browse.page(browse.ordered(t.orders.withColumn("creationTs", F.unix_seconds(c("o_orderdate").cast("timestamp"))), "newest", key="o_orderkey"), 0, 20).select("o_orderkey", "o_orderpriority")


@query(f"select w as key, count(*)::bigint as n from (select unnest(list_distinct(string_split_regex(lower(p_name), '[^a-z0-9+#.]+'))) as w from part) where length(w) >= 3 and w not in {tables.TITLE_WORDS} group by 1")
def title_keywords(t: Tables) -> DataFrame:
    return ranking.ranked(ranking.tally_many(t.part, text.title_words(c("p_name"))))


def _replaced(expression: str, *steps: tuple[str, str, str]) -> str:
    for pattern, by, flags in steps:
        expression = f"regexp_replace({expression}, '{pattern}', {by}, '{flags}')"
    return expression


_PLAIN = _replaced(
    "html", (r"<br\s*/?>", "chr(10)", "gi"), (r"</(p|div|li|h[0-9])>", "chr(10)", "gi"), ("<[^>]+>", "' '", "g"), ("&nbsp;", "' '", "gi"), ("&amp;", "'&'", "gi"), ("&lt;", "'<'", "gi"), ("&gt;", "'>'", "gi"),
    ("&#39;|&rsquo;|&lsquo;", "chr(39)", "gi"), ("&quot;|&ldquo;|&rdquo;", "chr(34)", "gi"), ("&[a-z#0-9]+;", "' '", "gi"), (r"[ \t]+", "' '", "g"), (r"\n{3,}", "chr(10) || chr(10)", "g"), (r"^[\s\x{a0}\x{feff}]+", "''", "g"), (r"[\s\x{a0}\x{feff}]+$", "''", "g"),
)


@query(f"select page_id, {_PLAIN} as text from pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.plain_text(c("html")).alias("text"))


_TERMS = f"""w as (select doc_id, coalesce(lang = 'en', false) as inside, list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '[^a-z0-9+#&./ -]+', ' ', 'g'), ' +'), lambda x: regexp_replace(x, '^[-.]+|[-.]+$', '', 'g')), lambda x: x <> '') as t from documents),
    x as (select doc_id, inside, unnest(t) as w, generate_subscripts(t, 1) as i from w), y as (select *, length(w) >= 3 and w not in {tables.COMMON_WORDS} and not regexp_matches(w, '^[0-9]+$') as good from x),
    z as (select *, lead(w) over (partition by doc_id, inside order by i) as w2, lead(good) over (partition by doc_id, inside order by i) as good2 from y),
    terms as (select distinct doc_id, inside, w as term from y where good union select distinct doc_id, inside, w || ' ' || w2 from z where good and good2),
    counted as (select term, count(*) filter (inside)::bigint as n, count(*) filter (not inside)::bigint as rest_n from terms group by 1)"""


@query(f"with {_TERMS} select term, n, rest_n from counted")
def tokens_df(t: Tables) -> DataFrame:
    return cohorts.term_counts(t.documents, cohorts.inside(c("lang"), ["en"]), c("text"))


@query(
    f"""with {_TERMS}, s as (select greatest(count(*) filter (lang = 'en'), 1) as in_n, greatest(count(*) filter (lang is distinct from 'en'), 1) as out_n from documents),
    r as (select term, n, rest_n, n::double / in_n as share, rest_n::double / out_n as rest_share, (n::double / in_n) / ((rest_n + 0.5) / out_n::double) as lift from counted cross join s where n >= 5),
    g as (select * from r where lift >= 1.6), p as (select * from g where contains(term, ' ')), covered as (select distinct unnest(string_split(term, ' ')) as term from p)
    select * from p union all select g.* from g anti join covered using (term) where not contains(term, ' ') and lift >= 3.0"""
)
def distinctive_terms(t: Tables) -> DataFrame:
    return cohorts.distinctive(t.documents, cohorts.inside(c("lang"), ["en"]), c("text"))


@query("select substr(sha1(coalesce(text, '')), 1, 16) as key, count(*)::bigint as n from documents group by 1 having count(*) > 1")
def fingerprint_dups(t: Tables) -> DataFrame:
    return ranking.tally(t.documents, text.fingerprint(c("text"))).where("n > 1")


@query("select case when p_name like 'red %' then 'red' when p_name ilike '%bolt%' then 'bolt' else 'other' end as key, count(*)::bigint as n from part group by 1")
def first_match_class(t: Tables) -> DataFrame:
    return ranking.tally(t.part, rules.first_match(c("p_name"), [("red", r"^red\b"), ("bolt", "bolt")], "other"))


@query("select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, count(*)::bigint as n from events group by 1, 2")
def day_month_keys(t: Tables) -> DataFrame:
    return t.events.groupBy(dates.day_key(c("ts")).alias("day"), dates.month_key(c("ts")).alias("month")).agg(F.count("*").alias("n"))


def _postings(t: Tables) -> DataFrame:
    """Orders as postings, for the reports; what orders lack is dealt by their key."""
    key = c("o_orderkey")

    def dealt(n: int, *values: str | None):
        out = F.when(key % n == 0, F.lit(values[0]))
        for i, v in enumerate(values[1:], 1):
            out = out.when(key % n == i, F.lit(v))
        return out

    rows = t.placed(t.tagged())
    return rows.select(
        key.cast("string").alias("id"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"), c("c_mktsegment").alias("department"), c("o_orderpriority").alias("profession"), c("c_mktsegment").alias("discipline"),
        dealt(3, "People Manager", "Individual Contributor", None).alias("roleType"), F.lit("Full-Time").alias("employmentType"), dealt(4, "Senior", "Principal", "Manager", "Mid / Unspecified").alias("seniority"),
        dealt(5, "engineer", "sales", "architect", "csam", None).alias("archetype"), dealt(3, "3 days / week in-office", "Up to 100% remote", None).alias("workSite"), F.lit(None).cast("string").alias("workLocationOption"),
        dealt(4, "0-25%", "25-50%", None, "50-75%").alias("travel"), F.when(key % 6 != 0, c("n_name")).alias("org"), F.when(key % 6 != 0, c("r_name")).alias("parent"), dealt(2, "department", "self").alias("orgSource"),
        F.array(F.concat_ws(", ", "r_name", "n_name")).alias("locations"), F.array(F.lit("")).alias("countryCodes"), c("tags").alias("themes"), F.array("c_mktsegment").alias("industries"), F.array().cast("array<string>").alias("products"),
        F.array().cast("array<string>").alias("solutionAreas"), F.when(key % 8 == 0, F.array(F.lit("agentic"))).otherwise(F.array().cast("array<string>")).alias("initiatives"), F.concat("tags", F.when(key % 10 == 0, F.array(F.lit("any_lang"))).otherwise(F.array().cast("array<string>"))).alias("skills"),
        F.when(c("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.unix_seconds(c("o_orderdate").cast("timestamp")).alias("creationTs"), F.when(key % 7 != 0, (key % 12).cast("int")).alias("requiredYears"),
        dealt(4, "Bachelor's", "Master's", "PhD", None).alias("degree"), (key % 9 != 0).alias("hasQualifications"), F.when(c("o_orderstatus") == "F", key % 40).alias("daysOpen"), F.lit("").alias("url"),
        F.when(key % 5 == 0, F.lit("works with Europe teams")).alias("descriptionHtml"),
    )


def _now():
    return F.to_timestamp(F.lit("2001-08-01"))


_BOOK = f"""{_KEYS}, {_PLACED}, book as (select o_orderkey as id, o_orderpriority as profession, c_mktsegment as discipline, case o_orderkey % 3 when 0 then 'People Manager' when 1 then 'Individual Contributor' end as role,
    case o_orderkey % 4 when 0 then 'Senior' when 1 then 'Principal' when 2 then 'Manager' else 'Mid / Unspecified' end as seniority, case o_orderkey % 5 when 0 then 'engineer' when 1 then 'sales' when 2 then 'architect' when 3 then 'csam' else 'other' end as archetype,
    case o_orderkey % 3 when 0 then '3 days / week in-office' when 1 then 'Up to 100% remote' end as site, case o_orderkey % 4 when 0 then '0-25%' when 1 then '25-50%' when 3 then '50-75%' end as travel,
    case when o_orderkey % 6 <> 0 then n_name end as org, case when o_orderkey % 6 <> 0 then r_name end as parent, case o_orderkey % 2 when 0 then 'department' else 'self' end as source, r_name as city, n_name as country, o_orderdate as posted, o_orderstatus = 'F' as closed,
    case when o_orderkey % 7 <> 0 then o_orderkey % 12 end as years, case o_orderkey % 4 when 0 then 'Bachelor''s' when 1 then 'Master''s' when 2 then 'PhD' end as degree, o_orderkey % 9 <> 0 as asks, o_orderkey % 40 as days_open from placed),
    o as (select * from book where not closed), k as (select o.*, key from o join keys using (id))"""


@query(
    f"""with {_BOOK}, age as (select date_diff('day', posted, timestamp '2001-08-01') as d from o), tw as (select id, unnest(list_distinct(string_split_regex(lower(profession || ' ' || discipline), '[^a-z0-9+#.]+'))) as w from o)
    select 'meta' as section, 'open' as key, count(*)::bigint as n from o union all select 'meta', 'closed', count(*) from book where closed union all select 'meta', 'tracked', count(*) from book
    union all select 'meta', 'multiLocation', 0 union all select 'meta', 'remoteEligible', count(*) from o where site like '%remote%' union all select 'meta', 'untagged', count(*) from o where id not in (select id from keys)
    union all select 'meta', 'orgIdentified', count(org) from o union all select 'meta', 'orgFrom_department', count(org) from o where source = 'department' union all select 'meta', 'orgFrom_profession', 0 union all select 'meta', 'orgFrom_self', count(org) from o where source = 'self'
    union all select 'meta', 'aged', count(*) from o union all select 'meta', 'ageDays', sum(d)::bigint from age union all select 'meta', 'medianDaysToClose', quantile_disc(days_open, 0.5 order by days_open desc)::bigint from book where closed
    union all select 'profession', profession, count(*) from o group by 2 union all select 'discipline', discipline, count(*) from o group by 2 union all select 'department', discipline, count(*) from o group by 2
    union all select 'roleType', coalesce(role, 'Unspecified'), count(*) from o group by 2 union all select 'employmentType', 'Full-Time', count(*) from o union all select 'seniority', seniority, count(*) from o group by 2
    union all select 'workSite', coalesce(site, 'Unspecified'), count(*) from o group by 2 union all select 'travel', coalesce(travel, 'Unspecified'), count(*) from o group by 2 union all select 'archetype', archetype, count(*) from o group by 2
    union all select 'org', coalesce(org, 'not_stated'), count(*) from o group by 2 union all select 'division', coalesce(parent, 'not_stated'), count(*) from o group by 2
    union all select 'country', country, count(*) from o group by 2 union all select 'city', city || ', ' || country, count(*) from o group by 2 union all select 'theme', key, count(*) from k group by 2 union all select 'industry', discipline, count(*) from o group by 2
    union all select 'initiative', 'agentic', count(*) from o where id % 8 = 0 having count(*) > 0 union all select 'titleWord', w, count(*) from tw where length(w) >= 3 and w not in {tables.TITLE_WORDS} group by 2
    union all select 'age', case when d <= 7 then '0-7 days' when d <= 30 then '8-30 days' when d <= 60 then '31-60 days' when d <= 90 then '61-90 days' when d <= 180 then '91-180 days' else '180+ days' end, count(*) from age group by 2"""
)
def report_overview(t: Tables) -> DataFrame:
    found = reports.overview(_postings(t), _now())
    return found["meta"].select(F.lit("meta").alias("section"), "key", "n").unionByName(found["breakdowns"].withColumnRenamed("dim", "section"))


_SENIORITIES = f"(select unnest([{', '.join(repr(x) for x in tables.SENIORITY_ORDER)}]) as col)"


def _crossed(name: str, row: str, col: str, cols: str, where: str = "true") -> str:
    cells = f"(select coalesce({row}, 'Unspecified') as row, coalesce({col}, 'Unspecified') as col, count(*) as n from o where {where} group by 1, 2)"
    return f"select '{name}', r.row || '|' || q.col, coalesce(cells.n, 0)::bigint from (select row from {cells} group by 1 order by sum(n) desc, row limit 12) r cross join {cols} q left join {cells} cells on cells.row = r.row and cells.col = q.col"


def _by_month(name: str, rows: str) -> str:
    top = f"(select key, count(*) as s from {rows} semi join g using (month) group by 1 order by s desc, key limit 8)"
    return f"select '{name}', top.key || '|' || g.month, (select count(*) from {rows} m where m.key = top.key and m.month = g.month)::bigint from {top} top cross join g"


def _shift(name: str, rows: str) -> str:
    top = f"(select key, count(*) as s from {rows} semi join g using (month) group by 1 order by s desc, key limit 8)"
    per = f"(select key, (select count(*) from {rows} m join g using (month) where m.key = top.key and g.k <= 3) as recent, (select count(*) from {rows} m join g using (month) where m.key = top.key and g.k between 4 and 6) as prior from {top} top)"
    return f"select '{name}', key || '|' || prior, recent::bigint from {per} where (select count(*) from g) >= 6 and (select sum(recent) from {per}) > 0 and (select sum(prior) from {per}) > 0"


@query(
    f"""with {_BOOK}, p as (select x.key as a, y.key as b, count(*) as n from k x join k y on x.id = y.id and x.key < y.key group by 1, 2 order by n desc, a, b limit 15),
    m as (select strftime(posted, '%Y-%m') as month, key from k), mo as (select strftime(posted, '%Y-%m') as month, org as key from o where org is not null), mp as (select strftime(posted, '%Y-%m') as month, profession as key from o),
    g as (select month, row_number() over (order by month desc) as k from (select distinct month from mp order by month desc limit 12))
    select 'pair' as section, a || '|' || b as key, n::bigint as n from p
    union all {_crossed("profession by roleType", "profession", "role", "(values ('Individual Contributor'), ('People Manager'), ('Unspecified'))").replace(" q left", " q(col) left")}
    union all {_crossed("profession by seniority", "profession", "seniority", _SENIORITIES)} union all {_crossed("org by seniority", "org", "seniority", _SENIORITIES, "org is not null")}
    union all select 'day', strftime(d.day, '%Y-%m-%d'), (select count(*) from o where posted::date = d.day)::bigint from (select unnest(generate_series(max(posted::date) - 179, max(posted::date), interval 1 day))::date as day from o) d
    union all {_by_month("month theme", "m")} union all {_by_month("month org", "mo")} union all {_by_month("month profession", "mp")} union all {_shift("shift theme", "m")} union all {_shift("shift org", "mo")}"""
)
def report_overview_tables(t: Tables) -> DataFrame:
    found = reports.overview(_postings(t), _now())

    def of(section, df: DataFrame, *key, n: str = "n") -> DataFrame:
        return df.select((F.lit(section) if isinstance(section, str) else section).alias("section"), F.concat_ws("|", *key).alias("key"), c(n).alias("n"))

    parts = [of("pair", found["themePairs"], "a", "b"), of(c("dim"), found["crosstabs"], "row", "col"), of("day", found["trend"], dates.day_key(c("day"))), of(F.concat(F.lit("month "), "dim"), found["timeline"], "key", "month")]
    parts.append(of(F.concat(F.lit("shift "), "dim"), found["shift"], "key", c("prior").cast("string"), n="recent"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(
    f"""with {_BOOK}, s as (select * from o where asks), sk as (select s.*, key from s join keys using (id)), bands as (select *, case seniority when 'Senior' then 'senior' when 'Principal' then 'principal' when 'Manager' then 'manager' else 'mid' end as band from s),
    kc as (select distinct id, case when key in ('PROMO', 'ECONOMY') then 'cheap' else 'sized' end as kind from sk where key <> 'STANDARD'), r as (select *, posted >= timestamp '2001-08-01' - interval 90 day as recent from sk)
    select 'coverage' as section, 'open' as key, count(*)::bigint as n, null::double as value from o union all select 'coverage', 'n', count(*), null from s union all select 'breadth', 'keys', count(*), null from sk
    union all select 'skill', key, count(*), count(*)::double / (select count(*) from s) from sk group by 2 union all select 'category', kind, count(*), count(*)::double / (select count(*) from s) from kc group by 2
    union all select 'openList', 'any_lang', count(*), count(*)::double / (select count(*) from s) from s where id % 10 = 0 having count(*) > 0
    union all select 'years', case when years <= 1 then '0-1 years' when years <= 3 then '2-3 years' when years <= 5 then '4-5 years' when years <= 8 then '6-8 years' else '9+ years' end, count(*), null from s where years is not null group by 2
    union all select 'band', band, count(*), median(years)::double from bands where years is not null group by 2 having count(*) >= 5 union all select 'degree', coalesce(degree, 'Not stated'), count(*), null from s group by 2
    union all select 'demand', key, count(*) filter (recent), coalesce((count(*) filter (recent) * (select count(distinct id) from r))::double / nullif((select count(distinct id) from r where recent) * count(*), 0)::double, 0) from r group by 2 having count(*) >= 12
    union all select 'gradient', kind || '|' || band, count(*), count(*)::double / (select count(*) from bands b where b.band = bands.band) from kc join bands using (id) group by kind, band"""
)
def report_requirements(t: Tables) -> DataFrame:
    found = reports.requirements(_postings(t), _now(), _CATEGORY)

    def of(section: str, df: DataFrame, key, n, value=None) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.alias("key"), n.cast("long").alias("n"), (F.lit(None) if value is None else value).cast("double").alias("value"))

    key, n, share = c("key"), c("n"), c("share")
    parts = [of("coverage", found["coverage"], F.lit("open"), c("open")), of("coverage", found["coverage"], F.lit("n"), n), of("breadth", found["breadth"], F.lit("keys"), c("keys"))]
    parts += [of("skill", found["skills"], key, n, share), of("category", found["categories"], key, n, share), of("openList", found["openList"], key, n, share), of("years", found["years"], c("bucket"), n), of("band", found["bands"], key, n, c("median"))]
    parts += [of("degree", found["degrees"], key, n), of("demand", found["demand"], key, c("recent"), c("index")), of("gradient", found["gradient"], F.concat_ws("|", "key", "band"), n, share)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_COHORT = "('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7')"


@query(
    f"""with {_BOOK}, w as (select *, coalesce(org in (select n_name from nation where n_regionkey = 3), false) as inside from o)
    select 'archetype' as section, archetype as key, count(*) filter (inside)::bigint as n, count(*) filter (not inside)::bigint as rest_n from w group by 2 having count(*) filter (inside) >= 1
    union all select 'seniority', seniority, count(*) filter (inside), count(*) filter (not inside) from w group by 2 having count(*) filter (inside) >= 1
    union all select 'theme', key, count(*) filter (inside), count(*) filter (not inside) from w join keys using (id) group by 2 having count(*) filter (inside) >= 3
    union all select 'country', country, count(*) filter (inside), count(*) filter (not inside) from w group by 2 having count(*) filter (inside) >= 1
    union all select 'travel', coalesce(travel, 'Unspecified'), count(*) filter (inside), count(*) filter (not inside) from w group by 2 having count(*) filter (inside) >= 1
    union all select 'org', org, count(*) filter (inside), count(*) filter (not inside) from w where org is not null group by 2 having count(*) filter (inside) >= 1
    union all select 'industry', discipline, count(*) filter (inside), count(*) filter (not inside) from w group by 2 having count(*) filter (inside) >= 1
    union all select 'initiative', 'agentic', count(*) filter (inside), count(*) filter (not inside) from w where id % 8 = 0 having count(*) filter (inside) >= 2
    union all select 'newness', d::varchar, count(*) filter (inside and posted >= timestamp '2001-08-01' - d * interval 1 day), count(*) filter (not inside and posted >= timestamp '2001-08-01' - d * interval 1 day) from w cross join (values (30), (60), (90)) v(d) group by d
    union all select 'shape', 'delivery', count(*) filter (archetype in ('engineer', 'architect')), count(*) filter (archetype in ('sales', 'csam')) from w where inside
    union all select 'surface', 'mentions', count(*), 0 from w where not inside and id % 5 = 0
    union all select 'managers', case when inside then 'cohort' else coalesce(parent, 'none') end, count(*) filter (role = 'People Manager'), count(role) from w group by 2
    union all select 'travels', case when inside then 'cohort' else coalesce(parent, 'none') end, count(*) filter (travel in ('25-50%', '50-75%')), count(travel) from w group by 2"""
)
def report_cohort(t: Tables) -> DataFrame:
    members = [r.n_name for r in t.nation.where("n_regionkey = 3").select("n_name").collect()]  # a lookup table of nations
    found = reports.cohort(_postings(t), members, _now(), "europe")

    def of(section, df: DataFrame, key, n, rest) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), rest.cast("long").alias("rest_n"))

    compared = found["compared"].select(c("dim").alias("section"), "key", "n", "rest_n")
    sizes = t.spark.createDataFrame([("managers", "manager"), ("travels", "travel")], "section string, measure string")
    rows = _postings(t).where("status = 'open'").select(F.when(cohorts.inside(c("org"), members), "cohort").otherwise(F.coalesce("parent", F.lit("none"))).alias("key"), "roleType", "travel").groupBy("key").agg(F.count("roleType").alias("manager"), F.count("travel").alias("travel"))
    given = rows.select("key", F.explode(F.array(F.struct(F.lit("manager").alias("measure"), c("manager").alias("given")), F.struct(F.lit("travel").alias("measure"), c("travel").alias("given")))).alias("x")).select("key", "x.*")
    profile = found["profile"].select("key", F.explode(F.array(F.struct(F.lit("manager").alias("measure"), c("manager").alias("share")), F.struct(F.lit("travel").alias("measure"), c("travel").alias("share")))).alias("x")).select("key", "x.*")
    shares = profile.join(given, ["key", "measure"]).join(sizes, "measure").select("section", "key", F.round(c("share") * c("given")).cast("long").alias("n"), c("given").alias("rest_n"))
    shape = of("shape", found["shape"], F.lit("delivery"), c("delivery"), c("demand"))
    return compared.unionByName(of("newness", found["newness"], c("days"), c("recent"), c("rest_recent"))).unionByName(shape).unionByName(of("surface", found["surface"], F.lit("mentions"), c("n"), F.lit(0))).unionByName(shares)


@query(
    f"""with {_BOOK}, w as (select count(*)::bigint as n, count(*) filter (seniority = 'Manager')::bigint as leadership, count(*) filter (role = 'People Manager')::bigint as managers, count(*) filter (role = 'Individual Contributor')::bigint as contributors,
    count(*) filter (site like '3 days%')::bigint as office, count(*) filter (site like '%remote%')::bigint as remote, count(site)::bigint as site_stated, count(*) filter (posted >= timestamp '2001-08-01' - interval 30 day)::bigint as posted30,
    (select count(distinct id) from k where key in ('PROMO', 'ECONOMY'))::bigint as together from o) select *, null::double as build_to_sell from w"""
)
def report_brief(t: Tables) -> DataFrame:
    kpis = reports.brief(_postings(t), _now(), None, ("PROMO", "ECONOMY"))["kpis"]
    return kpis.select("n", "leadership", "managers", "contributors", "office", "remote", "site_stated", "posted30", "together", "build_to_sell")


@query(
    f"""with {_BOOK}, s as (select key, count(*) as total, count(*) filter (posted >= timestamp '2001-08-01' - interval 30 day) as recent from k group by 1 having count(*) >= 25), d as (select count(distinct id) as all_n, count(distinct id) filter (posted >= timestamp '2001-08-01' - interval 30 day) as recent_n from k)
    select key, total::bigint as total, recent::bigint as recent, coalesce((recent * all_n)::double / nullif(recent_n * total, 0)::double, 0) as index from s cross join d"""
)
def report_brief_skew(t: Tables) -> DataFrame:
    return reports.brief(_postings(t), _now())["skew"].where("dim = 'theme'").select("key", "total", "recent", "index")


_RUNS = """select o_orderkey % 4 as run, o_orderkey as id, case o_orderkey % 3 when 0 then 'added' when 1 then 'removed' else 'updated' end as kind, o_orderpriority as title from orders"""


def _run_changes(t: Tables) -> DataFrame:
    key = c("o_orderkey")
    return t.orders.select((key % 4).cast("int").alias("run"), key.alias("id"), F.when(key % 3 == 0, "added").when(key % 3 == 1, "removed").otherwise("updated").alias("kind"), c("o_orderpriority").alias("title"))


@query(
    f"""with x as ({_RUNS}), f as (select *, row_number() over (partition by run, kind order by id) as k from x)
    select run::int as run, count(*) filter (kind = 'added')::bigint as added, count(*) filter (kind = 'removed')::bigint as removed, count(*) filter (kind = 'updated')::bigint as updated,
    string_agg(title, '; ' order by id) filter (kind = 'added' and k <= 8) as opened, string_agg(title, '; ' order by id) filter (kind = 'removed' and k <= 6) as closed from f group by 1"""
)
def report_change_log(t: Tables) -> DataFrame:
    return reports.change_log(_run_changes(t)).withColumns({"opened": F.array_join("opened", "; "), "closed": F.array_join("closed", "; ")})


@query(f"with x as ({_RUNS}), f as (select *, row_number() over (partition by run, kind order by id) as k from x where run >= 2) select run::int as run, id, kind from f where k <= 40")
def retention(t: Tables) -> DataFrame:
    return series.recent_changes(_run_changes(t), "run", "id", 2, 40).select("run", "id", "kind")


@query("select count(*) filter (kind = 'added')::bigint as added, count(*) filter (kind = 'removed')::bigint as removed, count(*) filter (kind = 'updated')::bigint as updated, (select count(*) from orders where o_orderstatus <> 'F')::bigint as open, (select count(*) from orders where o_orderstatus <> 'F' and o_orderkey % 5 <> 0)::bigint as missing_detail, (select count(*) from events where event_type = (select min(event_type) from events))::bigint as search_errors, 0::bigint as detail_errors, 0::bigint as blocked_errors from (" + _RUNS + ")")
def run_summary(t: Tables) -> DataFrame:
    state = t.orders.select(F.when(c("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.when(c("o_orderkey") % 5 == 0, True).alias("has_detail"))
    first = t.events.agg(F.min("event_type").alias("first"))
    errors = t.events.join(first, c("event_type") == c("first"), "left").select(F.when(c("first").isNotNull(), "search").otherwise("other").alias("kind"))
    return changes.run_summary(_run_changes(t), state, errors)


@query("with x as (select coalesce(p_size > 10, false) as inside, o_orderdate from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey), w as (select inside, o_orderdate >= (select max(o_orderdate) from orders) - interval 60 day as recent from x), s as (select count(*) filter (inside) as n, count(*) filter (not inside) as rest_n, count(*) filter (inside and recent) as recent, count(*) filter (not inside and recent) as rest_recent from w) select n::bigint as n, rest_n::bigint as rest_n, recent::bigint as recent, rest_recent::bigint as rest_recent, recent::double / n as share, rest_recent::double / rest_n as rest_share, (recent::double / n) / nullif(rest_recent::double / rest_n, 0) as growth from s")
def newness(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return series.newness(rows, c("o_orderdate"), c("p_size") > 10, t.as_of())


@query("select count(*)::bigint as n, sum(date_diff('day', o_orderdate::date, (select max(o_orderdate) from orders)::date))::bigint as days, sum(date_diff('day', o_orderdate::date, (select max(o_orderdate) from orders)::date))::double / count(*) as mean from orders")
def mean_age(t: Tables) -> DataFrame:
    return ranking.mean_age(t.orders, c("o_orderdate"), t.as_of())


@query("select count(*)::bigint as n from orders where o_orderpriority ilike '%urgent%' or o_orderstatus ilike 'p%'")
def regex_rows(t: Tables) -> DataFrame:
    return ranking.matching(t.orders, r"\burgent\b|^p$", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("select count(*)::bigint as n from part where coalesce(p_brand <> (select min(p_brand) from part), true) and (lower(p_name) like '%red%' or lower(p_type) like '%promo%')")
def mentions_outside(t: Tables) -> DataFrame:
    first = t.part.agg(F.min("p_brand").alias("first"))
    return cohorts.mentions(t.part.crossJoin(F.broadcast(first)), F.coalesce(c("p_brand") == c("first"), F.lit(False)), "red|promo", "p_name", "p_type").agg(F.count("*").alias("n"))


@query("with x as (select o_orderpriority as row, o_orderstatus as col, count(*) as n from orders group by 1, 2), y as (select * from x union all select 'nothing', 'F', 0 union all select row, 'nothing', 0 from x) select row, col, n::bigint as n from y where row <> 'nothing' and col <> 'nothing'")
def nonzero_cells(t: Tables) -> DataFrame:
    cells = t.orders.groupBy(c("o_orderpriority").alias("row"), c("o_orderstatus").alias("col")).agg(F.count("*").alias("n"))
    zeros = t.spark.createDataFrame([("nothing", "F", 0)], "row string, col string, n long").unionByName(cells.select("row", F.lit("nothing").alias("col"), F.lit(0).cast("long").alias("n")))
    return ranking.without_zeros(cells.unionByName(zeros))


@query("with x as (select o_orderpriority as row, o_orderstatus as col, count(*) as n from orders group by 1, 2) select row, col, n::bigint as n, n::double / max(n) over (partition by col) as part from x")
def column_max(t: Tables) -> DataFrame:
    return ranking.by_column_max(t.orders.groupBy(c("o_orderpriority").alias("row"), c("o_orderstatus").alias("col")).agg(F.count("*").alias("n")))


@query(f"with x as ({_recency_sql(90)}) (select 'rising' as kind, key, index from x where index >= 1.0 order by index desc, key limit 5) union all (select 'cooling', key, index from x where index <= 1.0 and index > 0 order by index, key limit 4)")
def rising_cooling(t: Tables) -> DataFrame:
    index = series.recency(t.tagged(), c("o_orderdate"), c("tags"), t.as_of(), 90)
    return series.rising(index, 1.0).select(F.lit("rising").alias("kind"), "key", "index").unionByName(series.cooling(index, 1.0).select(F.lit("cooling").alias("kind"), "key", "index"))


@query(
    f"""with {_MONTHLY}, p as (select key, sum(n) filter (ordinal <= 3)::bigint as recent, sum(n) filter (ordinal between 4 and 6)::bigint as prior from series group by 1), s as (select sum(recent) as r, sum(prior) as q from p)
    select key, recent::double / r - prior::double / q as delta from p cross join s order by abs(recent::double / r - prior::double / q) desc, key limit 3"""
)
def most_changed(t: Tables) -> DataFrame:
    return series.most_changed(series.share_shift(_monthly(t)), 3).select("key", "delta")


@query("select distinct c_mktsegment as value, 'segment' as facet from customer where coalesce(c_mktsegment, '') <> '' union all select distinct p_type, 'tag' from lineitem join part on l_partkey = p_partkey where coalesce(p_type, '') <> ''")
def facet_values(t: Tables) -> DataFrame:
    one, many = browse.facet_values(t.customer, "c_mktsegment"), browse.facet_values(t.tagged(), "tags", True)
    return one.withColumn("facet", F.lit("segment")).unionByName(many.withColumn("facet", F.lit("tag")))


@query("with d as (select strftime(o_orderdate, '%Y-%m-%d') as date, o_orderstatus as key, count(*) as n from orders group by 1, 2) select date, string_agg(key || '=' || n, ',' order by key) as statuses from d group by 1")
def history_maps(t: Tables) -> DataFrame:
    long = series.history(t.orders, dates.day_key(c("o_orderdate")), {"status": c("o_orderstatus")})
    maps = series.as_maps(long, ["status"])
    pairs = F.transform(F.array_sort(F.map_entries("status")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return maps.select("date", F.array_join(pairs, ",").alias("statuses"))


@query(f"with {_SNAPSHOTS} select id, priority from b where id not in (select id from a where status = 'open')")
def additions(t: Tables) -> DataFrame:
    return changes.additions(*_snapshots(t), "id").select("id", "priority")


@query("with x as (select o_orderkey as id, o_orderkey % 3 <> 0 as known, o_orderkey % 2 = 0 as has, o_orderkey % 5 = 0 as moved, o_orderkey % 7 = 0 as old from orders) select id, (known and has) as had_detail from x where not (known and has) or moved or old order by (known and has), id limit 500")
def stale_details(t: Tables) -> DataFrame:
    key = c("o_orderkey")
    now = F.to_timestamp(F.lit("2001-08-01"))
    live = t.orders.select(key.alias("id"), F.lit(1).alias("posted"))
    fetched = F.when(key % 7 == 0, now - F.make_dt_interval(F.lit(15))).otherwise(now)
    state = t.orders.where(key % 3 != 0).select(key.alias("id"), F.when(key % 5 == 0, 2).otherwise(1).alias("posted"), (key % 2 == 0).alias("has_detail"), fetched.alias("fetched"))
    return changes.stale(live, state, "id", now, budget=500).select("id", "had_detail")


@query("select o_orderkey as id, o_orderkey % 2 = 0 as listed from orders where o_orderkey % 3 = 0")
def failed_details(t: Tables) -> DataFrame:
    key = c("o_orderkey")
    return changes.gone_or_failed(t.orders.where(key % 3 == 0).select(key.alias("id")), t.orders.where(key % 2 == 0).select(key.alias("id")), "id")


@query("select strftime(o_orderdate, '%Y-%m-%d') as date, case when o_orderkey % 2 = 0 then 'new' else 'old' end as kind, count(*)::bigint as n from orders where o_orderkey % 2 = 0 or strftime(o_orderdate, '%Y-%m-%d') not in (select strftime(o_orderdate, '%Y-%m-%d') from orders where o_orderkey % 2 = 0) group by 1, 2")
def history_upsert(t: Tables) -> DataFrame:
    days = t.orders.groupBy(dates.day_key(c("o_orderdate")).alias("date"), F.when(c("o_orderkey") % 2 == 0, "new").otherwise("old").alias("kind")).agg(F.count("*").alias("n"))
    return changes.upsert(days.where("kind = 'old'"), days.where("kind = 'new'"), ["date"])


@query("select case when n_regionkey % 2 = 0 then 'Not stated' else 'Bachelor''s' end as key, count(*)::bigint as n from nation group by 1")
def degree_distribution(t: Tables) -> DataFrame:
    return ranking.in_order(ranking.tally(t.nation, F.when(c("n_regionkey") % 2 == 1, "Bachelor's").otherwise("Not stated")), tables.DEGREE_ORDER)


@query("select o_orderpriority as key, count(*) filter (o_orderstatus = 'O')::bigint as a, count(*) filter (o_orderstatus = 'X')::bigint as b, count(*) filter (o_orderstatus = 'O')::double / nullif(count(*) filter (o_orderstatus = 'F'), 0) as ratio, null::double as none from orders group by 1")
def ratio_kpis(t: Tables) -> DataFrame:
    found = t.orders.groupBy(c("o_orderpriority").alias("key")).agg(F.count_if(c("o_orderstatus") == "O").alias("a"), F.count_if(c("o_orderstatus") == "X").alias("b"), F.count_if(c("o_orderstatus") == "F").alias("f"))
    return found.select("key", "a", "b", quotient(c("a"), c("f")).alias("ratio"), quotient(c("a"), c("b")).alias("none"))


_FACETED = [("profession", "profession = '1-URGENT'"), ("seniority", "seniority = 'Senior'"), ("org", "org is null"), ("themes", "id in (select id from keys where key = 'PROMO')")]


def _facet(name: str) -> str:
    others = " and ".join(f"coalesce({test}, false)" for n, test in _FACETED if n != name)
    source, value = ("k", "key") if name == "themes" else ("o", f"coalesce({name}, '{browse.NONE}')")
    return f"select '{name}' as facet, {value} as value, count(*)::bigint as n from {source} where {others} group by 2"


@query(f"with {_BOOK} {' union all '.join(_facet(n) for n, _ in _FACETED)}")
def facet_counts(t: Tables) -> DataFrame:
    """Values of four facets of the open book, each under the filters of the others."""
    return browse.facet_counts(reports.is_open(_postings(t)), {"profession": "1-URGENT", "seniority": "Senior", "org": browse.NONE}, {"themes": "PROMO"})


@query(
    f"""with {_BOOK}, tags as (select id, array_to_string(list_sort(list(key)), ',') as themes from keys group by 1)
    select o.id::varchar as id, profession || ' ' || discipline as title, profession, discipline, coalesce(role, 'Unspecified') as role, 'Full-Time' as employment, seniority, coalesce(site, 'Unspecified') as site, coalesce(travel, 'Unspecified') as travel,
    country as countries, city || ', ' || country as location, date_part('epoch', posted)::bigint as created, coalesce(themes, '') as themes, discipline as industries, archetype, years::integer as years, org, case when o.id % 8 = 0 then 'agentic' else '' end as initiatives, '' as overview
    from o left join tags using (id)"""
)
def browse_table(t: Tables) -> DataFrame:
    """The rows that are browsed, of the whole open book."""
    postings = _postings(t).withColumns({"jobId": F.lit(None).cast("string"), "postedTs": F.lit(None).cast("long"), "overview": F.lit(None).cast("string")})
    rows = browse.browse_rows(postings)
    joined = [F.array_join(c(k), ",").alias(k) for k in ("countries", "industries", "initiatives")]
    return rows.select("id", "title", "profession", "discipline", c("roleType").alias("role"), c("employmentType").alias("employment"), "seniority", c("workSite").alias("site"), "travel", *joined, "location", c("creationTs").alias("created"), F.array_join(F.array_sort("themes"), ",").alias("themes"), "archetype", c("requiredYears").alias("years"), "org", "overview")


@query(
    f"""with {_BOOK}, w as (select *, case when coalesce(org in (select n_name from nation where n_regionkey = 3), false) then 'cohort' else coalesce(parent, 'none') end as key from o)
    select key, count(*) as n, 1.0::double as industry, count(*) filter (role = 'People Manager')::double / nullif(count(role), 0) as manager, count(*) filter (travel in ('25-50%', '50-75%'))::double / nullif(count(travel), 0) as travel,
    count(*) filter (id % 8 = 0)::double / count(*) as agentic, count(*) filter (seniority in ('Senior', 'Principal'))::double / count(*) as senior, count(*) filter (archetype in ('engineer', 'architect'))::double / count(*) as delivery,
    count(*) filter (archetype = 'architect')::double / count(*) as consulting, count(*) filter (archetype in ('sales', 'csam'))::double / count(*) as selling from w group by 1"""
)
def report_profile(t: Tables) -> DataFrame:
    """The cohort's profile beside each division's, all measures."""
    members = [r.n_name for r in t.nation.where("n_regionkey = 3").select("n_name").collect()]  # a lookup table of nations
    return reports.cohort(_postings(t), members, _now())["profile"]


#: All queries, with those of the other modules, and the SQL of each.
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
__all__ = ["ORACLES", "QUERIES", "adverts", "ingestion"]
