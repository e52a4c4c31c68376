"""Queries of how rows come in and are kept: landed pages read as a source, faults put aside, states kept as a log of changes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.changes import latest_struct
from sediment.operators.maintained import Breakdowns
from sediment.registry import Tables, query
from sediment.session import scratch
from sediment.sources import landing, paged, quarantine
from sediment.sources.log import Log

c = F.col

#: Positions on a landed page of customers.
PER_PAGE = 250


def land(rows: DataFrame, position, total: int, root: str, size: int = PER_PAGE, sort: str = "timestamp") -> str:
    """Writes rows (id, name) as the JSON documents of a paged index, one for each page and pass; returns the url for the source. position: the place of a row in the index."""
    placed = rows.withColumn("_at", position).withColumn("offset", (F.floor(c("_at") / size) * size).cast("long"))
    entry = F.struct("_at", c("id").cast("string").alias("id"), "name")
    pages = placed.groupBy("pass", "offset").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("_at")).alias("positions"))  # size rows of a page
    document = F.to_json(F.struct(F.lit(total).alias("total"), F.lit(sort).alias("sortBy"), "positions"))
    pages.select("pass", "offset", document.alias("value")).repartition("pass", "offset").write.partitionBy("pass", "offset").text(root)
    return root.removeprefix("file:") + "/pass={pass}/offset={offset}/part-*"


def _landed(t: Tables) -> DataFrame:
    """Two passes over customers in the source's format. In the first one, the last row is the first one again: rows moved meanwhile."""
    people = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    total = people.count()
    moved = F.when((c("pass") == 1) & (c("id") == total - 1), 0).otherwise(c("id"))
    passes = people.crossJoin(t.spark.range(1, 3).select(c("id").cast("int").alias("pass"))).withColumn("id", moved)
    # customers are numbered from 0 without gaps, so a key is a place
    place = F.when((c("pass") == 1) & (c("name") == F.format_string("Customer#%09d", F.lit(total - 1))), total - 1).otherwise(c("id"))
    url = land(passes, place, total, scratch(t.spark, "pages"))
    t.spark.dataSource.register(paged.PagedIndex)
    read = lambda n: t.spark.read.format("paged_index").option("url", url).option("size", PER_PAGE).option("pass", n).option("again", "true").load()
    return read(1).unionByName(read(2))


@query(f"select 2 as pass, c_custkey::varchar as id, c_name as name, (c_custkey // {PER_PAGE})::integer as page, (c_custkey % {PER_PAGE})::integer as at from customer")
def landed_index(t: Tables) -> DataFrame:
    """The rows of the first whole pass over a paged index of customers, which is the second one."""
    found, rows = landing.complete(_landed(t))
    return rows.select(F.lit(found).alias("pass"), "id", "name", "page", "at")


@query(
    f"""with pages as (select c_custkey // {PER_PAGE} as page, count(*) as n, string_agg(c_custkey::varchar, ',' order by c_custkey::varchar) as print from customer group by 1), ends as (select min(page) as a, max(page) as b from pages)
    select page::integer as page, md5(print) as print, n::integer as n, case when page = a or page = b then 2 else 1 end::bigint as reads, null::varchar as fault from pages, ends"""
)
def page_prints(t: Tables) -> DataFrame:
    """Fingerprint, rows, readings and fault of each page of the whole pass."""
    pages = _landed(t).where("pass = 2").select("page", landing.fingerprint().alias("print"), F.size("positions").alias("n"), landing.page_faults().alias("fault"))
    return pages.groupBy("page", F.md5("print").alias("print"), "n", "fault").agg(F.count("*").alias("reads"))


#: What the text of a click holds, and what is asked of a click.
CLICK = "k int, device struct<os:string,ver:string>, tags array<string>, items array<struct<sku:int,qty:int>>"
CLICK_RULES = {"no k": "value.k is not null", "no time": "ts is not null", "no client": "client_id is not null", "no kind": "trim(kind) <> ''"}

_CLICKS = """judged as (select *, case when missing or broken then null else json_extract(props, '$.k')::integer end as k from (
    select *, coalesce(trim(props), '') = '' as missing, coalesce(trim(props), '') <> '' and (not json_valid(props) or coalesce(case when json_valid(props) then json_type(props, '$.k') = 'VARCHAR' end, false)) as broken from clicks)),
  reasons as (select click_id, case when missing then 'missing' else 'broken' end as reason from judged where missing or broken
    union all select click_id, 'no k' from judged where not missing and not broken and k is null union all select click_id, 'no time' from judged where not missing and not broken and ts is null
    union all select click_id, 'no client' from judged where not missing and not broken and client_id is null union all select click_id, 'no kind' from judged where not missing and not broken and coalesce(trim(kind), '') = '')"""


@query(f"with {_CLICKS} select reason, count(*) as n, min(click_id) as first from reasons group by 1")
def faulty_clicks(t: Tables) -> DataFrame:
    """Why clicks are put aside, and how many."""
    faults = quarantine.split(quarantine.judged(t.clicks, "props", CLICK, CLICK_RULES))[1]
    return faults.select("click_id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min("click_id").alias("first"))


@query(
    f"""with {_CLICKS} select kind, json_extract_string(props, '$.device.os') as os, count(*) as n, sum(k)::bigint as k, coalesce(sum(json_array_length(json_extract(props, '$.items'))), 0)::bigint as items from judged
    where not missing and not broken and k is not null and ts is not null and client_id is not null and trim(kind) <> '' group by 1, 2"""
)
def good_clicks(t: Tables) -> DataFrame:
    """Clicks without a fault, by kind and system, from their parsed texts."""
    good = quarantine.split(quarantine.judged(t.clicks, "props", CLICK, CLICK_RULES))[0]
    items = F.when(c("value.items").isNotNull(), F.size("value.items")).otherwise(0)
    return good.groupBy("kind", c("value.device.os").alias("os")).agg(F.count("*").alias("n"), F.sum("value.k").alias("k"), F.sum(items).cast("long").alias("items"))


_CHANGE = "client_id, change_id, seq, op, source, segment, city"


def _replayed(t: Tables, after=lambda log: None) -> Log:
    """client_changes as a log: a version for each month, the last change of a client in it; D deletes. Compacted after the third. after: called with the log as each version is in."""
    month = F.coalesce(F.date_trunc("month", "valid_at").cast("date"), F.to_date(F.lit("2024-01-01")))
    rows = t.client_changes.where("client_id is not null").select(*_CHANGE.split(", "), month.alias("month"))
    last = latest_struct(rows.withColumn("all", F.to_json(F.struct(*_CHANGE.split(", ")))), ["client_id", "month"], ["seq", "change_id", "all"]).drop("all")
    log = Log(t.spark, scratch(t.spark, "clients"), "client_id")
    months = [r[0] for r in last.select("month").distinct().orderBy("month").collect()]  # five
    for n, at in enumerate(months):
        log.append(last.where(c("month") == F.lit(at)).withColumn("gone", c("op").eqNullSafe("D")), log.version())
        if n == 2:
            log.compact()
        after(log)
    return log


_MONTHS = f"""monthly as (select * from (select {_CHANGE}, coalesce(date_trunc('month', valid_at)::date, date '2024-01-01') as month from client_changes where client_id is not null)
  qualify row_number() over (partition by client_id, month order by seq desc nulls last, change_id desc nulls last) = 1)"""


@query(f"with {_MONTHS}, newest as (select * from monthly qualify row_number() over (partition by client_id order by month desc) = 1) select {_CHANGE}, month from newest where op is distinct from 'D'")
def log_state(t: Tables) -> DataFrame:
    """Clients after all their changes: base and changes of the log, merged."""
    return _replayed(t).read()


@query(f"with {_MONTHS}, newest as (select * from monthly where month < date '2024-03-01' qualify row_number() over (partition by client_id order by month desc) = 1) select {_CHANGE}, month from newest where op is distinct from 'D'")
def log_as_of(t: Tables) -> DataFrame:
    """Clients as they were after the second month, read when three more are in."""
    return _replayed(t).read(version=2)


@query(f"with {_MONTHS} select month, case when op = 'D' then true else false end as gone, count(*) as n, count(distinct client_id) as clients from monthly group by 1, 2")
def log_changes(t: Tables) -> DataFrame:
    """What each version changed, from the archive and the latest changes."""
    return _replayed(t).changes().groupBy("month", "gone").agg(F.count("*").alias("n"), F.count_distinct("client_id").alias("clients"))


@query(
    f"""with {_MONTHS}, newest as (select * from monthly qualify row_number() over (partition by client_id order by month desc) = 1), held as (select * from newest where op is distinct from 'D')
    select 'segment' as dim, coalesce(nullif(segment, ''), 'Unspecified') as value, count(*) as n from held group by 2 union all select 'city', coalesce(nullif(city, ''), 'Unspecified'), count(*) from held group by 2
    union all select 'source', coalesce(nullif(source, ''), 'Unspecified'), count(*) from held group by 2 union all select 'words', w, count(*) from (select client_id, unnest(list_distinct(string_split(city || ' ' || segment, ' '))) as w from held) group by 2"""
)
def maintained_counts(t: Tables) -> DataFrame:
    """Clients by segment, city, source and word, kept from version to version by what changed."""
    dims = {"segment": "segment", "city": "city", "source": "source", "words": "split(city || ' ' || segment, ' ')"}
    counts = Log(t.spark, scratch(t.spark, "counts"), "cell")
    log = _replayed(t, lambda log: Breakdowns(log, counts, dims).refresh())
    return Breakdowns(log, counts, dims).read()
