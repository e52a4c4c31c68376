"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

_TABLE = "(select list(c order by i) as tab from (select i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from (select unnest(range(256)) as i)))"


def _crc(text: str) -> str:
    """crc32 of a text's bytes, in a query over one row of the table of 256 remainders (tab)."""
    steps = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


_TRY = " ".join(f"when s + {10 * (2**a - 1)} >= 7 * p + delay and fails[{a + 1}] <> 0 then {a + 1}" for a in range(5))


def _outcome(source: str) -> str:
    return f"""select conv_id, p, case when k is null then 'dead' when k = 0 then 'blocked' else 'delivered' end as status, coalesce(k, 5) as attempts, s as first_at,
    case when k <> 0 or k is null then s + 10 * ((1 << (coalesce(k, 5) - 1)) - 1) end as last_at from (select *, case when s is null then 0 when not faulty then 1 {_TRY} end as k from ({source}))"""


OP11 = f"""
with recursive tab as materialized {_TABLE},
turns as materialized (
  select conv_id, turn, count(*) as copies, min(crc) as crc, row_number() over (partition by conv_id order by turn) - 1 as p
  from (select conv_id, turn, {_crc("coalesce(text, '')")} as crc from conversations, tab) group by conv_id, turn
),
marked as materialized (
  select t.*, {_crc("concat('0:', conv_id, ':', turn)")} % 3 as distance, {_crc("concat('1:', conv_id, ':', turn)")} % 101 < 35 as faulty, {_crc("concat('2:', conv_id, ':', turn)")} % 101 as delay,
  [{", ".join(_crc(f"concat('{a + 2}:', conv_id, ':', turn)") + " % 3" for a in range(1, 6))}] as fails from turns t, tab
),
done as (
  {_outcome("select *, 7 * p as s from marked where distance = 0 or p < distance")}
  union all
  {_outcome("select c.*, case when d.status = 'delivered' then greatest(7 * c.p, d.last_at) end as s from done d join marked c on c.conv_id = d.conv_id and c.distance > 0 and c.p - c.distance = d.p")}
),
released as (
  select conv_id, p, n, sum(n * crc) over (partition by conv_id order by n) as state
  from (select d.conv_id, d.p, m.crc, row_number() over (partition by d.conv_id order by d.last_at, m.turn) as n from done d join marked m using (conv_id, p) where d.status = 'delivered')
)
select m.conv_id, m.turn, d.status, d.attempts::integer as attempts, d.first_at::bigint as first_at, d.last_at::bigint as last_at, r.n::bigint as release_no, r.state::bigint as state, m.copies
from marked m join done d using (conv_id, p) left join released r using (conv_id, p)
"""


def _lloyd(rounds: int, width: int, k: int) -> str:
    at = f"range(1, {width + 1})"
    near = f"""select vec_id, any_value(q) as q, arg_min(k, (d, k)) as k, min(d) as d
      from (select v.vec_id, v.q, c.k, list_sum(list_transform({at}, lambda i: (v.q[i] - c.c[i]) * (v.q[i] - c.c[i])))::bigint as d from v, {{c}} c) group by vec_id"""
    parts = [
        f"""v as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings
      where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by h) - 1 as k, q as c from (select q, sha256('3:' || vec_id) as h from v order by h limit {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized ({near.format(c=f'c{n}')})")
        if n < rounds:
            parts.append(f"""c{n + 1} as materialized (select c.k, coalesce(m.c, c.c) as c from c{n} c left join (
      select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from (select k, i, sum(x)::bigint as s, count(*) as n from (select k, unnest(q) as x, unnest({at}) as i from a{n}) group by k, i) group by k) m using (k))""")
    return f"""with {", ".join(parts)}
    select vec_id, k::integer as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
    from a{rounds} join c{rounds} using (k)"""


OP12 = _lloyd(10, 64, 8)

_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13 = f"""
with cut as materialized (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
each as materialized (select doc_id, i, line, {_KEY} as key from (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as i from cut)),
held as (select key, min(doc_id) as first from each where length(key) >= 10 group by key having count(distinct doc_id) > 1)
select doc_id, count(*) as n_lines, count(*) filter (first is not null and first <> doc_id) as n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by i) filter (first is null or first = doc_id), '')) as kept_sha256
from each left join held using (key) group by doc_id
"""
