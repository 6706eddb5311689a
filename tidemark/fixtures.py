"""Views over the star-schema tables that stand for catalogue, library and progress tables.

The SQL is plain enough for Spark and DuckDB alike; `with_views` prefixes a query with what it needs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "lineitem", "orders", "events")

VIEWS: dict[str, str] = {
    "fx_works": """
select p_partkey as book_id, p_name as title, p_type || ' ' || p_brand as author, p_type as series_name,
  p_size as series_sequence, 1950 + p_size as publication_year, coalesce(a.n, 0) as activity
from part left join (select l_partkey, count(*) as n from lineitem group by l_partkey) a on a.l_partkey = p_partkey""",
    "fx_editions": """
select e.*,
  case when e.supp % 2 = 0 then e.core || case when e.c10 = 10 then 'X' else cast(e.c10 as string) end end as isbn_10,
  case when e.supp % 2 = 1 then '978' || e.core || cast(e.c13 as string) end as isbn_13
from (
  select d.*,
    (11 - (10*a1+9*a2+8*a3+7*a4+6*a5+5*a6+4*a7+3*a8+2*a9) % 11) % 11 as c10,
    (10 - (38+3*a1+a2+3*a3+a4+3*a5+a6+3*a7+a8+3*a9) % 10) % 10 as c13
  from (
    select g.*,
      cast(substr(core,1,1) as int) a1, cast(substr(core,2,1) as int) a2, cast(substr(core,3,1) as int) a3,
      cast(substr(core,4,1) as int) a4, cast(substr(core,5,1) as int) a5, cast(substr(core,6,1) as int) a6,
      cast(substr(core,7,1) as int) a7, cast(substr(core,8,1) as int) a8, cast(substr(core,9,1) as int) a9
    from (
      select l_partkey * 1000 + l_suppkey as edition_id, l_partkey as book_id, l_suppkey as supp,
        lpad(cast(l_partkey * 1000 + l_suppkey as string), 9, '0') as core,
        count(*) as users_count, cast(sum(l_quantity) as bigint) as score,
        case when l_suppkey % 3 = 0 then 3600 + (l_partkey * 37 + l_suppkey * 11) % 36000 end as audio_seconds,
        case when l_suppkey % 3 = 1 then 50 + (l_partkey + l_suppkey) % 900 end as pages,
        case l_suppkey % 5 when 0 then 'Listened' when 1 then 'Ebook' when 2 then 'Read' when 3 then 'Both' end as reading_format,
        case when l_suppkey % 7 = 0 then 'Paperback' end as physical_format,
        case when l_suppkey % 4 = 0 then 'B0' || lpad(cast(l_partkey * 1000 + l_suppkey as string), 8, '0') end as asin
      from lineitem group by l_partkey, l_suppkey) g) d) e""",
    "fx_items": """
select p_partkey as item_id, p_partkey % 3 as library_id,
  case p_partkey % 6 when 0 then 'The ' || p_name when 1 then p_name || ': A Novel' when 2 then p_name || ' (Unabridged)'
    when 3 then upper(p_name) when 4 then p_name || ', Book 2' else p_name end as title,
  case when p_partkey % 2 = 0 then p_type || ' ' || p_brand else p_brand || ', ' || p_type end as author,
  case when p_partkey % 4 = 0 then '978-' || f.core || '-' || cast(f.c13 as string) end as isbn_raw,
  case when p_partkey % 4 = 1 then lower(f.asin) end as asin_raw,
  case when p_partkey % 3 <> 2 then 'book' else 'ebook' end as media_type,
  f.audio_seconds + (p_partkey % 7) * 60 as duration_s
from part left join (select * from (select e.*, row_number() over (partition by book_id order by supp) rn from fx_editions e) x where rn = 1) f
on f.book_id = p_partkey""",
    "fx_progress": """
select event_id as pos, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as item_id, ts as last_update,
  value / 300.0 as progress_ratio, event_type = 'purchase' and value > 60 as is_finished,
  case when event_type = 'error' then 'ep' || cast(event_id as string) end as episode_id
from events""",
    "fx_user_books": """
select user_id, book_id, user_id * 1000000 + book_id as user_book_id,
  case st when 'F' then 3 when 'O' then 2 else 1 end as status_id
from (select o_custkey % 200 as user_id, l_partkey as book_id, min(o_orderstatus) as st
      from orders join lineitem on l_orderkey = o_orderkey group by o_custkey % 200, l_partkey) u""",
    "fx_state": """
select user_id, item_id, progress_ratio * 100 as progress_percent, last_update as updated_at,
  1 + item_id % 3 as status_id, is_finished
from (select p.*, row_number() over (partition by user_id, item_id order by last_update desc, pos desc) rn
      from fx_progress p where episode_id is null and last_update < timestamp '2024-01-16 00:00:00') x
where rn = 1""",
    "fx_history": """
select pos, user_id, item_id, last_update,
  case when pos % 11 = 0 then null else progress_ratio * 100 end as progress,
  case when pos % 5 = 0 then null else is_finished end as is_finished,
  case pos % 3 when 0 then 'audiobook' when 1 then 'ebook' else 'physical' end as fmt,
  case pos % 3 when 0 then 3600 + (item_id * 37) % 36000 when 1 then 2 + item_id % 900 end as total,
  cast(floor(progress_ratio * 3000) as bigint) as position,
  lag(progress_ratio * 100) over (partition by user_id, item_id order by pos) as previous
from fx_progress""",
    "fx_known": """
select s.user_id, s.item_id, cast(s.item_id as string) as identifier, 'isbn' as identifier_type, 'title ' || cast(s.item_id as string) as title,
  s.progress_percent, s.updated_at, s.status_id, case when s.item_id % 4 <> 0 then s.item_id * 1000 + s.item_id % 9 end as edition_id
from fx_state s""",
    "fx_current": """
select user_id, item_id, cast(item_id as string) as identifier, 'isbn' as identifier_type, 'title ' || cast(item_id as string) as title,
  progress_ratio * 100 as progress_percent, last_update as updated_at, 2 as status_id,
  case when item_id % 5 <> 0 then item_id * 1000 + item_id % 9 end as edition_id
from (select p.*, row_number() over (partition by user_id, item_id order by last_update desc, pos desc) rn from fx_progress p where episode_id is null) x
where rn = 1""",
}
NEEDS = {"fx_items": ("fx_editions",), "fx_state": ("fx_progress",), "fx_history": ("fx_progress",), "fx_known": ("fx_progress", "fx_state"), "fx_current": ("fx_progress",)}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in (*NEEDS.get(name, ()), name):
            if need not in out:
                out.append(need)
    return out


def with_views(query: str, *names: str, more: str = "") -> str:
    """query, after a WITH clause that defines the views and `more` (name AS (...), ...)."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _ordered(names)] + ([more] if more else [])
    return f"WITH {', '.join(parts)}\n{query}" if parts else query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame over the tables in sf_dir."""
    sql = with_views(f"select * from {name}", name)
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
