"""Query-log analytics over the stored events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import querylog as ql
from ..session import shared_dir
from ..sources.adapters import AS_OF, Tables
from .ctes import NOW, compact, sql, stamp
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def ts(column: str):
    return F.date_format(column, STAMP).alias(column)


@query("a1_read_table", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def a1(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


HITS_SQL = """
select case when event_type = 'error' then '' else logs.user_id end as user_id,
  case when event_type = 'click' then '  ' else ' ' || query || ' ' end as query, total_hits,
  case when event_type = 'view' then true end as is_failed, created_at
from events join logs on events.event_id = logs.id"""


_APPENDED = f"""
select case when user_id = '' then 'anonymous' else user_id end as user_id, trim(query) as query, total_hits,
  coalesce(is_failed, total_hits = 0) as is_failed, 'manual_search' as search_type, {stamp('created_at')} as created_at
from hits where trim(query) <> ''"""


def _hits(t: Tables) -> DataFrame:
    kind = F.split("query", " ")[0]
    return t.logs.select(
        F.when(kind == "error", "").otherwise(F.col("user_id")).alias("user_id"),
        F.when(kind == "click", "  ").otherwise(F.concat(F.lit(" "), "query", F.lit(" "))).alias("query"),
        "total_hits", F.when(kind == "view", True).alias("is_failed"), "created_at")


@query("a8_append_search_logs", sql(_APPENDED, "logs", hits=HITS_SQL))
def a8(t: Tables) -> DataFrame:
    return ql.append_search_logs(_hits(t)).withColumn("created_at", ts("created_at"))


@query("a8_log_window", sql(f"{_APPENDED} and created_at >= {NOW} - interval 7 day", "logs", hits=HITS_SQL))
def a8_window(t: Tables) -> DataFrame:
    """Two appends to a stored log, then the last seven days of it."""
    path = f"{shared_dir(t.spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    found = F.coalesce("total_hits", F.lit(0)) > 0
    ql.save_search_logs(_hits(t).filter(found), path)
    ql.save_search_logs(_hits(t).filter(~found), path)
    return ql.read_search_logs(t.spark, path, AS_OF, days=7).withColumn("created_at", ts("created_at"))


@query("e1_popular_keywords", sql("select keyword, cnt as count from popular", "popular"))
def e1(t: Tables) -> DataFrame:
    return ql.popular_keywords(t.logs, AS_OF, days=7)


@query("e2_failed_keywords", sql(f"""
select query as keyword, count(*) as count from logs
where created_at >= {NOW} - interval 7 day and total_hits <= 0
group by 1 order by 2 desc, 1 limit 10""", "logs"))
def e2(t: Tables) -> DataFrame:
    return ql.failed_keywords(t.logs, AS_OF, days=7, limit=10)


def _top(name: str) -> str:
    return f"(select string_agg(keyword || '=' || cast(count as varchar), ',' order by count desc, keyword) from {name})"


@query("e3_search_summary", sql(f"""
select 7 as days, count(*) as total_logs, count(*) filter (total_hits <= 0) as failed_logs,
  round(count(*) filter (total_hits <= 0) / count(*), 6) as failure_rate,
  {_top('pop10')} as top_keywords, {_top('fail10')} as top_failed_keywords
from logs""", "popular",
    pop10="select keyword, cnt as count from popular order by 2 desc, 1 limit 10",
    fail10=f"""select query as keyword, count(*) as count from logs
where created_at >= {NOW} - interval 7 day and total_hits <= 0 group by 1 order by 2 desc, 1 limit 10"""))
def e3(t: Tables) -> DataFrame:
    def flat(c: str):
        entry = lambda e: F.concat(e["keyword"], F.lit("="), e["count"].cast("string"))
        return F.array_join(F.transform(c, entry), ",").alias(c)
    return ql.search_summary(t.logs, AS_OF, days=7).select(
        F.col("days").cast("int").alias("days"), "total_logs", "failed_logs",
        F.round("failure_rate", 6).alias("failure_rate"), flat("top_keywords"), flat("top_failed_keywords"))


@query("e4_search_trend", sql(f"""
select strftime(created_at, '%Y-%m-%d') as date, count(*) as total, count(*) filter (total_hits <= 0) as failed,
  count(*) filter (total_hits > 0) as success
from logs where created_at >= {NOW} - interval 14 day group by 1""", "logs"))
def e4(t: Tables) -> DataFrame:
    return ql.search_trend(t.logs, AS_OF, days=14)


SPIKE = f"""
select *, prev_total >= 10 and last_total >= 5 and baseline > 0 as judged,
  case when prev_total >= 10 and last_total >= 5 and baseline > 0 then "current" / baseline else 0.0 end as ratio
from (
  select *, coalesce(last_failed / nullif(last_total, 0), 0.0) as "current",
    coalesce(prev_failed / nullif(prev_total, 0), 0.0) as baseline
  from (
    select count(*) filter (created_at >= {NOW} - interval 1 day) as last_total,
      count(*) filter (created_at >= {NOW} - interval 1 day and total_hits <= 0) as last_failed,
      count(*) filter (created_at >= {NOW} - interval 8 day and created_at < {NOW} - interval 1 day) as prev_total,
      count(*) filter (created_at >= {NOW} - interval 8 day and created_at < {NOW} - interval 1 day and total_hits <= 0) as prev_failed
    from logs))"""


@query("e5_failure_spike", sql("""
select last_total, last_failed, prev_total, prev_failed, round("current", 6) as "current", round(baseline, 6) as baseline,
  round(ratio, 6) as ratio, judged and ratio >= 1.5 as is_spike from spike""", "logs", spike=SPIKE))
def e5(t: Tables) -> DataFrame:
    out = ql.failure_spike(t.logs, AS_OF)
    for c in ("current", "baseline", "ratio"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("e16_paged", sql(f"""
select id, user_id, query, total_hits, total_hits = 0 as is_failed, search_type, {stamp('created_at')} as created_at,
  (select count(*) from logs) as total
from logs order by logs.created_at desc, id desc limit 50 offset 100""", "logs"))
def e16(t: Tables) -> DataFrame:
    return ql.list_search_logs(t.logs, skip=100, limit=50).withColumn("created_at", ts("created_at"))


RECENT = """
select user_id, query, max(created_at) as created_at from logs where trim(query) <> '' group by 1, 2
qualify row_number() over (partition by user_id order by max(created_at) desc, query) <= 20"""


@query("w1_recent_searches", sql(
    f"select user_id, query, {stamp('created_at')} as created_at from recent", "logs", recent=RECENT))
def w1(t: Tables) -> DataFrame:
    return ql.recent_searches(t.logs, keep=20).withColumn("created_at", ts("created_at"))


@query("w2_recent_for_and_forget", sql(f"""
select user_id, query, {stamp('created_at')} as created_at
from (select * from recent where user_id = '7' and query <> 'view 3' order by created_at desc, query limit 10)
union all
select user_id, 'rows kept', cast(count(*) as varchar) from recent where user_id <> '7' group by 1""",
    "logs", recent=RECENT))
def w2(t: Tables) -> DataFrame:
    recent = ql.recent_searches(t.logs)
    shown = ql.recent_for(ql.forget(recent, "7", "view 3"), "7", 10).select("user_id", "query", ts("created_at"))
    rest = ql.forget(recent, "7").groupBy("user_id").agg(F.count("*").cast("string").alias("created_at"))
    return shown.unionByName(rest.select("user_id", F.lit("rows kept").alias("query"), "created_at"))


@query("w3_recommend", sql(f"""
select user_id, row_number() over (partition by user_id order by pri, rk) as rank, keyword from (
  select user_id, keyword, min(pri) as pri, min_by(rk, pri) as rk from (
    select user_id, query as keyword, 1 as pri, row_number() over (partition by user_id order by created_at desc, query) as rk
    from recent qualify rk <= 10
    union all
    select u.user_id, p.keyword, 2, p.rk from (select distinct user_id from logs) u, pop p)
  group by 1, 2)
qualify rank <= 10""", "logs", recent=RECENT, pop=f"""
select query as keyword, row_number() over (order by count(*) desc, query) as rk from logs
where created_at >= {NOW} - interval 14 day group by query order by rk limit 10"""))
def w3(t: Tables) -> DataFrame:
    out = ql.recommend(t.logs.select("user_id"), ql.recent_searches(t.logs), t.logs, AS_OF, limit=10)
    return out.withColumn("rank", F.col("rank").cast("long"))


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(trim(lower({x})), '\\s+'), lambda w: length(w) >= 2))"


def _grams(x: str) -> str:
    return (f"case when length({x}) >= 2 then list_distinct(list_transform(range(1, length({x})), lambda i: {x}[i:i + 1])) "
            f"when length({x}) = 1 then [{x}] else [] end")


RELATED = dict(
    ranked=f"select query, count(*) as cnt from logs where created_at >= {NOW} - interval 30 day group by 1",
    best=f"""
select query, cnt, c, {_tokens('query')} as toks, {_grams('c')} as grams
from (select query, cnt, {compact('query')} as c from ranked) where c <> ''
qualify row_number() over (partition by c order by cnt desc, query) = 1""",
    needles="""
select keyword as needle from (select keyword from popular order by cnt desc, keyword limit 10)
union select left(item, 1) from (select event_type as item from events)
union select 'nothing like it' """,
    asks=f"select needle, n, {_tokens('needle')} as toks, {_grams('n')} as grams from (select needle, {compact('needle')} as n from needles)",
    scored="""
select a.needle, b.query,
  round(100.0 * len(list_intersect(a.toks, b.toks)) / greatest(1, len(list_distinct(list_concat(a.toks, b.toks))))
  + 60.0 * len(list_intersect(a.grams, b.grams)) / greatest(1, len(list_distinct(list_concat(a.grams, b.grams))))
  + case when contains(a.n, b.c) or contains(b.c, a.n) then 20.0 else 0.0 end + least(b.cnt, 50), 6) as score
from asks a, best b
where a.n <> b.c and (len(list_intersect(a.toks, b.toks)) > 0 or len(list_intersect(a.grams, b.grams)) > 0
  or contains(a.n, b.c) or contains(b.c, a.n))""",
    related="""
select needle, row_number() over (partition by needle order by score desc, query) as rank, query as keyword, score, false as is_fallback
from scored where score >= 12 qualify rank <= 10""",
    fallback="""
select needle, row_number() over (partition by needle order by cnt desc, query) as rank, query as keyword, 0.0 as score, true as is_fallback
from asks, (select query, cnt from ranked order by cnt desc, query limit 20)
where needle not in (select needle from related) and query <> needle qualify rank <= 10""",
)


@query("w4_related_keywords", sql("select * from related union all select * from fallback", "popular", **RELATED))
def w4(t: Tables) -> DataFrame:
    top = ql.popular_keywords(t.logs, AS_OF, days=7, limit=10).select(F.col("keyword").alias("needle"))
    initials = t("events").select(F.substring("event_type", 1, 1).alias("needle")).distinct()
    alone = t("events").select(F.lit("nothing like it").alias("needle")).distinct()
    out = ql.related_keywords(top.union(initials).union(alone), t.logs, AS_OF)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("c10_search_rows", sql(
    "select id, user_id, query, total_hits from logs where contains(lower(user_id), 'view 1') or contains(lower(query), 'view 1')",
    "logs"))
def c10(t: Tables) -> DataFrame:
    return fl.search_rows(t.logs, ["user_id", "query"], " VIEW 1").select("id", "user_id", "query", "total_hits")


@query("c11_list_history", sql(f"""
select id, source_type, source_name, action, status, {stamp('created_at')} as created_at from history
where action = 'sync_summary' and source_type = 'smb' and status = 'fail'
order by history.created_at desc, id desc limit 100""", "history"))
def c11(t: Tables) -> DataFrame:
    rows = fl.list_history(t.history, source_type="smb", status="fail", limit=100)
    return rows.withColumn("created_at", ts("created_at"))


@query("c13_purge", sql(f"""
select count(*) filter (created_at >= {NOW} - interval 10 day) as kept,
  count(*) filter (created_at < {NOW} - interval 10 day) as deleted from history""", "history"))
def c13(t: Tables) -> DataFrame:
    kept, deleted = fl.purge(t.history, "created_at", AS_OF, 10)
    return kept.agg(F.count("*").alias("kept")).select("kept", deleted.scalar().alias("deleted"))
