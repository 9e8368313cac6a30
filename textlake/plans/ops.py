"""Operations queries over sources, volumes, schedules and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import ops
from ..operators import querylog as ql
from ..sources.adapters import AS_OF, Tables
from .ctes import NOW, sql, stamp
from .querylog import SPIKE, ts
from .registry import query


@query("d15_resolve_volumes", sql("""
select s.id, s.name, nullif(s.target_volume, '') as target_volume,
  case when coalesce(a.is_active, i.is_active) then coalesce(a.index_name, i.index_name) end as target_index,
  case when s.target_volume = '' then 'none' when a.index_name is null and i.index_name is null then 'missing'
    when not coalesce(a.is_active, i.is_active) then 'inactive' else 'ok' end as status
from db_sources s left join volumes a on a.alias_name = s.target_volume left join volumes i on i.index_name = s.target_volume""",
    "db_sources", "volumes"))
def d15(t: Tables) -> DataFrame:
    return ops.resolve_volumes(t.db_sources, t.volumes)


NAMES = """select 'smb' as source_type, id as source_id, name as source_name, is_active from smb_sources
union all select 'db', id, name, is_active from db_sources"""


@query("d16_list_schedules", sql(f"""
select source_type, source_id, coalesce(source_name, '(삭제됨)') as source_name, interval_minutes, is_enabled, {stamp('next_run_at')} as next_run_at
from schedules left join names using (source_type, source_id)""", "schedules", "smb_sources", "db_sources", names=NAMES))
def d16(t: Tables) -> DataFrame:
    out = ops.list_schedules(t.schedules, t.smb_sources, t.db_sources)
    return out.select("source_type", "source_id", "source_name", F.col("interval_minutes").cast("long").alias("interval_minutes"),
                      "is_enabled", ts("next_run_at"))


@query("d17_missing_schedules", sql(f"""
select source_type, source_id, 1440 as interval_minutes, true as is_enabled, {stamp(f"({NOW} + interval 1440 minute)")} as next_run_at
from names where is_active and not exists (
  select 1 from schedules s where s.source_type = names.source_type and s.source_id = names.source_id)""",
    "schedules", "smb_sources", "db_sources", names=NAMES))
def d17(t: Tables) -> DataFrame:
    out = ops.missing_schedules(t.smb_sources, t.db_sources, t.schedules, AS_OF)
    return out.withColumn("next_run_at", ts("next_run_at"))


ROOTS = "select '/mnt/' || source as root, source as source_name from documents group by source union all select '/mnt/src1/1', 'deep'"


@query("d18_attribute_paths", sql("""
select path, coalesce((select r.source_name from roots r where lower(p.path) = r.root or starts_with(lower(p.path), r.root || '/')
  order by length(r.root) desc limit 1), 'local') as source_name
from (select case when source_name = 'src2' then '/other' || file_path when source_name = 'src3' then upper(file_path) else file_path end as path
  from listing union all select '/mnt/src1/1/' || source_name || '/' || file_hash from listing) p""", "listing", roots=ROOTS))
def d18(t: Tables) -> DataFrame:
    roots = t("documents").select(F.concat(F.lit("\\mnt\\"), "source").alias("root"), F.col("source").alias("source_name")).distinct()
    deep = t("documents").select(F.lit("/MNT/src1/1/").alias("root"), F.lit("deep").alias("source_name")).distinct()
    path = F.when(F.col("source_name") == "src2", F.concat(F.lit("/other"), "file_path")).when(
        F.col("source_name") == "src3", F.upper("file_path")).otherwise(F.col("file_path"))
    below = F.concat(F.lit("/mnt/src1/1/"), "source_name", F.lit("/"), "file_hash")
    changes = t.listing.select(path.alias("path")).unionByName(t.listing.select(below.alias("path")))
    return ops.attribute_paths(changes, roots.unionByName(deep))


@query("d19_volume_usage", sql("""
select v.index_name, v.alias_name, count(s.id) as linked, count(s.id) filter (s.is_active) as linked_active
from volumes v left join db_sources s on s.target_volume = v.alias_name group by 1, 2""", "volumes", "db_sources"))
def d19(t: Tables) -> DataFrame:
    return ops.volume_usage(t.volumes, t.db_sources)


@query("d20_sync_schedules", sql(f"""
select coalesce(e.source_type, g.source_type) as source_type, coalesce(e.source_id, g.source_id) as source_id,
  coalesce(e.interval_minutes, 1440) as interval_minutes, coalesce(g.is_active, e.is_enabled) as is_enabled,
  {stamp(f"case when g.is_active then coalesce(e.next_run_at, {NOW} + to_minutes(coalesce(e.interval_minutes, 1440))) else e.next_run_at end")} as next_run_at
from schedules e full join names g on e.source_type = g.source_type and e.source_id = g.source_id
where e.source_id is not null or g.is_active""", "schedules", "smb_sources", "db_sources", names=NAMES))
def d20(t: Tables) -> DataFrame:
    toggles = ops.typed_sources(t.smb_sources, t.db_sources)
    out = ops.sync_schedules(t.schedules, toggles, AS_OF)
    return out.select("source_type", "source_id", F.col("interval_minutes").cast("long").alias("interval_minutes"),
                      "is_enabled", ts("next_run_at"))


EXPIRY = f"""
select *, case when days_left is null then 'invalid' when days_left < 0 then 'expired' when days_left <= 1 then 'warning' else 'healthy' end as health_status
from (select cert_name, cast(floor((epoch(expires_at) - epoch({NOW})) / 86400) as bigint) as days_left from certificates)"""
COUNTS = """select count(*) filter (days_left < 0) as expired, count(*) filter (days_left between 0 and 1) as due,
  count(*) filter (days_left <= 30 or health_status <> 'healthy') as at_risk from expiry"""


@query("e6_expiry_status", sql(
    "select cert_name, coalesce(days_left, -999) as days_left, health_status from expiry", "certificates", expiry=EXPIRY))
def e6(t: Tables) -> DataFrame:
    out = ops.expiry_status(t.certificates, "expires_at", AS_OF, warn_days=1)
    return out.select("cert_name", F.coalesce("days_left", F.lit(-999)).alias("days_left"), "health_status")


@query("e6_expiry_counts", sql("select * from counts", "certificates", expiry=EXPIRY, counts=COUNTS))
def e6_counts(t: Tables) -> DataFrame:
    return ops.expiry_counts(ops.expiry_status(t.certificates, "expires_at", AS_OF, warn_days=1), warn_days=1)


@query("e7_alert_badges", sql("""
select 'certificate_expired' as code, 'critical' as severity, '만료 인증서 ' || expired || '건' as message from counts where expired > 0
union all select 'certificate_due', 'warning', '1일 내 만료 인증서 ' || due || '건' from counts where expired = 0 and due > 0
union all select 'failure_rate_spike', 'warning', '실패율 급등 감지 ' || printf('%.2f', ratio) || '배' from spike where judged and ratio >= 0.5
union all select 'healthy', 'info', '운영 상태 정상' from counts, spike where expired = 0 and due = 0 and not (judged and ratio >= 0.5)""",
    "certificates", "logs", expiry=EXPIRY, counts=COUNTS, spike=SPIKE))
def e7(t: Tables) -> DataFrame:
    expiry = ops.expiry_counts(ops.expiry_status(t.certificates, "expires_at", AS_OF, warn_days=1), warn_days=1)
    return ops.alert_badges(ql.failure_spike(t.logs, AS_OF, ratio=0.5), expiry, warn_days=1)


RUNS = """
select source_type, source_name, count(*) as total, count(*) filter (outcome = 'success') as success,
  count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'unchanged') as unchanged,
  count(*) filter (outcome = 'fail') as failed, list(file_name order by file_name) filter (outcome = 'fail') as names
from outcomes group by 1, 2"""


@query("e10_sync_summary", sql("""
select source_type, source_name, total, success, skipped, unchanged, failed,
  case when failed = 0 then 'success' when success > 0 or skipped > 0 then 'partial' else 'fail' end as status,
  '총 ' || total || '건 (성공 ' || success || ' / 실패 ' || failed || ' / 스킵 ' || skipped || ' / 변경없음 ' || unchanged || ')' as file_name,
  'trigger=manual, source_id=' || source_name || ', total=' || total || ', success=' || success || ', skipped=' || skipped || ', unchanged=' || unchanged || ', failed=' || failed
    || case when failed > 0 then ', failed_files=' || array_to_string(names[1:8], ', ')
      || case when failed > 8 then ' 외 ' || (failed - 8) || '건' else '' end else '' end as message
from runs""", "outcomes", runs=RUNS))
def e10(t: Tables) -> DataFrame:
    return ops.sync_summary(t.outcomes)


@query("e11_sync_all_summary", sql("""
select count(*) as total_sources, count(*) filter (failed = 0) as success_sources, count(*) filter (failed > 0) as failed_sources
from runs""", "outcomes", runs=RUNS))
def e11(t: Tables) -> DataFrame:
    return ops.sync_all_summary(ops.sync_summary(t.outcomes))


@query("e12_upload_summary", sql("""
select source_name, total, success, skipped, failed as fail,
  case when success = 0 and failed > 0 then 'fail' when failed > 0 or skipped > 0 then 'partial' else 'success' end as status
from runs""", "outcomes", runs=RUNS))
def e12(t: Tables) -> DataFrame:
    return ops.upload_summary(t.outcomes, "source_name")


@query("e13_health_counts", sql("""
select source_type as kind, count(*) as total, count(*) filter (is_active) as active from names group by 1
union all select 'certificate', count(*), count(*) from certificates""", "smb_sources", "db_sources", "certificates", names=NAMES))
def e13(t: Tables) -> DataFrame:
    return ops.health_counts(t.smb_sources, t.db_sources, t.certificates)


@query("e14_ops_radar", sql(f"""
select total::double as total, (total - failed)::double as success, failed::double as failed,
  (total / greatest(days, 1))::double as daily_mean, round(greatest(0, 100 - failed / total * 100), 6) as success_index
from (select count(*) as total, count(*) filter (total_hits <= 0) as failed, count(distinct cast(created_at as date)) as days
  from logs where created_at >= {NOW} - interval 14 day)""", "logs"))
def e14(t: Tables) -> DataFrame:
    return ops.ops_radar(ql.search_trend(t.logs, AS_OF, 14)).withColumn("success_index", F.round("success_index", 6))


@query("e15_docs_today", sql("""
select count(*) as total, count(*) filter (cast(indexed_at as date) = date '2024-01-01') as today from docs""", "docs"))
def e15(t: Tables) -> DataFrame:
    return ops.docs_today(t.docs, "2024-01-01 15:00:00")


@query("c14_list_active", sql("select id, name, target_volume from smb_sources where is_active", "smb_sources"))
def c14(t: Tables) -> DataFrame:
    return fl.list_active(t.smb_sources, ["id"]).select("id", "name", "target_volume")


@query("w9_due_schedules", sql(f"""
select source_type, source_id, interval_minutes, {stamp('next_run_at')} as was_due_at, {stamp(NOW)} as last_run_at,
  {stamp(f'({NOW} + to_minutes(interval_minutes))')} as next_run_at
from schedules where is_enabled and next_run_at <= {NOW}""", "schedules"))
def w9(t: Tables) -> DataFrame:
    out = ops.due_schedules(t.schedules, AS_OF)
    return out.select("source_type", "source_id", F.col("interval_minutes").cast("long").alias("interval_minutes"),
                      ts("was_due_at"), ts("last_run_at"), ts("next_run_at"))


EVENTS = """
select key, id, ts, unnest(case when was and not ok then ['disconnect'] when not was and ok then ['reconnect_success']
  when not was and not ok then ['reconnect_attempt', 'reconnect_fail'] else [] end) as event_type
from (select *, coalesce(lag(ok) over (partition by key order by ts, id), true) as was from probes)"""


@query("w10_connectivity_events", sql("select key, id, event_type from events_", "probes", events_=EVENTS))
def w10(t: Tables) -> DataFrame:
    return ops.connectivity_events(t.probes).select("key", "id", "event_type")


@query("c12_list_events", sql(f"""
select key as source_name, id, event_type, {stamp('ts')} as created_at from events_ e
where event_type = 'disconnect' and key = 'smb:3' order by e.ts desc, id desc limit 100""", "probes", events_=EVENTS))
def c12(t: Tables) -> DataFrame:
    events = ops.connectivity_events(t.probes).select(
        F.lit("smb").alias("source_type"), F.col("key").alias("source_name"), "id", "event_type", F.col("ts").alias("created_at"))
    out = fl.list_events(events, source_type="smb", source_name="smb:3", event_type="disconnect")
    return out.select("source_name", "id", "event_type", ts("created_at"))


@query("c12_list_sync_history", sql(f"""
select id, source_id, status, {stamp('started_at')} as started_at from (
  select id, id % 7 as source_id, status, created_at as started_at from history) h
where source_id = 3 order by h.started_at desc, id desc limit 50""", "history"))
def c12_sync(t: Tables) -> DataFrame:
    history = t.history.select("id", (F.col("id") % 7).alias("source_id"), "status", F.col("created_at").alias("started_at"))
    return fl.list_sync_history(history, source_id=3).withColumn("started_at", ts("started_at"))
