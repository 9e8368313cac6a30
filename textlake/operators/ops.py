"""Operations tables: sources, volumes, schedules, run summaries, alerts, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .querylog import at

# ---------------------------------------------------------------- fixed values
DELETED_SOURCE = "(삭제됨)"
DEFAULT_INTERVAL = 1440
SHOWN_FAILURES = 8
SCHEDULER_STOPPED = "자동 색인 스케줄러 중지"
EXPIRED = "만료 인증서 "
DUE = "일 내 만료 인증서 "
ITEMS = "건"
FAILURES_RISE = "실패율 급등 감지 "
TIMES = "배"
HEALTHY = "운영 상태 정상"
AND_MORE = " 외 "
HEADLINE = ("총 ", "건 (성공 ", " / 실패 ", " / 스킵 ", " / 변경없음 ", ")")
# ------------------------------------------------------------------------------
SOURCE_KEY = ["source_type", "source_id"]


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def resolve_volumes(sources: DataFrame, volumes: DataFrame) -> DataFrame:
    """(id, name, target_volume, target_index, status) per source: the alias is tried
    first, then the index name. status: none (no target), missing, inactive, ok."""
    target = F.nullif(F.trim("target_volume"), F.lit(""))

    def side(key: str, tag: str) -> DataFrame:
        # one row per name, whatever the volume table holds
        return volumes.groupBy(F.col(key).alias("_target")).agg(F.min_by(
            F.struct("index_name", "is_active"), "index_name").alias(tag))

    out = (
        sources.withColumn("_target", target)
        .join(side("alias_name", "_a"), "_target", "left").join(side("index_name", "_i"), "_target", "left")
        .withColumn("_v", F.coalesce("_a", "_i"))
    )
    status = (
        F.when(F.col("_target").isNull(), "none").when(F.col("_v").isNull(), "missing")
        .when(~F.col("_v.is_active"), "inactive").otherwise("ok")
    )
    return out.select("id", "name", F.col("_target").alias("target_volume"),
                      F.when(status == "ok", F.col("_v.index_name")).alias("target_index"), status.alias("status"))


def typed_sources(smb: DataFrame, db: DataFrame) -> DataFrame:
    def one(kind: str, sources: DataFrame) -> DataFrame:
        return sources.select(F.lit(kind).alias("source_type"), F.col("id").alias("source_id"),
                              F.col("name").alias("source_name"), "is_active")
    return one("smb", smb).unionByName(one("db", db))


def list_schedules(entries: DataFrame, smb: DataFrame, db: DataFrame) -> DataFrame:
    """Schedules with their source's name, in (type, id) order."""
    names = typed_sources(smb, db).drop("is_active")
    return (
        entries.join(names, SOURCE_KEY, "left")
        .withColumn("source_name", F.coalesce("source_name", F.lit(DELETED_SOURCE)))
        .orderBy(*SOURCE_KEY)
    )


def missing_schedules(smb: DataFrame, db: DataFrame, entries: DataFrame, as_of,
                      interval: int = DEFAULT_INTERVAL) -> DataFrame:
    """New schedule rows for active sources without one."""
    lacking = typed_sources(smb, db).filter("is_active").join(entries.select(SOURCE_KEY), SOURCE_KEY, "left_anti")
    return lacking.select(
        *SOURCE_KEY, F.lit(interval).alias("interval_minutes"), F.lit(True).alias("is_enabled"),
        plus_minutes(at(as_of), F.lit(interval)).alias("next_run_at"))


def normalize_path(col: Column) -> Column:
    """Lower case, one kind of slash, none at the end."""
    return F.regexp_replace(F.trim(F.lower(F.translate(F.coalesce(col, F.lit("")), "\\", "/"))), "/+$", "")


def attribute_paths(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, source_name): the watched root with the longest path above or at each
    changed path, else "local". A path meets the roots by equality on its ancestors,
    so there is no range join, and the work grows with the depth of a path."""
    parts = F.split(normalize_path(F.col("path")), "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    watched = (
        roots.select(normalize_path(F.col("root")).alias("ancestor"), "source_name")
        .filter(F.col("ancestor") != "").groupBy("ancestor").agg(F.min("source_name").alias("source_name"))
    )
    paths = changes.select("path").distinct()
    found = (
        paths.select("path", F.explode(steps).alias("ancestor")).join(watched, "ancestor")
        .groupBy("path").agg(F.max_by("source_name", F.length("ancestor")).alias("source_name"))
    )
    return changes.join(found, "path", "left").withColumn(
        "source_name", F.coalesce("source_name", F.lit("local")))


def volume_usage(volumes: DataFrame, sources: DataFrame) -> DataFrame:
    """(index_name, alias_name, linked, linked_active) per volume."""
    used = sources.groupBy(F.col("target_volume").alias("alias_name")).agg(
        F.count("*").alias("linked"), F.count_if("is_active").alias("linked_active"))
    return volumes.join(used, "alias_name", "left").select(
        "index_name", "alias_name", F.coalesce("linked", F.lit(0)).alias("linked"),
        F.coalesce("linked_active", F.lit(0)).alias("linked_active"))


def sync_schedules(entries: DataFrame, toggles: DataFrame, as_of, interval: int = DEFAULT_INTERVAL) -> DataFrame:
    """Schedules after sources were switched on or off. On: enabled, created if absent,
    next run filled only where empty. Off: disabled."""
    both = entries.withColumn("_old", F.lit(True)).join(
        toggles.select(*SOURCE_KEY, F.col("is_active").alias("_on")), SOURCE_KEY, "full_outer")
    minutes = F.coalesce("interval_minutes", F.lit(interval))
    due = plus_minutes(at(as_of), minutes)
    return both.filter(F.col("_old") | F.col("_on")).select(
        *SOURCE_KEY, minutes.alias("interval_minutes"),
        F.coalesce("_on", "is_enabled").alias("is_enabled"),
        F.when(F.col("_on"), F.coalesce("next_run_at", due)).otherwise(F.col("next_run_at")).alias("next_run_at"),
        "last_run_at")


def expiry_status(df: DataFrame, expires_at: str, as_of, warn_days: int = 7) -> DataFrame:
    """Adds days_left (whole days, rounded down) and health_status."""
    seconds = F.unix_timestamp(expires_at) - F.unix_timestamp(at(as_of))
    days = F.floor(seconds / 86400)
    status = (
        F.when(F.col("days_left").isNull(), "invalid").when(F.col("days_left") < 0, "expired")
        .when(F.col("days_left") <= warn_days, "warning").otherwise("healthy")
    )
    return df.withColumn("days_left", days).withColumn("health_status", status)


def expiry_counts(status: DataFrame, warn_days: int = 7, risk_days: int = 30) -> DataFrame:
    """One row: expired, due within warn_days, and at risk (due within risk_days or in
    any state but healthy)."""
    left = F.col("days_left")
    return status.agg(
        F.count_if(left < 0).alias("expired"),
        F.count_if((left >= 0) & (left <= warn_days)).alias("due"),
        F.count_if((left <= risk_days) | (F.col("health_status") != "healthy")).alias("at_risk"))


def alert_badges(spike: DataFrame, expiry: DataFrame, warn_days: int = 7, scheduler_running: bool = True) -> DataFrame:
    """(code, severity, message): a stopped scheduler, expiry (expired beats due), a
    failure-rate spike, or one "healthy" row. Both inputs are one-row aggregates."""
    expired = expiry.select("expired").scalar()
    due = expiry.select("due").scalar()
    state = spike.select("is_spike", "ratio", expired.alias("expired"), due.alias("due"))

    def badge(code: str, severity: str, *message: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(*message).alias("message"))

    def count(c: str) -> Column:
        return F.col(c).cast("string")

    raised = F.array_compact(F.array(
        F.when(F.lit(not scheduler_running), badge("scheduler_stopped", "critical", F.lit(SCHEDULER_STOPPED))),
        F.when(F.col("expired") > 0, badge("certificate_expired", "critical", F.lit(EXPIRED), count("expired"), F.lit(ITEMS)))
        .when(F.col("due") > 0, badge("certificate_due", "warning", F.lit(f"{warn_days}{DUE}"), count("due"), F.lit(ITEMS))),
        F.when(F.col("is_spike"), badge(
            "failure_rate_spike", "warning", F.lit(FAILURES_RISE), F.format_string("%.2f", "ratio"), F.lit(TIMES))),
    ))
    healthy = F.array(badge("healthy", "info", F.lit(HEALTHY)))
    return state.withColumn("b", F.when(F.size(raised) > 0, raised).otherwise(healthy)).select(F.explode("b").alias("b")).select("b.*")


def _outcome_counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    kinds = {"success": "success", "skipped": "skipped", "unchanged": "unchanged", "failed": "fail"}
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("outcome") == v).alias(k) for k, v in kinds.items()])


def failed_files(outcomes: DataFrame, order: str = "file_name") -> DataFrame:
    """All failed files of a run, one row each, in `order` within their source."""
    return outcomes.filter(F.col("outcome") == "fail").select(
        "source_type", "source_name", "file_name", *([order] if order != "file_name" else []))


def sync_summary(outcomes: DataFrame, trigger: str = "manual", order: str = "file_name",
                 message_limit: int | None = None) -> DataFrame:
    """Run summary per source: counts, status, headline and message with the first
    failed files; `failed_files` lists all of them. Only those few names per source are
    ever gathered; the rank limit works before the shuffle too. A `message_limit` cuts
    names, never the counts, which stand before them."""
    keys = ["source_type", "source_name"]
    counts = _outcome_counts(outcomes, *keys)
    first = Window.partitionBy(*keys).orderBy(order)
    shown = (
        outcomes.filter((F.col("outcome") == "fail") & (F.coalesce("file_name", F.lit("")) != ""))
        .select(*keys, "file_name", *([order] if order != "file_name" else []))
        .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= SHOWN_FAILURES)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "file_name"))).alias("names"))
    )
    status = (
        F.when(F.col("failed") == 0, "success")
        .when((F.col("success") > 0) | (F.col("skipped") > 0), "partial").otherwise("fail")
    )
    n_shown = F.coalesce(F.size("names"), F.lit(0))
    listed = F.array_join(F.transform("names", lambda e: e["file_name"]), ", ")
    more = F.when(F.col("failed") > n_shown, F.concat(
        F.lit(AND_MORE), (F.col("failed") - n_shown).cast("string"), F.lit(ITEMS))).otherwise("")
    files = F.when(n_shown > 0, F.concat(listed, more)).otherwise("")
    message = F.concat(
        F.lit(f"trigger={trigger}, source_id="), F.col("source_name"), F.lit(", total="), F.col("total"), F.lit(", success="), F.col("success"),
        F.lit(", skipped="), F.col("skipped"), F.lit(", unchanged="), F.col("unchanged"),
        F.lit(", failed="), F.col("failed"),
        F.when(files != "", F.concat(F.lit(", failed_files="), files)).otherwise(""))
    headline = F.concat(
        *[x for text, name in zip(HEADLINE, ("total", "success", "failed", "skipped", "unchanged"), strict=False)
          for x in (F.lit(text), F.col(name))], F.lit(HEADLINE[-1]))
    return counts.join(shown, keys, "left").select(
        *keys, "total", "success", "skipped", "unchanged", "failed", status.alias("status"),
        headline.alias("file_name"),
        (message if message_limit is None else F.substring(message, 1, message_limit)).alias("message"))


def sync_all_summary(runs: DataFrame) -> DataFrame:
    """One row: sources synced, successful (status "success") and failed."""
    good = F.count_if(F.col("status") == "success")
    return runs.agg(F.count("*").alias("total_sources"), good.alias("success_sources"),
                    (F.count("*") - good).alias("failed_sources"))


def upload_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Roll-up of upload batches; unlike a sync, skipped files make a batch partial."""
    counts = _outcome_counts(outcomes, *keys)
    status = (
        F.when((F.col("success") == 0) & (F.col("failed") > 0), "fail")
        .when((F.col("failed") > 0) | (F.col("skipped") > 0), "partial").otherwise("success")
    )
    return counts.select(*keys, "total", "success", "skipped", F.col("failed").alias("fail"), status.alias("status"))


def health_counts(smb: DataFrame, db: DataFrame, certificates: DataFrame) -> DataFrame:
    """(kind, total, active) per kind of source, and the certificate rows."""
    sources = typed_sources(smb, db).groupBy(F.col("source_type").alias("kind")).agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"))
    certs = certificates.agg(F.count("*").alias("total")).select(
        F.lit("certificate").alias("kind"), "total", F.col("total").alias("active"))
    return sources.unionByName(certs)


def ops_radar(trend: DataFrame, ceiling: float | None = None) -> DataFrame:
    """One row of dashboard measures from a daily trend; `ceiling`, where given, bounds
    counts for a chart of fixed scale."""
    sums = trend.agg(
        F.coalesce(F.sum("success"), F.lit(0)).alias("s"), F.coalesce(F.sum("failed"), F.lit(0)).alias("f"),
        F.greatest(F.count("*"), F.lit(1)).alias("days"))
    total = F.col("s") + F.col("f")
    rate = F.when(total > 0, F.col("f") / total * 100).otherwise(0.0)

    def capped(c: Column) -> Column:
        value = c.cast("double")
        return value if ceiling is None else F.least(value, F.lit(float(ceiling)))

    return sums.select(
        capped(total).alias("total"), capped(F.col("s")).alias("success"), capped(F.col("f")).alias("failed"),
        capped(total / F.col("days")).alias("daily_mean"), F.greatest(F.lit(0.0), 100 - rate).alias("success_index"))


def docs_today(docs: DataFrame, as_of) -> DataFrame:
    today = F.to_date("indexed_at") == F.to_date(at(as_of))
    return docs.agg(F.count("*").alias("total"), F.count_if(today).alias("today"))


def due_schedules(entries: DataFrame, as_of) -> DataFrame:
    """Enabled schedules that are due, with the run times after running them now."""
    now = at(as_of)
    return entries.filter(F.col("is_enabled") & (F.col("next_run_at") <= now)).select(
        *SOURCE_KEY, "interval_minutes", F.col("next_run_at").alias("was_due_at"), now.alias("last_run_at"),
        plus_minutes(now, F.col("interval_minutes")).alias("next_run_at"))


def previous_value(df: DataFrame, key: str, ts: str, tie: str, value: Column, default: Column,
                   name: str, bucket: str = "day") -> DataFrame:
    """Adds the key's previous `value` in (ts, tie) order. A key's rows are compared
    inside time buckets; across buckets only one row per (key, bucket) travels, so a
    key with a third of all rows spreads over its buckets."""
    cut = df.withColumn("_v", value).withColumn("_b", F.date_trunc(bucket, ts))
    inside = Window.partitionBy(key, "_b").orderBy(ts, tie)
    lasts = cut.groupBy(key, "_b").agg(F.max_by(F.struct("_v"), F.struct(ts, tie)).alias("_l"))
    carried = lasts.withColumn("_c", F.lag("_l").over(Window.partitionBy(key).orderBy("_b"))).select(key, "_b", "_c")
    seen = cut.withColumn("_p", F.lag(F.struct("_v")).over(inside))
    # rows without a key or a time are a bucket like any other
    other = carried.select(F.col(key).alias("_k2"), F.col("_b").alias("_b2"), "_c")
    return (
        seen.join(other, seen[key].eqNullSafe(other["_k2"]) & seen["_b"].eqNullSafe(other["_b2"]))
        .withColumn(name, F.coalesce("_p._v", "_c._v", default)).drop("_v", "_b", "_p", "_c", "_k2", "_b2")
    )


def connectivity_events(probes: DataFrame) -> DataFrame:
    """(key, ts, id, seq, event_type) from a probe log (id, key, ts, ok); every key
    starts out connected."""
    states = previous_value(probes, "key", "ts", "id", F.col("ok"), F.lit(True), "was_ok")
    was, ok = F.col("was_ok"), F.col("ok")
    events = (
        F.when(was & ~ok, F.array(F.lit("disconnect")))
        .when(~was & ok, F.array(F.lit("reconnect_success")))
        .when(~was & ~ok, F.array(F.lit("reconnect_attempt"), F.lit("reconnect_fail")))
    )
    return states.select("key", "ts", "id", F.posexplode(events).alias("seq", "event_type"))
