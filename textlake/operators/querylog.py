"""Query-log analytics: popularity, failures, trend, recent, recommended and related
queries. All windows end at `as_of`, which stands in for the clock."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, char_ngrams, compact, strip, token_set

# ---------------------------------------------------------------- fixed values
ANONYMOUS = "anonymous"
KEEP_RECENT = 20
# ------------------------------------------------------------------------------


def at(as_of: str | datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def since(as_of, **interval: int) -> Column:
    return at(as_of) - F.make_dt_interval(**{k: F.lit(v) for k, v in interval.items()})


def failed() -> Column:
    """Failure is no hits; the stored flag is not used in aggregates."""
    return F.coalesce(F.col("total_hits"), F.lit(0)) <= 0


def append_search_logs(hits: DataFrame) -> DataFrame:
    """Log rows of answered requests: blank queries dropped, failure flag kept or
    derived from the hit count, missing users anonymous. Input: query, total_hits,
    user_id, created_at, optional is_failed and search_type."""
    flag = F.col("total_hits") == 0
    if "is_failed" in hits.columns:
        flag = F.coalesce(F.col("is_failed"), flag)
    kind = F.lit("manual_search")
    if "search_type" in hits.columns:
        kind = F.coalesce(F.col("search_type"), kind)
    return hits.filter(~blank("query")).select(
        F.when(F.coalesce("user_id", F.lit("")) == "", ANONYMOUS).otherwise(F.col("user_id")).alias("user_id"),
        strip("query").alias("query"),
        F.col("total_hits"),
        flag.alias("is_failed"),
        kind.alias("search_type"),
        F.col("created_at"),
    )


def save_search_logs(hits: DataFrame, path: str) -> None:
    """Append log rows, partitioned by day so that time windows prune folders. Rows are
    ranged by time first, so a task writes few days and a busy day takes several tasks."""
    rows = append_search_logs(hits).withColumn("log_date", F.to_date("created_at"))
    rows.repartitionByRange("log_date", "created_at").write.mode("append").partitionBy("log_date").parquet(path)


def read_search_logs(spark: SparkSession, path: str, as_of, **interval: int) -> DataFrame:
    """Stored log rows from `interval` before `as_of` on. The bound on the day prunes
    folders; rows without a time lie in no window."""
    begin = since(as_of, **interval)
    stored = spark.read.parquet(path)
    return stored.filter((F.col("log_date") >= F.to_date(begin)) & (F.col("created_at") >= begin)).drop("log_date")


def _ranked_counts(logs: DataFrame, limit: int | None) -> DataFrame:
    counts = logs.groupBy(F.col("query").alias("keyword")).agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc("keyword"))
    return ordered if limit is None else ordered.limit(limit)


def popular_keywords(logs: DataFrame, as_of, days: int = 7, limit: int | None = None) -> DataFrame:
    return _ranked_counts(logs.filter(F.col("created_at") >= since(as_of, days=days)), limit)


def failed_keywords(logs: DataFrame, as_of, days: int = 7, limit: int | None = 10) -> DataFrame:
    window = logs.filter((F.col("created_at") >= since(as_of, days=days)) & (F.col("total_hits") <= 0))
    return _ranked_counts(window, limit)


def search_summary(logs: DataFrame, as_of, days: int = 7, top: int = 10) -> DataFrame:
    """One row. The totals cover all logs, the two top lists only the last days."""
    def top_list(ranked: DataFrame) -> Column:
        # at most `top` entries, put back in rank order
        entry = F.struct((-F.col("count")).alias("order"), "keyword", "count")
        packed = ranked.agg(F.array_sort(F.collect_list(entry)).alias("x"))
        return packed.select(F.transform(
            "x", lambda e: F.struct(e["keyword"].alias("keyword"), e["count"].alias("count")))).scalar()

    totals = logs.agg(F.count("*").alias("total_logs"), F.count_if(failed()).alias("failed_logs"))
    return totals.select(
        F.lit(days).alias("days"), "total_logs", "failed_logs",
        F.when(F.col("total_logs") > 0, F.col("failed_logs") / F.col("total_logs")).otherwise(0.0).alias("failure_rate"),
        top_list(popular_keywords(logs, as_of, days, top)).alias("top_keywords"),
        top_list(failed_keywords(logs, as_of, days, top)).alias("top_failed_keywords"),
    )


def search_trend(logs: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Total, failed and successful searches per day, days with searches only."""
    return (
        logs.filter(F.col("created_at") >= since(as_of, days=days))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count("*").alias("total"), F.count_if(failed()).alias("failed"))
        .withColumn("success", F.col("total") - F.col("failed"))
        .orderBy("date")
    )


def failure_spike(logs: DataFrame, as_of, ratio: float = 1.5) -> DataFrame:
    """Failure rate of the last 24 hours against the seven days before, in one scan."""
    ts = F.col("created_at")
    last = ts >= since(as_of, days=1)
    prev = (ts >= since(as_of, days=8)) & (ts < since(as_of, days=1))
    agg = logs.filter(ts >= since(as_of, days=8)).agg(
        F.count_if(last).alias("last_total"), F.count_if(last & failed()).alias("last_failed"),
        F.count_if(prev).alias("prev_total"), F.count_if(prev & failed()).alias("prev_failed"),
    )

    def rate(part: str) -> Column:
        total = F.col(f"{part}_total")
        return F.when(total > 0, F.col(f"{part}_failed") / total).otherwise(0.0)

    judged = (F.col("prev_total") >= 10) & (F.col("last_total") >= 5) & (F.col("baseline") > 0)
    return (
        agg.withColumn("current", rate("last")).withColumn("baseline", rate("prev"))
        .withColumn("ratio", F.when(judged, F.col("current") / F.col("baseline")).otherwise(0.0))
        .withColumn("is_spike", judged & (F.col("ratio") >= ratio))
    )


def recent_searches(logs: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """(user_id, query, created_at): each user's queries at their latest time, the
    newest `keep` per user. The rank filter is applied before the shuffle as well, so a
    user with very many queries sends at most `keep` rows per task."""
    latest = (
        logs.filter(~blank("query"))
        .groupBy(
            F.when(F.coalesce("user_id", F.lit("")) == "", ANONYMOUS).otherwise(F.col("user_id")).alias("user_id"),
            strip("query").alias("query"))
        .agg(F.max("created_at").alias("created_at"))
    )
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("query"))
    return latest.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= keep).drop("rn")


def merge_recent(recent: DataFrame, logs: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """Recent searches after more log rows."""
    cols = ["user_id", "query", "created_at"]
    return recent_searches(recent.select(cols).unionByName(logs.select(cols)), keep)


def recent_for(recent: DataFrame, user: str, n: int = 10) -> DataFrame:
    return (
        recent.filter(F.col("user_id") == (user or ANONYMOUS))
        .orderBy(F.desc("created_at"), F.asc("query")).limit(n)
    )


def forget(recent: DataFrame, user: str, query: str | None = None) -> DataFrame:
    """Recent searches without one of the user's queries, or without the user."""
    gone = F.col("user_id") == (user or ANONYMOUS)
    if query is not None:
        gone = gone & (F.col("query") == strip(F.lit(query)))
    return recent.filter(~gone)


def _popular_array(logs: DataFrame, as_of, days: int, limit: int) -> Column:
    """The popular list as one array value of at most `limit` entries."""
    top = popular_keywords(logs, as_of, days, limit)
    packed = top.agg(F.array_sort(F.collect_list(
        F.struct((-F.col("count")).alias("order"), "keyword"))).alias("x"))
    return packed.select(F.transform("x", lambda e: e["keyword"])).scalar()


def recommend(users: DataFrame, recent: DataFrame, logs: DataFrame, as_of, limit: int = 10,
              days: int = 14) -> DataFrame:
    """(user_id, rank, keyword): the user's recent queries, newest first, then popular
    ones, each once. Lists hold at most `limit` entries before they are merged."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("query"))
    own = (
        recent.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= limit)
        .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "query"))).alias("own"))
    )
    mine = F.coalesce(F.transform("own", lambda e: e["query"]), F.array().cast("array<string>"))
    merged = F.slice(
        F.array_distinct(F.concat(mine, _popular_array(logs, as_of, days, limit))), 1, limit)
    return (
        users.select("user_id").distinct().join(own, "user_id", "left")
        .select("user_id", F.posexplode(merged).alias("pos", "keyword"))
        .select("user_id", (F.col("pos") + 1).alias("rank"), "keyword")
    )


def _chars(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(col, ""), lambda c: c != ""))


def _features(tokens: Column, grams: Column, body: Column, single_tag: str, any_tag: str) -> Column:
    """Everything two related queries must have in common, as tagged strings: a token,
    a bigram, or, where one of the two is a single character, that character."""
    def tag(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(f"{prefix}:"), v))
    none = F.array().cast("array<string>")
    single = F.when(F.length(body) == 1, F.array(body)).otherwise(none)
    return F.concat(tag("t", tokens), tag("g", grams), tag(single_tag, single), tag(any_tag, _chars(body)))


def related_keywords(needles: DataFrame, logs: DataFrame, as_of, days: int = 30, limit: int = 10,
                     min_score: float = 12.0) -> DataFrame:
    """(needle, rank, keyword, score, is_fallback) for a table of needles.

    score = 100 token-Jaccard + 60 bigram-Jaccard + 20 if one compact form contains the
    other + min(count, 50). Queries with the same compact form count as one, the most
    frequent; needles without any hit get the popular list.

    The log shrinks to distinct compact forms first. Pairs come from an equi-join on
    shared features, and since a query's features are exploded in place, the overlaps
    are summed before the shuffle."""
    folded = strip(F.lower(F.col("query")))
    best = (
        logs.filter(F.col("created_at") >= since(as_of, days=days))
        .groupBy("query").agg(F.count("*").alias("cnt"))
        .groupBy(compact(F.col("query")).alias("c_compact"))
        .agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "query")).alias("b"))
        .filter(F.col("c_compact") != "")
        .select(F.col("b.query").alias("query"), (-F.col("b.neg")).alias("cnt"), "c_compact")
    )
    cands = (
        best.withColumn("_t", token_set(folded)).withColumn("_g", char_ngrams(folded))
        .select(
            "query", "cnt", "c_compact", F.size("_t").alias("c_t"), F.size("_g").alias("c_g"),
            F.explode(_features(F.col("_t"), F.col("_g"), F.col("c_compact"), "a", "b")).alias("feature"))
    )
    wanted = needles.select(strip("needle").alias("needle")).filter(F.col("needle") != "").distinct()
    asks = (
        wanted.withColumn("n_compact", compact("needle"))
        .withColumn("_t", token_set("needle")).withColumn("_g", char_ngrams("needle"))
        .filter((F.size("_t") > 0) | (F.size("_g") > 0))
    )
    ask_features = asks.select(
        "needle", "n_compact", F.size("_t").alias("n_t"), F.size("_g").alias("n_g"),
        F.explode(_features(F.col("_t"), F.col("_g"), F.col("n_compact"), "b", "a")).alias("feature"))
    pairs = (
        cands.join(ask_features, "feature")
        .filter(F.col("c_compact") != F.col("n_compact"))
        .groupBy("needle", "query")
        .agg(
            F.count_if(F.col("feature").startswith("t:")).alias("tok"),
            F.count_if(F.col("feature").startswith("g:")).alias("gram"),
            *[F.max(c).alias(c) for c in ("cnt", "c_compact", "n_compact", "c_t", "c_g", "n_t", "n_g")],
        )
    )

    def jaccard(shared: str, a: str, b: str) -> Column:
        union = F.greatest(F.lit(1), F.col(a) + F.col(b) - F.col(shared))
        return F.col(shared) / union

    inside = (F.col("n_compact") != "") & (
        F.col("c_compact").contains(F.col("n_compact")) | F.col("n_compact").contains(F.col("c_compact")))
    score = (
        jaccard("tok", "c_t", "n_t") * 100 + jaccard("gram", "c_g", "n_g") * 60
        + F.when(inside, 20.0).otherwise(0.0) + F.least(F.col("cnt"), F.lit(50))
    )
    by_score = Window.partitionBy("needle").orderBy(F.desc("score"), F.asc("query"))
    related = (
        pairs.filter((F.col("tok") > 0) | (F.col("gram") > 0) | inside)
        .withColumn("score", F.round(score, 6)).filter(F.col("score") >= min_score)
        .withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= limit)
        .select("needle", "rank", F.col("query").alias("keyword"), "score", F.lit(False).alias("is_fallback"))
    )
    popular = _popular_array(logs, as_of, days, max(limit * 2, 10))
    fallback = (
        asks.select("needle").join(related.select("needle").distinct(), "needle", "left_anti")
        .withColumn("_rest", F.array_remove(F.array_remove(popular, ""), F.col("needle")))
        .select("needle", F.posexplode(F.slice("_rest", 1, limit)).alias("pos", "keyword"))
        .select("needle", (F.col("pos") + 1).alias("rank"), "keyword",
                F.lit(0.0).alias("score"), F.lit(True).alias("is_fallback"))
    )
    return related.unionByName(fallback)


def paged(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 20) -> DataFrame:
    """One page in the given order, with the table's `total`. Sort and limit fuse into
    a per-task top-(skip + limit), so no global sort happens."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).offset(skip).limit(limit).withColumn("total", total)


def list_search_logs(logs: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """Newest log rows with the failure flag recomputed from the hit count."""
    shown = logs.withColumn("is_failed", F.coalesce("total_hits", F.lit(0)) == 0)
    return paged(shown, [F.desc("created_at"), F.desc("id")], skip, limit)
