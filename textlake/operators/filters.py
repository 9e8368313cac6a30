"""Filters. Every `*_matches` takes columns, so a whole table of requests can bring
its own values; the `filter_*` forms take one value for a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lit_of, normalize_category, normalize_ext, sanitize, strip
from .postings import Index, match_phrase
from .querylog import at

# queries tested against one document at a time
NEEDLES = 1000
PRESETS = {"1d": {"days": 1}, "7d": {"days": 7}, "1m": {"months": 1}}


def category_matches(column: Column, wanted: Column | str) -> Column:
    """Exact match after normalisation of both sides; an empty wish matches all."""
    wish = normalize_category(lit_of(wanted))
    return (wish == "") | (normalize_category(column) == wish)


def filter_category(docs: DataFrame, category: str) -> DataFrame:
    return docs.filter(category_matches(F.col("doc_category"), category))


def ext_matches(column: Column, wanted: Column | str) -> Column:
    """The wished extension ends the stored one, any case, leading dots ignored."""
    wish = normalize_ext(lit_of(wanted))
    return (wish == "") | F.lower(F.coalesce(column, F.lit(""))).endswith(wish)


def filter_ext(docs: DataFrame, ext: str) -> DataFrame:
    return docs.filter(ext_matches(F.col("file_ext"), ext))


def date_matches(ts: Column, gte, lte, legacy: Column | None = None) -> Column:
    """Inclusive range, either bound may be null. A legacy string date also counts."""
    low, high = lit_of(gte).cast("timestamp"), lit_of(lte).cast("timestamp")

    def inside(c: Column) -> Column:
        return F.coalesce((low.isNull() | (c >= low)) & (high.isNull() | (c <= high)), F.lit(False))

    out = inside(ts)
    if legacy is not None:
        out = out | inside(F.try_to_timestamp(legacy))
    return out | (low.isNull() & high.isNull())


def filter_dates(docs: DataFrame, gte=None, lte=None, column: str = "indexed_at",
                 legacy: str | None = None) -> DataFrame:
    """Date range on one frame. Without a legacy column the bounds are plain
    comparisons that reach the Parquet scan."""
    if legacy is not None:
        return docs.filter(date_matches(F.col(column), gte, lte, F.col(legacy)))
    if gte is not None:
        docs = docs.filter(F.col(column) >= lit_of(gte).cast("timestamp"))
    if lte is not None:
        docs = docs.filter(F.col(column) <= lit_of(lte).cast("timestamp"))
    return docs


def preset_start(as_of, preset: str) -> Column:
    """Lower bound of a preset period: one day, seven days or a month before `as_of`."""
    step = PRESETS[preset]
    if "months" in step:
        return F.timestamp_add("MONTH", F.lit(-step["months"]), at(as_of))
    return F.timestamp_add("DAY", F.lit(-step["days"]), at(as_of))


def keyword_rows(requests: DataFrame, column: str, role: str) -> DataFrame:
    """(qid, kid, keyword) of an array column, sanitised, blanks dropped."""
    return (
        requests.select("qid", F.posexplode(column).alias("i", "k"))
        .select("qid", F.concat(F.lit(role), F.col("i").cast("string")).alias("kid"), sanitize("k").alias("keyword"))
        .filter(F.col("keyword") != "")
    )


def _phrase_docs(index: Index, keywords: DataFrame) -> DataFrame:
    """(qid, doc_id, kid) for phrase hits in any field."""
    return match_phrase(index, keywords).select("qid", "doc_id", "kid").distinct()


def include_all(hits: DataFrame, keywords: DataFrame, phrase_docs: DataFrame) -> DataFrame:
    """Hits whose document holds every include keyword of its request. Requests without
    include keywords pass untouched."""
    need = keywords.groupBy("qid").agg(F.count_distinct("kid").alias("need"))
    have = phrase_docs.groupBy("qid", "doc_id").agg(F.count_distinct("kid").alias("have"))
    return (
        hits.join(need, "qid", "left").join(have, ["qid", "doc_id"], "left")
        .filter(F.col("need").isNull() | (F.col("have") == F.col("need")))
        .drop("need", "have")
    )


def exclude_any(hits: DataFrame, phrase_docs: DataFrame) -> DataFrame:
    """Hits whose document holds none of the exclude keywords of its request."""
    return hits.join(phrase_docs.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")


def include_keywords(hits: DataFrame, requests: DataFrame, index: Index) -> DataFrame:
    rows = keyword_rows(requests, "include_keywords", "i")
    return include_all(hits, rows, _phrase_docs(index, rows))


def exclude_keywords(hits: DataFrame, requests: DataFrame, index: Index) -> DataFrame:
    return exclude_any(hits, _phrase_docs(index, keyword_rows(requests, "exclude_keywords", "e")))


def filter_author(docs: DataFrame, author: str, column: str = "author") -> DataFrame:
    return docs.filter(F.col(column) == author) if author else docs


def min_score(hits: DataFrame, default: float, override: Column | float | None = None) -> DataFrame:
    """Score floor: the request's own when above zero, else the configured one."""
    floor = F.lit(default)
    if override is not None:
        own = lit_of(override)
        floor = F.when(own > 0, own).otherwise(floor)
    return hits.filter(F.col("score") >= floor)


def prefer_exact(hits: DataFrame) -> DataFrame:
    """For corrected queries: where some hit holds the corrected query literally, only
    such hits stay. Needs is_typo_corrected and exact. The per-query flag is a small
    aggregate joined back, so no query's hits have to meet in one task."""
    any_exact = (
        hits.filter(F.col("is_typo_corrected") & F.col("exact")).select("qid").distinct()
        .withColumn("_narrow", F.lit(True))
    )
    return (
        hits.join(any_exact, "qid", "left")
        .filter(F.col("_narrow").isNull() | F.col("exact")).drop("_narrow")
    )


def require_exact_names(hits: DataFrame) -> DataFrame:
    """For name-like queries only hits that hold the query literally stay."""
    return hits.filter(~F.col("is_name_like") | F.col("exact"))


def with_exact(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds `exact` to hits with corrected_query: whether the document holds it literally.

    The different queries asked of a document are gathered, in parts of bounded size, and
    tested where its text is read; only booleans come back to the hits, so no text is
    joined with them and a document that many requests hit is searched once a query."""
    asks = F.coalesce(F.col("is_typo_corrected") | F.col("is_name_like"), F.lit(False))
    asked = hits.filter(asks).select("doc_id", "corrected_query").filter("corrected_query is not null").distinct()
    # a part of a document's queries; each has about NEEDLES at most
    counts = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / NEEDLES).alias("_parts"))
    needles = asked.join(counts, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("corrected_query"), F.col("_parts")).alias("_part")).agg(
        F.collect_list("corrected_query").alias("_needles"))

    def tested(text: Column) -> Column:
        def one(raw: Column) -> Column:
            needle = F.lower(strip(raw))
            held = (raw != "") & (text["title"].contains(needle) | text["body"].contains(needle))
            return F.struct(raw.alias("corrected_query"), held.alias("exact"))
        return F.transform("_needles", one)

    lowered = F.struct(F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("all_text", F.lit(""))).alias("body"))
    answers = docs.select("doc_id", "title", "all_text").join(needles, "doc_id").select(
        "doc_id", F.explode(let(lowered, tested)).alias("a")).select("doc_id", "a.corrected_query", F.col("a.exact").alias("_exact"))
    told = hits.filter(asks).join(answers, ["doc_id", "corrected_query"], "left").withColumn(
        "exact", F.coalesce("_exact", F.lit(False))).drop("_exact")
    return hits.filter(~asks).withColumn("exact", F.lit(False)).unionByName(told)


def search_rows(df: DataFrame, columns: Sequence[str], keyword: str) -> DataFrame:
    """Rows with the keyword in any of the columns, any case."""
    needle = F.lower(F.trim(F.lit(keyword)))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
    return df.filter(hit)


def _equals(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == value)
    return df


def list_history(history: DataFrame, source_type=None, source_name=None, status=None, limit: int = 100) -> DataFrame:
    """Run summaries, newest first."""
    rows = _equals(history.filter(F.col("action") == "sync_summary"),
                   source_type=source_type, source_name=source_name, status=status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def list_events(events: DataFrame, source_type=None, source_name=None, event_type=None, limit: int = 100) -> DataFrame:
    rows = _equals(events, source_type=source_type, source_name=source_name, event_type=event_type)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def list_sync_history(history: DataFrame, source_id=None, limit: int = 50) -> DataFrame:
    return _equals(history, source_id=source_id).orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def purge(df: DataFrame, ts: str, as_of, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number deleted) for a retention of `days`."""
    cutoff = F.timestamp_add("DAY", F.lit(-days), at(as_of))
    old = F.coalesce(F.col(ts) < cutoff, F.lit(False))
    return df.filter(~old), df.filter(old).agg(F.count("*").alias("deleted"))


def list_active(df: DataFrame, order: Sequence[str], flag: str = "is_active") -> DataFrame:
    return df.filter(F.col(flag)).orderBy(*order)
