"""Hybrid search over tables of requests: lexical, chosung and vector scores, request
filters, ranking, paging, facets and highlights."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hangul import is_chosung_query, restore_jamo, to_chosung
from ..functions.highlight import (
    contains_exact,
    fallback_summary,
    highlight,
    highlight_chosung,
)
from ..functions.rewrite import STATIC_SYNONYMS, prepare_queries
from ..functions.text import ext_for_stats, let, sanitize, strip, windows_of
from ..session import materialize
from . import filters as fl
from .postings import (
    DEFAULT_ANALYZER,
    TITLE,
    Analyzer,
    Index,
    build_index,
    field_stats,
    keyword_terms,
    match_any,
    match_keywords,
    prefix_postings,
    prefix_terms,
)
from .vectors import knn

# ---------------------------------------------------------------- fixed values
WEIGHTS = {
    "title_phrase": 20.0,
    "title_and": 10.0,
    "content_phrase": 5.0,
    "content_and": 1.0,
    "vector": 1.0,
    "chosung": 10.0,
    "min_score": 0.0058,
}
RERANK_BOOSTS = {"title": 0.35, "body": 0.15, "popular": 0.10}
UNKNOWN_RANK = 10_000
# ------------------------------------------------------------------------------
CHOSUNG_MODES = ("wildcard", "ngram", "hybrid")
PACK_LIMIT = 1000


@dataclass(frozen=True)
class SearchConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    chosung_mode: str = "wildcard"
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(STATIC_SYNONYMS))
    facet_size: int | None = None


def combine_clauses(matches: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(qid, doc_id, score) of keyword matches: weighted phrase and AND scores of both
    fields, summed over a request's keywords."""
    in_title = F.col("field") == TITLE
    phrase = F.when(in_title, weights["title_phrase"]).otherwise(weights["content_phrase"])
    plain = F.when(in_title, weights["title_and"]).otherwise(weights["content_and"])
    points = phrase * F.col("phrase_score") + plain * F.col("and_score")
    return matches.groupBy("qid", "doc_id").agg(F.round(F.sum(points), 6).alias("score"))


def lexical_score(keywords: DataFrame, index: Index, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(qid, doc_id, score) for keywords (qid, kid, keyword); at least one clause matches."""
    return combine_clauses(match_keywords(index, keyword_terms(keywords, index.analyzer)), weights)


def _chosung_points(mode: str, raw: Column, flat: Column, c_text: Column, flat_text: Column) -> Column:
    """Number of matching clauses of a mode for one keyword and one text."""
    grams = F.when(F.length(flat) <= 20, F.array(flat)).otherwise(windows_of(flat, 20))
    wildcard = (~raw.contains(" ") & c_text.contains(raw)).cast("int")
    ngram = ((F.length(flat) >= 2) & F.forall(grams, lambda g: flat_text.contains(g))).cast("int")
    return {"wildcard": wildcard, "ngram": ngram, "hybrid": wildcard + ngram}[mode]


def match_chosung(keywords: DataFrame, docs: DataFrame, mode: str = "wildcard",
                  boost: float = WEIGHTS["chosung"], text_col: str = "all_text",
                  pack_limit: int = PACK_LIMIT) -> DataFrame:
    """(qid, kid, doc_id, score) of chosung keywords against the chosung form of a text.

    wildcard: the keyword lies inside one white-space token (so one with a space never
    matches). ngram: all 2..20-grams of the space-free keyword occur in the space-free
    text, which for up to 20 characters is containment. hybrid: either, summed.

    The keywords are a stated query set: in blocks of about `pack_limit` they travel to
    the scan as one value, and every text is tested where it is read, without a
    shuffle. With several blocks, the result of one is stored before the next is read."""
    if mode not in CHOSUNG_MODES:
        raise ValueError(f"unknown mode {mode}")
    wanted = keywords.select(
        "qid", "kid", strip("keyword").alias("raw"),
        F.lower(F.replace(strip("keyword"), F.lit(" "), F.lit(""))).alias("flat"),
    ).filter(F.col("flat") != "")

    def flat_of(c: Column) -> Column:
        return F.lower(F.replace(c, F.lit(" "), F.lit("")))

    def scored_by(form: Column) -> Column:
        return F.filter(
            F.transform("_wanted", lambda w: F.struct(
                w["qid"].alias("qid"), w["kid"].alias("kid"),
                (_chosung_points(mode, w["raw"], w["flat"], form["c"], form["f"]) * F.lit(float(boost))).alias("score"))),
            lambda s: s["score"] > 0)

    def scan(block: DataFrame) -> DataFrame:
        pack = block.agg(F.collect_list(F.struct("qid", "kid", "raw", "flat")).alias("w")).scalar()
        text = let(to_chosung(text_col), lambda c: F.struct(c.alias("c"), flat_of(c).alias("f")))
        return (
            docs.withColumn("_wanted", pack).select("doc_id", F.explode(let(text, scored_by)).alias("m"))
            .select("m.qid", "m.kid", "doc_id", "m.score")
        )

    blocks = -(-wanted.count() // max(1, pack_limit))
    if blocks <= 1:
        return scan(wanted) if blocks else scan(wanted).limit(0)
    own = F.pmod(F.xxhash64("qid", "kid", "raw"), F.lit(blocks))
    found = None
    for i in range(blocks):
        hits = materialize(scan(wanted.filter(own == i)), "chosung")
        found = hits if found is None else found.unionByName(hits)
    return found


def keyword_table(prepared: DataFrame) -> DataFrame:
    """(qid, kid, keyword, is_chosung) of all search keywords."""
    return prepared.select("qid", "is_chosung", F.posexplode("target_keywords").alias("i", "keyword")).select(
        "qid", F.concat(F.lit("t"), F.col("i").cast("string")).alias("kid"), "keyword", "is_chosung")


def hybrid_hits(requests: DataFrame, docs: DataFrame, dictionary: DataFrame,
                vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
                index: Index | None = None, config: SearchConfig | None = None, k: int = 10) -> DataFrame:
    """All hits of a table of requests, before paging: qid, doc_id, score, title,
    doc_category, file_ext, indexed_at and the prepared request columns.

    The lexical (or chosung) match is required, the vector score is added to it. One
    pass over the postings serves search, include and exclude keywords."""
    config = config or SearchConfig()
    index = index or build_index(docs)
    weights = config.weights
    prepared = materialize(prepare_queries(requests, dictionary, synonyms=config.synonyms), "requests")
    targets = keyword_table(prepared)
    includes = fl.keyword_rows(prepared, "include_keywords", "i")
    excludes = fl.keyword_rows(prepared, "exclude_keywords", "e")
    plain = targets.filter(~F.col("is_chosung")).drop("is_chosung")
    every = plain.unionByName(includes).unionByName(excludes)
    matches = materialize(match_keywords(index, keyword_terms(every, index.analyzer)), "matches")
    role = F.substring("kid", 1, 1)
    phrases = matches.filter(F.col("phrase_tf") > 0)
    lexical = combine_clauses(matches.filter(role == "t"), weights)
    chosung = match_chosung(
        targets.filter("is_chosung").drop("is_chosung"), docs, config.chosung_mode, weights["chosung"])
    lexical = lexical.unionByName(chosung.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")))
    hits = fl.include_all(
        lexical, includes, phrases.filter(role == "i").select("qid", "doc_id", "kid").distinct())
    hits = fl.exclude_any(hits, phrases.filter(role == "e").select("qid", "doc_id"))
    if vectors is not None and query_vectors is not None:
        # as many neighbours as the request's page is long
        asked = prepared.filter(~F.col("is_chosung")).select("qid", asked_size(prepared, "size", k).alias("k"))
        near = knn(query_vectors.join(asked, "qid"), vectors, k).select("qid", "doc_id", F.col("score").alias("_near"))
        hits = hits.join(near, ["qid", "doc_id"], "left").withColumn(
            "score", F.round(F.col("score") + weights["vector"] * F.coalesce("_near", F.lit(0.0)), 6)).drop("_near")
    meta = docs.select("doc_id", "title", "doc_category", "file_ext", "indexed_at")
    asks = prepared.select(
        "qid", "original_query", "corrected_query", "is_typo_corrected", "is_chosung", "is_name_like",
        "target_keywords", F.col("doc_category").alias("_category"), F.col("file_ext").alias("_ext"),
        "start_date", "end_date", F.col("min_score").alias("_floor"),
        *[c for c in ("page", "size") if c in prepared.columns])
    hits = (
        hits.join(asks, "qid").join(meta, "doc_id")
        .filter(fl.category_matches(F.col("doc_category"), F.col("_category")))
        .filter(fl.ext_matches(F.col("file_ext"), F.col("_ext")))
        .filter(fl.date_matches(F.col("indexed_at"), F.col("start_date"), F.col("end_date")))
    )
    hits = fl.min_score(hits, weights["min_score"], F.col("_floor")).drop(
        "_category", "_ext", "start_date", "end_date", "_floor")
    hits = fl.with_exact(materialize(hits, "hits"), docs)
    return fl.require_exact_names(fl.prefer_exact(hits))


def asked_size(df: DataFrame, name: str, otherwise: int) -> Column:
    """A request's own page or size, where its table has one."""
    return F.coalesce(F.col(name).cast("int"), F.lit(otherwise)) if name in df.columns else F.lit(otherwise)


def _ranking() -> Window:
    return Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("indexed_at"), F.asc("doc_id"))


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits per request with their `rank`. The rank limit is also applied
    before the shuffle, so a request with very many hits sends k rows per task."""
    return hits.withColumn("rank", F.row_number().over(_ranking())).filter(F.col("rank") <= k)


def limited_rank(hits: DataFrame, score: str, last: str) -> DataFrame:
    """The hits with their `rank` by a score column, up to the rank in column `last`, which is
    the same for all hits of a request. Requests are dealt by the power of two their limit
    fits, so each such class sends no more rows per task than its own requests ask for."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.desc("indexed_at"), F.asc("doc_id"))
    power = F.ceil(F.log2(F.greatest(F.col(last), F.lit(1)))).cast("int")
    # at most 31 classes
    classes = sorted(r[0] for r in hits.select(power).distinct().collect())
    parts = [hits.filter(power == c).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 ** c) for c in classes]
    ranked = reduce(DataFrame.unionByName, parts) if parts else hits.withColumn("rank", F.lit(1))
    return ranked.filter(F.col("rank") <= F.col(last))


def page_hits(hits: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """One page per request, with total and total_pages. A request's own `page` and `size`
    count where the hits carry them; only ranks up to its own page's end are kept before
    the shuffle."""
    asked = hits.withColumns({"_page": asked_size(hits, "page", page), "_size": asked_size(hits, "size", size)}).drop("page", "size")
    totals = asked.groupBy("qid").agg(F.count("*").alias("total"))
    rank, first = F.col("rank"), (F.col("_page") - 1) * F.col("_size")
    if {"page", "size"} & set(hits.columns):
        ranked = limited_rank(asked.withColumn("_last", F.col("_page") * F.col("_size")), "score", "_last").drop("_last")
    else:
        ranked = top_hits(asked, page * size)
    return ranked.filter(rank > first).join(totals, "qid").withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("_size"))).cast("int")).drop("_page", "_size")


def add_highlights(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds `summary` and `page` to page rows; only their documents' texts are read."""
    found = rows.join(docs.select("doc_id", "all_text"), "doc_id").withColumn(
        "_hit", F.when(F.col("is_chosung"), highlight_chosung("all_text", "corrected_query"))
        .otherwise(highlight("all_text", "target_keywords")))
    return (
        found.withColumn("summary", F.coalesce("_hit.summary", fallback_summary("all_text")))
        .withColumn("page", F.coalesce("_hit.page", F.lit("1"))).drop("_hit", "all_text")
    )


def hybrid_search(requests: DataFrame, docs: DataFrame, dictionary: DataFrame,
                  vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
                  index: Index | None = None, config: SearchConfig | None = None,
                  page: int = 1, size: int = 10) -> DataFrame:
    """Result pages of a table of requests, highlighted."""
    hits = hybrid_hits(requests, docs, dictionary, vectors, query_vectors, index, config, k=size)
    return add_highlights(page_hits(hits, page, size), docs)


def facet_category(hits: DataFrame) -> DataFrame:
    """Hits per request and category over the whole match set."""
    return hits.filter(F.coalesce("doc_category", F.lit("")) != "").groupBy(
        "qid", "doc_category").agg(F.count("*").alias("count"))


def facet_extension(hits: DataFrame, size: int | None = None) -> DataFrame:
    """Hits per request and extension, missing ones "unknown"; the `size` largest where
    the caller asks for so many only."""
    counts = hits.groupBy("qid", ext_for_stats("file_ext").alias("file_ext")).agg(F.count("*").alias("count"))
    if size is None:
        return counts
    largest = Window.partitionBy("qid").orderBy(F.desc("count"), F.asc("file_ext"))
    return counts.withColumn("_rn", F.row_number().over(largest)).filter(F.col("_rn") <= size).drop("_rn")


def hybrid_or_search(keywords: DataFrame, query_vectors: DataFrame, vectors: DataFrame, docs: DataFrame,
                     index: Index | None = None, floor: float = 0.75, k: int = 10,
                     title_boost: float = 3.0) -> DataFrame:
    """The older OR search, top k per request: the better of title (boosted) and body
    over any query word, plus the vector score; either side alone is enough."""
    index = index or build_index(docs)
    any_word = match_any(index, keyword_terms(keywords, index.analyzer)).withColumn(
        "points", F.when(F.col("field") == TITLE, title_boost).otherwise(1.0) * F.col("or_score"))
    lexical = any_word.groupBy("qid", "doc_id").agg(F.max("points").alias("_lex"))
    near = knn(query_vectors, vectors, k).select("qid", "doc_id", F.col("score").alias("_near"))
    both = lexical.join(near, ["qid", "doc_id"], "full_outer").select(
        "qid", "doc_id",
        F.round(F.coalesce("_lex", F.lit(0.0)) + F.coalesce("_near", F.lit(0.0)), 6).alias("score"))
    meta = docs.select("doc_id", "indexed_at")
    return top_hits(both.filter(F.col("score") >= floor).join(meta, "doc_id"), k).select(
        "qid", "doc_id", "score", "rank")


def autocomplete(prefixes: DataFrame, docs: DataFrame, k: int = 5, chosung_mode: str = "wildcard",
                 analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """(qid, title, rank) suggestions for typed prefixes (qid, prefix): titles whose
    words continue the prefix, or documents matching a chosung input. The best k titles,
    each by its best hit."""
    typed = prefixes.select("qid", restore_jamo(sanitize("prefix")).alias("keyword")).filter(
        F.col("keyword") != "").withColumn("kid", F.lit("p")).withColumn("_c", is_chosung_query("keyword"))
    index = Index(prefix_postings(docs, "title", analyzer), field_stats(docs, {TITLE: "title"}, analyzer), analyzer)
    words = prefix_terms(typed.filter(~F.col("_c")).drop("_c"), analyzer)
    phrase = match_keywords(index, words).filter(F.col("phrase_tf") > 0).select(
        "qid", "doc_id", F.round("phrase_score", 6).alias("score"))
    chosung = match_chosung(typed.filter("_c").drop("_c"), docs, chosung_mode, 1.0).select("qid", "doc_id", "score")
    titled = phrase.unionByName(chosung).join(docs.select("doc_id", "title"), "doc_id").filter(
        F.coalesce("title", F.lit("")) != "")
    titles = titled.groupBy("qid", "title").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("title"))
    return titles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "title", "rank")


def boost_autocomplete(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """Suggestions re-ordered by their place in the popular list (keyword,
    popular_rank); titles not in it keep their order behind."""
    placed = candidates.join(popular.withColumnRenamed("keyword", "title"), "title", "left").withColumn(
        "popular_rank", F.coalesce("popular_rank", F.lit(UNKNOWN_RANK)))
    order = Window.partitionBy("qid").orderBy("popular_rank", "rank")
    return placed.withColumn("position", F.row_number().over(order)).select(
        "qid", "title", "popular_rank", "position")


def rerank(page: DataFrame, docs: DataFrame, popular: DataFrame | None = None,
           boosts: dict[str, float] = RERANK_BOOSTS) -> DataFrame:
    """Second ranking of page rows (qid, doc_id, query, score, rank): bonuses for the
    query in title and body and for a popular query; ties keep the first order."""
    # stored, so that the planner sees how few rows these are before it shuffles all texts
    page = materialize(page, "page")
    texts = page.join(docs.select("doc_id", F.col("title").alias("_t"), F.col("all_text").alias("_b")), "doc_id")
    needle = F.lower(strip(F.coalesce("query", F.lit(""))))
    nothing = F.lit(None).cast("string")
    bonus = (
        F.when(contains_exact("_t", nothing, needle), boosts["title"]).otherwise(0.0)
        + F.when(contains_exact(nothing, "_b", needle), boosts["body"]).otherwise(0.0)
    )
    if popular is not None:
        # a page holds few requests, the popular list is bounded by its limit
        wanted = popular.select(F.lower(strip("keyword")).alias("_n")).distinct().withColumn("_p", F.lit(True))
        texts = texts.withColumn("_n", needle).join(wanted, "_n", "left")
        bonus = bonus + F.when(F.col("_p") & (F.col("_n") != ""), boosts["popular"]).otherwise(0.0)
    order = Window.partitionBy("qid").orderBy(F.desc("new_score"), F.asc("rank"))
    return (
        texts.withColumn("new_score", F.round(F.col("score") + bonus, 6))
        .withColumn("new_rank", F.row_number().over(order))
        .select("qid", "doc_id", "score", "rank", "new_score", "new_rank")
    )


def latest_docs(docs: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of the newest documents, `limit` long as asked for, with the corpus total."""
    total = docs.agg(F.count("*").alias("n")).scalar()
    return (
        docs.orderBy(F.desc("indexed_at"), F.asc("doc_id")).offset(skip).limit(limit)
        .withColumn("total", total)
    )


def get_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def delete_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")

