"""Search over the stored documents with requests taken from the benchmark passages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import to_chosung
from ..operators import chosung as ch
from ..operators import filters as fl
from ..operators import library as li
from ..operators import postings as po
from ..operators import querylog as ql
from ..operators import ranked as ra
from ..operators import search as se
from ..operators import suggest as su
from ..operators.dictionary import upsert_dictionary
from ..operators.vectors import StoredVectors, knn, read_vectors, write_vectors
from ..session import shared_dir
from ..sources.adapters import AS_OF, Tables, as_syllables
from .ctes import NOW, as_syllables as syllables_sql
from .ctes import chosung, sanitize, sql, words
from .registry import query
from .texts import ordered_distinct, page_sql, prepared_ctes, snippet_sql

POSTINGS = dict(
    fields=f"""select doc_id, 'title' as field, {words('title')} as w from docs
union all select doc_id, 'body', {words('all_text')} from docs""",
    post="select field, unnest(w) as term, doc_id, unnest(range(0, len(w))) as pos, len(w) as dl from fields",
    fstats="select field, count(*)::double as n_docs, avg(len(w)) as avgdl from fields where len(w) > 0 group by field",
    tfs="select field, term, doc_id, count(*) as tf, max(dl) as dl from post group by 1, 2, 3",
    idfs="""select field, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) as idf from (
  select field, term, count(*) as df from tfs group by 1, 2) join fstats using (field)""",
)
NORM = "{tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def match_ctes(keywords: str) -> dict[str, str]:
    """matches(qid, kid, field, doc_id, and_score, phrase_tf, phrase_score)."""
    return dict(
        **POSTINGS,
        kw=keywords,
        kt=f"""select qid, kid, unnest(w) as term, unnest(range(0, len(w))) as qpos, len(w) as n
from (select qid, kid, {words('keyword')} as w from kw)""",
        ands=f"""select qid, kid, field, doc_id, sum(idf * {NORM.format(tf='tf')}) as and_score, sum(idf) as idf_sum, max(dl) as dl, max(avgdl) as avgdl
from kt join tfs using (term) join idfs using (field, term) join fstats using (field)
group by 1, 2, 3, 4 having count(*) = max(n)""",
        phrases="""select qid, kid, field, doc_id, count(*) as phrase_tf from (
  select qid, kid, field, doc_id, pos - qpos as start from kt join post using (term) group by 1, 2, 3, 4, 5 having count(*) = max(n))
group by 1, 2, 3, 4""",
        matches=f"""select qid, kid, field, doc_id, and_score, coalesce(phrase_tf, 0) as phrase_tf,
  case when phrase_tf > 0 then idf_sum * {NORM.format(tf='phrase_tf')} else 0.0 end as phrase_score
from ands left join phrases using (qid, kid, field, doc_id)""",
        lexical="""select qid, doc_id, round(sum(case field when 'title' then 20 * phrase_score + 10 * and_score
  else 5 * phrase_score + and_score end), 6) as score from matches where kid like 't%' group by 1, 2""",
    )


_LEFT = "where doc_id not in (select doc_id from labels)"
QUERY_KEYWORDS = "select qid, 't0' as kid, query as keyword from requests"


def _keywords(t: Tables) -> DataFrame:
    return t.requests.select("qid", F.lit("t0").alias("kid"), F.col("query").alias("keyword"))


@query("d1_build_postings", sql("""
select field, term, count(*) as occurrences, count(distinct doc_id) as df, sum(pos)::bigint as pos_sum, max(dl) as max_dl
from post group by 1, 2""", "docs", **POSTINGS))
def d1(t: Tables) -> DataFrame:
    return po.build_postings(t.docs).groupBy("field", "term").agg(
        F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("df"),
        F.sum("pos").alias("pos_sum"), F.max("dl").cast("long").alias("max_dl"))


@query("d1_field_stats", sql("select field, n_docs, round(avgdl, 6) as avgdl from fstats", "docs", **POSTINGS))
def d1_stats(t: Tables) -> DataFrame:
    return po.field_stats(t.docs).select(
        "field", F.col("n_docs").cast("double").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))


@query("d2_match_and", sql(
    "select qid, kid, field, doc_id, round(and_score, 6) as and_score from matches",
    "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def d2(t: Tables) -> DataFrame:
    hits = po.match_and(stored_index(t), _keywords(t))
    return hits.withColumn("and_score", F.round("and_score", 6))


@query("d3_match_phrase", sql(
    "select qid, kid, field, doc_id, phrase_tf, round(phrase_score, 6) as phrase_score from matches where phrase_tf > 0",
    "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def d3(t: Tables) -> DataFrame:
    hits = po.match_phrase(stored_index(t), _keywords(t))
    return hits.withColumn("phrase_score", F.round("phrase_score", 6)).withColumn(
        "phrase_tf", F.col("phrase_tf").cast("long"))


@query("d4_lexical_score", sql("select * from lexical", "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def d4(t: Tables) -> DataFrame:
    return se.lexical_score(_keywords(t), po.build_index(t.docs))


CHOSUNG_KEYWORDS = f"select item_id as qid, 't0' as kid, {chosung(syllables_sql('w[3]'))} || case when item_id % 4 = 0 then ' ' || {chosung(syllables_sql('w[4]'))} else '' end as keyword from (select item_id, {words('text')} as w from benchmark)"


def _chosung_keywords(t: Tables) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    first, second = (to_chosung(as_syllables(F.get(w, F.lit(i)))) for i in (2, 3))
    keyword = F.concat(first, F.when(F.col("item_id") % 4 == 0, F.concat(F.lit(" "), second)).otherwise(""))
    return t("benchmark").select(F.col("item_id").alias("qid"), F.lit("t0").alias("kid"), keyword.alias("keyword"))


def _chosung_sql(points: str) -> str:
    return sql(f"""
select qid, kid, doc_id, 10.0 * ({points}) as score from ckw, forms where ({points}) > 0""",
        "hangul_docs", ckw=CHOSUNG_KEYWORDS,
        forms=f"select doc_id, c, lower(replace(c, ' ', '')) as flat from (select doc_id, {chosung('all_text')} as c from hangul_docs)")


WILDCARD = "(not contains(keyword, ' ') and contains(c, keyword))::int"
NGRAM = "(length(replace(keyword, ' ', '')) between 2 and 20 and contains(flat, lower(replace(keyword, ' ', ''))))::int"


@query("d1_stored_index", sql("select * from lexical", "docs", "requests", **{
    **match_ctes(QUERY_KEYWORDS),
    "fields": f"""select doc_id, 'title' as field, {words('title')} as w from docs {_LEFT}
union all select doc_id, 'body', {words('all_text')} from docs {_LEFT}"""}))
def d1_stored(t: Tables) -> DataFrame:
    """An index stored in two parts, with the labelled documents deleted, searched."""
    path = f"{shared_dir(t.spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    later = F.col("doc_id") % 2 == 1
    po.write_index(po.build_index(t.docs.filter(~later)), path, buckets=64)
    po.append_index(t.docs.filter(later), path)
    po.delete_from_index(t("labels"), path)
    return se.lexical_score(_keywords(t), po.read_index(t.spark, path))


_STORED: dict[tuple[str, ...], str] = {}


def stored(t: Tables, label: str, write) -> str:
    """The folder of a table derived from the documents, written on first use and read by
    every search of the session over the same documents."""
    key = (t.spark.sparkContext.applicationId, t.directory, label)
    if key not in _STORED:
        path = f"{shared_dir(t.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_grams(t: Tables) -> str:
    return stored(t, "grams", lambda place: ch.write_grams(t.hangul_docs, place, buckets=64))


def _chosung_hits(t: Tables, mode: str) -> DataFrame:
    return ch.match_stored_chosung(_chosung_keywords(t), stored_grams(t), mode, se.WEIGHTS["chosung"])


# files of the library: slots of documents; of the second listing a quarter is gone, a
# quarter new, a quarter changed
FILE_DOCS = 10
_KEPT = "(doc_id // 10) % 4 <> 0 and ((doc_id // 10) % 4 <> 1 or doc_id % 2 = 0)"


def _listing(t: Tables, later: bool) -> DataFrame:
    slot, doc = F.expr(f"doc_id div {FILE_DOCS}"), F.col("doc_id")
    kept = (slot % 4 != 0) & ((slot % 4 != 1) | (doc % 2 == 0)) if later else slot % 4 != 3
    line = F.concat("text", F.lit("\n"))
    return t("documents").filter(kept & F.col("text").isNotNull()).groupBy(slot.cast("string").alias("slot")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda r: r["line"]), "").alias("all")).select(
        F.concat(F.lit("/share/"), "slot", F.lit(".txt")).alias("file_path"),
        F.concat(F.lit("file "), "slot", F.lit(".txt")).alias("file_name"), F.encode("all", "UTF-8").alias("content"))


@query("j1_library", sql("select * from lexical", "requests", **{
    **match_ctes(QUERY_KEYWORDS),
    "fields": f"""select doc_id, 'title' as field, {words('title')} as w from files
union all select doc_id, 'body', {words('body')} from files"""}).replace("with ", f"""with files as (
  select sha256(body) as doc_id, {sanitize("title")} as title, {sanitize("body")} as body from (
    select 'file ' || cast(doc_id // 10 as varchar) || '.txt' as title, string_agg(text || chr(10), '' order by doc_id) as body
    from documents where text is not null and {_KEPT} group by doc_id // 10)),
""", 1))
def j1_library(t: Tables) -> DataFrame:
    """Two listings of a source, the second with files added, changed and deleted, and a
    search of the library they leave."""
    path = f"{shared_dir(t.spark).rstrip('/')}/library-{uuid.uuid4().hex}"
    li.create_library(t.spark, path, buckets=32)
    for later in (False, True):
        li.sync_listing(_listing(t, later), path, AS_OF)
    return se.lexical_score(_keywords(t), li.library_index(t.spark, path))


@query("d5_match_chosung_wildcard", _chosung_sql(WILDCARD))
def d5_wildcard(t: Tables) -> DataFrame:
    return _chosung_hits(t, "wildcard")


@query("d5_match_chosung_ngram", _chosung_sql(NGRAM))
def d5_ngram(t: Tables) -> DataFrame:
    return _chosung_hits(t, "ngram")


@query("d5_match_chosung_hybrid", _chosung_sql(f"{WILDCARD} + {NGRAM}"))
def d5_hybrid(t: Tables) -> DataFrame:
    return _chosung_hits(t, "hybrid")


def stored_vectors(t: Tables) -> StoredVectors:
    path = stored(t, "vectors", lambda place: write_vectors(t.vectors, place))
    return read_vectors(t.spark, path)


KNN = """select q.vec_id as qid, d.vec_id as doc_id,
  round(1 / (1 + list_distance(q.embedding::double[], d.embedding::double[]) ** 2), 6) as score,
  row_number() over (partition by q.vec_id order by round(list_distance(q.embedding::double[], d.embedding::double[]) ** 2, 9), d.vec_id) as rank
from embeddings q, embeddings d where q.vec_id in (select item_id from benchmark) qualify rank <= 10"""
# as many neighbours as the request's page is long
NEAR = KNN.replace("from embeddings q, embeddings d where q.vec_id in (select item_id from benchmark) qualify rank <= 10",
                   "from embeddings q join requests r on q.vec_id = r.qid, embeddings d qualify rank <= any_value(r.size) over (partition by q.vec_id)")


@query("d6_knn", KNN)
def d6(t: Tables) -> DataFrame:
    return knn(t.query_vectors, stored_vectors(t), k=10).withColumn("rank", F.col("rank").cast("long"))


TARGETS = f"""select qid, unnest(ks) as keyword, unnest(range(0, len(ks))) as i from (
  select qid, list_filter(list_concat([final],
    case when contains(lower(final), 'ai') then ['인공지능', 'Machine Learning'] else [] end,
    case when contains(lower(final), '한전') then ['한국전력공사', 'KEPCO'] else [] end,
    case when contains(lower(final), 'rag') then ['검색 증강 생성'] else [] end,
    {ordered_distinct('raw_expanded')}), lambda k: k <> '') as ks from ready)"""
HITS = dict(
    **prepared_ctes("requests"),
    targets=TARGETS,
    inc=f"select * from (select qid, 'i' || cast(i as varchar) as kid, {sanitize('k')} as keyword from (select qid, unnest(include_keywords) as k, unnest(range(0, len(include_keywords))) as i from requests)) where keyword <> ''",
    exc=f"select * from (select qid, 'e' || cast(i as varchar) as kid, {sanitize('k')} as keyword from (select qid, unnest(exclude_keywords) as k, unnest(range(0, len(exclude_keywords))) as i from requests)) where keyword <> ''",
    **match_ctes("""select qid, 't' || cast(i as varchar) as kid, keyword from targets
union all select qid, kid, keyword from inc union all select qid, kid, keyword from exc"""),
    included="""select qid, doc_id, count(distinct kid) as have from matches where phrase_tf > 0 and kid like 'i%' group by 1, 2""",
    near=NEAR,
    scored="""select l.qid, l.doc_id, round(l.score + coalesce(n.score, 0.0), 6) as score from lexical l left join near n using (qid, doc_id)""",
    filtered="""select s.*, d.title, d.all_text, d.doc_category, d.file_ext, d.indexed_at, r.final, r.clean <> r.original_query as corrected,
  contains(lower(d.title), lower(trim(r.final))) or contains(lower(d.all_text), lower(trim(r.final))) as exact
from scored s join docs d using (doc_id) join ready r using (qid)
where (r.doc_category = '' or d.doc_category = 'OTHERS')
  and (r.file_ext = '' or d.file_ext = 'pdf')
  and (r.start_date is null or d.indexed_at >= r.start_date) and (r.end_date is null or d.indexed_at <= r.end_date)
  and s.score >= 0.0058
  and (len(r.include_keywords) = 0 or exists (select 1 from included i where i.qid = s.qid and i.doc_id = s.doc_id
    and i.have = (select count(*) from inc where inc.qid = s.qid)))
  and not exists (select 1 from matches m where m.phrase_tf > 0 and m.kid like 'e%' and m.qid = s.qid and m.doc_id = s.doc_id)""",
    hits="""select * from filtered f where not corrected or exact or not exists (
  select 1 from filtered g where g.qid = f.qid and g.exact)""",
)
SEARCH_TABLES = ("docs", "requests", "dictionary")


def _dictionary(t: Tables) -> DataFrame:
    return upsert_dictionary(None, t.raw_dictionary, "row_no")


def _hits(t: Tables) -> DataFrame:
    return se.hybrid_hits(t.requests, t.docs, _dictionary(t), t.vectors, t.query_vectors)


def stored_index(t: Tables) -> po.Index:
    path = stored(t, "index", lambda place: po.write_index(po.build_index(t.docs), place, buckets=64))
    return po.read_index(t.spark, path)


def _matched(t: Tables) -> ra.Matched:
    return ra.match_requests(t.requests, t.docs, _dictionary(t), stored_index(t), stored_vectors(t), t.query_vectors)


@query("d7_hybrid_hits", sql("""
select qid, doc_id, score, doc_category, file_ext, corrected as is_typo_corrected from hits""", *SEARCH_TABLES, **HITS))
def d7_hits(t: Tables) -> DataFrame:
    return _hits(t).select("qid", "doc_id", "score", "doc_category", "file_ext", "is_typo_corrected")


PAGE = dict(
    first_pages="""select qid, doc_id, score, all_text, row_number() over (partition by qid order by score desc, indexed_at desc, doc_id) as rank,
  count(*) over (partition by qid) as total from hits""",
    page1="""select f.*, r.size as page_size from first_pages f join requests r using (qid)
where rank > (r.page - 1) * r.size and rank <= r.page * r.size""",
    found="""select p.qid, p.doc_id, min_by(instr(lower(all_text), lower(trim(keyword))), i) as pos,
  min_by(length(lower(trim(keyword))), i) as size
from page1 p join targets t on t.qid = p.qid where instr(lower(all_text), lower(trim(keyword))) > 0 group by 1, 2""",
)


@query("d7_hybrid_search", sql(f"""
select qid, doc_id, rank, score, total, ceil(total / page_size)::bigint as total_pages,
  case when pos is null then '1' else {page_sql('all_text', 'pos')} end as page,
  case when pos is null then left(all_text, 200) || '...' else {snippet_sql('all_text', 'pos', 'size')} end as summary
from page1 left join found using (qid, doc_id)""", *SEARCH_TABLES, **HITS, **PAGE))
def d7(t: Tables) -> DataFrame:
    out = ra.search_pages(t.requests, t.docs, _dictionary(t), stored_index(t), stored_vectors(t), t.query_vectors)
    return out.select(
        "qid", "doc_id", F.col("rank").cast("long").alias("rank"), "score", "total",
        F.col("total_pages").cast("long").alias("total_pages"), "page", "summary")


@query("d8_hybrid_or_search", sql(f"""
select qid, doc_id, score, row_number() over (partition by qid order by score desc, indexed_at desc, doc_id) as rank from (
  select coalesce(l.qid, n.qid) as qid, coalesce(l.doc_id, n.doc_id) as doc_id,
    round(coalesce(l.s, 0.0) + coalesce(n.score, 0.0), 6) as score
  from (select qid, doc_id, max(s) as s from (
      select qid, field, doc_id, case field when 'title' then 3.0 else 1.0 end * sum(idf * {NORM.format(tf='tf')}) as s
      from kt join tfs using (term) join idfs using (field, term) join fstats using (field) group by 1, 2, 3) group by 1, 2) l
  full join near n on n.qid = l.qid and n.doc_id = l.doc_id) join docs using (doc_id)
where score >= 0.75 qualify rank <= 10""", "docs", "requests", **match_ctes(QUERY_KEYWORDS), near=KNN))
def d8(t: Tables) -> DataFrame:
    out = se.hybrid_or_search(_keywords(t), t.query_vectors, stored_vectors(t), t.docs)
    return out.withColumn("rank", F.col("rank").cast("long"))


PREFIXES = f"""select item_id as qid, w[1] || ' ' || left(w[2], 2) as prefix from (select item_id, {words('text')} as w from benchmark)
union all select item_id + 100000, left(w[1], 2) from (select item_id, {words('text')} as w from benchmark)"""
SUGGESTED = dict(
    prefixes=PREFIXES,
    typed=f"select qid, {sanitize('prefix')} as keyword from prefixes",
    tt=f"select doc_id, title, {words('title')} as w from docs",
    tpost="select doc_id, title, unnest(w) as term, unnest(range(0, len(w))) as pos, len(w) as dl from tt",
    tdl="select avg(len(w)) as avgdl, count(*)::double as n_docs from tt where len(w) > 0",
    pt=f"select qid, unnest(w) as term, unnest(range(0, len(w))) as qpos, len(w) as n from (select qid, {words('keyword')} as w from typed)",
    joined="""select qid, doc_id, title, dl, n, qpos, pos, p.term as qterm from pt p join tpost t
on (qpos < n - 1 and t.term = p.term) or (qpos = n - 1 and t.term like p.term || '%')""",
    tdf="select qid, qpos, count(distinct doc_id) as df from joined group by 1, 2",
    tidf="select qid, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))) as idf from tdf, tdl group by 1",
    starts="""select qid, doc_id, title, dl, count(*) as tf from (
  select qid, doc_id, title, dl, pos - qpos as s from joined group by 1, 2, 3, 4, 5 having count(*) = max(n)) group by 1, 2, 3, 4""",
    titles_of=f"""select qid, title, max(round(idf * {NORM.format(tf='tf')}, 6)) as score from starts join tidf using (qid), tdl group by 1, 2""",
    suggestions="""select qid, title, row_number() over (partition by qid order by score desc, title) as rank
from titles_of qualify rank <= 5""",
)


def _prefixes(t: Tables) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    bench = t("benchmark")
    return bench.select(
        F.col("item_id").alias("qid"), F.concat(first, F.lit(" "), F.substring(second, 1, 2)).alias("prefix")
    ).unionByName(bench.select((F.col("item_id") + 100000).alias("qid"), F.substring(first, 1, 2).alias("prefix")))


def stored_suggestions(t: Tables) -> str:
    return stored(t, "suggestions", lambda place: su.write_suggestions(t.docs, place))


def _suggested(t: Tables) -> DataFrame:
    return su.suggest(_prefixes(t), stored_suggestions(t), t.docs)


# what searches read besides the documents; the first search that needs one writes it
STORED_TABLES = {"index": stored_index, "grams": stored_grams, "vectors": stored_vectors, "suggestions": stored_suggestions}


@query("d9_autocomplete", sql("select qid, title, rank from suggestions", "docs", **SUGGESTED))
def d9(t: Tables) -> DataFrame:
    return _suggested(t).withColumn("rank", F.col("rank").cast("long"))


POPULAR_TITLES = """select title, row_number() over (order by count(*) desc, title) - 1 as popular_rank
from docs group by title order by popular_rank limit 100"""


@query("d10_boost_autocomplete", sql("""
select qid, title, coalesce(popular_rank, 10000) as popular_rank,
  row_number() over (partition by qid order by coalesce(popular_rank, 10000), rank) as position
from suggestions left join titles using (title)""", "docs", **SUGGESTED, titles=POPULAR_TITLES))
def d10(t: Tables) -> DataFrame:
    # a log of searches for document titles: every document was asked for once
    top = ql.popular_keywords(
        t.docs.select(F.col("title").alias("query"), F.lit(AS_OF).cast("timestamp").alias("created_at")), AS_OF, 14, 100)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "keyword"))).alias("x")).select(
        F.posexplode("x").alias("popular_rank", "e")).select(F.col("e.keyword").alias("keyword"), "popular_rank")
    out = se.boost_autocomplete(_suggested(t), ranked)
    return out.select("qid", "title", F.col("popular_rank").cast("long").alias("popular_rank"),
                      F.col("position").cast("long").alias("position"))


@query("d11_rerank", sql("""
select qid, doc_id, score, rank, new_score, row_number() over (partition by qid order by new_score desc, rank) as new_rank from (
  select p.qid, p.doc_id, p.score, p.rank, round(p.score
    + case when contains(lower(d.title), lower(r.query)) then 0.35 else 0.0 end
    + case when contains(lower(d.all_text), lower(r.query)) then 0.15 else 0.0 end
    + case when r.query in (select query from hot) then 0.10 else 0.0 end, 6) as new_score
  from (select *, row_number() over (partition by qid order by score desc, indexed_at desc, doc_id) as rank
        from lexical join (select doc_id, indexed_at from docs) using (doc_id) qualify rank <= 10) p
  join docs d using (doc_id) join requests r using (qid))""", "docs", "requests",
    hot="select query from requests group by query order by count(*) desc, query limit 50",
    **match_ctes(QUERY_KEYWORDS)))
def d11(t: Tables) -> DataFrame:
    hits = se.lexical_score(_keywords(t), stored_index(t)).join(t.docs.select("doc_id", "indexed_at"), "doc_id")
    page = se.top_hits(hits, 10).join(t.requests.select("qid", "query"), "qid")
    hot = ql.popular_keywords(
        t.requests.select("query", F.lit(AS_OF).cast("timestamp").alias("created_at")), AS_OF, 14, 50)
    out = se.rerank(page, t.docs, hot)
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("new_rank", F.col("new_rank").cast("long"))


SECOND = dict(
    searched=f"""select query from logs where created_at >= {NOW} - interval 14 day
union all select trim(query) from requests where trim(query) <> ''""",
    hot="select query from searched group by query order by count(*) desc, query limit 200",
    first10="""select qid, doc_id, score, title, all_text, row_number() over (partition by qid order by score desc, indexed_at desc, doc_id) as rank
from hits qualify rank <= 10""",
    second="""select qid, doc_id, title, score, rank, new_score, row_number() over (partition by qid order by new_score desc, rank) as new_rank from (
  select f.*, round(f.score
    + case when contains(lower(f.title), lower(trim(r.query))) then 0.35 else 0.0 end
    + case when contains(lower(f.all_text), lower(trim(r.query))) then 0.15 else 0.0 end
    + case when lower(trim(r.query)) in (select lower(query) from hot) then 0.10 else 0.0 end, 6) as new_score
  from first10 f join requests r using (qid))""",
)


def second_ranking(t: Tables) -> DataFrame:
    """The first page of the hybrid search, ranked again with what the log of the last 14
    days, these requests included, shows as popular."""
    path = f"{shared_dir(t.spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    asked = t.requests.select(
        F.lit("").alias("user_id"), "query", F.lit(0).cast("long").alias("total_hits"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"))
    ql.save_search_logs(t.logs.select(asked.columns).unionByName(asked), path)
    hot = ql.popular_keywords(ql.read_search_logs(t.spark, path, AS_OF, days=14), AS_OF, 14, 200)
    page = ra.best_hits(_matched(t), F.lit(10)).select("qid", "doc_id", "score", "rank").join(t.requests.select("qid", "query"), "qid")
    return se.rerank(page, t.docs, hot)


@query("d11_second_ranking", sql(
    "select qid, doc_id, score, rank, new_score, new_rank from second", *SEARCH_TABLES, "logs", **HITS, **SECOND))
def d11_second(t: Tables) -> DataFrame:
    return second_ranking(t).withColumn("rank", F.col("rank").cast("long")).withColumn(
        "new_rank", F.col("new_rank").cast("long"))


@query("d12_strict_hits", sql("""
select qid, count(distinct doc_id) as strict_hits from requests left join (select * from matches where phrase_tf > 0) using (qid) group by 1""",
    "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def d12(t: Tables) -> DataFrame:
    return po.strict_hits(stored_index(t), t.requests)


@query("c1_filter_category", sql("select doc_id, doc_category from docs where doc_category = 'PLAN'", "docs"))
def c1(t: Tables) -> DataFrame:
    return fl.filter_category(t.docs, "사업계획서").select("doc_id", "doc_category")


@query("c2_filter_ext", sql("select doc_id, file_ext from docs where file_ext in ('docx', 'pptx', 'xlsx') and file_ext like '%x'", "docs"))
def c2(t: Tables) -> DataFrame:
    return fl.filter_ext(t.docs, " .X").select("doc_id", "file_ext")


@query("c3_filter_dates", sql(f"""
select doc_id, 'range' as kind from docs where indexed_at between timestamp '2024-01-01 02:00:00' and timestamp '2024-01-01 09:00:00'
union all select id, 'week' from logs where created_at >= {NOW} - interval 7 day
union all select doc_id, 'legacy' from docs where indexed_at >= timestamp '2024-01-01 12:00:00'""", "docs", "logs"))
def c3(t: Tables) -> DataFrame:
    inside = fl.filter_dates(t.docs, "2024-01-01 02:00:00", "2024-01-01 09:00:00")
    week = fl.filter_dates(t.logs, fl.preset_start(AS_OF, "7d"), None, "created_at")
    old = t.docs.withColumn("indexedat", F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss")).withColumn(
        "indexed_at", F.lit(None).cast("timestamp"))
    legacy = fl.filter_dates(old, "2024-01-01 12:00:00", None, legacy="indexedat")
    return inside.select("doc_id", F.lit("range").alias("kind")).unionByName(
        week.select(F.col("id").alias("doc_id"), F.lit("week").alias("kind"))).unionByName(
        legacy.select("doc_id", F.lit("legacy").alias("kind")))


KEYWORD_HITS = dict(
    inc=HITS["inc"], exc=HITS["exc"],
    **match_ctes(f"{QUERY_KEYWORDS} union all select qid, kid, keyword from inc union all select qid, kid, keyword from exc"),
)


@query("c4_include_all", sql("""
select l.qid, l.doc_id from lexical l where not exists (select 1 from inc i where i.qid = l.qid and not exists (
  select 1 from matches m where m.qid = i.qid and m.kid = i.kid and m.phrase_tf > 0 and m.doc_id = l.doc_id))""",
    "docs", "requests", **KEYWORD_HITS))
def c4(t: Tables) -> DataFrame:
    index = stored_index(t)
    hits = se.lexical_score(_keywords(t), index)
    return fl.include_keywords(hits, t.requests, index).select("qid", "doc_id")


@query("c5_exclude_any", sql("""
select l.qid, l.doc_id from lexical l where not exists (
  select 1 from matches m where m.qid = l.qid and m.kid like 'e%' and m.phrase_tf > 0 and m.doc_id = l.doc_id)""",
    "docs", "requests", **KEYWORD_HITS))
def c5(t: Tables) -> DataFrame:
    index = stored_index(t)
    hits = se.lexical_score(_keywords(t), index)
    return fl.exclude_keywords(hits, t.requests, index).select("qid", "doc_id")


@query("c6_filter_author", "select doc_id, source as author from documents where source = 'src3'")
def c6(t: Tables) -> DataFrame:
    return fl.filter_author(t("documents").withColumnRenamed("source", "author"), "src3").select("doc_id", "author")


@query("c7_min_score", sql("""
select qid, doc_id, score from lexical where score >= case when qid % 2 = 0 then 20.0 else 10.0 end""",
    "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def c7(t: Tables) -> DataFrame:
    hits = se.lexical_score(_keywords(t), stored_index(t))
    return fl.min_score(hits, 10.0, F.when(F.col("qid") % 2 == 0, 20.0).otherwise(0.0))


EXACT = dict(
    flagged="""select l.qid, l.doc_id, l.qid % 2 = 0 as corrected, l.qid % 3 = 0 as name_like,
  contains(lower(d.title), lower(r.query)) or contains(lower(d.all_text), lower(r.query)) as exact
from lexical l join docs d using (doc_id) join requests r using (qid)""",
)


def _flagged(t: Tables) -> DataFrame:
    hits = se.lexical_score(_keywords(t), stored_index(t)).join(
        t.requests.select("qid", F.col("query").alias("corrected_query")), "qid")
    return fl.with_exact(
        hits.withColumn("is_typo_corrected", F.col("qid") % 2 == 0).withColumn("is_name_like", F.col("qid") % 3 == 0),
        t.docs)


@query("c8_prefer_exact", sql("""
select qid, doc_id from flagged f where not corrected or exact
  or not exists (select 1 from flagged g where g.qid = f.qid and g.exact)""", "docs", "requests", **match_ctes(QUERY_KEYWORDS), **EXACT))
def c8(t: Tables) -> DataFrame:
    return fl.prefer_exact(_flagged(t)).select("qid", "doc_id")


@query("c9_require_exact_names", sql(
    "select qid, doc_id from flagged where not name_like or exact", "docs", "requests", **match_ctes(QUERY_KEYWORDS), **EXACT))
def c9(t: Tables) -> DataFrame:
    return fl.require_exact_names(_flagged(t)).select("qid", "doc_id")


@query("e8_facet_category", sql(
    "select qid, doc_category, count(*) as count from hits group by 1, 2", *SEARCH_TABLES, **HITS))
def e8(t: Tables) -> DataFrame:
    return se.facet_category(_matched(t).rows)


@query("e9_facet_extension", sql(
    "select qid, file_ext, count(*) as count from hits group by 1, 2", *SEARCH_TABLES, **HITS))
def e9(t: Tables) -> DataFrame:
    return se.facet_extension(_matched(t).rows)


@query("w5_page_hits", sql("""
select qid, doc_id, rank, total, greatest(1, ceil(total / size))::bigint as total_pages from (
  select *, row_number() over (partition by qid order by score desc, indexed_at desc, doc_id) as rank,
    count(*) over (partition by qid) as total from lexical join docs using (doc_id)) join (select qid, page, size from requests) using (qid)
where rank > (page - 1) * size and rank <= page * size""",
    "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def w5(t: Tables) -> DataFrame:
    hits = se.lexical_score(_keywords(t), stored_index(t)).join(t.docs.select("doc_id", "indexed_at"), "doc_id")
    return se.page_hits(hits.join(t.requests.select("qid", "page", "size"), "qid")).select(
        "qid", "doc_id", F.col("rank").cast("long").alias("rank"), "total", F.col("total_pages").cast("long").alias("total_pages"))


@query("w6_top_hits", sql("""
select qid, doc_id, score, row_number() over (partition by qid order by score desc, indexed_at desc, doc_id) as rank
from lexical join docs using (doc_id) qualify rank <= 3""", "docs", "requests", **match_ctes(QUERY_KEYWORDS)))
def w6(t: Tables) -> DataFrame:
    hits = se.lexical_score(_keywords(t), stored_index(t)).join(t.docs.select("doc_id", "indexed_at"), "doc_id")
    return se.top_hits(hits, 3).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("w7_latest_docs", sql("""
select doc_id, title, (select count(*) from docs) as total from docs order by indexed_at desc, doc_id limit 500 offset 10""", "docs"))
def w7(t: Tables) -> DataFrame:
    return se.latest_docs(t.docs, skip=10, limit=500).select("doc_id", "title", "total")


@query("w8_get_documents", sql(
    "select doc_id, title, all_text from docs where doc_id in (select doc_id from labels where quality = 0)", "docs"))
def w8(t: Tables) -> DataFrame:
    return se.get_documents(t.docs, t("labels").filter("quality = 0")).select("doc_id", "title", "all_text")


@query("w11_delete_documents", sql(
    "select doc_id, title from docs where doc_id not in (select doc_id from labels)", "docs"))
def w11(t: Tables) -> DataFrame:
    return se.delete_documents(t.docs, t("labels")).select("doc_id", "title")
