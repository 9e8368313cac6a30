"""Corpus preparation over the stored documents, pages and labels."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as co
from ..operators.dictionary import ingest_dictionary, upsert_dictionary
from ..session import materialize, shared_dir
from ..sources import files as fi
from ..sources.adapters import AS_OF, TEXT_RULES, Tables
from ..sources.sql import rows_to_documents
from .ctes import compact, sanitize, sql
from .registry import query


@query("a3_rows_to_documents", """
select n, title, body, title || chr(10) || body as payload, 'parts_' || title || '.txt' as file_name from (
  select n, case when p_type = 'SMALL' then 'parts-' || cast(n as varchar) else p_name end as title,
    concat_ws(' ', cast(p_partkey as varchar), p_brand, case when p_type <> 'SMALL' then p_name end) as body
  from (select *, row_number() over (order by p_brand, p_partkey) as n from part))""")
def a3(t: Tables) -> DataFrame:
    rows = t("part").select(
        "p_partkey", "p_brand", F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("title"))
    return rows_to_documents(rows, "parts", "title", ["p_brand", "p_partkey"])


@query("a4_read_files", """
select lang || '/' || cast(doc_id // 100 as varchar) as folder, 'txt' as file_ext, sum(strlen(text) + 1)::bigint as length,
  sha256(string_agg(text || chr(10), '' order by doc_id, text)) as digest
from documents where text is not null and lang is not null group by lang, doc_id // 100""")
def a4(t: Tables) -> DataFrame:
    """The documents written out as text files in nested folders, with other files
    beside them, and read back."""
    root = f"{shared_dir(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    texts = t("documents").filter("text is not null and lang is not null").select(
        "lang", F.expr("doc_id div 100").alias("slot"), "doc_id", F.col("text").alias("value"))
    filed = texts.repartition("lang", "slot").sortWithinPartitions("lang", "slot", "doc_id", "value")
    filed.select("lang", "slot", "value").write.partitionBy("lang", "slot").text(root)
    texts.select("lang", "slot", "doc_id").write.mode("append").partitionBy("lang", "slot").csv(root)
    files = fi.read_files(t.spark, root, ["txt"])
    folder = F.concat_ws("/", *[F.regexp_extract("path", f"/{c}=([^/]*)/", 1) for c in ("lang", "slot")])
    return files.select(folder.alias("folder"), "file_ext", "length", F.sha2("content", 256).alias("digest"))


@query("a5_decode_text", "select doc_id, text from documents")
def a5(t: Tables) -> DataFrame:
    bom, utf8 = F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")
    content = (
        F.when(F.col("lang") == "en", utf8).when(F.col("lang") == "fr", F.concat(bom, utf8))
        .otherwise(F.encode("text", "UTF-16"))
    )
    return t("documents").select("doc_id", fi.decode_text(content).alias("text"))


# what ends a zip archive with one member of a docx file, whatever stands before it: the
# directory, and the record that tells its size
_NAME = b"word/x"
MEMBER = struct.pack("<4s4B4H3L5H2L", b"PK\x01\x02", 20, 0, 20, 0, 0, 0, 0, 33, 0, 0, 0, len(_NAME), 0, 0, 0, 0, 0, 0) + _NAME
MEMBER += struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 1, 1, len(MEMBER), 0, 0)
LEADS = (b"%PDF-", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"")


@query("a6_triage_files", """
select doc_id, case when reason = 'ok' then 'ok' else 'rejected' end as status, reason from (
  select doc_id, case when ext = '' then 'no_extension'
    when length(text) + [5, 3, 8, 78, 0][lead + 1] > 20000 then 'too_large'
    when ext in ('docx', 'xlsx') then case when ext = 'docx' and lead = 3 then 'ok' else 'signature_mismatch' end
    when (ext = 'pdf' and lead = 0) or (ext = 'jpg' and lead = 1) or (ext = 'png' and lead = 2) then 'ok'
    when ext in ('pdf', 'jpg', 'png') then 'signature_mismatch' else 'unsupported' end as reason
  from (select doc_id, encode(text) as b, strlen(text) as n, strlen(text) as bytes, n_chars % 5 as lead,
      (['pdf', 'jpg', 'png', 'docx', 'xlsx', 'txt', ''])[doc_id % 7 + 1] as ext, text from documents))""".replace(
    "length(text) + [5", "bytes + [5"))
def a6(t: Tables) -> DataFrame:
    exts = F.array(*map(F.lit, ("pdf", "jpg", "png", "docx", "xlsx", "txt", "")))
    leads = F.array(*map(F.lit, LEADS))
    files = t("documents").select(
        "doc_id", F.get(exts, (F.col("doc_id") % 7).cast("int")).alias("file_ext"),
        F.concat(F.get(leads, (F.col("n_chars") % 5).cast("int")), F.encode("text", "UTF-8"),
                 F.when(F.col("n_chars") % 5 == 3, F.lit(MEMBER)).otherwise(F.lit(b""))).alias("content"))
    return fi.triage_files(files, max_bytes=20000).select("doc_id", "status", "reason")


@query("a7_split_pages", sql("""
select doc_id, page_no, page, text from (
  select doc_id, unnest(range(0, len(lines) + 1)) as page_no, unnest(list_concat(['1'], list_transform(lines, lambda l, i: cast(i as varchar)))) as page,
    trim(unnest(list_concat([''], lines)), E' \\t\\r\\n') as text
  from (select doc_id, string_split(all_text, chr(10)) as lines from docs)) where text <> ''""", "docs"))
def a7(t: Tables) -> DataFrame:
    return fi.split_pages(t.paged_docs).withColumn("page_no", F.col("page_no").cast("long"))


@query("a9_upsert_documents", f"""
with old as (select sha256(text) as content_hash, min(doc_id) as d from documents where lang in ('en', 'fr') group by 1),
incoming as (select sha256(text) as content_hash, max(doc_id) as d from documents where lang <> 'en' group by 1)
select coalesce(i.content_hash, o.content_hash) as content_hash,
  case when i.d is null or (o.d is not null and i.d % 2 = 0) then 'os-' || cast(o.d as varchar)
    when i.d % 2 = 0 then '' else 'new-' || cast(i.d as varchar) end as os_doc_id,
  case when i.d is not null then 'new' else 'old' end as origin_file,
  case when i.d is not null then '{AS_OF}' else '2024-01-01 00:00:00' end as indexed_at
from old o full join incoming i using (content_hash)""")
def a9(t: Tables) -> DataFrame:
    docs = t("documents")
    row = lambda ident, origin, ts: (
        F.sha2("text", 256).alias("content_hash"), ident.alias("os_doc_id"), F.lit(origin).alias("origin_file"),
        F.lit(ts).cast("timestamp").alias("indexed_at"))
    first = docs.filter(F.col("lang").isin("en", "fr")).groupBy(F.sha2("text", 256).alias("content_hash")).agg(
        F.min("doc_id").alias("d"))
    existing = first.select(
        "content_hash", F.concat(F.lit("os-"), F.col("d").cast("string")).alias("os_doc_id"),
        F.lit("old").alias("origin_file"), F.lit("2024-01-01").cast("timestamp").alias("indexed_at"))
    ident = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("new-"), F.col("doc_id").cast("string")))
    incoming = docs.filter(F.col("lang") != "en").select(*row(ident, "new", AS_OF), "doc_id")
    out = co.upsert_documents(existing, incoming, AS_OF, "doc_id")
    return out.withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss"))


@query("a11_ingest_dictionary", sql("""
select 'loaded' as what, dict_type, '' as term, '' as replacement, count(*) as n from (
  select trim(lower(dict_type)) as dict_type from raw_dictionary
  where trim(lower(dict_type)) in ('synonym', 'stopword', 'user') and trim(term) <> '') group by dict_type
union all
select 'entry', dict_type, term, coalesce(nullif(trim(replacement), ''), ''), 1 from (
  select trim(lower(dict_type)) as dict_type, trim(term) as term, replacement, row_no from raw_dictionary)
where term <> '' and dict_type in ('synonym', 'stopword', 'user')
qualify row_number() over (partition by dict_type, term order by row_no desc) = 1""", "raw_dictionary"))
def a11(t: Tables) -> DataFrame:
    entries, counts = ingest_dictionary(None, t.raw_dictionary, "row_no")
    loaded = counts.select(
        F.lit("loaded").alias("what"), "dict_type", F.lit("").alias("term"), F.lit("").alias("replacement"),
        F.col("loaded").alias("n"))
    return loaded.unionByName(entries.select(
        F.lit("entry").alias("what"), "dict_type", "term", F.coalesce("replacement", F.lit("")).alias("replacement"),
        F.lit(1).cast("long").alias("n")))


@query("a12_upsert_dictionary", sql("select * from dictionary", "dictionary"))
def a12(t: Tables) -> DataFrame:
    return upsert_dictionary(None, t.raw_dictionary, "row_no")


@query("a14_unify_legacy_columns", """
select doc_id, text as all_text, source as doc_category,
  case when lang = 'de' then null else lang end as file_ext from documents""")
def a14(t: Tables) -> DataFrame:
    en = F.col("lang") == "en"
    docs = t("documents").select(
        "doc_id",
        F.when(en, F.col("text")).otherwise("").alias("all_text"), F.when(~en, F.col("text")).alias("alltext"),
        F.col("source").alias("doc_category"), F.lit("old").alias("doccategory"),
        F.when(F.col("lang") != "de", F.col("lang")).otherwise("").alias("fileext"))
    return co.unify_legacy_columns(docs)


# One-by-one indexing in order of doc_id, in as many rounds as it takes: of the rows still
# open, whoever is first under both keys is accepted and removes its rivals.
_RIVALS = {
    "walk(o, a, b, win)": """
select min(o), a, b, false from fresh group by a, b
union all
select o, a, b, o = min(o) over (partition by a) and o = min(o) over (partition by b) from (
  select o, a, b from walk where not win and a not in (select a from walk where win) and b not in (select b from walk where win))""",
    "accepted": "select distinct o from walk where win",
}


CLEAN = f"""
select doc_id as in_id, {sanitize("case when lang = 'es' then source || '.exe' else left(text, 12) || '.txt' end")} as title,
  case when n_chars < 40 then '' else {sanitize('text')} end as all_text, sha256(text) as content_hash from documents"""
EXISTING = f"""
select page_id as doc_id, title, all_text, content_hash from (
  select page_id, {sanitize("left(d.text, 12) || '.txt'")} as title, {sanitize("d.text || ' '")} as all_text,
    case when page_id % 2 = 0 then sha256(d.text) else 'none' end as content_hash
  from pages p join documents d on d.doc_id = p.page_id)"""
INDEXING = dict(
    clean=CLEAN, existing=EXISTING,
    usable="select * from clean where title like '%.txt' and all_text <> ''",
    keyed=f"""select *, title || chr(1) || all_text as ke, title || chr(1) || {compact('all_text')} as kt, {compact('all_text')} as whole,
  sha256(case when regexp_replace(left(all_text, 500), '[^가-힣a-zA-Z0-9]', '', 'g') <> ''
    then regexp_replace(left(all_text, 500), '[^가-힣a-zA-Z0-9]', '', 'g')
    else regexp_replace(title, '[^가-힣a-zA-Z0-9]', '', 'g') end) as legacy_hash from usable""",
    stored=f"""select *, title || chr(1) || all_text as ke, title || chr(1) || {compact('all_text')} as kt,
  nullif({compact('all_text')}, '') as whole from existing""",
    known="""select in_id, min(p) as p, min_by(doc_id, p * 1000000000::bigint + doc_id) as match_id from (
  select in_id, 1 as p, doc_id from keyed join stored using (ke)
  union all select in_id, 2, doc_id from keyed join stored using (kt)
  union all select in_id, 3, doc_id from keyed join stored using (content_hash)
  union all select in_id, 4, doc_id from keyed k join stored s on k.legacy_hash = s.content_hash and k.whole = s.whole) group by in_id""",
    fresh="select in_id as o, kt as a, content_hash as b from keyed where in_id not in (select in_id from known)",
    **_RIVALS,
)


def _raw(t: Tables) -> DataFrame:
    name = F.when(F.col("lang") == "es", F.concat("source", F.lit(".exe"))).otherwise(
        F.concat(F.substring("text", 1, 12), F.lit(".txt")))
    return t("documents").select(
        F.col("doc_id").alias("in_id"), name.alias("file_name"),
        F.when(F.col("n_chars") >= 40, F.col("text")).alias("text"), F.encode("text", "UTF-8").alias("content"))


def _existing(t: Tables) -> DataFrame:
    pages = t("pages").join(t("documents"), F.col("page_id") == F.col("doc_id"))
    return pages.select(
        F.col("page_id").alias("doc_id"),
        co.sanitize(F.concat(F.substring("text", 1, 12), F.lit(".txt"))).alias("title"),
        co.sanitize(F.concat("text", F.lit(" "))).alias("all_text"),
        F.when(F.col("page_id") % 2 == 0, F.sha2("text", 256)).otherwise("none").alias("content_hash"))


@query("a15_index_documents", sql("""
select c.in_id, c.title as file_name, c.content_hash,
  case when c.title not like '%.txt' or c.all_text = '' then 'fail' when a.o is not null then 'success' else 'skipped' end as outcome,
  case when c.title not like '%.txt' then 'unsupported' when c.all_text = '' then 'no_text'
    when k.p <= 2 then 'title_and_content' when k.p = 3 then 'content_hash' when k.p = 4 then 'legacy_digest'
    when a.o is not null then 'indexed' else 'in_batch' end as reason
from clean c left join known k on k.in_id = c.in_id left join accepted a on a.o = c.in_id""", **INDEXING).replace("with ", "with recursive ", 1))
def a15(t: Tables) -> DataFrame:
    _, outcomes = co.index_documents(_raw(t), _existing(t), AS_OF, rules=TEXT_RULES)
    return outcomes


@query("a15_indexed_rows", sql("""
select c.content_hash as doc_id, c.title, c.all_text,
  case when contains(title, 'tion') or contains(title, 'plan') then 'PLAN'
    when contains(title, 'ment') or contains(title, 'report') then 'REPORT'
    when contains(title, 'ung') or contains(title, 'rule') then 'RULE' else 'OTHERS' end as doc_category,
  c.all_text as chosung_text, replace(c.all_text, ' ', '') as chosung_text_ngram
from clean c join accepted a on a.o = c.in_id""", **INDEXING).replace("with ", "with recursive ", 1))
def a15_rows(t: Tables) -> DataFrame:
    docs, _ = co.index_documents(_raw(t), _existing(t), AS_OF, rules=TEXT_RULES)
    return docs.select("doc_id", "title", "all_text", "doc_category", "chosung_text", "chosung_text_ngram")


@query("b28_embed", """
select doc_id, (length(h) - length(replace(h, 'e', '')))::double as e, round(length(h)::double, 4) as n
from (select doc_id, left(text, 2000) as h from documents)""")
def b28(t: Tables) -> DataFrame:
    def load_model():
        return lambda texts: [[text.count("e"), len(text)] for text in texts]

    out = co.embed(t("documents").select("doc_id", F.col("text").alias("all_text")), load_model, dim=2)
    return out.select("doc_id", F.col("text_vector")[0].cast("double").alias("e"), F.col("text_vector")[1].cast("double").alias("n"))


@query("d13_find_duplicates", sql("""
select in_id, case when p <= 2 then 'title_and_content' when p = 3 then 'content_hash' else 'legacy_digest' end as reason, match_id
from known""", **INDEXING).replace("with ", "with recursive ", 1))
def d13(t: Tables) -> DataFrame:
    raw = _raw(t).select(
        "in_id", co.sanitize("file_name").alias("title"), co.sanitize("text").alias("all_text"),
        F.sha2("content", 256).alias("content_hash"))
    usable = materialize(raw, "incoming").filter((F.col("all_text") != "") & F.col("title").endswith(".txt"))
    return co.find_duplicates(usable.withColumn("legacy_hash", co.content_digest("all_text", "title")), _existing(t))


@query("d14_diff_files", sql("""
select coalesce(l.source_type, s.source_type) as source_type, coalesce(l.source_name, s.source_name) as source_name,
  coalesce(l.file_path, s.file_path) as file_path,
  case when s.file_hash is null then 'new' when l.file_hash is null then 'deleted'
    when s.file_hash = l.file_hash then 'unchanged' else 'changed' end as change,
  coalesce(l.file_hash, s.file_hash) as file_hash
from listing l full join file_states s on l.source_type = s.source_type and l.source_name = s.source_name and l.file_path = s.file_path""",
    "listing", "file_states"))
def d14(t: Tables) -> DataFrame:
    return co.diff_files(t.listing, t.file_states)
