"""Scalar text functions over whole stored texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hangul as hg
from ..functions import highlight as hi
from ..functions import rewrite as rw
from ..functions import text as tx
from ..operators.dictionary import upsert_dictionary
from ..sources.adapters import TEXT_RULES, Tables, as_jamo, as_syllables
from .ctes import as_jamo as jamo_sql
from .ctes import as_syllables as syllables_sql
from .ctes import chosung, compact, sanitize, sql, strip
from .registry import query

NOISY = "chr(1) || replace(text, ' ', '  ') || chr(9) || '%^&한글ㄱㅏ' || chr(160)"


def _noisy() -> Column:
    """The text with a control character, doubled spaces and off-list characters."""
    return F.concat(
        F.lit("\x01"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\t%^&한글ㄱㅏ "))


@query("b1_sanitize", f"select doc_id, {sanitize(NOISY)} as text from documents")
def b1(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.sanitize(_noisy()).alias("text"))


@query("b2_sanitize_record", f"""
select doc_id, {sanitize('text')} as text, 0.0::double as ratio, n_chars, {sanitize('source')} as source, {sanitize('lang')} as lang
from documents""")
def b2(t: Tables) -> DataFrame:
    record = t("documents").select(
        "doc_id", "n_chars",
        F.struct(
            F.encode("text", "UTF-8").alias("body"),
            F.array(F.create_map(F.lit("lang%"), F.col("lang"))).alias("tags"),
            (F.col("n_chars") * F.lit(float("inf"))).alias("ratio"),
            F.col("source")).alias("r"))
    out = tx.sanitize_record(record)
    return out.select(
        "doc_id", "n_chars", F.col("r.body").alias("text"), F.col("r.ratio").alias("ratio"),
        F.col("r.source").alias("source"), F.get(F.col("r.tags"), F.lit(0))["lang%"].alias("lang"))


@query("b3_clean_text",
       r"select doc_id, regexp_replace(" + NOISY + r", '[^가-힣\x{3131}-\x{318E}\x20-\x7E\t\n\r]', '', 'g') as text from documents")
def b3(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.clean_text(_noisy()).alias("text"))


@query("b4_scrub_query",
       r"select doc_id, regexp_replace(text, '[^가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g') as text from documents")
def b4(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.scrub_query("text").alias("text"))


@query("b5_content_digest", """
select doc_id, sha256(case when head <> '' then head else regexp_replace(name, '[^가-힣a-zA-Z0-9]', '', 'g') end) as digest
from (select doc_id, source || '.txt' as name,
  regexp_replace(left(case when lang = 'de' then '...' else text end, 500), '[^가-힣a-zA-Z0-9]', '', 'g') as head from documents)""")
def b5(t: Tables) -> DataFrame:
    text = F.when(F.col("lang") == "de", "...").otherwise(F.col("text"))
    return t("documents").select(
        "doc_id", tx.content_digest(text, F.concat("source", F.lit(".txt"))).alias("digest"))


@query("b6_byte_digest", "select page_id, sha256(html) as digest from pages")
def b6(t: Tables) -> DataFrame:
    return t("pages").select("page_id", tx.byte_digest(F.encode("html", "UTF-8")).alias("digest"))


@query("b7_map_category", sql("""
select doc_id, doc_category, case when contains(name, '계획') or contains(name, '기획') then 'PLAN'
  when contains(name, '보고') or contains(name, '결과') then 'REPORT'
  when contains(name, '규정') or contains(name, '지침') or contains(name, '가이드') or contains(name, '법규') then 'RULE'
  else 'OTHERS' end as hangul_category
from (select *, title || case file_ext when 'pdf' then '계획' when 'docx' then '결과' when 'xlsx' then '보안지침' else '' end as name
  from docs)""", "docs"))
def b7(t: Tables) -> DataFrame:
    tail = F.when(F.col("file_ext") == "pdf", "계획").when(F.col("file_ext") == "docx", "결과").when(
        F.col("file_ext") == "xlsx", "보안지침").otherwise("")
    return t.docs.select(
        "doc_id", tx.map_category("title", TEXT_RULES).alias("doc_category"),
        tx.map_category(F.concat("title", tail)).alias("hangul_category"))


CATEGORY_WORDS = {"PLAN": " plan ", "REPORT": "결과보고서", "RULE": "사내규정 ", "OTHERS": "other"}


@query("b8_normalize_category", sql("select doc_id, doc_category as category from docs", "docs"))
def b8(t: Tables) -> DataFrame:
    spelled = F.lit("")
    for category, word in CATEGORY_WORDS.items():
        spelled = F.when(F.col("doc_category") == category, word).otherwise(spelled)
    return t.docs.select("doc_id", tx.normalize_category(spelled).alias("category"))


@query("b9_normalize_ext", sql("""
select doc_id, file_ext as ext, case when file_ext = 'txt' then 'unknown' else file_ext end as stats_ext, file_ext as name_ext
from docs""", "docs"))
def b9(t: Tables) -> DataFrame:
    return t.docs.select(
        "doc_id", tx.normalize_ext(F.concat(F.lit(" .."), F.upper("file_ext"), F.lit(" "))).alias("ext"),
        tx.ext_for_stats(F.when(F.col("file_ext") != "txt", F.concat(F.lit("."), "file_ext"))).alias("stats_ext"),
        tx.ext_of("origin_file").alias("name_ext"))


@query("b10_to_chosung", sql(f"select doc_id, {chosung('all_text')} as chosung from hangul_docs", "hangul_docs"))
def b10(t: Tables) -> DataFrame:
    return t.hangul_docs.select("doc_id", hg.to_chosung("all_text").alias("chosung"))


@query("b11_chosung_ngrams", f"""
select p_partkey, count(distinct g) as n_grams, count(distinct g) filter (length(g) = 2) as bigrams, max(g) as last_gram from (
  select p_partkey, unnest(flatten(list_transform(range(2, 21),
    lambda n: list_transform(range(1, greatest(length(c) - n + 2, 1)), lambda i: c[i:i + n - 1])))) as g
  from (select p_partkey, replace({chosung(syllables_sql('p_name'))}, ' ', '') as c from part))
group by 1""")
def b11(t: Tables) -> DataFrame:
    grams = t("part").select("p_partkey", hg.chosung_ngrams(as_syllables("p_name")).alias("g"))
    return grams.select(
        "p_partkey", F.size("g").cast("long").alias("n_grams"),
        F.size(F.filter("g", lambda g: F.length(g) == 2)).cast("long").alias("bigrams"),
        F.array_max("g").alias("last_gram"))


INITIALS, VOWELS = hg.INITIALS, hg.VOWELS


def _number(x: str, table: dict[str, int], default: int) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    return f"case {x} {cases} else {default} end"


_PAIRS = "|".join(hg.VOWEL_PAIRS)
_TAIL = "|".join(hg.FINAL_PAIRS)
_VOWEL_NO = {**{v: i for i, v in enumerate(VOWELS)}, **{p: VOWELS.index(v) for p, v in hg.VOWEL_PAIRS.items()}}
_FINAL_NO = {**{f: i + 1 for i, f in enumerate(hg.FINALS)}, **{p: hg.FINALS.index(f) + 1 for p, f in hg.FINAL_PAIRS.items()}}
# Cut before every "initial? vowel": what is left in a piece after the vowel can no
# longer be the next syllable's initial.
JAMO_SQL = f"""
select doc_id, coalesce(string_agg(out, '' order by i), '') as composed from (
  select doc_id, i, case when v = '' then piece else
      chr(cast(44032 + ({_number('c', {x: i for i, x in enumerate(INITIALS)}, 11)} * 21 + {_number('v', _VOWEL_NO, 0)}) * 28
        + {_number('f', _FINAL_NO, 0)} as int)) || substr(piece, length(c) + length(v) + length(f) + 1) end as out
  from (
    select doc_id, i, piece, c, v, regexp_extract(substr(piece, length(c) + length(v) + 1), '^(?:{_TAIL}|[{INITIALS}])') as f from (
      select doc_id, i, piece, regexp_extract(piece, '^([{INITIALS}]?)(?:[{VOWELS}])', 1) as c,
        regexp_extract(piece, '^[{INITIALS}]?((?:{_PAIRS}|[{VOWELS}]))', 1) as v from (
        select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i from (
          select doc_id, string_split(regexp_replace(regexp_replace({jamo_sql('text')}, '[ |]', '', 'g'),
            '[{INITIALS}]?(?:{_PAIRS}|[{VOWELS}])', chr(30) || '\\0', 'g'), chr(30)) as pieces from documents)))))
group by 1"""


@query("b12_compose_jamo", JAMO_SQL)
def b12(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", hg.compose_jamo(as_jamo("text")).alias("composed"))


HINTS = "|".join(hg.DOMAIN_HINTS)


@query("b13_classify_query", sql(f"""
select qid, regexp_full_match(q, '[ㄱ-ㅎㅏ-ㅣ| ]+') as is_jamo, regexp_full_match(q, '[ㄱ-ㅎ| ]+') as is_chosung,
  regexp_full_match(q, '[가-힣]+') and not regexp_matches(q, '{HINTS}') as is_name_like
from (select qid, case when qid % 3 = 0 then replace(query, ' ', '') when qid % 3 = 1 then {chosung('query')} else query || '계획' end as q
  from name_queries)""", "name_queries"))
def b13(t: Tables) -> DataFrame:
    kind = F.col("qid") % 3
    q = F.when(kind == 0, F.replace("query", F.lit(" "), F.lit(""))).when(kind == 1, hg.to_chosung("query")).otherwise(
        F.concat("query", F.lit("계획")))
    return t.name_queries.select("qid", hg.classify_query(q).alias("c")).select("qid", "c.*")


def typos_sql(x: str) -> str:
    for wrong, right in rw.TYPO_PAIRS:
        x = f"replace({x}, '{wrong}', '{right}')"
    return x


@query("b14_fix_typos", f"""
select p_partkey, {typos_sql("trim(p_name || ' ' || " + '''(['계확', '게획', '산엽', '계획서', '개휙안'])[p_size % 5 + 1] || ' ')''')} as fixed from part""")
def b14(t: Tables) -> DataFrame:
    words = F.array(*map(F.lit, ["계확", "게획", "산엽", "계획서", "개휙안"]))
    text = F.concat("p_name", F.lit(" "), F.get(words, F.col("p_size") % 5), F.lit(" "))
    return t("part").select("p_partkey", rw.fix_typos(text).alias("fixed"))


def rewrite_ctes(source: str, column: str) -> dict[str, str]:
    """normalized and expanded of a query column by the dictionary."""
    return dict(
        active="""select dict_type, trim(term) as term, trim(coalesce(replacement, '')) as replacement from dictionary
where is_active and (dict_type = 'stopword' or trim(coalesce(replacement, '')) <> '')""",
        fixes="select list(term || chr(1) || replacement order by term) as fix from active where dict_type = 'user'",
        stops="select list(term) as stop from active where dict_type = 'stopword'",
        syns="select list({t: term, r: replacement} order by term) as syn from active where dict_type = 'synonym'",
        corrected=f"""select *, list_reduce(list_prepend({strip(column)}, fix),
  lambda acc, e: replace(acc, string_split(e, chr(1))[1], string_split(e, chr(1))[2])) as fixed from {source}, fixes""",
        kept="""select * exclude (fix), list_filter(string_split_regex(fixed, '\\s+'), lambda w: w <> '' and not list_contains(stop, w)) as kept
from corrected, stops""",
        normal="select * exclude (stop, kept), case when len(kept) > 0 then array_to_string(kept, ' ') else fixed end as normalized from kept",
        rewritten="""select * exclude (syn), case when fixed = '' then [] else
  list_transform(list_filter(syn, lambda s: contains(normalized, s.t)), lambda s: s.r) end as raw_expanded from normal, syns""",
    )


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


@query("b15_rewrite_queries", sql(
    f"select qid, normalized, array_to_string({ordered_distinct('raw_expanded')}, '|') as expanded from rewritten",
    "name_queries", "dictionary", **rewrite_ctes("name_queries", "query")))
def b15(t: Tables) -> DataFrame:
    dictionary = upsert_dictionary(None, t.raw_dictionary, "row_no")
    return rw.rewrite_queries(t.name_queries, dictionary).select(
        "qid", "normalized", F.array_join("expanded", "|").alias("expanded"))


PART_SYNONYMS = {"AI": ("인공지능", "Machine Learning"), "RING": ("loop", "band"), "Bolt": ("screw",)}
STATIC_SQL = """list_concat(
  case when contains(lower({q}), 'ai') then ['인공지능', 'Machine Learning'] else [] end,
  case when contains(lower({q}), 'ring') then ['loop', 'band'] else [] end,
  case when contains(lower({q}), 'bolt') then ['screw'] else [] end)"""


@query("b16_expand_static", sql(f"""
select qid, array_to_string(list_concat([query], {STATIC_SQL.format(q='query')}), '|') as target_keywords
from name_queries""", "name_queries"))
def b16(t: Tables) -> DataFrame:
    out = rw.expand_static(t.name_queries, "query", PART_SYNONYMS)
    return out.select("qid", F.array_join("target_keywords", "|").alias("target_keywords"))


def prepared_ctes(source: str) -> dict[str, str]:
    """Prepared requests (`ready`: final, clean, original_query, raw_expanded) of a
    table with qid and query."""
    return dict(
        asked=f"select * exclude (query), {sanitize('query')} as original_query from {source}",
        **rewrite_ctes("asked", "original_query"),
        cleaned=f"""select *, case when coalesce(nullif(normalized, ''), original_query) = original_query
  then {typos_sql('trim(original_query)')} else normalized end as clean from rewritten""",
        # jamo composition of a short column, reusing the piecewise form above
        typed="select qid as doc_id, clean as text from cleaned where regexp_full_match(clean, '[ㄱ-ㅎㅏ-ㅣ| ]+')",
        composed=JAMO_SQL.replace(jamo_sql("text"), "text").replace("from documents", "from typed"),
        ready="""select c.*, case when k.composed is not null and regexp_matches(k.composed, '[가-힣]') then k.composed else c.clean end as final
from cleaned c left join composed k on k.doc_id = c.qid""",
    )


@query("b17_prepare_queries", sql(f"""
select qid, original_query, final as corrected_query, clean <> original_query as is_typo_corrected,
  regexp_full_match(final, '[ㄱ-ㅎ| ]+') as is_chosung,
  regexp_full_match(trim(final), '[가-힣]+') and not regexp_matches(final, '{HINTS}') as is_name_like,
  array_to_string(list_filter(list_concat([final], {STATIC_SQL.format(q='final')}, {ordered_distinct('raw_expanded')}),
    lambda k: k <> ''), '|') as target_keywords
from ready""", "name_queries", "dictionary", **prepared_ctes("name_queries")))
def b17(t: Tables) -> DataFrame:
    dictionary = upsert_dictionary(None, t.raw_dictionary, "row_no")
    out = rw.prepare_queries(t.name_queries, dictionary, synonyms=PART_SYNONYMS)
    return out.select(
        "qid", "original_query", "corrected_query", "is_typo_corrected", "is_chosung", "is_name_like",
        F.array_join("target_keywords", "|").alias("target_keywords"))


@query("b18_compact", f"select doc_id, {compact('text')} as compact from documents")
def b18(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.compact("text").alias("compact"))


@query("b19_token_set", """
select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text),
  '[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'),
  lambda w: length(w) >= 2))), ' ') as tokens from documents""")
def b19(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(F.array_sort(tx.token_set("text")), " ").alias("tokens"))


@query("b20_char_ngrams", f"""
select doc_id, coalesce(string_agg(g, ' ' order by g), '') as grams, count(*) as n from (
  select distinct doc_id, unnest(case when length(c) >= 2 then list_transform(range(1, length(c)), lambda i: c[i:i + 1]) else [c] end) as g
  from (select doc_id, {compact('text')} as c from documents)) group by 1""")
def b20(t: Tables) -> DataFrame:
    grams = t("documents").select("doc_id", tx.char_ngrams("text").alias("g"))
    return grams.select("doc_id", F.array_join(F.array_sort("g"), " ").alias("grams"), F.size("g").cast("long").alias("n"))


def snippet_sql(text: str, start: str, size: str) -> str:
    """`start` is one-based here."""
    return f"""case when {start} > 61 then '...' else '' end
  || substr({text}, greatest({start} - 60, 1), least({start} - 1, 60))
  || '<mark>' || substr({text}, {start}, {size}) || '</mark>'
  || substr({text}, {start} + {size}, 60)
  || case when {start} + {size} + 59 < length({text}) then '...' else '' end"""


@query("b21_snippet", f"""
select doc_id, {snippet_sql('text', '(length(text) // 2 + 1)', 'least(4, length(text) - length(text) // 2)')} as snippet from documents""")
def b21(t: Tables) -> DataFrame:
    n = F.length("text")
    start = F.floor(n / 2).cast("int")
    return t("documents").select("doc_id", hi.snippet("text", start, F.least(n, start + 4)).alias("snippet"))


def page_sql(text: str, at: str) -> str:
    found = rf"regexp_extract_all(substr({text}, 1, {at} - 1), '\[\[Page\s+(\d+)\]\]', 1)"
    return f"coalesce({found}[-1], '1')"


@query("b22_highlight", sql(f"""
select doc_id, page, summary from (
  select doc_id, {page_sql('all_text', 'pos')} as page, {snippet_sql('all_text', 'pos', 'length(kw)')} as summary from (
    select doc_id, all_text, case when p1 > 0 then p1 else p2 end as pos, case when p1 > 0 then 'tion' else 'ung' end as kw from (
      select *, instr(lower(all_text), 'tion') as p1, instr(lower(all_text), 'ung') as p2 from paged_docs)
    where p1 > 0 or p2 > 0))""", "paged_docs"))
def b22(t: Tables) -> DataFrame:
    found = t.paged_docs.select(
        "doc_id", hi.highlight("all_text", F.array(F.lit(" TION "), F.lit("Ung"))).alias("h"))
    return found.filter("h is not null").select("doc_id", "h.page", "h.summary")


@query("b23_highlight_chosung", sql(f"""
select doc_id, {page_sql('all_text', 'pos')} as page, {snippet_sql('all_text', 'pos', '3')} as summary from (
  select doc_id, all_text, instr({chosung('all_text')}, 'ㅂㅈㄹ') as pos from hangul_docs) where pos > 0""", "hangul_docs"))
def b23(t: Tables) -> DataFrame:
    found = t.hangul_docs.select("doc_id", hi.highlight_chosung("all_text", F.lit(" ㅂㅈ ㄹ")).alias("h"))
    return found.filter("h is not null").select("doc_id", "h.page", "h.summary")


@query("b24_fallback_summary", """
select doc_id, case when lang = 'fr' then '내용 없음' else left(text, 200) || '...' end as summary from documents""")
def b24(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", hi.fallback_summary(F.when(F.col("lang") != "fr", F.col("text"))).alias("summary"))


@query("b25_contains_exact", sql("""
select doc_id, contains(lower(title), 'the of') or contains(lower(all_text), 'the of') as hit, false as empty_hit from docs""", "docs"))
def b25(t: Tables) -> DataFrame:
    return t.docs.select(
        "doc_id", hi.contains_exact("title", "all_text", F.lit(" The OF ")).alias("hit"),
        hi.contains_exact("title", "all_text", F.lit("")).alias("empty_hit"))


@query("b26_preview", sql("""
select doc_id, left(all_text, 120) as text_preview, left(all_text, 100) || '...' as short_preview,
  strftime(indexed_at, '%Y-%m-%d') as day from docs""", "docs"))
def b26(t: Tables) -> DataFrame:
    return t.docs.select(
        "doc_id", tx.preview("all_text").alias("text_preview"), tx.preview("all_text", 100, "...").alias("short_preview"),
        F.substring(F.col("indexed_at").cast("string"), 1, 10).alias("day"))


@query("b27_valid_utf8", "select doc_id, text as plain, text || 'x' as repaired from documents")
def b27(t: Tables) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("FFFE")), F.unhex(F.lit("78")), F.unhex(F.lit("C3")))
    return t("documents").select("doc_id", tx.valid_utf8(raw).alias("plain"), tx.valid_utf8(broken).alias("repaired"))


AUDIT_HEADS = ("select ", "-- note\nselect ", "delete ", "select 1; drop ", "SELECT a -- call me\n, ")


@query("b29_audit_sql", r"""
select doc_id, reason = 'ok' as ok, reason from (
  select doc_id, case when bare not like 'select%' then 'not_select'
    when regexp_matches(bare, ';|insert |update |delete |drop |alter |truncate |create |grant |revoke |execute |call ') then 'forbidden'
    else 'ok' end as reason from (
    select doc_id, lower(trim(regexp_replace(q, '(?m)--.*?$', '', 'g'), E' \n')) as bare from (
      select doc_id, (['select ', E'-- note\nselect ', 'delete ', 'select 1; drop ', E'SELECT a -- call me\n, '])[n_chars % 5 + 1] || text as q
      from documents)))""")
def b29(t: Tables) -> DataFrame:
    head = F.get(F.array(*map(F.lit, AUDIT_HEADS)), (F.col("n_chars") % 5).cast("int"))
    return t("documents").select("doc_id", tx.audit_sql(F.concat(head, "text")).alias("a")).select("doc_id", "a.*")
