"""SQL forms of the logical tables, for the DuckDB twins of the queries."""

from __future__ import annotations

from ..sources.adapters import AS_OF, KEYBOARD_JAMO, LATIN, SYLLABLES

WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NOW = f"timestamp '{AS_OF}'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sanitize(x: str) -> str:
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
    keep = r"""가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9.,!?;:()"''\-\[\]<>+_"""
    cleaned = f"regexp_replace(regexp_replace({x}, '{control}', ' ', 'g'), '[^{keep}{WS}]', '', 'g')"
    return strip(f"regexp_replace({cleaned}, ' +', ' ', 'g')")


def compact(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^가-힣a-z0-9]', '', 'g')"


def as_syllables(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{SYLLABLES}')"


def as_jamo(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{KEYBOARD_JAMO}')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def chosung(x: str) -> str:
    """One character class per initial consonant: 588 consecutive syllables each."""
    for i, initial in enumerate("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"):
        lo, hi = chr(0xAC00 + 588 * i), chr(0xAC00 + 588 * i + 587)
        x = f"regexp_replace({x}, '[{lo}-{hi}]', '{initial}', 'g')"
    return x


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


_cte("logs", """
select event_id as id, cast(user_id as varchar) as user_id,
  event_type || ' ' || cast(cast(json_extract_string(props, '$.k') as bigint) % 20 as varchar) as query,
  cast(floor(value) as bigint) as total_hits, floor(value) = 0 as is_failed,
  'manual_search' as search_type, cast(ts as timestamp) as created_at
from events""")

_cte("docs", """
select doc_id, left(text, 60) as title, text as all_text,
  case when contains(left(text, 60), 'tion') or contains(left(text, 60), 'plan') then 'PLAN'
       when contains(left(text, 60), 'ment') or contains(left(text, 60), 'report') then 'REPORT'
       when contains(left(text, 60), 'ung') or contains(left(text, 60), 'rule') then 'RULE'
       else 'OTHERS' end as doc_category,
  (['pdf', 'docx', 'xlsx', 'pptx', 'txt'])[cast(regexp_extract(source, '(\\d+)', 1) as int) % 5 + 1] as file_ext,
  left(text, 60) || '.' ||
  (['pdf', 'docx', 'xlsx', 'pptx', 'txt'])[cast(regexp_extract(source, '(\\d+)', 1) as int) % 5 + 1] as origin_file,
  sha256(text) as content_hash, source as source_label,
  timestamp '2024-01-01' + to_minutes(doc_id) as indexed_at
from documents""")

_cte("hangul_docs", f"""
select * replace ({as_syllables('title')} as title, {as_syllables('all_text')} as all_text) from docs""", "docs")

_cte("paged_docs", """
select * replace (list_aggregate(list_transform(string_split(all_text, chr(10)),
  lambda line, i: '[[Page ' || cast(i as varchar) || ']]' || chr(10) || line), 'string_agg', chr(10)) as all_text)
from docs""", "docs")

_cte("requests", f"""
select item_id as qid, concat_ws(' ', w[3], w[4]) as query,
  case when item_id % 4 = 1 then [w[5]] else [] end as include_keywords,
  case when item_id % 4 = 2 then [w[6]] else [] end as exclude_keywords,
  case when item_id % 5 = 3 then timestamp '2024-01-01 01:00:00' end as start_date,
  case when item_id % 5 = 4 then timestamp '2024-02-10 00:00:00' end as end_date,
  case when item_id % 6 = 5 then 'other' else '' end as doc_category,
  case when item_id % 7 = 6 then '.PDF' else '' end as file_ext,
  0.0 as min_score, item_id % 3 * 5 + 5 as size, item_id % 2 + 1 as page, 'user-' || cast(item_id % 5 as varchar) as user_id
from (select item_id, {words('text')} as w from benchmark)""")

_cte("raw_dictionary", """
select p_partkey as row_no,
  case p_type when 'ECONOMY' then 'synonym' when 'SMALL' then 'stopword' when 'STANDARD' then 'user'
              when 'PROMO' then ' User_Dict ' else 'other' end as dict_type,
  case when p_size % 2 = 0 then string_split(p_name, ' ')[1] else string_split(p_name, ' ')[2] end as term,
  case when p_size % 5 = 0 then '' else p_brand end as replacement,
  p_retailprice % 10 >= 1 as is_active
from part""")

_cte("dictionary", """
select dict_type, term, replacement, is_active from (
  select case when trim(lower(dict_type)) in ('user_dict', 'userdict') then 'user' else trim(lower(dict_type)) end as dict_type,
    trim(term) as term, replacement, is_active, row_no from raw_dictionary)
where term <> '' and dict_type in ('synonym', 'stopword', 'user')
qualify row_number() over (partition by dict_type, term order by row_no desc) = 1""", "raw_dictionary")

_cte("name_queries", f"""
select p_partkey as qid,
  case p_size % 4 when 2 then {as_syllables('p_name')} when 3 then {as_jamo('p_name')} else p_name end as query
from part""")

_cte("listing", """
select 'smb' as source_type, source as source_name, '/mnt/' || source || '/' || cast(doc_id as varchar) || '.txt' as file_path,
  sha256(text) as file_hash, length(text) as file_size from documents""")

_cte("file_states", """
select 'smb' as source_type, source as source_name, '/mnt/' || source || '/' || cast(doc_id as varchar) || '.txt' as file_path,
  sha256(case when quality = 0 then upper(text) else text end) as file_hash
from documents join labels using (doc_id)
union all
select 'smb', 'web', url, min(sha256(html)) from pages group by url""")

_cte("outcomes", """
select 'smb' as source_type, 'share-' || cast(user_id % 16 as varchar) as source_name,
  'file-' || cast(event_id as varchar) || '.txt' as file_name,
  case event_type when 'error' then 'fail' when 'click' then 'skipped' when 'view' then 'unchanged' else 'success' end as outcome
from events""")

_cte("history", """
select event_id as id, case when user_id % 3 = 0 then 'db' else 'smb' end as source_type,
  'share-' || cast(user_id % 16 as varchar) as source_name,
  case event_type when 'view' then 'index' else 'sync_summary' end as action,
  case event_type when 'error' then 'fail' when 'click' then 'partial' else 'success' end as status,
  cast(ts as timestamp) as created_at
from events""")

_cte("smb_sources", """
select s_suppkey as id, s_name as name, '/mnt/' || lower(s_name) as root,
  'alias-' || cast(s_nationkey as varchar) as target_volume, s_acctbal > 2000 as is_active from supplier""")

_cte("db_sources", """
select c_custkey as id, c_name as name,
  case c_mktsegment when 'BUILDING' then 'missing' when 'MACHINERY' then 'index-' || cast(c_nationkey as varchar)
    when 'HOUSEHOLD' then '' else 'alias-' || cast(c_nationkey as varchar) end as target_volume,
  c_acctbal > 2000 as is_active
from customer""")

_cte("volumes", """
select 'index-' || cast(n_nationkey as varchar) as index_name, 'alias-' || cast(n_nationkey as varchar) as alias_name,
  n_regionkey <> 4 as is_active from nation""")

_cte("schedules", """
select *, case when interval_minutes % 5 <> 0 then last_run_at + to_minutes(interval_minutes) end as next_run_at from (
  select 'smb' as source_type, s_suppkey as source_id, cast(60 + s_suppkey % 24 as bigint) as interval_minutes,
    s_acctbal < 5000 as is_enabled, timestamp '2024-01-29' + to_minutes(s_suppkey % 2880) as last_run_at
  from supplier where s_acctbal between 500 and 6000
  union all
  select 'db', c_custkey, cast(60 + c_custkey % 24 as bigint), c_acctbal < 5000, timestamp '2024-01-29' + to_minutes(c_custkey % 2880)
  from customer where c_acctbal between 500 and 6000
  union all
  select 'smb', s_suppkey + 1000000000, cast(60 + s_suppkey % 24 as bigint), s_acctbal < 5000, timestamp '2024-01-29' + to_minutes(s_suppkey % 2880)
  from supplier where s_acctbal > 7000)""")

_cte("certificates", """
select c_name as cert_name, case when c_mktsegment <> 'FURNITURE'
  then timestamp '2024-01-28' + to_minutes(cast(floor(c_acctbal * 10) as bigint)) end as expires_at
from customer""")

_cte("probes", """
select event_id as id, 'smb:' || cast(user_id % 10 as varchar) as key, cast(ts as timestamp) as ts, event_type <> 'error' as ok
from events""")

_cte("auth_events", """
select event_id as id, cast(ts as timestamp) as ts, 'User' || cast(user_id % 20 as varchar) as username,
  'ip-' || cast(user_id % 7 as varchar) as client_ip, event_type = 'view' as success
from events""")

_cte("popular", f"""
select query as keyword, count(*) as cnt from logs where created_at >= {NOW} - interval 7 day group by 1""", "logs")


def sql(body: str, *tables: str, **extra: str) -> str:
    """The query with the logical tables it names, and any `extra` CTEs in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, text = CTES[name]
            for need in needs:
                add(need)
            done[name] = text

    for table in tables:
        add(table)
    done.update(extra)
    if not done:
        return body.strip()
    head = ",\n".join(f"{name} as (\n{text.strip()}\n)" for name, text in done.items())
    return f"with {head}\n{body.strip()}"
