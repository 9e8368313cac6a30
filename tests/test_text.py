from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from textlake.functions import hangul as hg
from textlake.functions import highlight as hi
from textlake.functions import rewrite as rw
from textlake.functions import text as tx
from textlake.operators.dictionary import upsert_dictionary


def one(spark, column, *values):
    """The column's value over one row with columns a, b, ..."""
    names = "abcdef"[:len(values)]
    return spark.createDataFrame([values], [*names]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "expected"), [
    ("a\x01b  c%d", "a b cd"), ("  가 나  ", "가 나"), ("漢字 ok", "ok"), ("", ""), ("x+_[]<>", "x+_[]<>"),
])
def test_sanitize(spark, given, expected):
    assert one(spark, tx.sanitize("a"), given) == expected


@pytest.mark.parametrize(("given", "expected"), [
    ("연구개발 abc", "ㅇㄱㄱㅂ abc"), ("보안", "ㅂㅇ"), ("통합검색", "ㅌㅎㄱㅅ"), ("계획서", "ㄱㅎㅅ"), ("", ""),
])
def test_chosung(spark, given, expected):
    assert one(spark, hg.to_chosung("a"), given) == expected


@pytest.mark.parametrize(("given", "expected"), [
    ("ㄱㅏㄴㅏ", "가나"), ("ㅏ", "아"), ("ㄷㅏㄹㄱ", "닭"), ("ㄷㅏㄹㄱㅏ", "달가"), ("ㄱ ㅏ|ㄴ", "간"), ("ㅗㅏ", "와"),
    ("ㄱㅡㅣ", "긔"), ("ㄱㄱㅏ", "ㄱ가"), ("ㅎㅏㄴㄱㅡㄹ", "한글"), ("ㄱㅏㄸ", "가"), ("abㄱㅏ", "ab가"), ("ㅂㅏㅂㅅㄱ", "밦ㄱ"),
])
def test_compose_jamo(spark, given, expected):
    assert one(spark, hg.compose_jamo("a"), given) == expected


def test_compose_final_pair(spark):
    assert one(spark, hg.compose_jamo("a"), "ㄱㅏㅂㅅ") == "값"
    assert one(spark, hg.compose_jamo("a"), "ㄱㅏㅂㅅㅣ") == "갑시"


@pytest.mark.parametrize(("name", "expected"), [
    ("사업계획서.pdf", "PLAN"), ("결과보고.pdf", "REPORT"), ("보안지침.hwp", "RULE"), ("memo.txt", "OTHERS"),
])
def test_category(spark, name, expected):
    assert one(spark, tx.map_category("a"), name) == expected


def test_query_classes(spark):
    row = one(spark, hg.classify_query("a"), "홍길동")
    assert row.is_name_like and not row.is_jamo
    assert not one(spark, hg.classify_query("a"), "연구계획").is_name_like
    assert one(spark, hg.classify_query("a"), "ㅂㅇ ㅅ").is_chosung
    assert not one(spark, hg.classify_query("a"), "ㅂㅏ").is_chosung


@pytest.mark.parametrize(("given", "reason"), [
    ("select 1; drop table x", "forbidden"), ("select a from t -- insert ", "ok"), ("update t", "not_select"),
    ("  ", "empty"), ("-- x\nselect 1", "ok"),
])
def test_audit_sql(spark, given, reason):
    assert one(spark, tx.audit_sql("a"), given).reason == reason


def test_highlight_page_and_snippet(spark):
    text = "[[Page 1]] intro [[Page 2]] " + "x" * 80 + " Needle here"
    hit = one(spark, hi.highlight("a", F.array(F.lit("absent"), F.lit(" needle "))), text)
    assert hit.page == "2"
    assert hit.summary.startswith("...") and "<mark>Needle</mark> here" in hit.summary
    assert not hit.summary.endswith("...")
    assert one(spark, hi.highlight("a", F.array(F.lit("absent"))), text) is None


def test_highlight_chosung(spark):
    hit = one(spark, hi.highlight_chosung("a", F.lit("ㅂ ㅇ")), "우리 보안 문서")
    assert hit.summary == "우리 <mark>보안</mark> 문서"


def test_fallback_summary(spark):
    assert one(spark, hi.fallback_summary("a"), "") == "내용 없음"
    assert one(spark, hi.fallback_summary("a"), "ab") == "ab..."


def test_long_chosung_ngrams(spark):
    grams = one(spark, hg.chosung_ngrams("a"), "가 나다")
    assert sorted(grams) == ["ㄱㄴ", "ㄱㄴㄷ", "ㄴㄷ"]


def dictionary(spark):
    rows = [(1, "stopword", "에", None, True), (2, "synonym", "AI", "인공지능", True), (3, "user_dict", "게획", "계획", True),
            (4, "user", "off", "on", False)]
    frame = spark.createDataFrame(rows, "n int, dict_type string, term string, replacement string, is_active boolean")
    return upsert_dictionary(None, frame, "n")


def test_dictionary_rewrite(spark):
    queries = spark.createDataFrame([("AI 게획 에",), ("에",), ("off b b",)], ["query"])
    rows = {r.query: r for r in rw.rewrite_queries(queries, dictionary(spark)).collect()}
    assert rows["AI 게획 에"].normalized == "AI 계획" and rows["AI 게획 에"].expanded == ["인공지능"]
    assert rows["에"].normalized == "에"
    assert rows["off b b"].normalized == "off b b"


def plain_rewrite(query, entries):
    """Entry after entry, as one loop."""
    user, stop, synonyms = (sorted((t, r) for k, t, r in entries if k == kind) for kind in ("user", "stopword", "synonym"))
    now = query.strip()
    for term, replacement in user:
        now = now.replace(term, replacement)
    left = [w for w in now.split() if w not in {t for t, _ in stop}]
    now = " ".join(left) if left else now
    return now, list(dict.fromkeys(r for t, r in synonyms if now and t in now))


def test_rewriting_with_a_large_dictionary_equals_a_loop(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd e") for _ in range(rng.randrange(1, n))).strip() or "a"
    entries = list({(k, t): (k, t, word(5)) for k, t in ((rng.choice(["user", "user", "stopword", "synonym"]), word(6)) for _ in range(900))}.values())
    frame = spark.createDataFrame([(k, t, r, True) for k, t, r in entries], "dict_type string, term string, replacement string, is_active boolean")
    queries = list({word(14) for _ in range(150)} | {"", "zz", "abc abc"})
    # an entry that matches only what an earlier one has made
    texts = spark.createDataFrame([(q, 1) for q in queries + queries[:20]], "query string, now int")
    got = {}
    for r in rw.rewrite_queries(texts, frame).collect():
        assert got.setdefault(r.query, (r.normalized, r.expanded)) == (r.normalized, r.expanded)
    assert got == {q: plain_rewrite(q, entries) for q in queries}
    assert rw.rewrite_queries(texts, frame).count() == len(queries) + 20


def test_no_dictionary_value_travels_with_the_rows(spark):
    queries = spark.createDataFrame([("AI",)], ["query"])
    out = rw.rewrite_queries(queries, dictionary(spark))
    assert "scalar-subquery" not in out._jdf.queryExecution().analyzed().toString()
    anchors = rw.anchored(spark.createDataFrame([("abx", "1"), ("aby", "2"), ("abz", "3"), ("q", "4")], ["term", "replacement"]))
    assert {r.term: r.gram for r in anchors.collect()} == {"abx": "bx", "aby": "by", "abz": "bz", "q": "q"}


def test_prepare(spark):
    queries = spark.createDataFrame([(1, "계휙서"), (2, "ㅂㅇ"), (3, "ㄱㅏㄴㅏ"), (4, "AI 사업"), (5, "")], ["qid", "query"])
    rows = {r.qid: r for r in rw.prepare_queries(queries, dictionary(spark)).collect()}
    assert rows[1].corrected_query == "계획서" and rows[1].is_typo_corrected
    assert rows[2].is_chosung and not rows[2].is_typo_corrected
    assert rows[3].corrected_query == "가나"
    assert rows[4].target_keywords == ["AI 사업", "인공지능", "Machine Learning", "인공지능"]
    assert rows[5].target_keywords == []


def test_sanitize_record_follows_the_schema(spark):
    frame = spark.sql("""select named_struct('t', 'a%', 'xs', array('b%', null), 'm', map('k%', 'v%'), 'n', 3, 'f', true,
      'd', double('nan'), 'raw', cast('c%' as binary)) as r""")
    row = tx.sanitize_record(frame).first().r
    assert (row.t, row.xs, row.m, row.n, row.f, row.d, row.raw) == ("a", ["b", None], {"k%": "v"}, 3, True, 0.0, "c")


def test_valid_utf8(spark):
    assert one(spark, tx.valid_utf8("a"), bytearray(b"ok\xff\xfe!\xc3")) == "ok!"


def test_digest_falls_back_to_the_name(spark):
    assert one(spark, tx.content_digest("a", "b"), "!!", "f.txt") == one(spark, F.sha2(F.lit("ftxt"), 256), "x")


def test_sanitize_drops_what_its_allow_list_does_not_hold(spark):
    keep = re.compile(f"[{tx.SANITIZE_KEEP}{tx.SPACES}]")
    control = re.compile(f"[{tx.CONTROL_CHARS}]")
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + ["\U0001F600", "\U0010FFFF"]
    rows = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(chars)], "i int, t string").repartition(4)
    got = dict(rows.select("i", tx.sanitize("t")).collect())

    def plain(c):
        c = control.sub(" ", c)
        return f"a{c}b" if keep.match(c) else "ab"

    assert [got[i] for i in range(len(chars))] == [plain(c) for c in chars]
    ends = spark.createDataFrame([(c,) for c in tx.SPACES], "c string")
    assert {r[0] for r in ends.select(tx.sanitize(F.concat("c", F.lit(" \n x  y"), "c", F.lit("\u3000\r\n")))).collect()} == {"x y"}
    # no ASCII character is looked up in the long list
    plan = ends.select(tx.sanitize("c"))._jdf.queryExecution().toString()
    assert f"&&[^{tx.SANITIZE_KEEP}" in plan and plan.count(tx.SANITIZE_KEEP) == plan.count(f"&&[^{tx.SANITIZE_KEEP}")


def test_compact_keeps_syllables_small_letters_and_digits(spark):
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + ["\U0001F600", "\U0010FFFF"]
    rows = spark.createDataFrame([(i, f"A{c}b") for i, c in enumerate(chars)], "i int, t string").repartition(4)
    for i, low, got in rows.select("i", F.lower("t"), tx.compact("t")).collect():
        assert got == re.sub("[^가-힣a-z0-9]", "", low), hex(ord(chars[i]))
    plan = rows.select(tx.compact("t"))._jdf.queryExecution().toString()
    assert plan.count("[^가-힣") == plan.count("&&[^가-힣")
