from __future__ import annotations

import io
import json
import os
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators import corpus as co
from textlake.operators import evaluate as ev
from textlake.operators import filters as fl
from textlake.operators import ops
from textlake.operators import postings as po
from textlake.operators import querylog as ql
from textlake.operators import search as se
from textlake.operators.lockouts import Attempts, lockouts
from textlake.operators.numbering import number_rows
from textlake.operators.vectors import knn
from textlake.sources import files as fi
from textlake.sources.sql import read_sql_source

NOW = datetime(2024, 1, 31)


def logs(spark, rows):
    data = [(i, user, query, hits, NOW - timedelta(minutes=len(rows) - i)) for i, (user, query, hits) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, user_id string, query string, total_hits int, created_at timestamp")


def test_recent_keeps_the_latest(spark):
    rows = logs(spark, [("tester", "인공지능", 1), ("tester", "검색", 1), ("tester", "인공지능", 1), ("", "x", 0), ("t", " ", 0)])
    recent = ql.recent_searches(rows)
    assert [r.query for r in ql.recent_for(recent, "tester").collect()] == ["인공지능", "검색"]
    assert [r.query for r in ql.recent_for(recent, "").collect()] == ["x"]


def test_popular_failed_related_recommend(spark):
    rows = logs(spark, [("u", "한전", 3), ("u", "한전", 1), ("u", "원전", 0)])
    assert ql.popular_keywords(rows, NOW).first().keyword == "한전"
    assert [r.keyword for r in ql.failed_keywords(rows, NOW).collect()] == ["원전"]
    more = logs(spark, [("u1", "원전 계획", 1), ("u1", "원전 정비", 1), ("u2", "일반 문서", 1)])
    needle = spark.createDataFrame([("원전",), ("!",), ("계",)], ["needle"])
    related = {(r.needle, r.keyword, r.is_fallback) for r in ql.related_keywords(needle, more, NOW).collect()}
    assert ("원전", "원전 계획", False) in related and ("원전", "일반 문서", False) not in related
    assert ("계", "원전 계획", False) in related
    assert not [r for r in related if r[0] == "!"]
    got = ql.recommend(more.select("user_id"), ql.recent_searches(more), more, NOW).filter("user_id = 'u1'")
    assert "원전 계획" in [r.keyword for r in got.collect()]


def test_spike(spark):
    def at(days, fails, total):
        return [(i, "u", "q", 0 if i < fails else 1, NOW - timedelta(days=days)) for i in range(total)]
    frame = spark.createDataFrame(at(3, 1, 10) + at(0.5, 1, 5), "id long, user_id string, query string, total_hits int, created_at timestamp")
    row = ql.failure_spike(frame, NOW).first()
    assert row.is_spike and row.ratio == pytest.approx(2.0)


def test_summary_counts_all_logs(spark):
    row = ql.search_summary(logs(spark, [("u", "a", 1), ("u", "b", 0)]), NOW).first()
    assert (row.total_logs, row.failed_logs) == (2, 1)


def test_number_rows_with_hot_keys(spark):
    rows = [(7 if i % 3 else i, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, id long").repartition(7)
    got = {(r.k, r.id): r.n for r in number_rows(frame, ["k", "id"], "n", slices=13).collect()}
    assert got == {row: n for n, row in enumerate(sorted(rows), 1)}


def test_lockouts_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows, clock = [], NOW
    for i in range(1500):
        clock += timedelta(seconds=rng.choice([1, 20, 100, 400, 1000]))
        # one key holds most rows
        user = "Hot" if rng.random() < 0.7 else f"u{rng.randrange(4)}"
        rows.append((i, clock, user, "ip", rng.random() < 0.1))
    frame = spark.createDataFrame(rows, "id long, ts timestamp, username string, client_ip string, success boolean")
    states, want = {}, {}
    for i, ts, user, _, success in rows:
        want[i] = states.setdefault(user.lower(), Attempts()).record(ts.timestamp(), success)
    got = {r.id: r.outcome for r in lockouts(frame.repartition(5)).collect()}
    assert got == want and {"locked", "rejected"} <= set(want.values())


def test_locks_begin_and_end_on_the_microsecond(spark):
    rng = random.Random(5)
    rows, ends = [], {}
    for u in range(40):
        begun = NOW + timedelta(microseconds=rng.randrange(10**9))
        times = [begun + timedelta(microseconds=n * 75 * 10**6) for n in range(5)]
        end = times[-1] + timedelta(seconds=900)
        # the window's last microsecond counts; the block's last one is rejected, its end is not
        times += [end - timedelta(microseconds=1), end]
        rows += [(u * 10 + n, t, f"u{u}", "ip", False) for n, t in enumerate(times)]
        ends[u] = end
    frame = spark.createDataFrame(rows, "id long, ts timestamp, username string, client_ip string, success boolean")
    got = {r.id: (r.outcome, r.blocked_until) for r in lockouts(frame).collect()}
    for u, end in ends.items():
        assert [got[u * 10 + n][0] for n in range(7)] == ["failed"] * 4 + ["locked", "rejected", "failed"]
        assert got[u * 10 + 4][1] == got[u * 10 + 5][1] == end


def test_five_failures_lock_and_success_clears():
    state = Attempts()
    assert [state.record(t, False) for t in (1000, 1010, 1020, 1030, 1040, 1050)] == ["failed"] * 4 + ["locked", "rejected"]
    assert state.record(1940.5, True) == "success" and state.fails == 0


def test_connectivity(spark):
    rows = [(i, "k", NOW + timedelta(days=i), ok) for i, ok in enumerate([True, False, False, True])]
    got = ops.connectivity_events(spark.createDataFrame(rows, "id long, key string, ts timestamp, ok boolean"))
    assert [r.event_type for r in got.orderBy("id", "seq").collect()] == [
        "disconnect", "reconnect_attempt", "reconnect_fail", "reconnect_success"]


@pytest.mark.parametrize(("kinds", "status"), [
    (["success"], "success"), (["success", "fail"], "partial"), (["fail"], "fail"), (["skipped", "fail"], "partial")])
def test_sync_status(spark, kinds, status):
    rows = [("smb", "s", f"f{i}", k) for i, k in enumerate(kinds)]
    frame = spark.createDataFrame(rows, ["source_type", "source_name", "file_name", "outcome"])
    assert ops.sync_summary(frame).first().status == status


def test_upload_status_differs(spark):
    frame = spark.createDataFrame([("skipped",), ("success",)], ["outcome"])
    assert ops.upload_summary(frame).first().status == "partial"


def test_knn_in_passes_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = rng.normal(size=(300, 8)).astype("float32")
    docs[::3] = docs[0]  # a third are copies
    queries = rng.normal(size=(9, 8)).astype("float32")
    dframe = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(docs)], "doc_id long, text_vector array<float>")
    qframe = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid long, vector array<float>")
    want = {}
    for q, v in enumerate(queries):
        score = np.round(1 / (1 + ((docs.astype("float64") - v.astype("float64")) ** 2).sum(axis=1)), 6)
        order = sorted(range(300), key=lambda d: (-score[d], d))[:5]
        want[q] = [(d, score[d]) for d in order]
    for budget in (1 << 20, 8 * 8 * 4):
        got = {}
        for r in knn(qframe, dframe.repartition(6), 5, pass_bytes=budget).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.doc_id, r.score))
        assert got == want


def test_accepted_in_batch_equals_one_by_one(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        base = rng.choice("abcde")
        text = base + rng.choice(["", " ", "!"])
        rows.append((i, f"t{rng.randrange(6)}", text, text))
    frame = spark.createDataFrame(rows, ["in_id", "title", "all_text", "content_hash"])
    seen_title, seen_hash, want = set(), set(), set()
    for i, title, text, digest in rows:
        key = (title, text.strip(" !"))
        if key in seen_title or digest in seen_hash:
            continue
        seen_title.add(key)
        seen_hash.add(digest)
        want.add(i)
    assert {r.in_id for r in co.accepted_in_batch(frame).collect()} == want


def test_upsert_keeps_the_stored_id(spark):
    old = spark.createDataFrame([("h", "os-1", "a", NOW)], "content_hash string, os_doc_id string, title string, indexed_at timestamp")
    new = spark.createDataFrame([("h", "", "b", NOW, 1), ("g", "", "c", NOW, 2)], "content_hash string, os_doc_id string, title string, indexed_at timestamp, n int")
    got = {r.content_hash: (r.os_doc_id, r.title) for r in co.upsert_documents(old, new, NOW, "n").collect()}
    assert got == {"h": ("os-1", "b"), "g": ("", "c")}


def test_decode_order(spark):
    rows = [("한글".encode(),), (b"\xef\xbb\xbf" + "표준".encode(),), ("한글 문서 검색".encode("utf-16"),), ("한글a".encode("cp949"),)]
    got = [r.x for r in spark.createDataFrame(rows, "content binary").select(fi.decode_text("content").alias("x")).collect()]
    assert got == ["한글", "표준", "한글 문서 검색", "한글a"]


def test_triage_reads_zip_members(spark):
    def archive(member):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(member, "x")
        return buffer.getvalue()
    rows = [("docx", archive("word/document.xml")), ("docx", archive("xl/a.xml")), ("pptx", b"PK"), ("pdf", b"%PDF-1"), ("txt", b"a"), ("", b"")]
    # a name without an archive, an archive cut off, one with bytes in front and a comment behind
    whole = archive("word/document.xml")
    bare = b"PK\x03\x04" + whole[whole.index(b"PK\x01\x02"):whole.index(b"PK\x05\x06")]
    noted = b"PK" + whole[:-2] + b"\x02\x00hi"
    rows += [("docx", bare), ("docx", whole[:-30]), ("docx", noted), ("docx", None)]
    got = [r.reason for r in fi.triage_files(spark.createDataFrame(rows, "file_ext string, content binary")).collect()]
    assert got == ["ok", "signature_mismatch", "signature_mismatch", "ok", "unsupported", "no_extension",
                   "signature_mismatch", "signature_mismatch", "ok", "signature_mismatch"]


def test_files_and_judgements(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.PDF").write_bytes(b"%PDF-")
    (tmp_path / "a" / "b" / "y.txt").write_text("hello")
    (tmp_path / "a" / "z.exe").write_bytes(b"MZ")
    assert {r.file_name for r in fi.read_files(spark, str(tmp_path / "a")).collect()} == {"x.PDF", "y.txt"}
    path = tmp_path / "j.json"
    path.write_text(json.dumps({"queries": [{"query": " q ", "relevant_titles": ["A"], "user_id": "u"}, {"query": "  "}]}))
    rows = fi.read_judgements(spark, str(path)).collect()
    assert [(r.query, r.relevant_titles, r.user_id) for r in rows] == [("q", ["A"], "u")]


def test_sql_source_refuses_other_statements(spark):
    with pytest.raises(ValueError, match="forbidden"):
        read_sql_source(spark, "jdbc:none:x", "select 1; drop table t")


DOCS = [
    (1, "(산업부)_2026년도_산업기술혁신사업_통합_시행계획_공고문.hwp", "산업 시행계획 공고", "hwp"),
    (2, "1. 연구개발계획서 양식_울산지방청.pdf", "연구개발계획서 양식 울산지방청 문서", "pdf"),
    (3, "연구개발계획서_작성중.docx", "연구개발계획서 작성중 문서", "docx"),
    (4, "AI개발진행-20251201.pptx", "인공지능 개발 진행", "pptx"),
    (5, "2026_운영지침_보안.pdf", "운영 지침 보안", "jpg"),
]


def corpus(spark):
    rows = [(i, title, text, "OTHERS", ext, NOW - timedelta(days=i)) for i, title, text, ext in DOCS]
    return spark.createDataFrame(rows, "doc_id long, title string, all_text string, doc_category string, file_ext string, indexed_at timestamp")


def requests(spark, *rows):
    schema = ("qid long, query string, include_keywords array<string>, exclude_keywords array<string>, start_date timestamp, "
              "end_date timestamp, doc_category string, file_ext string, min_score double")
    return spark.createDataFrame([(q, text, inc, exc, None, None, "", ext, 0.0) for q, text, inc, exc, ext in rows], schema)


def test_scenarios(spark):
    asked = requests(
        spark, (1, "연구개발계획서", [], [], ""), (2, "ㅇㄱㄱㅂㄱㅎㅅ", [], [], ""), (3, "ㅂㅇ", [], [], ""),
        (4, "연구개발계획서", ["울산지방청"], ["작성중"], ".PDF"), (5, "ZXCVBNM존재하지않는키워드", [], [], ""), (6, "AI", [], [], ""),
        (7, "울산지방청 양식", [], [], ""))
    nothing = spark.createDataFrame([], "dict_type string, term string, replacement string, is_active boolean")
    got = {}
    for r in se.hybrid_search(asked, corpus(spark), nothing).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    # whole-word tokens: the compound title of the first document does not match
    assert got == {1: {2, 3}, 2: {2, 3}, 3: {5}, 4: {2}, 6: {4}, 7: {2}}


def test_phrase_needs_order_and_stopwords_keep_distance(spark):
    docs = spark.createDataFrame([(1, "", "a b c"), (2, "", "b a c"), (3, "", "a 에 b"), (4, "", "a b a b")], ["doc_id", "title", "all_text"])
    keywords = spark.createDataFrame([(1, "k", "a b"), (2, "k", "a 에 b"), (3, "k", "b b")], ["qid", "kid", "keyword"])
    got = {(r.qid, r.doc_id): r.phrase_tf for r in po.match_phrase(po.build_index(docs), keywords).collect()}
    assert got == {(1, 1): 1, (1, 4): 2, (2, 3): 1}


def test_stored_index_is_maintained(spark, tmp_path):
    rng, path = random.Random(8), str(tmp_path / "index")
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "beta gamma", "delta"]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(3), text(12)) for i in range(30)], "doc_id long, title string, all_text string")
    keywords = spark.createDataFrame([(1, "t0", "alpha"), (2, "t0", "beta gamma")], "qid long, kid string, keyword string")
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    half, gone = ids[: len(ids) // 2], ids[::3]
    po.write_index(po.build_index(docs.filter(docs.doc_id.isin(half))), path, buckets=7)
    po.append_index(docs.filter(~docs.doc_id.isin(half)), path)
    po.delete_from_index(spark.createDataFrame([(i,) for i in gone], "doc_id long"), path)
    left = docs.filter(~docs.doc_id.isin(gone))

    def scores(index):
        return sorted(map(tuple, se.lexical_score(keywords, index).collect()))
    assert scores(po.read_index(spark, path)) == scores(po.build_index(left))
    po.append_index(docs.filter(docs.doc_id.isin(gone)), path)
    assert scores(po.read_index(spark, path)) == scores(po.build_index(docs))
    with pytest.raises(ValueError):
        po.read_index(spark, path, po.Analyzer(po.cjk_bigram_tokens))


def test_nearest_in_full_precision_with_own_k_and_filter(spark):
    docs = spark.createDataFrame([(1, [100.2 ** 0.5]), (2, [100.0 ** 0.5]), (3, [1.0]), (4, None)], "doc_id long, text_vector array<double>")
    asked = spark.createDataFrame([(1, [0.0], 2), (2, [0.0], 1)], "qid long, vector array<double>, k int")
    far = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = sorted((r.qid, r.rank, r.doc_id) for r in knn(asked, docs, allowed=far).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 2)]


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    docs = corpus(spark)
    index = po.build_index(docs)
    po.write_index(index, str(tmp_path / "index"))
    keywords = spark.createDataFrame([(1, "k", "연구개발계획서"), (2, "k", "운영 지침")], ["qid", "kid", "keyword"])
    fresh = sorted(map(tuple, se.lexical_score(keywords, index).collect()))
    stored = sorted(map(tuple, se.lexical_score(keywords, po.read_index(spark, str(tmp_path / "index"))).collect()))
    assert fresh == stored and len(fresh) == 3


def test_cjk_bigrams(spark):
    docs = spark.createDataFrame([(1, "", "연구개발계획서")], ["doc_id", "title", "all_text"])
    index = po.build_index(docs, analyzer=po.Analyzer(po.cjk_bigram_tokens))
    keywords = spark.createDataFrame([(1, "k", "개발계획"), (2, "k", "발구")], ["qid", "kid", "keyword"])
    assert [r.qid for r in po.match_phrase(index, keywords).collect()] == [1]


@pytest.mark.parametrize("pack_limit", [0, 1000])
@pytest.mark.parametrize("mode", se.CHOSUNG_MODES)
def test_chosung_modes(spark, mode, pack_limit):
    docs = spark.createDataFrame([(1, "가나 다라"), (2, "가나다")], ["doc_id", "all_text"])
    rows = [(1, "k", "ㄱㄴㄷ"), (2, "k", "ㄱㄴ ㄷ"), (3, "k", "ㄷ")]
    got = {(r.qid, r.doc_id) for r in se.match_chosung(spark.createDataFrame(rows, ["qid", "kid", "keyword"]), docs, mode, pack_limit=pack_limit).collect()}
    wildcard, ngram = {(1, 2), (3, 1), (3, 2)}, {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert got == {"wildcard": wildcard, "ngram": ngram, "hybrid": wildcard | ngram}[mode]


def test_chosung_longer_than_twenty(spark):
    body = "가나다라마바사아자차카타파하가다나마라사바자아"
    docs = spark.createDataFrame([(1, body), (2, body[:21])], ["doc_id", "all_text"])
    chosung = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎㄱㄷㄴㅁㄹㅅㅂㅈㅇ"
    rows = spark.createDataFrame([(1, "k", chosung)], ["qid", "kid", "keyword"])
    for pack_limit in (0, 1000):
        assert [r.doc_id for r in se.match_chosung(rows, docs, "ngram", pack_limit=pack_limit).collect()] == [1]


def test_autocomplete(spark):
    docs = spark.createDataFrame([(1, "연구 개발", "x"), (2, "연구 계획", "x"), (3, "개발 연구", "x")], ["doc_id", "title", "all_text"])
    typed = spark.createDataFrame([(1, "연"), (2, "연구 개")], ["qid", "prefix"])
    got = {}
    for r in se.autocomplete(typed, docs).orderBy("rank").collect():
        got.setdefault(r.qid, []).append(r.title)
    assert sorted(got[1]) == ["개발 연구", "연구 개발", "연구 계획"] and got[2] == ["연구 개발"]


def test_pages_partition_the_ranking(spark):
    rows = [(1, d, float(d % 7), NOW) for d in range(23)] + [(2, 1, 1.0, NOW)]
    hits = spark.createDataFrame(rows, "qid long, doc_id long, score double, indexed_at timestamp")
    whole = [r.doc_id for r in se.top_hits(hits, 100).filter("qid = 1").orderBy("rank").collect()]
    pages = []
    for page in (1, 2, 3):
        part = se.page_hits(hits, page, 10).filter("qid = 1").orderBy("rank").collect()
        assert all(r.total == 23 and r.total_pages == 3 for r in part)
        pages += [r.doc_id for r in part]
    assert pages == whole and len(whole) == 23


def test_metrics(spark):
    run = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("ABC")], ["qid", "rank", "item"])
    truth = spark.createDataFrame([(1, "B"), (1, "D"), (2, "Z")], ["qid", "item"])
    assert {r.qid: r.mrr for r in ev.mrr_at_k(run, truth, 3).collect()} == {1: 0.5, 2: 0.0}
    ndcg = {r.qid: r.ndcg for r in ev.ndcg_at_k(run, truth, 3).collect()}
    assert ndcg[1] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3))) and ndcg[2] == 0
    assert all(r.ndcg == 0 for r in ev.ndcg_at_k(run, truth, 0).collect())
    assert ev.evaluate_queries(run, truth, 3).first().queries == 2


def test_overlap_edges(spark):
    empty = spark.createDataFrame([], "qid long, rank int, item string")
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "qid long, rank int, item string")
    qids = spark.createDataFrame([(1,), (2,)], ["qid"])
    assert {r.qid: r.overlap for r in ev.overlap_at_k(empty, one, 10, qids).collect()} == {1: 0.0, 2: 1.0}
    assert {r.qid: r.overlap for r in ev.overlap_at_k(one, empty, 10, qids).collect()} == {1: 0.0, 2: 1.0}


def test_prefer_exact_and_purge(spark):
    hits = spark.createDataFrame([(1, 1, True, True), (1, 2, True, False), (2, 3, True, False)], ["qid", "doc_id", "is_typo_corrected", "exact"])
    assert sorted(r.doc_id for r in fl.prefer_exact(hits).collect()) == [1, 3]
    frame = spark.createDataFrame([(NOW,), (NOW - timedelta(days=40),)], ["created_at"])
    kept, deleted = fl.purge(frame, "created_at", NOW, 30)
    assert kept.count() == 1 and deleted.first().deleted == 1


def test_exact_tests_are_gathered_per_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Title {i}", "The Body text" if i % 2 else None) for i in range(6)], "doc_id long, title string, all_text string")
    asked = [" title", "body TEXT", "", "  ", "nowhere", None, "5"]
    rows = [(q, d, asked[q % 7], q % 2 == 0, q % 3 == 0) for q in range(42) for d in range(6)]
    hits = spark.createDataFrame(rows, "qid long, doc_id long, corrected_query string, is_typo_corrected boolean, is_name_like boolean")
    want = {}
    for q, d, text, typo, name in rows:
        both = (f"title {d}", "the body text" if d % 2 else "")
        want[q, d] = (typo or name) and bool(text) and any(text.strip().lower() in x for x in both)
    for most in (1000, 2):
        monkeypatch.setattr(fl, "NEEDLES", most)
        found = fl.with_exact(hits, docs)
        assert {(r.qid, r.doc_id): r.exact for r in found.collect()} == want and found.count() == len(rows)
    assert found.columns == [*hits.columns, "exact"]


def test_embed_skips_blank_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 3000), (2, " "), (3, None)], "doc_id int, all_text string")
    out = {r.doc_id: r.text_vector for r in co.embed(docs, lambda: (lambda ts: [[len(t)] for t in ts]), 1).collect()}
    assert out == {1: [2000.0], 2: None, 3: None}


def test_streams_equal_batches(spark):
    from textlake.plans import load
    from textlake.plans.registry import QUERIES
    from textlake.sources.adapters import Tables
    load()
    tables = Tables(spark, "/root/testdata/sf0.001")
    batch = sorted(map(tuple, QUERIES["j3_lockouts"](tables).select("id", "outcome", F.coalesce("blocked_until", F.lit(""))).collect()))
    stream = sorted(map(tuple, QUERIES["j3_lockout_stream"](tables).select("id", "outcome", F.coalesce("blocked_until", F.lit(""))).collect()))
    assert batch == stream


def _arrivals(spark, folder, files: list[str]):
    for rows in files:
        spark.sql(rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finish(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def test_stream_order_over_chunks_and_batches(spark, tmp_path):
    from textlake.operators.ops import connectivity_events
    from textlake.streaming.streams import connectivity_stream
    probe = """select id, if(id % 5 = 0, null, 'k') as key, timestamp_seconds(1700000000 + id) as ts, hash(id, 7) % 3 <> 0 as ok
      from range(400) where {} order by hash(id)"""
    files = [probe.format(w) for w in ("id < 100 and id % 3 > 0", "id < 200 and (id % 3 = 0 or id >= 100)", "id >= 200")]
    end = "select -1L as id, 'end' as key, timestamp_seconds(1700009000) as ts, true as ok"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = _finish(connectivity_stream(_arrivals(spark, f"{tmp_path}/in", [*files, end]), "150 seconds"), tmp_path)
        got = sorted(map(repr, out.select("key", "id", "seq", "event_type").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = connectivity_events(spark.sql(probe.format("true"))).select("key", "id", "seq", "event_type")
    assert got == sorted(map(repr, batch.collect()))


def test_stream_gives_late_rows_out_and_retires(spark, tmp_path):
    from textlake.streaming.streams import connectivity_stream, lockout_stream
    row = "select {0}L as id, 'k' as key, timestamp_seconds({1}) as ts, {2} as ok"
    files = [row.format(1, 1000, "false"), row.format(2, 5000, "false"), row.format(3, 9000, "true"),
             row.format(4, 900, "true"), row.format(5, 9500, "true"), row.format(6, 90000, "true")]
    out = _finish(connectivity_stream(_arrivals(spark, f"{tmp_path}/in", files), "10 seconds", 2_000_000), tmp_path)
    # the silence before 2 and 3 retires the key each time
    assert sorted((r.id, r.event_type) for r in out.collect()) == [(1, "disconnect"), (2, "disconnect"), (4, "late")]
    row = "select {0}L as id, timestamp_seconds({1}) as ts, 'A' as username, 'ip' as client_ip, false as success"
    files = [" union all ".join(row.format(i, 1000 + 10 * i) for i in (4, 2, 0, 3, 1)),
             row.format(5, 1100), row.format(6, 8000), row.format(7, 1000), row.format(8, 50000)]
    other = tmp_path / "other"
    out = _finish(lockout_stream(_arrivals(spark, f"{other}/in", files), "10 seconds"), other)
    assert [r.outcome for r in out.orderBy("id").collect()] == ["failed"] * 4 + ["locked", "rejected", "failed", "late"]


def test_watch_reads_changed_files_again(spark, tmp_path):
    from textlake.streaming.streams import WatchTables, watch_files
    corpus = spark.createDataFrame([], "doc_id string, title string, all_text string, content_hash string")
    tables = WatchTables(*(f"{tmp_path}/{n}" for n in ("state", "documents", "outcomes", "summaries", "checkpoint")))
    folder = tmp_path / "in"
    folder.mkdir()

    def run() -> dict[str, str]:
        before = {tuple(r) for r in spark.read.parquet(tables.outcomes).select("in_id", "batch").collect()} if (tmp_path / "outcomes").exists() else set()
        watch_files(spark, str(folder), corpus, tables).awaitTermination()
        rows = spark.read.parquet(tables.outcomes).collect()
        return {r.file_name: r.reason for r in rows if (r.in_id, r.batch) not in before}

    (folder / "a.txt").write_text("first text")
    (folder / "b.txt").write_text("second text")
    assert run() == {"a.txt": "indexed", "b.txt": "indexed"}
    os.utime(folder / "a.txt", (2_000_000_000, 2_000_000_000))
    (folder / "c.txt").write_text("second text")
    got = run()
    assert got.get("c.txt") == "content_hash" and got.get("a.txt", "same_hash") == "same_hash"


def _one_by_one(rows):
    titles, hashes, accepted = set(), set(), set()
    for i, title, digest in rows:
        if title in titles or (digest is not None and digest in hashes):
            continue
        titles.add(title)
        hashes.add(digest)
        accepted.add(i)
    return accepted


@pytest.mark.parametrize("shape", ["chain", "null_hashes", "hub", "mixed"])
def test_rivals_are_settled_whatever_their_shape(spark, shape):
    rng = random.Random(9)
    rows = {
        # every document shares a key with the one before and the one behind it
        "chain": [(i, f"t{(i + 1) // 2}", f"h{i // 2}") for i in range(1000)],
        "null_hashes": [(i, f"t{i % 7}", None if i % 3 else f"h{i % 5}") for i in range(60)],
        "hub": [(i, "same" if i % 3 else f"t{i}", f"h{i % 40}") for i in range(400)],
        "mixed": [(i, f"t{rng.randrange(120)}", rng.choice([None, f"h{rng.randrange(120)}"])) for i in range(400)],
    }[shape]
    frame = spark.createDataFrame([(i, t, "text", h) for i, t, h in rows], "in_id int, title string, all_text string, content_hash string")
    want = _one_by_one(rows)
    for rounds in (0, 2):
        assert {r.in_id for r in co.accepted_in_batch(frame, rounds=rounds).collect()} == want


def test_documents_without_content_are_indexed(spark):
    none = spark.createDataFrame([], "doc_id string, title string, all_text string, content_hash string")
    raw = spark.createDataFrame([(1, "a.txt", "one", None), (2, "b.txt", "two", b"x"), (3, "a.txt", "one", None), (4, "c.txt", "three", None)],
                                "in_id int, file_name string, text string, content binary")
    docs, outcomes = co.index_documents(raw, none, NOW)
    assert {r.in_id: r.reason for r in outcomes.collect()} == {1: "indexed", 2: "indexed", 3: "in_batch", 4: "indexed"}
    assert docs.filter("doc_id is null").count() == 0 and set(co.KEYS) <= set(docs.columns)
    _, again = co.index_documents(raw, docs, NOW)
    assert {r.in_id: r.reason for r in again.collect()} == {1: "title_and_content", 2: "title_and_content", 3: "title_and_content", 4: "title_and_content"}


def test_a_legacy_digest_only_nominates(spark):
    head = "가나다 same head " * 60
    digest = spark.createDataFrame([(head, "t")], "all_text string, title string").select(co.content_digest("all_text", "title")).first()[0]
    held = spark.createDataFrame([("a", "x", head + " one end", digest), ("b", "y", None, "other")], "doc_id string, title string, all_text string, content_hash string")
    gone = held.withColumn("all_text", F.lit(None).cast("string"))
    new = spark.createDataFrame([(1, "u", head + " one end!", "h1"), (2, "v", head + " another end", "h2")], "in_id int, title string, all_text string, content_hash string")
    new = new.withColumn("legacy_hash", co.content_digest("all_text", "title"))
    got = {r.in_id: (r.reason, r.match_id) for r in co.find_duplicates(new, held).collect()}
    assert got == {1: ("legacy_digest", "a")}
    # where no text is held, the digest is all there is
    assert {r.in_id for r in co.find_duplicates(new, gone).collect()} == {1, 2}


def test_stored_keys_spare_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "x y", "h")], "doc_id string, title string, all_text string, content_hash string")
    co.duplicate_keys(docs).write.parquet(f"{tmp_path}/catalogue")
    stored = spark.read.parquet(f"{tmp_path}/catalogue")
    new = spark.createDataFrame([(1, "t", "xy!", "g")], "in_id int, title string, all_text string, content_hash string")
    found = co.find_duplicates(new, stored)
    assert [r.reason for r in found.collect()] == ["title_and_content"]
    scans = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "parquet" in x]
    assert scans and not any("all_text" in x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
