"""Chosung search through stored grams against a scan of the texts."""

from __future__ import annotations

import random

import pytest

from textlake.operators import chosung as ch
from textlake.operators import search as se


def hits(df):
    return sorted((r.qid, r.kid, r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(2)
    syllables = "가나다라 마바사 아자차까A1\U0001f600\t"
    rows = [(i, "".join(rng.choice(syllables) for _ in range(rng.choice([0, 1, 2, 5, 60, 300])))) for i in range(150)]
    rows += [(200, "가나다라마바사아자차카타파하가다나마라사바자아"), (201, None), (202, "가나다라마바사아자차카타파하가다나마라사")]
    docs = spark.createDataFrame(rows, "doc_id long, all_text string")
    path = str(tmp_path_factory.mktemp("grams") / "g")
    ch.write_grams(docs, path, buckets=8)
    return docs, path


@pytest.mark.parametrize("mode", ch.MODES)
def test_equals_a_scan(spark, texts, mode):
    docs, path = texts
    rng = random.Random(3)
    letters = "ㄱㄴㄷㄹㅁ ㅂㅅㅇㅈㅊㄲA1\U0001f600"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 7]))) for _ in range(120)]
    words += ["ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎㄱㄷㄴㅁㄹㅅㅂㅈㅇ", "ㄱㄱㄱㄱ", "a1", "", " ", "ㄱ ㄴ", "ㄱㄴ", "ㄱㄴ"]
    keywords = spark.createDataFrame([(i, f"k{i % 2}", w) for i, w in enumerate(words)], "qid long, kid string, keyword string")
    want = hits(se.match_chosung(keywords, docs, mode))
    assert len(want) > 200 and hits(ch.match_stored_chosung(keywords, path, mode)) == want


def test_grams_are_appended_and_deleted(spark, texts, tmp_path):
    docs, _ = texts
    path = str(tmp_path / "g")
    ch.write_grams(docs.filter("doc_id < 80"), path, buckets=4)
    spark.createDataFrame([(3,), (5,)], "doc_id long").write.parquet(f"{path}/deleted/segment=2")
    ch.write_grams(docs.filter("doc_id >= 80 or doc_id = 5"), path, segment=3)
    keywords = spark.createDataFrame([(1, "k", "ㄱㄴ"), (2, "k", "ㄷㄹㅁㅂ"), (3, "k", "ㅈ")], "qid long, kid string, keyword string")
    assert hits(ch.match_stored_chosung(keywords, path, "hybrid")) == hits(se.match_chosung(keywords, docs.filter("doc_id <> 3"), "hybrid"))


def test_work_follows_the_candidates(spark, texts):
    """Only grams of the keywords are read, and no text."""
    docs, path = texts
    patterns = spark.createDataFrame([("p", "c", "ㄱㄴㄷㄹㅁㅂㅅ")], "pid string, form string, pattern string")
    found = ch.containing(ch.read_grams(spark, path), patterns, 8)
    assert "all_text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.term for r in ch._pieces(patterns).orderBy("offset").collect()] == ["ㄱㄴㄷ", "ㄹㅁㅂ", "ㅁㅂㅅ"]
    assert {r.doc_id for r in found.collect()} >= {200, 202}


def test_a_gram_takes_one_row_for_many_texts(spark, texts, tmp_path):
    docs, _ = texts
    path = str(tmp_path / "g")
    ch.write_grams(docs.coalesce(1), path, buckets=4)
    stored = spark.read.parquet(f"{path}/postings")
    held = stored.selectExpr("sum(size(docs))").first()[0]
    assert stored.count() == stored.select("field", "term").distinct().count() and held > 4 * stored.count()


def test_letters_beyond_one_number_are_cut_into_parts():
    signs = "".join(chr(0x20000 + i) for i in range(40_000))
    texts = [signs + f"{i:06}" for i in range(2)] + ["", "ab"]
    want = {(t[i:i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    copies = 40_000
    got = {(term, k) for terms, ends, places in ch._grams(texts + ["zz"] * copies, 3)
           for term, start, end in zip(terms, ends, ends[1:], strict=False) for k in places[start:end].tolist()}
    assert got == want
