"""Pages from a stored index against pages over all scored hits."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textlake.operators import postings as po
from textlake.operators import ranked as ra
from textlake.operators import search as se

NOW = datetime(2024, 1, 31)
WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(4)
    pick = lambda n: " ".join(WORDS[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    rows = [(i, pick(rng.randrange(1, 6)), pick(rng.choice([5, 20, 80])), "OTHERS", rng.choice(["pdf", "docx"]),
             NOW - timedelta(hours=rng.randrange(50))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, all_text string, doc_category string, file_ext string, indexed_at timestamp")
    docs.write.parquet(str(tmp_path_factory.mktemp("docs") / "d"), mode="overwrite")
    path = str(tmp_path_factory.mktemp("index") / "i")
    po.write_index(po.build_index(docs), path, buckets=8, ranges=40)
    return docs, path


def asked(spark):
    schema = ("qid long, query string, include_keywords array<string>, exclude_keywords array<string>, start_date timestamp, "
              "end_date timestamp, doc_category string, file_ext string, min_score double, size int, page int")
    rows = [
        (1, "w0", [], [], None, None, "", "", 0.0, 5, 1), (2, "w0 w1", [], [], None, None, "", "", 0.0, 5, 2),
        (3, "w2", ["w3"], [], None, None, "", ".PDF", 0.0, 10, 1), (4, "w1", [], ["w0 w2", "w5"], None, None, "", "", 0.0, 3, 4),
        (5, "w4 w9", [], [], NOW - timedelta(hours=20), None, "", "", 0.0, 50, 1), (6, "w3", [], [], None, None, "", "", 25.0, 5, 1),
        (7, "nowhere", [], [], None, None, "", "", 0.0, 5, 1), (8, "w59", [], [], None, None, "", "", 0.0, 5, 3),
        (9, "w7", [], [], None, None, "", "", 0.0, 5, 100_000), (10, "ㄱ", [], [], None, None, "", "", 0.0, 5, 1),
    ]
    return spark.createDataFrame(rows, schema)


def nothing(spark):
    return spark.createDataFrame([], "dict_type string, term string, replacement string, is_active boolean")


def pages(df):
    return sorted(tuple(r) for r in df.select("qid", "rank", "doc_id", "score", "total", "total_pages").collect())


def test_pages_equal_those_over_all_hits(spark, library):
    docs, path = library
    index = po.read_index(spark, path)
    vectors = docs.select("doc_id", F.array((F.col("doc_id") % 13).cast("double")).alias("text_vector"))
    query_vectors = asked(spark).select("qid", F.array(F.col("qid").cast("double")).alias("vector"))
    for near in ((None, None), (vectors, query_vectors)):
        hits = se.hybrid_hits(asked(spark), docs, nothing(spark), *near)
        found = ra.match_requests(asked(spark), docs, nothing(spark), index, *near)
        want = pages(se.page_hits(hits))
        assert len(want) > 60 and pages(ra.ranked_pages(found)) == want
        count = lambda df: sorted(map(tuple, df.collect()))
        assert count(se.facet_category(found.rows)) == count(se.facet_category(hits))
        assert count(se.facet_extension(found.rows)) == count(se.facet_extension(hits))


def test_few_hits_are_scored_and_few_postings_read(spark, library, monkeypatch):
    docs, path = library
    short = asked(spark).filter("qid in (1, 3)")
    found = ra.match_requests(short, docs, nothing(spark), po.read_index(spark, path))
    matches = found.rows.count()
    scored, words = [], []
    real, read = ra.Matched.scored, ra._words_of
    monkeypatch.setattr(ra.Matched, "scored", lambda self, wanted: scored.append(wanted.count()) or real(self, wanted))
    monkeypatch.setattr(ra, "_words_of", lambda *a: (lambda df: words.append(df.count()) or df)(read(*a)))
    assert pages(ra.ranked_pages(found)) == pages(se.page_hits(se.hybrid_hits(short, docs, nothing(spark))))
    assert matches > 200 and sum(scored) < matches / 3 and sum(words) < matches


def test_no_text_is_tokenised(spark, library):
    docs, path = library
    found = ra.match_requests(asked(spark).filter("qid < 3"), docs, nothing(spark), po.read_index(spark, path))
    plan = ra.ranked_pages(found)._jdf.queryExecution().executedPlan().toString()
    assert "all_text" not in plan and "split(" not in plan


def test_bounds_hold_for_every_hit(spark, library):
    docs, path = library
    found = ra.match_requests(asked(spark), docs, nothing(spark), po.read_index(spark, path))
    hits = se.hybrid_hits(asked(spark), docs, nothing(spark)).select("qid", "doc_id", F.col("score").alias("real"))
    both = found.rows.join(hits, ["qid", "doc_id"], "full_outer")
    assert both.filter("real is null or low is null or real < low or real > high").count() == 0


def test_a_merged_index_answers_alike(spark, library, tmp_path):
    docs, _ = library
    path, merged = str(tmp_path / "i"), str(tmp_path / "m")
    po.write_index(po.build_index(docs.filter("doc_id % 3 = 0")), path, buckets=8, ranges=40)
    po.append_index(docs.filter("doc_id % 3 = 1"), path)
    po.delete_from_index(docs.filter("doc_id % 5 = 0").select("doc_id"), path)
    po.append_index(docs.filter("doc_id % 3 = 2 or doc_id % 15 = 0"), path)
    po.merge_index(spark, path, merged)
    left = docs.filter("doc_id % 5 <> 0 or doc_id % 3 = 2 or doc_id % 15 = 0")
    keywords = asked(spark).select("qid", F.lit("t0").alias("kid"), F.col("query").alias("keyword"))

    def scores(index):
        return sorted(map(tuple, se.lexical_score(keywords, index).collect()))
    want = scores(po.build_index(left))
    assert scores(po.read_index(spark, path)) == want and scores(po.read_index(spark, merged)) == want
    assert spark.read.parquet(f"{merged}/postings").count() < spark.read.parquet(f"{path}/postings").count()
    assert len(spark.read.parquet(f"{merged}/postings").inputFiles()) < len(spark.read.parquet(f"{path}/postings").inputFiles())
    # and goes on being maintained
    po.delete_from_index(docs.filter("doc_id = 1").select("doc_id"), merged)
    assert scores(po.read_index(spark, merged)) == scores(po.build_index(left.filter("doc_id <> 1")))


def test_a_far_page_of_one_request_is_its_own(spark):
    rows = [(q, d, float(d % 50), NOW, 5, 100_000 if q == 2 else 1) for q in (1, 2) for d in range(300)]
    hits = spark.createDataFrame(rows, "qid long, doc_id long, score double, indexed_at timestamp, size int, page int")
    got = se.page_hits(hits).collect()
    assert sorted(r.rank for r in got if r.qid == 1) == [1, 2, 3, 4, 5] and not [r for r in got if r.qid == 2]


def test_words_are_folded_where_their_document_is(spark, library):
    docs, path = library
    folded = po.build_index(docs).dealt.groupBy("field", "term", "doc_id").agg(F.max("dl"))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    # texts are dealt out once, words are not
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in plan
    plain = po.build_postings(docs).groupBy("field", "term", "doc_id").agg(F.sort_array(F.collect_list("pos")), F.count("*"), F.max("dl"))
    stored = po.read_index(spark, path).postings.select("field", "term", "doc_id", "positions", F.col("tf").cast("long"), "dl")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
