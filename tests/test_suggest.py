"""Suggestions from the stored table against the search over all titles."""

from __future__ import annotations

import random

import pytest

from textlake.operators import chosung as ch
from textlake.operators import search as se
from textlake.operators import suggest as su


def rows(df):
    return sorted((r.qid, r.rank, r.title) for r in df.collect())


def titles(rng, count):
    words = ["alpha", "alp", "beta", "bet", "gamma", "연구", "개발", "연구소", "의", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(count)]


def test_equal_to_the_search(spark, tmp_path):
    rng = random.Random(12)
    names = titles(rng, 250)
    docs = spark.createDataFrame([(i, t or None, t) for i, t in enumerate(names)], "doc_id long, title string, all_text string")
    typed = ["a", "alp", "alpha b", "beta gamma a", "연", "연구 개", "연구 의 개", "의", "zzz", "alpha zzz", "", "x x", "ㅇㄱ", "ㄱㅂ", "x x x x x x x"]
    typed += [" ".join(w[:rng.randrange(1, 5)] for w in rng.choice(names).split()[:2]) for _ in range(40)]
    asked = spark.createDataFrame(list(enumerate(typed)), "qid long, prefix string")
    path, grams = str(tmp_path / "s"), str(tmp_path / "g")
    su.write_suggestions(docs.filter("doc_id < 150"), path, k=5, buckets=4)
    su.write_suggestions(docs.filter("doc_id >= 150"), path, segment=2, k=5, buckets=4)
    ch.write_grams(docs, grams, buckets=4)
    want = rows(se.autocomplete(asked, docs))
    assert len(want) > 100 and rows(su.suggest(asked, path, docs, grams)) == want
    with pytest.raises(ValueError):
        su.suggest(asked, path, docs, k=6)


def test_one_look_up_and_no_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (2, "alpha gamma", "y")], "doc_id long, title string, all_text string")
    path = str(tmp_path / "s")
    su.write_suggestions(docs, path, buckets=4)
    out = su.suggest(spark.createDataFrame([(1, "alpha g")], "qid long, prefix string"), path, docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out) == [(1, 1, "alpha gamma")] and "all_text" not in plan and plan.count("key#") > 0


def test_a_title_is_stored_once_for_each_word(spark, tmp_path):
    name = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(i, f"{name} {i}", "x") for i in range(30)], "doc_id long, title string, all_text string")
    path = str(tmp_path / "s")
    su.write_suggestions(docs, path, k=5, buckets=4)
    stored = spark.read.parquet(f"{path}/titles").unionByName(spark.read.parquet(f"{path}/runs"), allowMissingColumns=True)
    # nine words and 43 beginnings of words, of which each keeps five titles
    assert stored.count() <= 30 * 9 + 5 * 60
    asked = spark.createDataFrame([(1, "beta gamma delta e"), (2, "zeta eta theta 1"), (3, "gam")], "qid long, prefix string")
    assert rows(su.suggest(asked, path, docs)) == rows(se.autocomplete(asked, docs))


def test_titles_under_one_id_keep_their_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (1, "alpha beta", "x"), (2, "alpha bet", "y"), (3, "alpha beta", "z"), (None, "alpha b", "n")],
                                 "doc_id long, title string, all_text string")
    path = str(tmp_path / "s")
    su.write_suggestions(docs, path, buckets=4)
    held = spark.read.parquet(f"{path}/titles").filter("key like '%alpha'").select("title", "tf", "dl").collect()
    # two rows of one id: two places and two titles
    assert sorted(map(tuple, held)) == [("alpha bet", 1, 2), ("alpha beta", 1, 2), ("alpha beta", 4, 2)]
