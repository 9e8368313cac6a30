"""The exact similarity join against all pairs."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from textlake.llm import jaccard

from .conftest import DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, words=5):
    parts = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def plain_groups(docs, similar=(4, 5)):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * similar[1] >= max(len(x), len(y)) * similar[0]:
            both = len(x & y)
            if similar[1] * both >= similar[0] * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, docs):
    return spark.createDataFrame([(i, t, 1, "k", "x") for i, t in docs],
                                 "doc_id bigint, text string, node int, key string, whole string").repartition(3)


def families(seed, count=260):
    """Texts of many lengths: copies with a few words changed, cut, or continued, passages
    that many texts share, and texts made of such passages alone."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(3)]
    texts = []
    for _ in range(count):
        kind = rng.integers(0, 6)
        if kind == 0 or not texts:
            words = [f"w{x}" for x in rng.integers(0, 10 ** 6, int(rng.choice([1, 3, 5, 8, 12, 20, 40, 90, 200, 500])))]
        elif kind < 4:
            words = list(texts[int(rng.integers(0, len(texts)))])
            for _ in range(int(rng.integers(0, 1 + max(1, len(words) // 40)))):
                at = int(rng.integers(0, len(words)))
                words[at:at + int(rng.integers(0, 2))] = [f"n{rng.integers(10 ** 9)}"] * int(rng.integers(0, 2))
            if kind == 3 and words:
                words = words[:max(1, int(len(words) * rng.uniform(0.75, 1)))]
        else:
            parts = [passages[int(k)] for k in rng.integers(0, 3, int(rng.integers(1, 4)))]
            words = [w for p in parts for w in p] + [f"u{rng.integers(10 ** 9)}" for _ in range(int(rng.integers(0, 50)))]
        texts.append(words or ["w"])
    return [(int(i), " ".join(t)) for i, t in zip(rng.permutation(10 ** 4)[:count], texts, strict=True)]


@pytest.mark.parametrize(("seed", "sample", "often", "hot"), [(1, 64, 4, 1 << 19), (2, 1, 3, 1 << 19), (3, 1, 2, 300)])
def test_against_all_pairs(spark, seed, sample, often, hot):
    docs = families(seed)
    want = plain_groups(docs)
    assert sum(c != i for i, _, c in want) > 40
    assert rows(jaccard.near_groups(table(spark, docs), sample=sample, often=often, hot=hot)) == want


def test_every_similar_pair_shares_a_signature():
    """Without a session, over many random pairs near the limit, with and without costs."""
    rng = np.random.default_rng(11)
    none = jaccard.Costs(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    met = 0
    for trial in range(3000):
        size = int(rng.choice([4, 5, 6, 7, 8, 9, 12, 15, 16, 20, 31, 33, 60, 130, 400]))
        x = rng.integers(0, 2 ** 63, size, dtype=np.uint64)
        drop, add = (int(v) for v in rng.integers(0, 2 + size // 8, 2))
        y = np.concatenate([x[drop:], rng.integers(0, 2 ** 63, add, dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y) or not jaccard.is_similar(x, y, (4, 5)) or np.array_equal(x, y):
            continue
        met += 1
        part = int(len(x) * (trial % 5) / 4)
        costs = none if trial % 5 == 0 else jaccard.Costs(x[:part], rng.integers(2, 9, part))
        (xs, ys), (xl, yl) = jaccard.index([x, y], costs, (4, 5))
        whole = [set(np.concatenate(v).tolist()) if v else set() for v in (xs, ys)]
        less = [set(np.concatenate(v).tolist()) if v else set() for v in (xl, yl)]
        assert whole[0] & whole[1] or whole[0] & less[1] or less[0] & whole[1]
        assert jaccard.least_difference(*jaccard.parities([x, y])) <= len(np.setxor1d(x, y))
    assert met > 1000


def test_segments_hold_more_than_sets_may_differ_in():
    band = np.arange(2, 24)
    most = jaccard.most_different(2 * ((2 << band) - 1), (4, 5))
    assert (jaccard.segment_count(band, (4, 5)) > most).all()


def test_awkward_rows(spark, wide):
    docs = [(r["doc_id"], r["text"]) for r in wide.collect()]
    assert rows(jaccard.near_groups(wide)) == plain_groups(docs)
    none = jaccard.near_groups(wide.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "n_shingles", "component_id"]
    long = " ".join(f"w{i * i % 100_003}" for i in range(500_000))
    docs = [(4, long), (2, long + " end"), (9, long[:len(long) // 2]), (None, "a b c d e f"), (None, "A B C D E F")]
    assert rows(jaccard.near_groups(table(spark, docs))) == plain_groups(docs)


def test_query_against_all_pairs(spark, stored):
    got = entry_points.queries()["op12_jaccard_join"](spark, DIR)
    assert rows(got) == plain_groups([(r["doc_id"], r["text"]) for r in stored.select("doc_id", "text").collect()])


def test_a_family_makes_few_pairs(spark):
    """A hot template: pairs to compare grow with its members, not with their square."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in range(120)]
    docs = []
    for i in range(700):
        words = list(base)
        words[int(rng.integers(5, 115))] = f"new{i}"
        docs.append((i, " ".join(words)))
    frame = table(spark, docs).select("doc_id", "text")
    signed = jaccard.sign(frame, jaccard.common_shingles(frame, sample=1)).cache()
    made = []
    real = jaccard.links
    jaccard.links = lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest)
    try:
        found = jaccard.classes(frame, signed)
        assert found.count() == 700 and found.select("root").distinct().count() == 1
    finally:
        jaccard.links = real
        signed.unpersist()
    assert sum(made) < 5 * 700


def test_unrelated_texts_with_a_common_passage_are_not_paired(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(f"u{x}" for x in rng.integers(0, 10 ** 9, 40)) + " " + passage + " " +
             " ".join(f"u{x}" for x in rng.integers(0, 10 ** 9, 40))) for i in range(400)]
    frame = table(spark, docs).select("doc_id", "text")
    signed = jaccard.sign(frame, jaccard.common_shingles(frame, sample=1))
    assert jaccard.shared_signatures(signed).count() == 0
    assert all(r["component_id"] == r["doc_id"] for r in jaccard.near_groups(frame, sample=1).collect())


def test_keep_one_leaves_the_smallest_id_of_each_group(spark):
    docs = families(5)
    want = {c for _, _, c in plain_groups(docs)}
    left = jaccard.keep_one(table(spark, docs))
    assert left.columns == ["doc_id", "text", "node", "key", "whole"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(want)
    assert jaccard.keep_one(table(spark, docs).limit(0)).collect() == []


def test_a_small_bitmap_only_costs(spark):
    from textlake.llm.common import sieve, sifted

    keys = spark.range(5000).select(F.xxhash64("id").alias("key"), "id")
    bitmap = sieve(keys.where("id % 3 = 0"), "key", bits=1 << 10)
    assert bitmap.count() <= 16
    told = sifted(keys, "key", bitmap, "maybe", bits=1 << 10)
    assert told.count() == 5000 and told.where("id % 3 = 0 and not maybe").count() == 0
    exact = sifted(keys, "key", sieve(keys.where("id % 3 = 0"), "key"), "maybe")
    assert exact.where("maybe").count() < 1700
