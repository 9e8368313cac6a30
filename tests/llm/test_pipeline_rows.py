"""The pipeline's near-dedup by five-word shingles, and decisions row by row."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from textlake.llm import decontam, simhash

from .conftest import DIR

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def spoiled(rng, base, n):
    """A copy with n words replaced, no two of them within one shingle of the other."""
    words = list(base)
    for k in rng.choice(range(5, 95, 6), n, replace=False):
        words[k] = f"new{rng.integers(10 ** 9)}"
    return words


def test_near_dedup_takes_five_words_and_four_fifths(spark):
    rng = np.random.default_rng(9)
    rows, near, far = [], [], []
    for k in range(120):
        base = [f"w{x}" for x in rng.integers(0, 10 ** 6, 100)]
        # 96 shingles: two replaced words leave 86 of 106 (0.81), three 81 of 111 (0.73)
        copy = spoiled(rng, base, 2 if k % 2 else 3)
        (near if k % 2 else far).append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    bits = [(simhash.fingerprint(rows[a][1].encode()) ^ simhash.fingerprint(rows[b][1].encode())).bit_count() for a, b in near]
    assert sum(n > simhash.DISTANCE for n in bits) > len(near) / 2
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, rows), DIR).collect()}
    assert all(a in left for a, _ in near)
    assert all(b not in left for _, b in near)
    assert all(a in left and b in left for a, b in far)


def test_near_dedup_of_a_family_and_of_mixed_buckets(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in range(100)]
    rows = [(i, " ".join(spoiled(rng, base, 1))) for i in range(400)]
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, rows), DIR).collect()] == [0]
    # one passage in all texts; every third text has a near copy
    passage = [f"p{x}" for x in range(60)]
    rows = []
    for k in range(300):
        own = [f"u{x}" for x in rng.integers(0, 10 ** 9, 100)]
        rows.append((len(rows), " ".join(passage + own)))
        if k % 3 == 0:
            own[50] = f"new{k}"
            rows.append((len(rows), " ".join(passage + own)))
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, rows), DIR).collect()}
    copies = {i for i, _ in rows if i and rows[i][1].split()[60:90] == rows[i - 1][1].split()[60:90]}
    assert len(copies) == 100 and left == {i for i, _ in rows} - copies


def test_near_dedup_leaves_one_row_of_each_group(spark):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    c, d = " ".join(f"c{k}" for k in range(80)), " ".join(f"d{k}" for k in range(80))
    rows = [(None, a), (7, a), (7, a), (None, b), (None, b), (3, c), (3, d), (5, d), (None, None), (9, " "), (8, "short"), (8, "text")]
    left = corpus_pipeline.near_dedup(spark, table(spark, rows), DIR)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(
        [(7, a), (None, b), (3, c), (3, d), (9, " "), (8, "short"), (8, "text")], key=repr)


def test_stages_decide_by_row_and_not_by_id(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("text is not null").first()["text"]
    left = docs
    for stage in (corpus_pipeline.language, corpus_pipeline.rules, corpus_pipeline.decontaminate):
        left = stage(spark, left, DIR)
    good = left.orderBy("doc_id").first()
    bad = {"language": "12345 !!", "rules": "too short", "decontaminate": f"{good['text']} {item}"}
    for name, text in bad.items():
        more = docs.where("doc_id <> {}".format(good["doc_id"])).union(table(spark, [
            (None, good["text"]), (None, good["text"]), (None, text), (good["doc_id"], good["text"]), (good["doc_id"], text)]))
        kept = getattr(corpus_pipeline, name)(spark, more, DIR)
        assert kept.columns == docs.columns
        mine = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] in (None, good["doc_id"])]
        assert sorted(mine, key=repr) == sorted([(None, good["text"])] * 2 + [(good["doc_id"], good["text"])], key=repr), name


def test_clean_rows_of_several_blocks(spark):
    docs = table(spark, [(1, "a cat sat here"), (1, "nothing of that"), (None, "a dog ran"), (None, None)])
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(["cat sat", "dog ran", "x y", "z w"])], "item_id string, text string")
    left = decontam.keep_clean(docs, bench, block_bytes=8)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == [(1, "nothing of that"), (None, None)]


def test_blocks_are_bounded_by_bytes_and_hold_every_window(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{x}" for x in rng.integers(0, 900, 5000))
    items = [("a", "one two three")] * 400 + [("b", long)] + [(f"i{k}", " ".join(f"v{x}" for x in rng.integers(0, 99, 30))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    blocks = decontam.blocks_of(bench, 4096)
    rows = [[(r["item_id"], r["text"]) for r in b.collect()] for b in blocks]
    assert len(blocks) > 8 and max(sum(len(t) for _, t in b) for b in rows) < 4096 + 400
    every = [r for b in rows for r in b]
    assert len(every) == len(set(every)) and sum(i == "a" for i, _ in every) == 1
    got = {w for i, t in every if i == "b" for w in decontam.windows_of(t.encode().split(), 10)}
    assert got == set(decontam.windows_of(long.encode().split(), 10))
    words = long.split()
    docs = table(spark, [(1, " ".join(words[700:709])), (2, " ".join(words[3000:3012])), (3, "x One, two THREE y"), (4, None)])
    found = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.decontaminate(docs, bench, block_bytes=4096).collect()}
    assert found == {1: (0, []), 2: (12, ["b"]), 3: (3, ["a"]), 4: (0, [])}
