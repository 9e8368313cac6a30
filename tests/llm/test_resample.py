"""Importance resampling against a plain loop."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry_points
from textlake.llm import resample

from .conftest import DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, order=2):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, share=(25, 100), least=20, buckets=10_000, order=2):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text, order)[1])
            for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, found = plain_features(text, order)
        weight = sum(gain[bucket(f)] for f in found) // max(1, len(found))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(enough[:len(enough) * share[0] // share[1]])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=repr)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_a_plain_loop(spark, stored):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    got = entry_points.queries()["op13_target_resampling"](spark, DIR)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain(texts_of(stored), [r["text"] for r in bench.collect()])
    assert rows(got) == sorted(((r[0], *r[2:]) for r in want), key=repr)


def test_awkward_rows(spark, wide, monkeypatch):
    docs = wide.withColumnsRenamed({"n": "score", "place": "rank"})
    target = ["The CAT sat on the mat", None, "", "le chien dort"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    for share, least, buckets, order in (((25, 100), 20, 10_000, 2), ((1, 1), 0, 64, 3), ((1, 2), 3, 100, 1)):
        got = resample.resample(docs, bench, share, least, buckets, order)
        want = plain(texts_of(docs), target, share, least, buckets, order)
        # repeated rows may change places among themselves; here they are equal
        assert rows(got) == want
    none = resample.resample(docs.limit(0), bench)
    assert none.collect() == [] and none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert rows(resample.resample(docs, bench.limit(0))) == plain(texts_of(docs), [])


def test_long_texts_take_several_runs():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (0, 1, 2, 700, 3, 900)] + ["x" * 500, None, "-- --"]
    for order in (1, 2, 3):
        for limit in (1, 9, 64, 1 << 20):
            counts = [Counter() for _ in texts]
            for run in resample.runs([None if t is None else t.encode() for t in texts], order, limit):
                for keys, now, owner in resample.features(run, order):
                    for a, i in zip(now.tolist(), owner.tolist(), strict=True):
                        counts[i][keys[a].decode()] += 1
            assert counts == [Counter(plain_features(t, order)[1]) for t in texts]


def test_crc_of_columns():
    rng = np.random.default_rng(8)
    keys = [rng.bytes(n) for n in [*range(0, 150), *([7] * 50), 5000]] * 2
    assert resample.crc32_all(keys).tolist() == [zlib.crc32(k) for k in keys]
    assert resample.crc32_all(keys, long=10 ** 6).tolist() == [zlib.crc32(k) for k in keys]
    assert resample.crc32_all([]).tolist() == []


def test_several_megabytes_in_one_text(spark):
    text = " ".join(f"token{i % 5003}" for i in range(900_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in resample.resample(docs, docs, (1, 1), 1).collect()}
    assert got[1]["n_words"] == 900_000 and got[1]["n_features"] == 1_799_999 and got[2]["n_features"] == 1
    assert sorted(r["rank"] for r in got.values()) == [1, 2]
