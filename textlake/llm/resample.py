"""Resampling documents towards a target distribution by hashed word n-grams."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import kept, raw, slices
from .decontam import NORMAL

BUCKETS = 10_000
ORDER = 2
LEAST_WORDS = 20
SHARE = (25, 100)
SEED = 7
# words of one run; a longer text takes several runs
RUN_BYTES = 4 << 20
# a matrix of longer features would hardly have a second row
LONG = 128


def _table() -> np.ndarray:
    """CRC-32 of every byte, by the reflected polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


TABLE = _table()


def crc32_columns(matrix: np.ndarray) -> np.ndarray:
    """The CRC-32 of each row of a two-dimensional uint8 array, all rows one column at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_all(keys: list[bytes], long: int = LONG) -> np.ndarray:
    """The CRC-32 of each key. Keys of one length form a matrix; results go back to their
    places. Keys of more than `long` bytes, of which hardly two have one length, are done
    one by one."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(lengths, kind="stable")
    flat = np.frombuffer(b"".join([keys[i] for i in order.tolist()]), np.uint8)
    out = np.empty(len(keys), np.uint32)
    at = 0
    for size, first, count in zip(*np.unique(lengths[order], return_index=True, return_counts=True), strict=True):
        rows = order[first:first + count]
        if size > long:
            out[rows] = [zlib.crc32(keys[i]) for i in rows.tolist()]
        else:
            out[rows] = crc32_columns(flat[at:at + size * count].reshape(count, size))
        at += size * count
    return out


def runs(texts: list[bytes | None], order: int, limit: int = RUN_BYTES) -> Iterator[list[tuple[int, list[bytes], int]]]:
    """Lists of (text, words, carried) of about `limit` bytes in all. A longer text is cut
    between words; its later parts repeat the last `order` - 1 words, which `carried` counts."""
    run, size = [], 0
    for i, text in enumerate(texts):
        plain = (text or b"").translate(NORMAL)
        start, before = 0, []
        while start < len(plain):
            end = len(plain)
            if end - start > limit:
                end = plain.rfind(b" ", start, start + limit)
                if end <= start:
                    end = plain.find(b" ", start + limit)
                    end = len(plain) if end < 0 else end
            words = before + plain[start:end].split()
            run.append((i, words, len(before)))
            before = words[len(words) - order + 1:] if order > 1 and len(words) >= order - 1 else words if order > 1 else []
            size += end - start
            start = end + 1
            if size >= limit:
                yield run
                run, size = [], 0
    if run:
        yield run


def features(run: list[tuple[int, list[bytes], int]], order: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """For each number of words up to `order`: the distinct features, and for every
    occurrence the feature and the text."""
    words = [w for _, part, _ in run for w in part]
    if not words:
        return
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    single = list(known)
    code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    sizes = np.array([len(part) for _, part, _ in run])
    owner = np.repeat(np.array([i for i, _, _ in run]), sizes)
    part = np.repeat(np.arange(len(run)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = place >= np.repeat(np.array([c for _, _, c in run]), sizes)
    keys, now, at = single, code, np.arange(len(words))
    yield keys, now[new], owner[new]
    for k in range(1, order):
        inside = at + k < len(words)
        inside[inside] = part[at[inside]] == part[at[inside] + k]
        at = at[inside]
        distinct, now = np.unique(now[inside] * len(single) + code[at + k], return_inverse=True)
        keys = [keys[a] + b" " + single[b] for a, b in zip(*(x.tolist() for x in divmod(distinct, len(single))), strict=True)]
        ends_new = new[at + k]
        yield keys, now[ends_new], owner[at[ends_new]]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(bucket, n): occurrences of the features of all texts. A task gives each bucket once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            for texts in runs(raw(part.column("text")), order):
                for keys, now, _ in features(texts, order):
                    times = np.bincount(now, minlength=len(keys))
                    counts += np.bincount(crc32_all(keys) % np.uint32(buckets), weights=times, minlength=buckets).astype(np.int64)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(counts[filled])], names=["bucket", "n"])
    return docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Of each bucket, floor(1000 ln of its smoothed share in `target` over that in `docs`).
    The driver holds one number a bucket."""
    counts = []
    for table in (docs, target):
        found = bucket_counts(table, buckets, order).toArrow()
        mine = np.zeros(buckets)
        mine[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        counts.append(mine)
    (s, t), (all_s, all_t) = counts, (c.sum() for c in counts)
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets))))
                     for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: str, seed: int = SEED) -> int:
    """A Gumbel draw fixed by the id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for part in slices(batches, "text"):
            total = np.zeros(part.num_rows, np.int64)
            count = np.zeros((order, part.num_rows), np.int64)
            for texts in runs(raw(part.column("text")), order):
                for k, (keys, now, owner) in enumerate(features(texts, order)):
                    each = value[crc32_all(keys) % np.uint32(buckets)]
                    total += np.bincount(owner, weights=each[now], minlength=len(total)).astype(np.int64)
                    count[k] += np.bincount(owner, minlength=len(total))
            n = count.sum(axis=0)
            weight = total // np.maximum(n, 1)
            drawn = np.array([noise(i, seed) for i in part.column("key").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, (count[0], n, weight, weight + drawn))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs`.

    Features are all runs of 1 to `order` words, hashed to `buckets`; weight is the mean gain
    of a document's features, score adds noise fixed by the id. Of the N documents with at
    least `least_words` words, the floor(N * share) best get a rank from 1, ties to the
    smaller id; so the draw is that of importance resampling without replacement.

    Texts are read twice and never move; a task hands on one count a bucket, the driver
    holds one number a bucket. Ranks come from key ranges with prefix sums, no task sorts
    all. A null or wordless text has weight 0. Every row counts, repeats too; rows with
    equal ids and scores are ranked in any order; a null id draws as the empty one and goes
    before others at ties. Without documents there are no rows, without target texts the
    target has no feature. Other columns are ignored."""
    rows = kept(weigh(docs, gains(docs, target, buckets, order), order, seed), "weights")
    enough = rows.where(F.col("n_words") >= least_words)
    drawn = enough.count() * share[0] // share[1]
    ranked = number_rows(enough.withColumn("down", -F.col("score")), ["down", "doc_id"], "rank")
    best = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.select(*rows.columns, best.alias("rank")).union(
        rows.where(F.col("n_words") < least_words).select("*", F.lit(None).cast("bigint")))
