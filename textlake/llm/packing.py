"""Packing of documents into sequences by length patterns and non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices
from .encoders import MEMORY, ByteLevel, load

LENGTH = 1024
END_ID = 2
# documents of one pattern at most
DEPTH = 3


def tokenize(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): every document's ids and the end
    id, cut into pieces of `length` where there are more; the first piece takes what
    full ones leave over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ByteLevel, path, memory)
        for part in slices(batches, "text"):
            ids, counts = encoder.ids(pc.fill_null(part.column("text"), "").to_pylist())
            ends = np.cumsum(counts)
            closed = np.insert(ids, ends, end_id).astype("<u4")
            total = counts + 1
            pieces = -(-total // length)
            owner = np.repeat(np.arange(len(total)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (total - 1) % length + 1
            start = np.where(nth == 0, 0, first[owner] + (nth - 1) * length)
            size = np.where(nth == 0, first[owner], length)
            begin = (np.cumsum(total) - total)[owner] + start
            crc = [zlib.crc32(closed[a:b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(owner)), part.column("doc_id").take(pa.array(owner)),
                 pa.array(nth, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(length: int, depth: int = DEPTH) -> np.ndarray:
    """All ways to fill `length` with up to `depth` lengths, longest first, zeros behind."""
    whole = np.array([[length, 0, 0]])
    b = np.arange(1, length // 2 + 1)
    two = np.stack([length - b, b, np.zeros_like(b)], axis=1)
    rows = [whole, two]
    if depth > 2:
        b, c = np.meshgrid(np.arange(1, length), np.arange(1, length), indexing="ij")
        a = length - b - c
        good = (a >= b) & (b >= c)
        rows.append(np.stack([a[good], b[good], c[good]], axis=1))
    return np.concatenate(rows)


def repeats(histogram: np.ndarray, choices: np.ndarray, steps: int = 400) -> np.ndarray:
    """How often to use each pattern, by non-negative least squares: the lengths they
    take are brought close to the histogram by accelerated projected gradients."""
    target = histogram.astype(np.float64)
    most = max(1.0, target.max())
    target = target / most
    size = len(histogram)
    flat = choices.T.ravel()
    used = choices > 0

    def taken(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.tile(x, choices.shape[1]), size)
        out[0] = 0
        return out

    # the largest eigenvalue of the normal matrix, by power steps
    v = np.ones(len(choices))
    for _ in range(20):
        w = (taken(v)[choices] * used).sum(axis=1)
        top = np.linalg.norm(w)
        v = w / top
    x = np.zeros(len(choices))
    look, pace = x, 1.0
    for _ in range(steps):
        gap = taken(look) - target
        new = np.maximum(0, look - (gap[choices] * used).sum(axis=1) / (1.02 * top))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look = new + (pace - 1) / faster * (new - x)
        x, pace = new, faster
    return x * most


def plan(histogram: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their repeat counts that place every length of the histogram (index:
    length, value: how many) exactly once. Fitted counts are rounded down, cut where they
    would take more than there is; what is left over is packed by best fit, many equal
    sequences at once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        out.append(((length,), int(left[length])))
        left[length] = 0
    if left.sum():
        choices = patterns(length)[1:]
        there = np.all((choices == 0) | (left[choices] > 0), axis=1)
        choices = choices[there]
        if len(choices):
            fitted = repeats(left, choices)
            for i in np.argsort(-fitted, kind="stable"):
                if fitted[i] < 0.5:
                    break
                need: dict[int, int] = {}
                for k in choices[i].tolist():
                    if k:
                        need[k] = need.get(k, 0) + 1
                times = min(int(fitted[i] + 0.5), *(int(left[k]) // n for k, n in need.items()))
                if times > 0:
                    out.append((tuple(k for k in choices[i].tolist() if k), times))
                    for k, n in need.items():
                        left[k] -= n * times
    # best fit decreasing on what is left: the longest, then again the longest that fits
    while (longest := int(np.flatnonzero(left).max(initial=0))):
        taken = [longest]
        used = {longest: 1}
        room = length - longest
        while room:
            fits = np.flatnonzero(left[:room + 1])
            fits = fits[left[fits] > np.array([used.get(int(k), 0) for k in fits])] if len(fits) else fits
            if not len(fits):
                break
            k = int(fits.max())
            taken.append(k)
            used[k] = used.get(k, 0) + 1
            room -= k
        times = min(int(left[k]) // n for k, n in used.items())
        out.append((tuple(taken), times))
        for k, n in used.items():
            left[k] -= n * times
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, repeats, first sequence, offset) of each place of each pattern:
    pieces of that length ranked from `first rank` on go there, one per sequence."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in made:
        offset = 0
        for k in pattern:
            rows.append((k, ranks.get(k, 0), times, sequence, offset))
            ranks[k] = ranks.get(k, 0) + times
            offset += k
        sequence += times
    return rows


def place(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """`pieces` (a stored table with `length` and a unique `row`, `piece`) with sequence_id
    and offset. Only the histogram of lengths comes to the driver. Pieces of one length
    are ranked within the parts they were read in and shifted by the counts of earlier
    parts, so the most frequent length does not gather in one task."""
    spark = pieces.sparkSession
    parted = kept(pieces.withColumn("part", F.spark_partition_id()), "parts")
    counts = kept(parted.groupBy("length", "part").count(), "lengths")
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    made = slots(plan(histogram, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part", "length").orderBy("row", "piece")
    ranked = parted.withColumn("nth", F.row_number().over(inside) - 1).join(shift, ["length", "part"]).withColumn(
        "rank", F.col("nth") + F.col("shift"))
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for k, first, times, sequence, offset in made:
        by_length.setdefault(k, []).append((first, times, sequence, offset))
    tables = {k: np.array(v, np.int64) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)
    names = [f.name for f in pieces.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size).tolist():
                mine = np.flatnonzero(size == k)
                table = known[k]
                at = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
                sequence[mine] = table[at, 2] + rank[mine] - table[at, 0]
                offset[mine] = table[at, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of
    every row of `docs`. A null or empty text is its end id alone; repeated rows and null
    ids are packed like any other; other columns are ignored; an empty table gives no
    rows. Each worker remembers the ids of `memory` words."""
    return place(kept(tokenize(docs, path, length, end_id, memory), "pieces"), length).drop("row")
