"""Hard negatives of anchors, in score windows set by each anchor's positives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

POSITIVES = 5
K = 10
LEAST = (30, 100)
MOST = (90, 100)
SCALE = 256
# anchors of one pass over all rows, by number and by bytes of their vectors
BLOCK_ANCHORS = 4096
BLOCK_BYTES = 32 << 20
# scores worked out at once
CELLS = 1 << 20
END = np.int64(2 ** 62)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond 62 bits they stop at the ends."""
    largest = max(1, rows.shape[1]) * float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(anchors.astype(float)).max(initial=0))
    if largest < 2 ** 53:
        return (rows.astype(float) @ anchors.astype(float).T).astype(np.int64)
    if largest < 2 ** 61:
        return rows @ anchors.T
    whole = rows.astype(object) @ anchors.astype(object).T
    return np.minimum(np.maximum(whole, -int(END)), int(END)).astype(np.int64)


class Best:
    """The first k (score, id) of each group, highest score first, ties by smaller id."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        # what a score must reach to matter
        self.bar = np.full(groups, -END, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group = group[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        stay = nth < self.k
        self.group, self.score, self.id = group[stay], score[order[stay]], ids[order[stay]]
        full = nth[stay] == self.k - 1
        self.bar[self.group[full]] = self.score[full]


class Anchors:
    """One block of anchors: ids, labels and vectors, by the length of the vectors."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        vectors = rows.column("vector").combine_chunks()
        self.of_length = {int(n): (at, _matrix(vectors.take(pa.array(at)), n)) for n, at in _lengths(vectors)}


def _lengths(vectors: pa.Array) -> list[tuple[int, np.ndarray]]:
    sizes = np.diff(vectors.offsets.to_numpy())
    return [(n, np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), length)


def scored(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple]:
    """Parts of the table of scores: places of anchors, ids and labels of rows, scores."""
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        vectors = batch.column("vector")
        for length, at in _lengths(vectors):
            if length not in anchors.of_length:
                continue
            columns, wanted = anchors.of_length[length]
            mine = _matrix(vectors.take(pa.array(at)), length)
            step = max(1, CELLS // len(columns))
            for low in range(0, len(at), step):
                here = at[low:low + step]
                yield columns, ids[here], labels[here], products(mine[low:low + step], wanted)


def _emit(best: Best, anchor_ids: np.ndarray, slots: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    anchor, slot = np.divmod(best.group, slots)
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor_ids[anchor]), pa.array(slot, pa.int32()), pa.array(best.score), pa.array(best.id)], names=names)


def positives_of(rows: DataFrame, block, count: int) -> DataFrame:
    """(anchor_id, nth, positive_id, positive_score): the first rows of the anchor's label
    with other ids. Every task keeps `count` rows an anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = Best(len(anchors.ids), count)
        for columns, ids, labels, score in scored(batches, anchors):
            fits = (labels[:, None] == anchors.labels[columns]) & (ids[:, None] != anchors.ids[columns])
            r, c = np.nonzero(fits & (score >= best.bar[columns]))
            best.add(columns[c], score[r, c], ids[r])
        yield from _emit(best, anchors.ids, 1, ["anchor_id", "slot", "score", "id"])

    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    return rows.mapInArrow(run, "anchor_id bigint, slot int, score bigint, id bigint").withColumn("nth", nth).where(
        F.col("nth") <= count).select("anchor_id", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))


def limits(scores: np.ndarray, least: tuple[int, int], most: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of the window of each positive score."""
    low = [-(-int(s) * least[0] // least[1]) for s in scores]
    high = [int(s) * most[0] // most[1] for s in scores]
    return tuple(np.array([min(max(x, -int(END)), int(END)) for x in part], np.int64) for part in (low, high))


def negatives_of(rows: DataFrame, block, windows, count: int, k: int) -> DataFrame:
    """(anchor_id, slot, score, id): the first k rows with another label of each slot. The
    upper limits of an anchor's windows cut the scores into disjoint slots; slot i holds
    what windows 1 to i may take and the next may not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        low, high = windows.value
        best = Best(len(anchors.ids) * (count + 1), k)
        for columns, ids, labels, score in scored(batches, anchors):
            slot = np.zeros(score.shape, np.int64)
            for i in range(count):
                slot += score <= high[columns, i]
            group = columns * (count + 1) + slot
            # the lowest limit of a slot's windows is that of its last
            fits = (slot > 0) & (labels[:, None] != anchors.labels[columns]) & (score >= low[columns, slot - 1])
            r, c = np.nonzero(fits & (score >= best.bar[group]))
            best.add(group[r, c], score[r, c], ids[r])
        yield from _emit(best, anchors.ids, count + 1, ["anchor_id", "slot", "score", "id"])

    first = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return rows.mapInArrow(run, "anchor_id bigint, slot int, score bigint, id bigint").withColumn("n", first).where(
        F.col("n") <= k).drop("n")


def mine_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, k: int = K,
                   least: tuple[int, int] = LEAST, most: tuple[int, int] = MOST, scale: int = SCALE,
                   block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, label and embedding; `anchors` says which rows ask. Components
    become floor(scale * x); a score is the inner product with the anchor, and higher scores,
    then smaller ids, come first. For each anchor and each of its first `positives` rows of
    the same label, the first k rows of other labels whose score lies between the shares
    `least` and `most` of the positive's.

    All windows of an anchor are answered at once: their upper limits, which fall with the
    positives, split the scores into disjoint slots. A task keeps the first k of each slot
    while rows stream by, the shuffle moves these only, and a window takes the first k of
    its own slot and those below it. Anchors travel in blocks of bounded size; each block's
    result is stored before the next is sent. No label or score is grouped whole.

    Rows without id, label or vector, or with a null or non-finite component, take no part.
    Rows that share an id count each for itself, but never as positive of their own id, and
    the one with the smallest label and vector asks; vectors of other lengths than the
    anchor's have no score with it; scores stop at 62 bits. Other columns are ignored; no row
    gives no row."""
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    whole = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double") * scale) < float("inf"), F.lit(False)))
    rows = kept(vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
                .select("vec_id", F.col("label").cast("bigint").alias("label"), x.alias("vector"), anchors.alias("asks")), "vectors")
    asked = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select(
        "vec_id", "v.label", "v.vector")
    rows = rows.drop("asks")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("length")).first()
    each = max(1, min(block_anchors, BLOCK_BYTES // (8 * max(1, size["length"] or 1))))
    blocks = -(-size["n"] // each)
    found = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                      "positive_score bigint, negative_score bigint")
    for b in range(blocks):
        mine = Anchors(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow())
        if not len(mine.ids):
            continue
        block = spark.sparkContext.broadcast(mine)
        near = positives_of(rows, block, positives).toArrow()  # at most `positives` rows an anchor
        score = near.column("positive_score").to_numpy()
        low, high = limits(score, least, most)
        order = np.argsort(mine.ids)
        place = order[np.searchsorted(mine.ids[order], near.column("anchor_id").to_numpy())]
        nth = near.column("nth").to_numpy() - 1
        lows, highs = np.full((2, len(mine.ids), positives), -END - 1)
        lows[place, nth], highs[place, nth] = low, high
        windows = spark.sparkContext.broadcast((lows, highs))
        slots = negatives_of(rows, block, windows, positives, k).groupBy("anchor_id").agg(F.sort_array(F.collect_list(
            F.struct((-F.col("score")).alias("down"), F.col("id").alias("id"), F.col("slot").alias("slot")))).alias("slots"))
        asking = spark.createDataFrame(near.append_column("low", pa.array(low)))
        # slots lie in descending order, so a window's rows are the first of its suffix
        inside = F.filter("slots", lambda s: (s["slot"] >= F.col("nth")) & (-s["down"] >= F.col("low")))
        done = asking.join(slots, "anchor_id").select(
            "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, k)).alias("place", "n")).select(
            "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
            "positive_score", (-F.col("n.down")).alias("negative_score"))
        found = found.union(kept(done, "negatives"))
        windows.destroy()
        block.destroy()
    return found
