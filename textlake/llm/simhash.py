"""Near-duplicate groups by SimHash, found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, kept, raw, slices, words_of
from .graph import components

WORDS = 4
SEED = 42
DISTANCE = 4
# values of one byte times its eight bits, lowest first
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Bit-wise majority of the XXH64 values of all word shingles, repeats included. A
    text with fewer words has its whole sequence as one shingle; no word gives zero."""
    parts = words_of(text.translate(LOWER)) if text else []
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last, strict=True)], np.uint64)
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * counts > n).ravel(), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """Each document's id and fingerprint as a signed long. Null and blank texts get zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = np.array([fingerprint(t, words) for t in raw(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", name])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {name} bigint")


def segments_of(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of 64 bits of which one at least
    differs in at most one bit when `distance` bits differ in all."""
    count = distance // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(low: int, width: int) -> int:
    value = ((1 << width) - 1) << low
    return value - (1 << 64) if value >= 1 << 63 else value


def variants(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per fingerprint and bit: the bit's segment with that bit wiped out. Two
    fingerprints within the distance share one such row at least."""
    rows = []
    for low, width in segments_of(distance):
        for bit in range(low, low + width):
            kept_bits = F.col("f").bitwiseAND(F.lit(_mask(low, width) & ~_mask(bit, 1)).cast("long"))
            rows.append(F.struct(F.lit(bit).cast("int").alias("bit"), F.call_function(
                "shiftrightunsigned", kept_bits, F.lit(low)).alias("seg")))
    return prints.select("f", F.explode(F.array(*rows)).alias("v")).select("v.bit", "v.seg", "f")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most `distance` bits apart, each
    once. The join is on equal variants; distance and first shared variant are tested
    inside the join, so it gives out links only, never candidates. Spark takes the variants
    for as small as the fingerprints and would broadcast them, 64 rows for each, so the
    merge is asked for."""
    one = variants(prints, distance)
    left = one.withColumnRenamed("f", "a").alias("l").hint("merge")
    right = one.withColumnRenamed("f", "b").alias("r")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(False)
    clear = F.lit(True)
    for low, width in segments_of(distance):
        inside = x.bitwiseAND(F.lit(_mask(low, width)).cast("long"))
        here = F.col("l.bit").between(low, low + width - 1) & F.when(
            inside == 0, F.col("l.bit") == low).otherwise(
            inside == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l.bit")))
        first = first | (clear & here)
        clear = clear & (F.bit_count(inside) > 1)
    return left.join(
        right,
        (F.col("l.bit") == F.col("r.bit")) & (F.col("l.seg") == F.col("r.seg")) & (F.col("a") < F.col("b"))
        & (F.bit_count(x) <= distance) & first,
    ).select("a", "b")


def near_groups(docs: DataFrame, text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of `docs`.

    Equal fingerprints shrink to one before anything is joined, so copies never meet
    each other; only links between different fingerprints are looked for, and their
    components are found by distributed star contraction. component_id is the smallest
    doc_id of the group. A null or blank text has fingerprint zero and links like any
    other; repeated rows keep their number; a null doc_id counts only where a group has
    no other; other columns are ignored; an empty table gives no rows."""
    prints = kept(add_fingerprints(docs, text, words=words), "prints")
    members = kept(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")), "members")
    found = components(links(members.select("f"), distance))
    joined = members.join(found.withColumnRenamed("node", "f"), "f", "left").select(
        "f", "least", F.coalesce("root", "f").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(smallest, "root").select(F.col("f").alias("fingerprint"), "component_id")
    return prints.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents left when each near-duplicate group keeps the one with the smallest
    doc_id. Rows with a null doc_id stay. All columns are returned."""
    groups = near_groups(docs, text)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti")
