"""Benchmark decontamination with one Aho-Corasick automaton over word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filtered, kept, raw, slices

WINDOW = 10
# normalised item bytes of one automaton, which has some eight nodes of 54 bytes for each: about
# 230 MB. A larger benchmark takes several, one after the other
BLOCK_BYTES = 1 << 19
# a long item is cut into pieces of this share of a block
PIECES_IN_BLOCK = 16
# everything in ASCII but digits and letters to a space, A-Z to a-z, other bytes stay
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """All windows of consecutive words, each between spaces. Fewer words are one."""
    n = max(1, len(words) - size + 1) if words else 0
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(n)]


def build(items: list[tuple[str, bytes | None]], size: int) -> ahocorasick.Automaton:
    """An automaton over the windows of all items; each knows its number of words and
    the places of its items in the list."""
    owners: dict[bytes, set[int]] = {}
    for i, (_, text) in enumerate(items):
        for w in windows_of((text or b"").translate(NORMAL).split(), size):
            owners.setdefault(w, set()).add(i)
    automaton = ahocorasick.Automaton()
    for w, mine in owners.items():
        automaton.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(sorted(mine))))
    automaton.make_automaton()
    return automaton


class Hits:
    """What occurs in one text: its words, which of them are hit, where these stand in
    the original, and the items found."""

    def __init__(self, text: bytes | None, automaton: ahocorasick.Automaton) -> None:
        plain = (text or b"").translate(NORMAL)
        words = plain.split()
        self.n_words = len(words)
        self.items: set[int] = set()
        self.spans: list[tuple[int, int, int, int]] = []
        self.n_hit = 0
        if not words or not len(automaton):
            return
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = [(end, length, count, mine) for end, (length, count, mine) in automaton.iter(line)]
        if not found:
            return
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        hit = np.zeros(len(words) + 1, np.int64)
        for end, length, count, mine in found:
            first = int(np.searchsorted(gaps, end - length + 1))
            hit[first] += 1
            hit[first + count] -= 1
            self.items.update(mine)
        on = np.cumsum(hit)[:-1] > 0
        self.n_hit = int(on.sum())
        # the same words in the text as it was, where they start and end
        data = np.frombuffer(plain, np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], data, [False]]).astype(np.int8)))
        turns = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        self.spans = [(int(a), int(b), int(edge[2 * a]), int(edge[2 * b - 1]))
                      for a, b in zip(turns[::2], turns[1::2], strict=True)]


def join_spans(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The stretches of words that the given ones cover together."""
    out: list[list[int]] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], d)
        else:
            out.append([a, b, c, d])
    return [tuple(x) for x in out]


def pieces_of(benchmark: DataFrame, size: int, piece_words: int) -> DataFrame:
    """(item_id, text): the different items in normal form, long ones in pieces of at most
    `piece_words` words. Pieces of an item overlap by all but one word of a window, so they
    have its windows and no others."""
    items = benchmark.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for item, text in zip(part.column("item_id").to_pylist(), raw(part.column("text")), strict=True):
                words = text.translate(NORMAL).split()
                step = max(1, piece_words - size + 1)
                starts = range(0, max(1, len(words) - size + 1), step) if words else ()
                texts = [b" ".join(words[i:i + step + size - 1]).decode() for i in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    return items.mapInArrow(run, "item_id string, text string")


def blocks_of(benchmark: DataFrame, block_bytes: int, size: int = WINDOW) -> list[DataFrame]:
    """The items in groups of at most `block_bytes` of normal form and one piece. Pieces are
    dealt to parts of that size on average by hash; prefix sums cut the larger parts."""
    pieces = pieces_of(benchmark, size, max(2 * size, block_bytes // PIECES_IN_BLOCK // 8))
    pieces = kept(pieces.withColumn("bytes", F.octet_length("text")), "pieces")
    total = pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    so_far = F.sum("bytes").over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    cut = pieces.withColumn("part", part).withColumn("cut", F.floor(F.coalesce(so_far, F.lit(0)) / block_bytes))
    if parts > 1:
        cut = kept(cut, "blocks")
    places = cut.select("part", "cut").distinct().orderBy("part", "cut").collect()  # one row a block
    return [cut.where((F.col("part") == r["part"]) & (F.col("cut") == r["cut"])).select("item_id", "text") for r in places] or [
        cut.select("item_id", "text")]


SCHEMA = ("n_words bigint, n_hit bigint, items array<string>, "
          "spans array<struct<word:bigint,end_word:bigint,first:bigint,last:bigint>>")
FIELDS = ("word", "end_word", "first", "last")
SPANS = pa.list_(pa.struct([(f, pa.int64()) for f in FIELDS]))


def span_column(spans: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(FIELDS, s, strict=True)) for s in own] for own in spans], SPANS)


def scan(docs: DataFrame, items: list[tuple[str, bytes | None]], size: int) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, spans) of every row against one block."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(shared.value, size)
        names = [i for i, _ in shared.value]
        for part in slices(batches, "text"):
            hits = [Hits(t, automaton) for t in raw(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array([h.n_words for h in hits], pa.int64()),
                 pa.array([h.n_hit for h in hits], pa.int64()),
                 pa.array([sorted({names[i] for i in h.items}) for h in hits], pa.list_(pa.string())),
                 span_column([h.spans for h in hits])],
                names=["row", "doc_id", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, {SCHEMA}")


def collected(block: DataFrame) -> list[tuple[str, bytes]]:
    return [(r["item_id"] or "", r["text"].encode()) for r in block.collect()]


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` in whose text no item has a window, as in decontaminate()."""
    blocks = blocks_of(benchmark, block_bytes, size)
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(collected(block))

        def test(shared=shared) -> Callable[[pa.RecordBatch], np.ndarray]:
            automaton = build(shared.value, size)
            return lambda part: np.array([Hits(t, automaton).n_hit == 0 for t in raw(part.column("text"))], bool)

        docs = filtered(docs, test) if len(blocks) == 1 else kept(filtered(docs, test), "clean")
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of `docs`.

    items are the ids, as sorted strings, of benchmark items with a window in the text;
    spans are the hit stretches, as word numbers and as byte offsets of the original
    UTF-8 text, the last ones excluded. The items of
    a block travel to every task; their bytes are bounded by `block_bytes`, a larger
    benchmark is scanned block by block, each result written out before the next. A null
    or wordless text has no words and no hits; items without words, or null, occur
    nowhere; a null item id counts as the empty string; ids that repeat are one item;
    other columns are ignored; empty tables give no rows or no hits."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    results = []
    blocks = blocks_of(benchmark, block_bytes, size)
    if len(blocks) > 1:
        # the numbers of the rows must be the same in every scan
        numbered = kept(numbered, "numbered")
    for block in blocks:
        got = scan(numbered, collected(block), size)
        results.append(got if len(blocks) == 1 else kept(got, "hits"))
    if len(results) == 1:
        return results[0].drop("row")
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    merged = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [join_spans([tuple(s[f] for f in FIELDS) for s in own]) for own in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array([sum(s[1] - s[0] for s in own) for own in spans], pa.int64()),
                 b.column("items"), span_column(spans)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return merged.mapInArrow(join, f"doc_id {kind}, {SCHEMA}")
