"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import lanes
from .common import kept, slices

UNKNOWN = "und"
# bounds of the sample an automaton is built from
SAMPLE_DOCS = 64
SAMPLE_CHARS = 2_048
# sample characters of the languages whose automata travel together: six whole samples
BLOCK_CHARS = 6 * SAMPLE_DOCS * (SAMPLE_CHARS + 1)
# symbols of a language that have a column in its table; the arcs of all others are sparse
WIDTH = 64
LANE = 512
TOP = np.uint32(1 << 31)


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case form where it is a letter, else zero."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The arcs of the smallest automaton of all substrings, state by state; state 0 is the
    start."""
    step: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """The suffix automaton of one language's sample, completed for parsing: an arc that
    opens a phrase is marked. Where a phrase cannot be prolonged, the arc leads to where the
    next one goes on after its first symbol; a symbol the sample lacks is a phrase alone.

    Its symbols are its own: 0 for anything but letters, 1 for letters the sample lacks,
    then all letters of the sample, the frequent ones first. Rows of the table hold the first
    WIDTH symbols; arcs of later ones are kept sparsely, sorted by row and symbol."""

    def __init__(self, run: np.ndarray, symbols: int) -> None:
        seen, counts = np.unique(run[run > 0], return_counts=True)
        own = seen[np.lexsort((seen, -counts))]
        self.key = np.ones(symbols, np.uint32)
        self.key[0] = 0
        self.key[own] = np.arange(2, 2 + len(own))
        step = suffix_automaton(self.key[run].tolist())
        width = min(WIDTH, len(own) + 2)
        state = np.repeat(np.arange(len(step)), [len(s) for s in step])
        symbol = np.fromiter((c for s in step for c in s), np.int64, len(state))
        after = np.fromiter((q for s in step for q in s.values()), np.int64, len(state)) * width
        first = np.zeros(len(own) + 2, np.int64)
        first[symbol[state == 0]] = after[state == 0]
        self.opening = (first + int(TOP)).astype(np.uint32)
        table = np.tile(self.opening[:width], (len(step), 1))
        inner = (state > 0) & (symbol < width)  # at the start every symbol opens a phrase
        table[state[inner], symbol[inner]] = after[inner]
        self.table = table.ravel()
        rare = (state > 0) & (symbol >= width)
        places = lanes.place(state[rare] * width, symbol[rare])
        order = np.argsort(places)
        self.places, self.after = places[order], after[rare][order].astype(np.uint32)
        self.width = width
        self.bits = np.log2(len(run) + 1) if len(run) else np.inf

    def phrases(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of phrases of each lane."""
        own = self.key[symbols]
        if len(self.opening) == self.width:
            return lanes.count_marks(own, start, length, self.table, np.zeros(1, np.uint32))[0]
        return lanes.count_sparse_marks(own, start, length, self.table, self.width, self.opening, self.places, self.after)


class Model:
    """One automaton per language. Texts become symbols of all samples together: 0 for
    anything but letters, 1 for letters no sample has, then all letters of the samples."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        self.samples = samples

    def blocks(self) -> list[Model]:
        """Models of bounded size, each of some languages, in the order of their names."""
        blocks: list[dict[str, list[str]]] = [{}]
        size = 0
        for k in self.languages:
            own = sum(len(t) + 1 for t in self.samples[k])
            if blocks[-1] and size + own > BLOCK_CHARS:
                blocks.append({})
                size = 0
            blocks[-1][k] = self.samples[k]
            size += own
        return [self] if len(blocks) == 1 else [Model(b) for b in blocks]

    def streams(self) -> list[np.ndarray]:
        return [letters()[code_points(" ".join(self.samples[k]))] for k in self.languages]

    @functools.cached_property
    def alphabet(self) -> np.ndarray:
        seen = np.unique(np.concatenate([*self.streams(), np.zeros(1, np.uint32)]))
        return seen[seen > 0]

    @functools.cached_property
    def automata(self) -> list[Automaton]:
        return [Automaton(squeeze(self.symbols(s)), len(self.alphabet) + 2) for s in self.streams()]

    @functools.cached_property
    def bits(self) -> np.ndarray:
        return np.array([a.bits for a in self.automata])

    def build(self) -> Model:
        self.bits  # noqa: B018
        return self

    def symbols(self, lowered: np.ndarray) -> np.ndarray:
        key = np.zeros(0x110000, np.uint32)
        key[1:] = 1
        key[self.alphabet] = np.arange(2, 2 + len(self.alphabet))
        return key[lowered]

    def direct(self) -> np.ndarray:
        """The symbol of each code point."""
        return self.symbols(letters())

    def rates(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits per symbol of each text (columns) under each language (rows)."""
        owner, start, length = lanes.cut(starts, lengths, LANE)
        phrases = np.stack([np.bincount(owner, a.phrases(symbols, start, length), len(starts)) for a in self.automata])
        return phrases * self.bits[:, None] / np.maximum(lengths, 1)


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """Without the second and later of adjoining zeros."""
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    return symbols[keep]


def sample(train: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Up to `docs` different labelled texts of each language: those with the smallest
    hashes, copies counted once, up to `chars` characters of each from a place picked by
    hash too. Texts without a letter are left out. Only this sample, bounded for each
    language, comes to the driver."""
    rows = train.where("lang is not null").where(F.col("text").rlike("\\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    hashes = rows.select("lang", "h").distinct()
    ranked = hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = ranked.where(F.col("n") <= docs).select("lang", "h")
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - chars, F.lit(1))) + 1
    cut = rows.join(F.broadcast(picked), ["lang", "h"]).select(
        "lang", "h", F.substring(F.col("text"), place.cast("int"), F.lit(chars)).alias("text")).distinct()
    out: dict[str, list[str]] = {}
    for r in cut.orderBy("lang", "h", "text").collect():
        if len(mine := out.setdefault(r["lang"], [])) < docs:
            mine.append(r["text"])
    return out


def parse(known: Model, direct: np.ndarray, part: pa.RecordBatch, rest: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's best language so far, None where there is none, and the best two rates,
    after those of earlier blocks, which stand in the columns `rest`."""
    text = pc.fill_null(part.column("text"), "")
    n = len(text)
    if rest:
        best = np.array(part.column(rest[0]).to_pylist(), object)
        one, two = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in rest[1:])
    else:
        best, one, two = np.full(n, None, object), np.full(n, np.inf), np.full(n, np.inf)
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = direct[code_points("".join(text.to_pylist()))]
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
    total = np.concatenate([[0], np.cumsum(symbols > 0)])[np.concatenate([[0], np.cumsum(sizes)])]
    some = np.flatnonzero((np.diff(total) > 0) & bool(known.languages))
    if len(some):
        for name, rate in zip(known.languages, known.rates(symbols[keep], ends[:-1][some], np.diff(ends)[some]), strict=True):
            better = rate < one[some]
            two[some] = np.where(better, one[some], np.minimum(two[some], rate))
            one[some] = np.minimum(one[some], rate)
            best[some[better]] = name
    return best, one, two


def parsed(docs: DataFrame, model: Model, schema: str | StructType,
           finish: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What `finish` makes of rows, their languages and scores. Automata travel in blocks of
    bounded size; with several blocks, the rows are stored with the best two rates so far
    before the next block is read."""
    carried = ["carried_language", "carried_one", "carried_two"]
    wide = StructType([*docs.schema.fields, *(StructField(c, t) for c, t in zip(
        carried, (StringType(), DoubleType(), DoubleType()), strict=True))])
    names = docs.columns
    blocks = model.blocks()
    for place, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block.build())
        rest, last = carried if place else [], place == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rest=rest, last=last) -> Iterator[pa.RecordBatch]:
            known = shared.value
            direct = known.direct()
            for part in slices(batches, "text"):
                best, one, two = parse(known, direct, part, rest)
                if last:
                    found = np.isfinite(one)
                    score = np.where(found, 1 - np.where(found, one, 0) / np.where(found, two, 1), 0)
                    yield finish(part, np.where(found, best, UNKNOWN), np.clip(score, 0, 1))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in names), pa.array(best, pa.string()), pa.array(one), pa.array(two)],
                        names=[*names, *carried])

        docs = docs.mapInArrow(run, schema if last else wide)
        if not last:
            docs = kept(docs, "languages")
    return docs


def keep_clear(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs` with a language and a score of at least `least`, as in identify()."""
    names = docs.columns

    def finish(part: pa.RecordBatch, best: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return part.select(names).filter(pa.array((best != UNKNOWN) & (score >= least), pa.bool_()))

    return parsed(docs, model, docs.schema, finish)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs`.

    Whole texts are parsed; lanes of 512 symbols bound the work of one step, a phrase
    ends with its lane. score is one minus the ratio of the best to the second-best
    rate. A null text or one without a letter is `und` with score 0, and so is every
    text when nothing was learned; ties go to the language that sorts first; one
    learned language alone scores 1; other columns are ignored."""
    def finish(part: pa.RecordBatch, best: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return parsed(docs.select("doc_id", "text"), model, f"doc_id {kind}, lang_pred string, score double", finish)
