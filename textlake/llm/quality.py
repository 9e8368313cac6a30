"""Quality rules: a linear-chain conditional random field marks lines as content or
boilerplate, and the share of content decides whether a document stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, raw, slices

# bounds of the sample the field is fitted on
TRAIN_DOCS = 600
TRAIN_LINES = 64
MIN_WORDS = 50
MIN_SHARE = 0.5

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CODE_START = np.array([(b & 0xC0) != 0x80 for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
SHOUT = np.zeros(256, bool)
SHOUT[list(b"!?")] = True
STOP = frozenset(b".!?:;\"'")

FEATURES = ("one", "symbols", "pipes_and_marks", "upper", "digits", "letters", "shouts", "variety", "low_variety",
            "repeated", "closed", "short", "long", "word_length", "first", "last")


class Lines:
    """The lines of a run of documents with what the rules need, all as arrays."""

    def __init__(self, texts: list[bytes | None]) -> None:
        docs = [t or b"" for t in texts]
        self.n_docs = len(docs)
        joined = b"\n".join(docs) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        breaks = np.flatnonzero(data == 10)
        line_start = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64)
        self.doc = np.searchsorted(ends, line_start, side="right")
        self.number = np.arange(len(breaks)) - np.searchsorted(breaks, starts)[self.doc]

        def by_line(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            return total[breaks] - total[line_start]

        def by_doc(per_line: np.ndarray) -> np.ndarray:
            return np.bincount(self.doc, per_line, self.n_docs).astype(np.int64)

        space = SPACE[data]
        opens = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        word_line = np.searchsorted(breaks, opens)
        self.words = np.bincount(word_line, minlength=len(breaks))
        chars = by_line(CODE_START & ~SPACE)
        symbols = by_line(SYMBOL)
        self.n_words = by_doc(self.words)
        self.word_chars = by_doc(chars)
        self.n_symbols = by_doc(symbols)
        parts = joined.split()
        ids = pd.factorize(np.array(parts, object))[0].astype(np.int64) if parts else np.zeros(0, np.int64)
        repeats = self._repeats(ids, self.doc[word_line])
        self.n_repeat_words = np.bincount(self.doc[word_line][repeats], minlength=self.n_docs)
        with_word = np.flatnonzero(self.words > 0)
        again = np.zeros(len(breaks), bool)
        at, seen = -1, set()
        for i, d, a, b in zip(with_word.tolist(), self.doc[with_word].tolist(), line_start[with_word].tolist(),
                              breaks[with_word].tolist(), strict=True):
            if d != at:
                at, seen = d, set()
            line = joined[a:b]
            again[i] = line in seen
            seen.add(line)
        self.n_dup_lines = by_doc(again)
        words = np.maximum(self.words, 1)
        size = np.maximum(chars, 1)
        kinds = pd.factorize(word_line * (int(ids.max()) + 1 if len(ids) else 1) + ids)[1]
        variety = np.bincount(kinds // (int(ids.max()) + 1), minlength=len(breaks)) / words if len(ids) else words * 0.0
        seen_here = np.bincount(word_line[repeats], minlength=len(breaks)) / words
        last_byte = data[np.maximum(breaks - 1, 0)]
        letters = np.maximum(by_line(LETTER), 1)
        known = with_word
        self.lines = known
        first = np.ones(len(known), bool)
        first[1:] = self.doc[known][1:] != self.doc[known][:-1]
        last = np.ones(len(known), bool)
        last[:-1] = first[1:]
        self.features = np.stack([x.astype(np.float64) for x in (
            np.ones(len(known)), np.minimum(1, symbols[known] / words[known]),
            symbols[known] * 4 > words[known], by_line(UPPER)[known] / letters[known],
            by_line(DIGIT)[known] / size[known], np.minimum(1, by_line(LETTER)[known] / size[known]),
            np.minimum(1, by_line(SHOUT)[known] / words[known]), variety[known], variety[known] < 0.4,
            seen_here[known], np.isin(last_byte[known], list(STOP)), words[known] < 4, words[known] > 40,
            np.minimum(1, size[known] / words[known] / 12), first, last)], axis=1)
        self.opens_doc = first

    @staticmethod
    def _repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Positions of words inside a three-word window that its document holds twice."""
        n = len(ids)
        if n < 3:
            return np.zeros(0, np.int64)
        base = int(ids.max()) + 1
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        pair = pd.factorize(ids[inside] * base + ids[inside + 1])[0].astype(np.int64)
        three = pd.factorize(pair * base + ids[inside + 2])[0].astype(np.int64)
        own = pd.factorize(three * (int(doc[-1]) + 1) + doc[inside])[0]
        twice = inside[np.bincount(own)[own] > 1] if len(own) else inside
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[twice + k] = True
        return np.flatnonzero(mark)


class Field:
    """Weights of the chain: emission[f, y] and transition[y, y'], y = 1 for content."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray) -> None:
        self.emission, self.transition = emission, transition

    def decode(self, lines: Lines) -> np.ndarray:
        """The most likely labels of all lines with a word, document by document."""
        scores = lines.features @ self.emission
        (t00, t01), (t10, t11) = self.transition.tolist()
        labels = np.zeros(len(scores), bool)
        back: list[tuple[bool, bool]] = []
        a = b = 0.0

        def trace(stop: int) -> None:
            y = b > a
            for i in range(stop - 1, stop - 1 - len(back), -1):
                labels[i] = y
                y = back[i - stop + len(back)][y]

        for i, (opens, (e0, e1)) in enumerate(zip(lines.opens_doc.tolist(), scores.tolist(), strict=True)):
            if opens:
                if i:
                    trace(i)
                back = [(False, False)]
                a, b = e0, e1
                continue
            to0, to1 = b + t10 > a + t00, b + t11 > a + t01
            back.append((to0, to1))
            a, b = (b + t10 if to0 else a + t00) + e0, (b + t11 if to1 else a + t01) + e1
        if len(scores):
            trace(len(scores))
        return labels


# used where nothing is labelled: symbols, shouting and repetition speak against a line
PRIOR = {"one": 2.0, "symbols": -3.0, "pipes_and_marks": -2.0, "shouts": -2.0, "low_variety": -4.0, "upper": -2.0}


def prior() -> Field:
    emission = np.zeros((len(FEATURES), 2))
    emission[:, 1] = [PRIOR.get(f, 0.0) for f in FEATURES]
    return Field(emission, np.array([[0.5, -0.5], [-0.5, 0.5]]))


def fit(features: np.ndarray, opens: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.1,
        ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps over whole chains, cut at TRAIN_LINES."""
    chain = np.cumsum(opens) - 1
    place = np.arange(len(opens)) - np.flatnonzero(opens)[chain]
    use = place < TRAIN_LINES
    n, most = int(chain[-1]) + 1, int(place[use].max()) + 1
    x = np.zeros((n, most, features.shape[1]))
    y = np.zeros((n, most), np.int64)
    on = np.zeros((n, most), bool)
    x[chain[use], place[use]], y[chain[use], place[use]], on[chain[use], place[use]] = features[use], labels[use], True
    weights = [np.zeros((features.shape[1], 2)), np.zeros((2, 2))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    truth = np.eye(2)[y] * on[..., None]
    both = on[:, 1:] & on[:, :-1]
    pairs = np.einsum("nta,ntb,nt->ab", truth[:, :-1], truth[:, 1:], both.astype(float))
    total = on.sum()
    for step in range(1, steps + 1):
        emission, transition = weights
        score = (x @ emission) * on[..., None]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, most):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + transition, axis=1) + score[:, t]
            forward[:, t] = np.where(on[:, t, None], moved, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            moved = np.logaddexp.reduce(transition + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(on[:, t + 1, None], moved, 0)
        all_paths = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        node = np.exp(forward + backward - all_paths) * on[..., None]
        edge = np.exp(forward[:, :-1, :, None] + transition + (score + backward)[:, 1:, None, :] - all_paths[..., None])
        grads = [np.einsum("ntf,nty->fy", x, truth - node) / total - ridge * emission,
                 (pairs - (edge * both[..., None, None]).sum((0, 1))) / total - ridge * transition]
        for k, g in enumerate(grads):
            m, v = moments[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            weights[k] = weights[k] + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return Field(*weights)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Field:
    """A field fitted on up to `limit` labelled documents of each quality, picked by the
    hash of their id. Lines get the label of their document; only line features of
    this bounded sample, TRAIN_LINES lines a document at most, come to the driver. With
    fewer than both qualities labelled, fixed weights serve."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if set(counts) != {0, 1}:
        return prior()
    share = F.when(F.col("quality") == 0, min(1.0, 2.0 * limit / counts[0])).otherwise(min(1.0, 2.0 * limit / counts[1]))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= share * (1 << 20))
    chosen = [
        (r["doc_id"], r["quality"])
        for q in (0, 1)
        for r in picked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]
    spark = docs.sparkSession
    small = spark.createDataFrame(chosen, picked.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lines = Lines(raw(part.column("text")))
            place = np.arange(len(lines.lines)) - np.flatnonzero(lines.opens_doc)[np.cumsum(lines.opens_doc) - 1]
            use = place < TRAIN_LINES
            doc = lines.doc[lines.lines][use]
            flat = pa.array(lines.features[use].ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(part.column("doc_id").to_pylist(), object)[doc], part.schema.field("doc_id").type),
                 pa.array(place[use], pa.int32()),
                 pa.array(np.array(part.column("quality").to_pylist(), np.int64)[doc]),
                 pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), flat)],
                names=["doc_id", "place", "quality", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = (rows.mapInArrow(run, f"doc_id {kind}, place int, quality bigint, f array<double>")
           .dropDuplicates(["doc_id", "place"]).orderBy("doc_id", "place").collect())
    if len({r["quality"] for r in got}) < 2:
        return prior()
    return fit(np.array([r["f"] for r in got]), np.array([r["place"] == 0 for r in got]),
               np.array([r["quality"] for r in got]))


COLUMNS = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
           ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"),
           ("content_share", "double"), ("content_lines", "array<int>"))


def rules(lines: Lines, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of words in the given content lines, and whether the base rules fail."""
    share = np.bincount(lines.doc[content], lines.words[content], lines.n_docs) / np.maximum(lines.n_words, 1)
    return share, (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > 50 * lines.n_words)


def keep_good(docs: DataFrame, field: Field, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of `docs` that judge() keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def test() -> Callable[[pa.RecordBatch], np.ndarray]:
        chain = shared.value

        def passes(part: pa.RecordBatch) -> np.ndarray:
            lines = Lines(raw(part.column("text")))
            share, failed = rules(lines, lines.lines[chain.decode(lines)])
            return ~failed & (share >= min_share)
        return passes

    return filtered(docs, test)


def judge(docs: DataFrame, field: Field, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for every row of `docs`: its id, the counts of the rules, whether the base
    rules fail (under 50 words, or over half of the words in repeated windows), whether
    it is kept, the share of words in content lines, and the numbers of those lines.

    Whole texts are read and Viterbi decoding covers every line with a word. A null or
    blank text has no words, fails the base rules and has share 0; ties in decoding go
    to boilerplate; repeated rows and null ids are judged like any other; other columns
    are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for part in slices(batches, "text"):
            lines = Lines(raw(part.column("text")))
            content = chain.decode(lines)
            mine = lines.lines[content]
            share, failed = rules(lines, mine)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(lines.doc[mine], minlength=lines.n_docs))])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (
                    lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)),
                 pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share),
                 pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(lines.number[mine].astype(np.int32)))],
                names=["doc_id", *(c for c, _ in COLUMNS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(" ".join(c) for c in COLUMNS))
