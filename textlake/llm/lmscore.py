"""Language-model scores from a weighted backoff automaton over the characters of words,
mixed token by token with the shares of whole words. Frequent contexts are states in
memory; the arcs of all others are a stored table, met by joins."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lanes
from .common import LOWER, kept, raw, remainder, slices, words_of

# classes of bytes: 0 the end of a text, 1 a word's end, 2.. the most frequent bytes, the last all others
CLASSES = 64
ORDER = 6
WARM = ORDER - 1
# contexts of three and more symbols get states in memory from this share of all symbols
# on, which bounds each order's states by its inverse; all get them where runs are so few
LEAST_SHARE = 5e-6
FEW_RUNS = 1 << 16
BLOCK = 4096
# bound of the arcs that every task gets of contexts without states: so many of the most
# frequent; the others are looked up in the stored table
HEAD_ARCS = 1 << 20
LANE = 1024
FLUSH_WORDS = 400_000
FLUSH_GRAMS = 4_000_000
# bound of the word counts that every task gets: so many of the most frequent; words that
# are longer than this stand there by their digest
HEAD_WORDS = 65_536
HEAD_BYTES = 64
# weight of the word's share of all training tokens against the automaton's spelling of it
WORD_WEIGHT = 0.2
LN_10 = math.log(10)


def split(texts: list[bytes | None]) -> list[list[bytes]]:
    return [words_of(t.translate(LOWER)) if t else [] for t in texts]


def class_key(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and the log10 share of each byte within its class."""
    key = np.full(256, CLASSES - 1, np.uint8)
    order = [b for b in np.lexsort((np.arange(256), -byte_counts)).tolist() if b != 32]
    key[32] = 1
    key[order[: CLASSES - 3]] = np.arange(2, CLASSES - 1)
    rest = order[CLASSES - 3:]
    share = byte_counts[rest] + 0.5
    inner = np.zeros(256)
    inner[rest] = np.log10(share / share.sum())
    return key, inner


class Stream:
    """The symbols of word lists, each list after five ends and closed by one. Every word
    is followed by its end, so each token, the end of the text too, has symbols of its own."""

    def __init__(self, texts: list[list[bytes]], key: np.ndarray) -> None:
        joined = [b" ".join(w) + b" " if w else b"" for w in texts]
        pad = b"\0" * WARM
        self.data = np.frombuffer(pad + (pad + b"\0").join(joined) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, joined), np.int64, len(joined))
        self.starts = np.concatenate([[0], np.cumsum(sizes + ORDER)])[:len(texts)]
        self.first = self.starts + WARM
        self.lengths = sizes + 1
        self.symbols = key[self.data]
        for k in range(WARM):
            self.symbols[self.starts + k] = 0
        self.symbols[self.first + sizes] = 0

    def codes(self) -> np.ndarray:
        """All runs of six symbols that end inside a text, six bits a symbol."""
        n = len(self.symbols) - WARM
        code = np.zeros(n, np.int64)
        for k in range(ORDER):
            code *= CLASSES
            code += self.symbols[k:n + k]
        inside = np.ones(len(self.symbols), bool)
        for k in range(WARM):
            inside[self.starts + k] = False
        return code[inside[WARM:]]

    def codes_at(self, places: np.ndarray) -> np.ndarray:
        """The runs of six symbols that end at `places`."""
        code = np.zeros(len(places), np.int64)
        for k in range(WARM, -1, -1):
            code *= CLASSES
            code += self.symbols[places - k]
        return code

    def begins(self) -> np.ndarray:
        """Where each token begins, the ends of the texts included."""
        return np.sort(np.concatenate([self.first, np.flatnonzero(self.symbols == 1) + 1]))


class Automaton:
    """States are contexts: all of two symbols, and frequent ones of three to five. An
    arc carries a smoothed log10 probability. Where a state lacks an arc, its failure
    arc leads to the context without its first symbol, at the price of its backoff
    weight. Failure arcs are followed once here, for every state and symbol, so that a
    text takes one arc for each symbol. An arc from a state of five symbols is final; the
    others stand in for contexts that may have arcs in the stored table."""

    def __init__(self, byte_counts: np.ndarray, three: tuple[np.ndarray, np.ndarray],
                 longer: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """three: codes and counts of all runs of three symbols; longer: for 4, 5 and 6
        those of runs whose context is frequent."""
        c = CLASSES
        self.key, self.inner = class_key(byte_counts)
        codes, counts = three
        one = np.bincount(codes % c, counts, c)
        below = np.log10((one + 0.5) / (one.sum() + 0.5 * c))[None, :]
        contexts = [np.arange(c ** m) if m < 3 else np.unique(longer[m + 1][0] // c) for m in range(ORDER)]
        starts = np.cumsum([0, *map(len, contexts[2:])])
        self.states = int(starts[-1])
        self.deep = int(starts[-2]) * c
        self.arcs = np.empty(self.states * c, [("next", np.int32), ("weight", np.float32)])
        for m in range(1, ORDER):
            grams, seen = longer[m + 1] if m > 2 else self._shorter(codes, counts, m + 1)
            own = contexts[m]
            context = np.searchsorted(own, grams // c)
            total = np.bincount(context, seen, len(own))
            kinds = np.bincount(context, minlength=len(own))
            backoff = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            table = below[np.searchsorted(contexts[m - 1], own % c ** (m - 1))]
            table += np.log10(backoff)[:, None]
            table[context, grams % c] = np.log10(seen / (total + kinds)[context] + 10 ** table[context, grams % c])
            below = table
            if m > 1:
                self.arcs["weight"][starts[m - 2] * c:starts[m - 1] * c] = table.ravel()
        # in blocks, since the driver holds the arcs besides
        for m in range(2, ORDER):
            for a in range(0, len(contexts[m]), BLOCK):
                own = contexts[m][a:a + BLOCK]
                reached = (own[:, None] * c + np.arange(c)).ravel()
                state = reached % c ** 2
                for k in range(3, min(m + 1, ORDER - 1) + 1):
                    if len(contexts[k]):
                        at = np.minimum(np.searchsorted(contexts[k], reached % c ** k), len(contexts[k]) - 1)
                        state = np.where(contexts[k][at] == reached % c ** k, starts[k - 2] + at, state)
                first = (starts[m - 2] + a) * c
                self.arcs["next"][first:first + len(state)] = state * c

    @staticmethod
    def _shorter(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        grams, inverse = np.unique(codes % CLASSES ** size, return_inverse=True)
        return grams, np.bincount(inverse, counts, len(grams))

    def walk(self, texts: list[list[bytes]]) -> tuple[Stream, np.ndarray, np.ndarray]:
        """The weight of each symbol given all before it, and the places whose arc does not
        leave from a state of five symbols. The lanes of a long text start five symbols
        early, by which time their state is that of one long walk."""
        run = Stream(texts, self.key)
        _, start, length = lanes.cut(run.first, run.lengths, LANE)
        weights, early = lanes.weights(run.symbols, start - WARM, length + WARM, self.arcs, WARM, self.deep)
        return run, weights, np.flatnonzero(early)

    def spelled(self, run: Stream, weights: np.ndarray) -> None:
        """Add the shares of rare bytes within their class."""
        rare = np.flatnonzero(run.symbols == CLASSES - 1)
        weights[rare] += self.inner[run.data[rare]]

    def tokens(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log10 probability by the states alone of each token of each text given all before
        it, the ends of the texts included."""
        run, weights, _ = self.walk(texts)
        self.spelled(run, weights)
        return np.add.reduceat(weights, run.begins())


def head_key(word: bytes) -> bytes:
    """What a word is looked up by: itself, or its digest after a space where it is long."""
    return word if len(word) <= HEAD_BYTES else b" " + hashlib.sha256(word).hexdigest().encode()


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def count_tokens(train: DataFrame) -> DataFrame:
    """(word, byte, n): how often each word occurs, the end of a text as the empty word;
    and with a null word, how often each byte does. Counted in the tasks first, in
    tables of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        lots = np.zeros(256, np.int64)

        def out() -> pa.RecordBatch:
            keys = pa.array(list(words), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [keys, pa.nulls(len(keys), pa.int32()), pa.array(words.values(), pa.int64())], names=["word", "byte", "n"])

        for part in slices(batches, "text"):
            texts = split(raw(part.column("text")))
            for t in texts:
                words.update(t)
            words[b""] += len(texts)
            lots += np.bincount(np.frombuffer(b" ".join(map(b" ".join, texts)), np.uint8), minlength=256)
            if len(words) > FLUSH_WORDS:
                yield out()
                words.clear()
        yield out()
        some = np.flatnonzero(lots)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(lots[some])], names=["word", "byte", "n"])

    return train.select("text").mapInArrow(run, "word string, byte int, n bigint").groupBy("word", "byte").agg(F.sum("n").alias("n"))


def count_grams(train: DataFrame, key: np.ndarray) -> DataFrame:
    """(code, n): how often each run of six symbols occurs."""
    shared = train.sparkSession.sparkContext.broadcast(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in slices(batches, "text"):
            parts.append(np.unique(Stream(split(raw(part.column("text"))), shared.value).codes(), return_counts=True))
            size += len(parts[-1][0])
            if size > FLUSH_GRAMS:
                parts = [merge(parts)]
                size = len(parts[0][0])
                if 2 * size > FLUSH_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["code", "n"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge(parts)], names=["code", "n"])

    return train.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def mixed(share: Column, own: Column) -> Column:
    """log10 of the sum of two probabilities; `own` alone where there is no share."""
    high, low = F.greatest(share, own), F.least(share, own)
    return F.when(share.isNull(), own).otherwise(high + F.log10(1 + F.pow(F.lit(10.0), low - high)))


class Model:
    """The automaton with its frequent contexts, the counts of whole words (N, V, how many
    texts ended), and two lookups, each with its most frequent keys in memory and all as a
    table: the counts of words, and the arcs of contexts without states."""

    def __init__(self, automaton: Automaton, total: int, kinds: int, ends: int, head: dict[bytes, int], words: DataFrame,
                 near: tuple[np.ndarray, np.ndarray], base: DataFrame, levels: dict[int, DataFrame]) -> None:
        self.automaton, self.total, self.kinds, self.ends = automaton, total, kinds, ends
        self.head, self.words = head, words
        self.near, self.base, self.levels = near, base, levels

    def arcs(self, codes: DataFrame) -> DataFrame:
        """(code, weight) of distinct runs of six symbols, whether learned or not: the arc of
        the longest run that was learned, behind the backoff weights of the longer contexts
        that were. All of a run's keys meet the stored arcs in one join."""
        c, code = CLASSES, F.col("code")
        stored = self.base.select((code + c ** 3).alias("key"), "weight")
        for size, level in self.levels.items():
            stored = stored.unionAll(level.select(code + c ** size, "weight")).unionAll(level.where("opens").select(
                F.expr(f"-(code div {c}) - {c ** (size - 1)}"), F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))))
        keys = [code % c ** 3 + c ** 3]
        for size in self.levels:
            keys += [code % c ** size + c ** size, F.expr(f"-(code % {c ** size} div {c}) - {c ** (size - 1)}")]
        met = codes.select("code", F.posexplode(F.array(*keys)).alias("nth", "key")).join(stored, "key").groupBy("code").agg(
            *(F.max(F.when(F.col("nth") == k, F.col("weight"))).alias(f"w{k}") for k in range(len(keys))))
        weight = F.col("w0")
        for k in range(1, len(keys), 2):
            weight = F.coalesce(F.col(f"w{k}"), F.coalesce(F.col(f"w{k + 1}"), F.lit(0.0)) + weight)
        return met.select("code", weight.alias("weight"))


def stored_arcs(grams: DataFrame, base: DataFrame) -> dict[int, DataFrame]:
    """For 4, 5 and 6 symbols, stored: (code, n, total, kinds, opens, weight) of every run that
    was counted: how often it and its context were, by how many symbols the context was
    followed, whether it is the first of its context, and the smoothed log10 probability
    of the arc. `base` has the weights of all runs of three. A context has at most 64 arcs,
    so no group is larger."""
    runs = {ORDER: grams}
    for size in range(ORDER - 1, 3, -1):
        runs[size] = runs[size + 1].groupBy((F.col("code") % CLASSES ** size).alias("code")).agg(F.sum("n").alias("n"))
    levels: dict[int, DataFrame] = {}
    below = base
    for size in range(4, ORDER + 1):
        context = Window.partitionBy(F.expr(f"code div {CLASSES}"))
        known = runs[size].select(
            "code", "n", F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("kinds"),
            (F.col("code") == F.min("code").over(context)).alias("opens"))
        low = below.select(F.col("code").alias("short"), F.col("weight").alias("low"))
        weight = F.log10((F.col("n") + F.col("kinds") * F.pow(F.lit(10.0), "low")) / (F.col("total") + F.col("kinds")))
        levels[size] = below = kept(known.join(low, F.col("code") % CLASSES ** (size - 1) == F.col("short")).select(
            "code", "n", "total", "kinds", "opens", weight.alias("weight")), f"arcs{size}")
    return levels


def most_frequent(arcs: DataFrame, limit: int) -> DataFrame:
    """The arcs from a count on, so many that they are at most `limit`; counts within a
    twelfth of each other stay together."""
    grade = F.floor(F.log2("n") * 8)
    least, size = math.inf, 0
    for value, many in sorted(map(tuple, arcs.groupBy(grade).count().collect()), reverse=True):
        size += many
        if size > limit:
            break
        least = value
    return arcs.where(grade >= least) if least < math.inf else arcs.limit(0)


def learn(train: DataFrame, least_share: float | None = None) -> Model:
    """Count all of `train` (null text: empty). Contexts of three symbols and more get states
    in memory from `least_share` of all symbols on, by default LEAST_SHARE, or all of them
    where they are few; every counted run has its arc in the stored table, so the share
    decides where an arc is looked up and not what it weighs.

    To the driver come at most 256 byte counts, 65,536 words or digests, 64 ** 3 runs of
    three symbols, HEAD_ARCS arcs, and for each longer order 64 / least_share runs, since at
    most 1 / least_share contexts can hold that share."""
    spark = train.sparkSession
    tokens = kept(count_tokens(train), "tokens")
    bytes_seen = np.zeros(256, np.int64)
    for r in tokens.where("word is null").select("byte", "n").collect():
        bytes_seen[r["byte"]] = r["n"]
    words = tokens.where("word is not null").select("word", F.col("n").alias("c"))
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = words.where("word = ''").agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    short = F.when(F.octet_length("word") <= HEAD_BYTES, F.col("word")).otherwise(
        F.concat(F.lit(" "), F.sha2(F.col("word").cast("binary"), 256)))
    top = words.select(short.alias("word"), "c").orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    head = dict(zip(raw(top.column("word").combine_chunks()), top.column("c").to_pylist(), strict=True)) if len(top) else {}
    key, _ = class_key(bytes_seen)
    grams = kept(count_grams(train, key), "grams")

    def arrays(df: DataFrame, value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        got = df.select("code", value).toArrow()
        codes, n = got.column("code").to_numpy().astype(np.int64), got.column(value).to_numpy().astype(kind)
        order = np.argsort(codes)
        return codes[order], n[order]

    three = arrays(grams.groupBy((F.col("code") % CLASSES ** 3).alias("code")).agg(F.sum("n").alias("n")), "n", np.int64)
    none = np.zeros(0, np.int64)
    shallow = Automaton(bytes_seen, three, {size: (none, none) for size in range(4, ORDER + 1)})
    base = spark.createDataFrame(pa.table({
        "code": np.arange(CLASSES ** 3), "weight": shallow.arcs["weight"].astype(np.float64)}))
    levels = stored_arcs(grams, base)
    whole = levels[ORDER]
    symbols, many = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if least_share is None:
        least_share = LEAST_SHARE if many > FEW_RUNS else 0.0
    least = least_share * symbols
    longer = {size: arrays(level.where(F.col("total") >= least), "n", np.int64) for size, level in levels.items()}
    near = arrays(most_frequent(whole.where(F.col("total") < least), HEAD_ARCS).select(
        "code", F.col("weight").cast("float")), "weight", np.float32)
    return Model(Automaton(bytes_seen, three, longer), total, kinds, ends, head, words, near, base, levels)


def score(docs: DataFrame, model: Model, word_weight: float = WORD_WEIGHT) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of `docs`.

    A token's probability is the automaton's for its symbols, mixed at `word_weight` with
    the token's share of all training tokens; a token that was never learned has the
    automaton's part alone. So all counted words and runs of symbols take part, and a
    text scores as the sum of log10 over its tokens.

    One pass walks whole texts and looks frequent words and arcs up in bounded heads. The
    arcs of other contexts, and then the counts of other words, come by joins, so no word
    there has more than one in 65,536 of the training tokens. A null text is an empty one:
    its end alone. Rows are told apart by place, so repeated rows and null ids are scored
    like any other; other columns are ignored; an empty table gives no rows, and with
    nothing learned every symbol is equally likely."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.automaton, model.head, model.near))
    norm = math.log10(model.total + 0.5 * (model.kinds + 1))
    weight = word_weight if model.total else 0.0
    spelled = math.log10(1 - weight)
    # log10 of what one count adds to the share
    unit = math.log10(weight / model.total) if weight else -math.inf
    ends = model.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, head, (near, near_weights) = shared.value
        for part in slices(batches, "text"):
            texts = split(raw(part.column("text")))
            n = len(texts)
            sizes = np.fromiter(map(len, texts), np.int64, n)
            walked, weights, places = automaton.walk(texts)
            codes = walked.codes_at(places)
            at = np.searchsorted(near, codes)
            hit = np.flatnonzero(at < len(near))
            hit = hit[near[at[hit]] == codes[hit]]
            weights[places] = 0
            weights[places[hit]] = near_weights[at[hit]]
            places, codes = np.delete(places, hit), np.delete(codes, hit)
            automaton.spelled(walked, weights)
            begin = walked.begins()
            own = np.add.reduceat(weights, begin) + spelled
            owner = np.repeat(np.arange(n), sizes + 1)
            end = np.zeros(len(own), bool)
            end[np.cumsum(sizes + 1) - 1] = True
            words = [w for t in texts for w in (*t, None)]
            c = np.array([ends if w is None else head.get(w if len(w) <= HEAD_BYTES else head_key(w), 0) for w in words], np.float64)
            met, lost = (c > 0) & ~end, (c == 0) & ~end
            # each token's arcs that are to be looked up, equal ones once
            token = np.searchsorted(begin, places, "right") - 1
            order = np.lexsort((codes, token))
            token, codes = token[order], codes[order]
            new = np.flatnonzero(np.diff(token, prepend=-1).astype(bool) | np.diff(codes, prepend=-1).astype(bool))
            times = np.diff(new, append=len(codes))
            token, codes = token[new], codes[new]
            waits = np.zeros(len(own), bool)
            waits[token] = True
            done = np.flatnonzero(~waits & ~lost)
            final = own[done]
            known = np.flatnonzero(c[done])
            final[known] = np.logaddexp((np.log10(c[done[known]]) + unit) * LN_10, final[known] * LN_10) / LN_10

            def strings(which: np.ndarray) -> pa.Array:
                return pa.array([words[i] if lost[i] else None for i in which.tolist()], pa.binary()).cast(pa.string())

            def lists(which: np.ndarray, items: pa.Array) -> pa.Array:
                stops = np.concatenate([[0], np.cumsum(np.bincount(owner[which], minlength=n))])
                return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), items)

            rare, held = np.flatnonzero(lost & ~waits), np.flatnonzero(waits)
            arcs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(token, np.append(held, len(own))), pa.int32()),
                pa.StructArray.from_arrays([pa.array(codes), pa.array(times)], names=["code", "times"]))
            known = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(sizes),
                 pa.array(np.bincount(owner[known], minlength=n).astype(np.int64)),
                 pa.array(np.bincount(owner[known], np.log10(c[known] + 0.5), n).astype(np.float64)),
                 pa.array(np.bincount(owner[done], final, n).astype(np.float64)),
                 lists(rare, pa.StructArray.from_arrays([strings(rare), pa.array(own[rare])], names=["word", "own"])),
                 lists(held, pa.StructArray.from_arrays(
                     [strings(held), pa.array(c[held].astype(np.int64)), pa.array(own[held]), arcs],
                     names=["word", "c", "own", "arcs"]))],
                names=["doc_id", "row", "n_words", "known", "base", "score", "rare", "held"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = kept(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"doc_id {kind}, row bigint, n_words bigint, known bigint, base double, score double, "
        "rare array<struct<word:string,own:double>>, "
        "held array<struct<word:string,c:bigint,own:double,arcs:array<struct<code:bigint,times:bigint>>>>"), "scores")
    held = part.select("row", F.posexplode("held").alias("nth", "t"))
    wanted = model.arcs(held.select(F.explode("t.arcs.code").alias("code")).distinct())
    # a token's own part and its word travel with its first arc
    first = F.col("k") == 0
    arcs = held.select("row", "nth", "t", F.posexplode("t.arcs").alias("k", "a")).select(
        "row", "nth", "a.code", "a.times", *(F.when(first, F.col(f"t.{x}")).alias(x) for x in ("word", "c", "own")))
    opened = kept(arcs.join(wanted, "code").groupBy("row", "nth").agg(
        F.max("word").alias("word"), F.max("c").alias("c"),
        (F.sum("own") + F.sum(F.col("times") * F.col("weight"))).alias("own")), "opened")

    def share(c: str) -> Column:
        return F.when(F.col(c) > 0, F.log10(c) + F.lit(unit))

    tail = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.own").unionAll(
        opened.where("word is not null").select("row", "word", "own"))
    found = tail.join(model.words, "word", "left").select(
        "row", F.col("c").isNotNull().cast("int").alias("met"), F.log10(F.coalesce("c", F.lit(0)) + 0.5).alias("rest"),
        mixed(share("c"), F.col("own")).alias("both")).unionAll(opened.where("word is null").select(
            "row", F.lit(0), F.lit(0.0), mixed(share("c"), F.col("own")))).groupBy("row").agg(
        F.sum("met").alias("more"), F.sum("rest").alias("rest"), F.sum("both").alias("tail"))
    return part.join(found, "row", "left").select(
        "doc_id", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + math.log10(ends + 0.5)
         - (F.col("n_words") + 1) * norm).alias("base_score"),
        (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"))


def score_held_out(docs: DataFrame, parts: int = 5, held: int = 1) -> DataFrame:
    """Learn from the documents whose id does not fall into the held-out part, and score
    all of them. Adds held_out and train_tokens to what `score` gives."""
    training = docs.where(remainder("doc_id", parts) != held)
    model = learn(training)
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", parts) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")
