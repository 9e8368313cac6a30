"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, exactly:
a partition of the universe of shingles, the pigeonhole principle, and whole sets.

Two sets of s shingles in all that reach the similarity p/q differ in at most
s * (q - p) / (p + q) of them. When all shingles are dealt to segments by their hash, more
segments than that cannot all differ, so some segment holds equal subsets. Which segments a
set is indexed by is a matter of cost, see `allocate`."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, kept, located, raw, sieve, sifted, slices, words_of
from .graph import components

WORDS = 5
# least similarity as a fraction, compared in whole numbers; one half or more
SIMILAR = (4, 5)
# shingles found this often in one of SAMPLE texts have a cost; the commonest HOT are kept
SAMPLE, OFTEN, HOT = 64, 4, 1 << 19
# rounds in which each node is compared with one other, before all pairs left are
ROUNDS = 1
SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
# text of one step of indexing, whose arrays take some twenty times as much
INDEX_BYTES = 1 << 20
# words of the parities that are compared inside the join
SMALL = 4
# bits of the quick test for a shingle with a cost
COMMON_BITS = 22
# kinds of signatures
COLD, ANY, LAST = 0, 1, 2
NEVER = np.uint64(2 ** 64 - 1)


def chain(columns: list[np.ndarray], start: int) -> np.ndarray:
    """One hash of several columns of hashes, in their order."""
    out = np.full(len(columns[0]), start, np.uint64)
    for c in columns:
        out = (out ^ c) * MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted. A text with fewer words has its
    whole sequence as one shingle; without a word there is none."""
    parts = words_of(text.translate(LOWER)) if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    size = min(words, len(parts))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    n = len(parts) - size + 1
    return np.unique(chain([hashes[k:k + n] for k in range(size)], size))


def most_different(total: np.ndarray | int, similar: tuple[int, int]) -> np.ndarray | int:
    """In how many members two similar sets of `total` members in all may differ."""
    return total * (similar[1] - similar[0]) // (similar[0] + similar[1])


def segment_count(band: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Segments of the universe for the sets of 2 ** band members and more."""
    most = most_different(2 * ((2 << band) - 1), similar)
    return most + most // 3 + 2


class Costs:
    """How often common shingles were seen in the sample; zero for all others."""

    def __init__(self, token: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(token)
        self.token, self.count = token[order], count[order].astype(np.uint64)
        self.near = np.zeros(1 << COMMON_BITS, bool)
        self.near[(token & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint64)
        if len(self.token):
            maybe = np.flatnonzero(self.near[(tokens & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.token, tokens[maybe]), len(self.token) - 1)
            hit = self.token[at] == tokens[maybe]
            out[maybe[hit]] = self.count[at[hit]]
        return out


def rank_key(cost: np.ndarray, count: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where a subset stands among those of its set: cheap ones first, then large ones. It is
    made of the subset and its segment only, so equal subsets stand alike in both sets."""
    large = np.uint64(255) - np.minimum(count, 255).astype(np.uint64)
    return np.minimum(cost, np.uint64((1 << 24) - 1)) << np.uint64(40) | large << np.uint64(32) | mark


def nth_smallest(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value number n (from 0) of each owner in ascending order, NEVER where it has fewer."""
    order = np.lexsort((values, owner))
    sizes = np.bincount(owner, minlength=len(n))
    first = np.cumsum(sizes) - sizes
    out = np.full(len(n), NEVER)
    enough = n < sizes
    out[enough] = values[order][(first + n)[enough]]
    return out


def allocate(flat: np.ndarray, cost: np.ndarray, sizes: np.ndarray, band: np.ndarray, most: np.ndarray,
             similar: tuple[int, int]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """(owner, signature) of subsets and of subsets less one member, for sets of the given
    sizes that lie one after the other in `flat`, each among the segments of its band. Two
    sets that differ in at most the `most` of either one have a signature in common, of which
    one at least is of a whole subset.

    The cost of a subset is the sampled frequency of its rarest member, a bound of how many
    sets share it. A set with more than `most` subsets free of cost takes its most + 1 first
    ones in the order of `rank_key`: one of them is equal in the other set and stands in front
    of the other's limit too, or the other's own limit is lower, and the same holds the other
    way round. Every other set gives all its free subsets, which answers sets of the first
    kind. Among themselves the other sets have signatures of their own: a segment counts once
    for its subset, which covers no difference, and a second time for all subsets less one
    member, which cover one; each is taken at its place in the order, and most + 1 are taken.
    A set with too little for that is compared with all such sets; only sets of a few
    shingles that fell into one segment can be."""
    count = segment_count(band, similar)
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = base[owner] + ((flat >> np.uint64(17)) % count[owner].astype(np.uint64)).astype(np.int64)
    total = int(count.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, cell, flat)
    members = np.bincount(cell, minlength=total)
    least = np.full(total, NEVER)
    np.minimum.at(least, cell, cost)
    of = np.repeat(np.arange(len(sizes)), count)
    place = (np.arange(total) - base[of]).astype(np.uint64) | band[of].astype(np.uint64) << np.uint64(40)
    mark = chain([place], 7) >> np.uint64(32)
    key = rank_key(least, members, mark)

    free = np.flatnonzero((members > 0) & (least == 0))
    limit = nth_smallest(key[free], of[free], most)
    taken = free[key[free] <= limit[of[free]]]
    whole = [(of[taken], chain([sums[taken], place[taken]], COLD))]
    less: list[tuple[np.ndarray, np.ndarray]] = []
    needy = limit == NEVER
    if needy.any():
        filled = np.flatnonzero((members > 0) & needy[of])
        mine = np.flatnonzero(needy[owner])
        mine = mine[np.lexsort((cost[mine], cell[mine]))]
        at = cell[mine]
        is_first = np.r_[True, at[1:] != at[:-1]]
        second = np.full(total, NEVER)
        starts = np.flatnonzero(is_first)
        more = starts[members[at[starts]] > 1]
        second[at[more]] = cost[mine[more + 1]]
        several = filled[members[filled] > 1]
        covers = rank_key(second[several], members[several] - 1, mark[several])
        limit = nth_smallest(np.concatenate([key[filled], covers]), np.concatenate([of[filled], of[several]]), most)
        taken = filled[key[filled] <= limit[of[filled]]]
        whole.append((of[taken], chain([sums[taken], place[taken]], ANY)))
        inside = members[at] > 1
        mine, at, is_first = mine[inside], at[inside], is_first[inside]
        left = rank_key(np.where(is_first, second[at], least[at]), members[at] - 1, mark[at])
        near = left <= limit[of[at]]
        mine, at = mine[near], at[near]
        less.append((of[at], chain([sums[at] - flat[mine], place[at]], ANY)))
        last = np.flatnonzero(needy & (limit == NEVER))
        whole.append((last, chain([band[last].astype(np.uint64)], LAST)))
    return whole, less


def index(sets: list[np.ndarray], costs: Costs, similar: tuple[int, int]) -> tuple[list, list]:
    """For each set, the signatures of subsets and of subsets less one member, under the
    segments of its own band of sizes and under those of the next band it may reach."""
    sizes = np.array([len(s) for s in sets])
    reach = sizes * similar[1] // similar[0]
    band = np.frexp(np.maximum(sizes, 1))[1].astype(np.int64) - 1
    end = (2 << band) - 1
    out = [[[] for _ in sets], [[] for _ in sets]]
    for at, most in ((band, most_different(sizes + np.minimum(end, reach), similar)),
                     (band + 1, np.where(reach > end, most_different(sizes + reach, similar), 0))):
        # sets that may differ in nothing only have equal ones
        some = np.flatnonzero(most > 0)
        if not len(some):
            continue
        flat = np.concatenate([sets[i] for i in some])
        found = allocate(flat, costs.of(flat), sizes[some], at[some], most[some], similar)
        for mine, parts in zip(out, found, strict=True):
            for owner, signature in parts:
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(some) + 1))
                signature = signature[order]
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        mine[some[i]].append(signature[a:b])
    return out[0], out[1]


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """For each set, of how many members the low hash bits have each value, modulo 2. The bits
    in which two of them differ are no more than the members in which their sets differ."""
    bits = np.array([max(64, 2 << max(len(s), 1).bit_length() - 1) for s in sets], np.int64)
    base = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = base[owner] + (flat & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(bits.sum())) & 1, bitorder="little").tobytes()
    return [packed[a // 8:(a + n) // 8] for a, n in zip(base.tolist(), bits.tolist(), strict=True)]


def small_parities(sets: list[np.ndarray]) -> np.ndarray:
    """The same of 256 values for each set, as SMALL numbers of 64 bits."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    counts = np.bincount(owner * 64 * SMALL + (flat & np.uint64(64 * SMALL - 1)).astype(np.int64), minlength=64 * SMALL * len(sets))
    return np.packbits(counts & 1, bitorder="little").view("<i8").reshape(len(sets), SMALL)


def least_difference(a: bytes, b: bytes) -> int:
    x, y = (int.from_bytes(v, "little") for v in (a, b))
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = x >> n ^ x & (1 << n) - 1
    while m > n:
        m //= 2
        y = y >> m ^ y & (1 << m) - 1
    return (x ^ y).bit_count()


def is_similar(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * similar[1] >= (len(a) + len(b) - both) * similar[0]


def common_shingles(docs: DataFrame, words: int = WORDS, sample: int = SAMPLE, often: int = OFTEN, hot: int = HOT) -> Costs:
    """The shingles found in `often` or more of the distinct texts whose hash falls into one
    of `sample` parts; with more than `hot` of them, those above the least count that leaves
    so many. They only steer the order in which subsets are taken, never what is found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles(t, words) for t in raw(part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])
    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).distinct()
    seen = kept(texts.mapInArrow(run, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(
        F.col("n") >= often), "common")
    # one row for each count that occurs
    counts = sorted(((r["n"], r["k"]) for r in seen.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    total = np.cumsum([k for _, k in counts])
    least = [n for (n, _), t in zip(counts, total, strict=True) if t <= hot]
    found = seen.where(F.col("n") >= (least[-1] if least else 2 ** 62)).toArrow()
    return Costs(found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy())


def sign(docs: DataFrame, costs: Costs, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """All columns of `docs` but the text, and (key, node, size, parity, small, whole, less):
    hashes of the text and of its set, the size and parities of the set, and its signatures.
    Where a task meets a set again, the last four are null."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for part in slices(batches, "text", INDEX_BYTES):
            sets = [shingles(t, words) for t in raw(part.column("text"))]
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets]
            first = []
            for i, node in enumerate(nodes):
                if node not in known:
                    known.add(node)
                    first.append(i)
            new = [sets[i] for i in first]
            columns = [[None] * len(sets) for _ in range(4)]
            made = (parities(new), small_parities(new).view(np.uint64)[:, None], *(index(new, shared.value, similar) if new else ([], [])))
            for mine, values in zip(columns, made, strict=True):
                for i, v in zip(first, values, strict=True):
                    mine[i] = v
            parity, small, whole, less = columns
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in [*others, "key"]), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                 pa.array([len(s) for s in sets], pa.int32()), pa.array(parity, pa.binary()),
                 _lists(small), _lists(whole), _lists(less)],
                names=[*others, "key", "node", "size", "parity", "small", "whole", "less"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select(*others, F.xxhash64("text").alias("key"), "text").mapInArrow(
        run, f"{kinds}, key bigint, node bigint, size int, parity binary, small array<bigint>, whole array<bigint>, less array<bigint>")


def _lists(values: list) -> pa.Array:
    joined = [None if v is None else np.concatenate([np.zeros(0, np.uint64), *v]) for v in values]
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in joined)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *(v for v in joined if v is not None)]).view(np.int64)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(flat), mask=pa.array([v is None for v in joined], pa.bool_()))


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of signature, those whose signature several nodes have. Nearly all
    have one node, so groups are told apart by array; of an unfinished group only rows of
    one node wait for the next batch."""
    waiting: pa.RecordBatch | None = None
    open_signature, is_shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        signature, node = (batch.column(c).to_numpy() for c in ("signature", "node"))
        before = waiting.num_rows if waiting is not None else 0
        if before:
            signature = np.concatenate([waiting.column("signature").to_numpy(), signature])
            node = np.concatenate([waiting.column("node").to_numpy(), node])
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
        several = np.minimum.reduceat(node, starts) < np.maximum.reduceat(node, starts)
        if is_shared and signature[0] == open_signature:
            several[0] = True
        keep = np.repeat(several, np.diff(np.r_[starts, len(node)]))
        open_signature, is_shared = signature[-1], bool(several[-1])
        waiting = None if is_shared else batch.slice(int(starts[-1]))
        found = batch.filter(pa.array(keep))
        if found.num_rows:
            yield found


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(signature, node, less) of the signatures that several nodes have."""
    firsts = signed.where("whole is not null")
    one = firsts.select(F.explode("whole").alias("signature"), "node", F.lit(False).alias("less")).union(
        firsts.select(F.explode("less"), "node", F.lit(True)))
    return one.repartition("signature").sortWithinPartitions("signature").mapInArrow(
        shared_rows, "signature bigint, node bigint, less boolean").distinct()


def links(pairs: DataFrame, attributes: DataFrame, docs: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar. Sizes and parities go first; then the
    texts of what is left are picked by a bitmap, without a shuffle of the others, and whole
    sets decide."""
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*(batch.column(c).to_pylist() for c in ("m", "n", "x", "y")), strict=True)
            fits = [least_difference(x, y) <= most_different(m + n, similar) for m, n, x, y in sizes]
            yield batch.select(["a", "b", "s", "t"]).filter(pa.array(fits, pa.bool_()))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(128)(lambda text: shingles(text, words))
        for part in slices(batches, "x"):
            same = [is_similar(known(x), known(y), similar)
                    for x, y in zip(raw(part.column("x")), raw(part.column("y")), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    left = attributes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("parity").alias("x"), F.col("key").alias("s"))
    right = attributes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("parity").alias("y"), F.col("key").alias("t"))
    near = F.least("m", "n") * similar[1] >= F.greatest("m", "n") * similar[0]
    open_pairs = kept(pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "s", "t", "m", "n", "x", "y").mapInArrow(
        possible, "a bigint, b bigint, s bigint, t bigint"), "pairs")
    wanted = open_pairs.select(F.explode(F.array("s", "t")).alias("key")).distinct()
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    texts = sifted(keyed, "key", sieve(wanted, "key"), "maybe").where("maybe").select("key", "text").join(
        wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = kept(texts, "texts")
    both = open_pairs.join(texts.select(F.col("key").alias("s"), F.col("text").alias("x")), "s").join(
        texts.select(F.col("key").alias("t"), F.col("text").alias("y")), "t")
    return kept(both.select("a", "b", "x", "y").mapInArrow(decide, "a bigint, b bigint"), "links")


def hub_pairs(rooted: DataFrame) -> DataFrame:
    """At most one pair (a, b), a < b, a node, of rows (signature, node, less, root, weight)
    with several roots to a signature: each node with the weightiest node of another component
    that it shares signatures with, by the number of these."""
    group = Window.partitionBy("signature")
    mine = F.struct("weight", "node", "root")
    known = rooted.withColumn("top", F.max(mine).over(group)).withColumn(
        "second", F.max(F.when(F.col("root") != F.col("top.root"), mine)).over(group))
    met = known.withColumn("hub", F.when(F.col("root") != F.col("top.root"), F.col("top")).otherwise(F.col("second")))
    counted = met.groupBy("node", "hub.weight", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
    best = counted.groupBy("node").agg(F.max(F.struct("n", "weight", "hub")).alias("m"))
    return best.select(F.least("node", "m.hub").alias("a"), F.greatest("node", "m.hub").alias("b")).distinct()


def classes(docs: DataFrame, signed: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR,
            rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of every node with a link: the components of all similar pairs.

    In each of a few rounds a node is compared with one node of another component: of those
    it shares most signatures with, the one that shares most with all others, which in a
    family of copies is near its origin. That ties families together with about a pair for
    each member. Then all pairs that share a signature and are still in different components
    are compared, so every link counts, and none inside a component is looked for; the join
    that finds them tests small parities, so it gives out few pairs that cannot be similar."""
    group = Window.partitionBy("signature")
    shared = kept(shared_signatures(signed), "shared")
    attributes = kept(signed.where("whole is not null").select("node", "size", "parity", "small", "key").join(
        shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "attributes")
    sized = shared.withColumn("n", F.count("*").over(group))
    weights = sized.groupBy("node").agg(F.sum("n").alias("weight"))
    mixed = kept(sized.drop("n").join(weights, "node").withColumn("root", F.col("node")), "mixed")
    found = []
    for _ in range(rounds):
        if mixed.isEmpty():
            break
        found.append(links(kept(hub_pairs(mixed), "hubs"), attributes, docs, words, similar))
        root_of = mixed.select("node", "root").distinct()
        ties = found[-1].join(root_of.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(
            root_of.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        moved = components(ties, "x", "y").select(F.col("node").alias("root"), F.col("root").alias("_to"))
        now = mixed.join(moved, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")
        mixed = kept(now.withColumns({"_low": F.min("root").over(group), "_high": F.max("root").over(group)}).where(
            "_low < _high").drop("_low", "_high"), "mixed")
    words_of_small = [F.col("small")[i].alias(f"p{i}") for i in range(SMALL)]
    told = kept(mixed.join(attributes.select("node", "size", *words_of_small), "node"), "told")
    l, r = told.alias("l"), told.alias("r")
    differ = sum((F.bit_count(F.col(f"l.p{i}").bitwiseXOR(F.col(f"r.p{i}"))) for i in range(SMALL)), F.lit(0))
    total = F.col("l.size") + F.col("r.size")
    rest = l.join(r, (F.col("l.signature") == F.col("r.signature")) & (F.col("l.node") < F.col("r.node"))
                  & (F.col("l.root") != F.col("r.root")) & ~(F.col("l.less") & F.col("r.less"))
                  & (differ * (similar[0] + similar[1]) <= total * (similar[1] - similar[0]))).select(
        F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    found.append(links(rest, attributes, docs, words, similar))
    return components(reduce(DataFrame.union, found))


def near_groups(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, sample: int = SAMPLE,
                often: int = OFTEN, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable by links, a link being a Jaccard similarity
    of `similar` or more between sets of `words`-word shingles; no link is missed. Equal sets
    shrink to one node before anything is paired. Sets and shingles are told apart by 64-bit
    hashes. A null or wordless text has an empty set and its own id; repeated rows keep their
    number; a null doc_id counts only where a group has no other; other columns are ignored;
    an empty table gives no rows."""
    texts = docs.select("doc_id", "text")
    signed = kept(sign(texts, common_shingles(texts, words, sample, often, hot), words, similar), "signed")
    members = signed.where("size > 0").select("doc_id", "node", "size")
    nodes = members.groupBy("node").agg(F.min("doc_id").alias("least")).join(classes(texts, signed, words, similar), "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    nodes = kept(nodes, "nodes")
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = nodes.join(smallest, "root").select("node", "component_id")
    return members.join(labels, "node").select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), "component_id").union(
        signed.where("size = 0").select("doc_id", F.col("size").cast("bigint"), "doc_id"))


def keep_one(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of each group of `near_groups`, with all its columns: that with the smallest
    doc_id, a null id last, the first stored where ids repeat. Null and wordless texts are one
    group here. Rows are told apart by file and place. A bitmap of the rows that go passes
    nearly all others at once; the few it cannot tell are looked up, so texts do not move."""
    rows = located(docs)
    texts = rows.select("doc_id", "_file", "_at", "text")
    signed = kept(sign(texts, common_shingles(texts, words), words, similar), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_at")).alias("first")
    members = signed.select("doc_id", "_file", "_at", "node")
    found = classes(texts.select("text"), signed, words, similar)
    best = members.groupBy("node").agg(first).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = kept(best.groupBy("root").agg(F.min("first").alias("first")).select("first._file", "first._at"), "stays")
    goes = kept(members.select("_file", "_at").join(stays, ["_file", "_at"], "left_anti").withColumn("_row", F.xxhash64("_file", "_at")), "goes")
    told = sifted(rows.withColumn("_row", F.xxhash64("_file", "_at")), "_row", sieve(goes, "_row"), "_maybe")
    unsure = told.where("_maybe").join(goes.select("_file", "_at"), ["_file", "_at"], "left_anti")
    return told.where("not _maybe").select(docs.columns).union(unsure.select(docs.columns))
