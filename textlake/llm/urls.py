"""Url filters on a sorted array of digests that tasks memory-map."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

# rules of one index file; more rules take more files
BLOCK_RULES = 2_000_000
VERDICTS = ("allow", "block")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """What stands after the first `://`: up to `/`, `?`, `#` or the end, A-Z in lower
    case; and from there up to `?`, `#` or the end. Else two empty strings."""
    col = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(col, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


class Index:
    """Sorted 64-bit keys, and beside them the full rules and verdicts. Laid out as one
    file: the numbers of rules and of path lengths, path lengths, keys, where each rule
    starts, verdicts, rules."""

    def __init__(self, path: str) -> None:
        n, m = np.fromfile(path, "<u8", 2).tolist()
        at = 16
        self.path_lengths = np.fromfile(path, "<u8", m, offset=at).tolist()
        at += 8 * m

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            begin, at = at, at + count * np.dtype(kind).itemsize
            return np.memmap(path, kind, "r", begin, (count,)) if count else np.zeros(0, kind)

        self.keys = part("<u8", n)
        self.starts = part("<u8", n + 1)
        self.verdicts = part("u1", n)
        self.rules = part("u1", int(self.starts[-1]))

    @staticmethod
    def pack(rules: list[tuple[bytes, str]]) -> bytes:
        keys = np.array([xxhash.xxh64_intdigest(r) for r, _ in rules], "<u8")
        order = np.argsort(keys, kind="stable").tolist()
        texts = [rules[i][0] for i in order]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        lengths = sorted({len(r) - (r.find(b"/") if b"/" in r else len(r)) for r in texts})
        return b"".join([
            np.array([len(texts), len(lengths)], "<u8").tobytes(), np.array(lengths, "<u8").tobytes(),
            keys[order].tobytes(), starts.astype("<u8").tobytes(),
            bytes(VERDICTS.index(rules[i][1]) for i in order), *texts])

    def find(self, wanted: list[bytes]) -> list[tuple[int, int]]:
        """(place in `wanted`, place of the equal rule): binary search for all keys at
        once, then full strings are compared wherever a key is met."""
        keys = np.array([xxhash.xxh64_intdigest(w) for w in wanted], np.uint64)
        at = np.searchsorted(self.keys, keys)
        near = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else []
        found = []
        for i in near:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if bytes(self.rules[int(self.starts[k]):int(self.starts[k + 1])]) == wanted[i]:
                    found.append((int(i), k))
                k += 1
        return found


def build_index(rules: DataFrame) -> list[str]:
    """Write the rules (rule, verdict) as index files to the shared folder, and have Spark
    hand these to the executors. A rule given with both verdicts blocks; null rules and
    other verdicts are left out. Rules stream through the driver in blocks of bounded
    number."""
    spark = rules.sparkSession
    clean = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin(*VERDICTS)).groupBy("rule").agg(
        F.max("verdict").alias("verdict"))
    stream = ((r["rule"].encode(), r["verdict"]) for r in clean.toLocalIterator())
    named = shared_dir(spark)
    fs, root = pyarrow.fs.FileSystem.from_uri(named if "://" in named else f"file://{named}")
    fs.create_dir(root, recursive=True)
    names = []
    while block := list(islice(stream, BLOCK_RULES)):
        name = f"rules-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(Index.pack(block))
        spark.sparkContext.addFile(f"{named.rstrip('/')}/{name}")
        names.append(name)
    return names


def judge_urls(pages: DataFrame, index: list[str], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`.

    A rule `host/path` fits its host and every subdomain when the url's path starts with
    the rule's. Of fitting rules the longest wins, of equally long ones that with the
    longer host; none gives a null rule and the default. A null url, or one without
    `://`, has empty host and path and fits no rule; repeated rows and null ids are
    judged like any other; other columns are ignored; empty tables give no rows."""
    host, path = host_and_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Index(SparkFiles.get(name)) for name in index]
        for batch in batches:
            hosts = batch.column("host").cast(pa.binary()).to_pylist()
            paths = batch.column("path").cast(pa.binary()).to_pylist()
            best: list[tuple[int, int, bytes, str] | None] = [None] * len(hosts)
            for block in blocks:
                wanted, owner, wide = [], [], []
                for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                    while h:
                        for n in block.path_lengths:
                            if n <= len(p):
                                wanted.append(h + p[:n])
                                owner.append(i)
                                wide.append(len(h))
                        h = h.partition(b".")[2]
                for place, k in block.find(wanted):
                    rule = wanted[place]
                    # a host holds no slash, so the parts of a rule cannot be confused
                    got = (len(rule), wide[place], rule, VERDICTS[block.verdicts[k]])
                    i = owner[place]
                    if best[i] is None or got[:2] > best[i][:2]:
                        best[i] = got
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array([b[2].decode() if b else None for b in best], pa.string()),
                 pa.array([b[3] if b else default for b in best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string")
