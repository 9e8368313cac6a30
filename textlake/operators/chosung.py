"""Chosung search through a stored table of character grams.

A text has two forms: its initial consonants with all else left alone ("c"), and the same
in lower case without spaces ("flat"). The table holds the forms, each under a number, and
for each form, which of its numbers hold a character, a pair or a run of three: a row for
each gram and block of numbers, so that an occurrence takes two bytes. A keyword meets the
numbers that hold all its runs, and their forms confirm it, so the work is that of the
candidates, and no text is read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hangul import to_chosung
from ..functions.text import let, strip, windows_of
from ..session import materialize
from .postings import living, of_buckets, term_bucket

GRAM = 3
# a longer keyword is found by all its windows of this length
LONGEST = 20
FORMS = ("c", "flat")
MODES = ("wildcard", "ngram", "hybrid")
GRAM_SCHEMA = "field string, term string, block long, docs array<smallint>"
# so many bits of a text's number tell it apart in its block
BLOCK_BITS = 11
# letters whose grams are sorted at once
SLICE_LETTERS = 2_000_000


@dataclass
class Grams:
    """What is stored: the forms of living documents, and the numbers that hold a gram."""

    texts: DataFrame
    postings: DataFrame


def _flat(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def _grams(texts: list[str], n: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Distinct grams of texts, where each one's texts begin, and the texts' places in order of
    gram. Comes in parts where a number cannot tell all grams and texts apart."""
    sizes = np.array([len(t) for t in texts])
    joined = "".join(texts)
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if len(letters) < n:
        return
    alphabet = np.flatnonzero(np.bincount(letters))
    if len(alphabet) ** n * len(texts) >= 2 ** 62 and len(texts) > 1:
        half = len(texts) // 2
        yield from _grams(texts[:half], n)
        for terms, ends, places in _grams(texts[half:], n):
            yield terms, ends, places + half
        return
    rank = np.zeros(alphabet[-1] + 1, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    letters = rank[letters]
    code = np.zeros(len(letters) - n + 1, np.int64)
    for k in range(n):
        code = code * len(alphabet) + letters[k:len(letters) - n + 1 + k]
    owner = np.repeat(np.arange(len(texts)), sizes)
    # a gram lies in one text
    inside = owner[:len(code)] == owner[n - 1:]
    held = np.unique(code[inside] * len(texts) + owner[:len(code)][inside])
    if not len(held):
        return
    found, places = np.divmod(held, len(texts))
    first = np.flatnonzero(np.r_[True, np.diff(found) > 0])
    spelled = found[first]
    signs = [chr(a) for a in alphabet.tolist()]
    columns = []
    for _ in range(n):
        spelled, last = np.divmod(spelled, len(alphabet))
        columns.append(last.tolist())
    yield ["".join(signs[i] for i in word) for word in zip(*reversed(columns), strict=True)], np.r_[first, len(found)], places


def grams(texts: DataFrame) -> DataFrame:
    """(field, term, block, docs) of numbered forms (no, c): which texts of a block hold a gram,
    found where the forms are read. field is the form and the gram's length. Rows of a block
    that is read in parts name different texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no = batch.column("no").to_numpy()
            size = np.maximum.reduce([pc.utf8_length(batch.column(form)).to_numpy(zero_copy_only=False) for form in FORMS])
            # a slice ends with its block, or where it has enough letters
            part = np.cumsum(size) // SLICE_LETTERS
            cuts = np.flatnonzero(np.r_[True, (np.diff(no >> BLOCK_BITS) != 0) | (np.diff(part) != 0)]) if len(no) else []
            for start, end in zip(cuts, [*cuts[1:], len(no)], strict=True):
                inner = (no[start:end] & (1 << BLOCK_BITS) - 1).astype(np.int16)
                for form in FORMS:
                    values = batch.column(form).slice(start, end - start).to_pylist()
                    for n in range(1, GRAM + 1):
                        for terms, ends, places in _grams(values, n):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([f"{form}{n}"] * len(terms)), pa.array(terms), pa.array(np.full(len(terms), no[start] >> BLOCK_BITS)),
                                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(inner[places]))],
                                names=["field", "term", "block", "docs"])

    return texts.select("no", "c", _flat(F.col("c")).alias("flat")).mapInArrow(run, GRAM_SCHEMA)


def write_grams(docs: DataFrame, path: str, segment: int = 1, buckets: int = 256, text: str = "all_text") -> None:
    """Store the forms and grams of documents as a segment of the table at `path`, the grams in
    folders and in order inside. Documents deleted later are listed beside them, as for a
    word index."""
    if segment == 1:
        docs.select("doc_id").limit(0).write.mode("errorifexists").parquet(f"{path}/deleted/segment=0")
        docs.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("errorifexists").parquet(f"{path}/settings")
    else:
        buckets = docs.sparkSession.read.parquet(f"{path}/settings").first()["buckets"]
    place = f"{path}/texts/segment={segment}"
    docs.select("doc_id", F.monotonically_increasing_id().alias("no"), to_chosung(text).alias("c")).write.mode(
        "errorifexists").option("compression", "zstd").parquet(place)
    found = grams(docs.sparkSession.read.parquet(place)).withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    found.hint("rebalance", F.col("term_bucket")).sortWithinPartitions("term_bucket", "field", "term", "block").write.mode(
        "errorifexists").option("compression", "zstd").partitionBy("term_bucket").parquet(f"{path}/postings/segment={segment}")


def read_grams(spark: SparkSession, path: str) -> Grams:
    return Grams(living(spark, path, "texts"), spark.read.parquet(f"{path}/postings"))


def _pieces(patterns: DataFrame) -> DataFrame:
    """(pid, field, term, offset, n_terms): runs of a pattern that together cover it. One of up
    to three characters is its own run."""
    length = F.length("pattern")
    offsets = F.when(length <= GRAM, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(
        F.sequence(F.lit(0), length - GRAM, F.lit(GRAM)), F.array(length - GRAM))))
    size = F.least(length, F.lit(GRAM))
    return patterns.withColumn("n_terms", F.size(offsets)).select(
        "pid", F.concat("form", size.cast("string")).alias("field"), "n_terms", "pattern", F.explode(offsets).alias("offset")).select(
        "pid", "field", F.col("pattern").substr(F.col("offset") + 1, F.lit(GRAM)).alias("term"), "offset", "n_terms")


def containing(table: Grams, patterns: DataFrame, buckets: int) -> DataFrame:
    """(pid, doc_id) of the texts that hold a pattern (pid, form, pattern)."""
    pieces = materialize(_pieces(patterns).select("pid", "field", "term").distinct(), "pieces")
    words = pieces.select("field", "term").distinct().withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    found = of_buckets(table.postings, words, ["term_bucket", "field", "term"]).select("segment", "field", "term", "block", "docs")
    wanted = pieces.join(pieces.groupBy("pid").agg(F.count("*").alias("n_terms")), "pid")
    blocks = wanted.join(found, ["field", "term"]).groupBy("pid", "n_terms", "segment", "block").agg(
        F.collect_list(F.struct("term", "docs")).alias("rows")).withColumn("terms", F.array_distinct("rows.term")).filter(
        F.size("terms") == F.col("n_terms"))
    sets = F.transform("terms", lambda t: F.flatten(F.transform(F.filter("rows", lambda r: r["term"] == t), lambda r: r["docs"])))
    common = let(sets, lambda s: F.reduce(F.slice(s, 2, F.size(s)), F.get(s, F.lit(0)), lambda acc, x: F.array_intersect(acc, x)))
    candidates = blocks.select("pid", "segment", F.col("block").alias("_block"), F.explode(common).alias("_doc")).select(
        "pid", "segment", (F.shiftleft("_block", BLOCK_BITS) + F.col("_doc")).alias("no"))
    # a text's patterns meet it together, so that its flat form is made once
    asked = candidates.join(patterns.select("pid", "form", "pattern"), "pid").groupBy("segment", "no").agg(
        F.collect_list(F.struct("pid", "form", "pattern")).alias("asked"))
    met = table.texts.select("segment", "no", "doc_id", "c").join(asked, ["segment", "no"])
    confirmed = let(_flat(F.col("c")), lambda flat: F.filter(
        "asked", lambda a: F.when(a["form"] == "c", F.col("c")).otherwise(flat).contains(a["pattern"])))
    return met.select("doc_id", F.explode(F.transform(confirmed, lambda a: a["pid"])).alias("pid")).select("pid", "doc_id")


def match_stored_chosung(keywords: DataFrame, path: str, mode: str = "wildcard", boost: float = 10.0) -> DataFrame:
    """(qid, kid, doc_id, score) as `match_chosung` gives it, from the gram table at `path`."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    spark = keywords.sparkSession
    raw = strip("keyword")
    wanted = keywords.select("qid", "kid", raw.alias("raw"), F.lower(F.replace(raw, F.lit(" "), F.lit(""))).alias("flat")).filter(
        F.col("flat") != "")
    # equal keywords of many requests are looked up once
    windows = F.when(F.length("flat") <= LONGEST, F.array("flat")).otherwise(F.array_distinct(windows_of(F.col("flat"), LONGEST)))
    clauses = []
    if mode != "ngram":
        clauses.append(wanted.filter(~F.col("raw").contains(" ")).select("qid", "kid", F.lit("c").alias("form"), F.array("raw").alias("parts")))
    if mode != "wildcard":
        clauses.append(wanted.filter(F.length("flat") >= 2).select("qid", "kid", F.lit("flat").alias("form"), windows.alias("parts")))
    asked = clauses[0] if len(clauses) == 1 else clauses[0].unionByName(clauses[1])
    parts = materialize(asked.select("qid", "kid", "form", F.size("parts").alias("n"), F.explode("parts").alias("pattern")).withColumn(
        "pid", F.concat_ws("/", "form", "pattern")), "patterns")
    buckets = spark.read.parquet(f"{path}/settings").first()["buckets"]
    hits = containing(read_grams(spark, path), parts.select("pid", "form", "pattern").distinct(), buckets)
    # a clause of one part and one of several are counted in one pass
    found = parts.join(hits, "pid").groupBy("qid", "kid", "doc_id").agg(*[
        F.count_if(F.col("form") == form).alias(form) for form in FORMS], *[
        F.max(F.when(F.col("form") == form, F.col("n"))).alias(f"{form}_n") for form in FORMS])
    points = sum((F.coalesce(F.col(form) == F.col(f"{form}_n"), F.lit(False)).cast("int") for form in FORMS), F.lit(0))
    return found.filter(points > 0).select("qid", "kid", "doc_id", (points * F.lit(float(boost))).alias("score"))
