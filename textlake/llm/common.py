"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# A-Z to a-z on single bytes; other bytes, those of UTF-8 sequences too, stay
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE_BYTES = 4 << 20
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20
# of the bitmaps sent to all tasks: half a million words
SIEVE_BITS = 1 << 25


def arrow_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds, by rows and bytes, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in runs of about `limit` bytes of column `name`. A
    longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def filtered(docs: DataFrame, test: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows of `docs` that pass, with all columns. `test` is called once in each task and
    gives a function from rows to booleans; every row is decided by itself, whatever its
    id, and nothing is joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for part in slices(batches, "text"):
            yield part.filter(pa.array(passes(part), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space, tab, line feed, vertical tab, form feed
    and carriage return."""
    return text.split() if text else []


def remainder(doc_id: Column | str, n: int) -> Column:
    """CRC-32 of the id written as text, modulo n. A null id counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bits(key: str, bits: int) -> tuple[Column, Column]:
    """The word and the bit of a key in a bitmap of `bits` bits, a power of two."""
    at = F.col(key).bitwiseAND(F.lit(bits - 1).cast("long"))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def sieve(keys: DataFrame, key: str, bits: int = SIEVE_BITS) -> DataFrame:
    """(word, mask): a bitmap of the low bits of all `keys`, of bits / 64 rows at most
    whatever their number."""
    word, bit = _bits(key, bits)
    return kept(keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask")), "sieve")


def sifted(rows: DataFrame, key: str, bitmap: DataFrame, name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """`rows` with a boolean `name`, false only where the key is surely not in the bitmap. The
    bitmap is broadcast, so nothing is shuffled."""
    word, bit = _bits(key, bits)
    held = F.broadcast(bitmap.withColumnsRenamed({"word": "_word", "mask": "_mask"}))
    found = rows.join(held, word == F.col("_word"), "left")
    return found.withColumn(name, F.coalesce(F.col("_mask").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_mask")


def located(docs: DataFrame) -> DataFrame:
    """`docs` with the file and the place in it of each row. Anything but a plain read of files
    is stored first, so that each row has a place of its own."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = kept(docs, "rows")
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
