"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, slices
from .encoders import ByteLevel, Pieces, load

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens bigint"


def content_digest(text: str = "text") -> Column:
    """SHA-256 of the content that is counted: a null text is the empty one. Nothing
    else is made equal, since any other change of a text may change its tokens."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and the name of the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + (b"tokenizers" if path.endswith(".json") else b"sentencepiece")).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """All stored counts. Where nothing was stored yet, an empty cache is laid down."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            plain = pc.fill_null(part.column("text"), "").to_pylist()
            if path.endswith(".json"):
                counts = load(ByteLevel, path).ids(plain)[1]
            else:
                counts = load(Pieces, path).counts(plain)
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts)], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest string, n_tokens bigint")


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs`.

    Contents are joined to the cache by content and tokenizer digest. Of each content it
    lacks one row is encoded, and the counts are appended to the cache: as the last
    step of one write job, so a failed run leaves nothing half done, and a content that
    two runs append at once is read once. Rows are told apart by place, so ids may be
    null or repeat; a null text is an empty one; other columns are ignored; an empty
    table gives no rows and appends none."""
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    keys = kept(rows.select(
        "doc_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        content_digest().alias("digest")), "digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = keys.groupBy("digest").agg(F.min("row").alias("row")).join(stored, "digest", "left_anti")
    # by the row, which no two share: copies spread over all tasks and end at the join
    texts = rows.select("row", "text").join(missing, "row")
    encode_counts(texts, path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
