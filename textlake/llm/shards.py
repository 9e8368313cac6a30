"""Contiguous shards of nearly equal bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

# rows of one range, which is what a task sums up
RANGE_ROWS = 500_000


def assign_shards(docs: DataFrame, shards: int, order: str = "doc_id", text: str = "text",
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row, in ascending id order.

    size is the UTF-8 length of the text (null: 0) plus 1. Rows are cut into id ranges,
    one total per range gives the bytes before it, and a row goes to the shard that its
    middle byte falls into when all bytes are cut at equal targets; so no shard is off
    by more than one row. Texts themselves never move. Rows with equal ids are ordered
    by checksum, size and place, null ids come first, so any number of copies or null
    ids can be cut; other columns are ignored; an empty table gives no rows."""
    small = kept(docs.select(
        F.col(order).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place")), "sizes")
    by = ["doc_id", "text_crc32", "size", "place"]
    ranges = max(1, -(-small.count() // range_rows))
    ranged = kept(
        small.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()),
        "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    whole = totals.agg(F.coalesce(F.sum("bytes"), F.lit(1))).first()[0]
    inside = Window.partitionBy("part").orderBy(*by)
    placed = kept(
        ranged.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets) if ranges <= 100_000 else offsets, "part")
        .withColumn("middle", F.col("bytes_before") + F.col("end") - F.expr("size div 2") - 1)
        .withColumn("shard", F.expr(
            f"cast(least(cast(middle as decimal(38,0)) * {shards} div {whole}, {shards - 1}) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth")).alias("position")),
        "placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write all columns of `docs`, one folder per shard, rows in slot order in each
    file. doc_id must be unique here; a large shard takes several tasks."""
    placed = assign_shards(docs, shards, **options).select("doc_id", "shard", "slot")
    (docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
