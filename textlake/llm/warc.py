"""WARC archives: writing captures, reading records, and assembling transactions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, located, sieve, sifted

BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# captures of one archive file
FILE_CAPTURES = 20_000
# fixed values of the record format
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HEX_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX_32, BASE_32)


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\r\n", F.lit("WARC/1.0"), *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_captures(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Archive every page as a request, a response or revisit, and a metadata record, as
    gzip files of whole records under `path`.

    Of pages with equal payloads of at least `min_revisit` bytes, the one with the
    largest page_id (of equal ids, the last stored) is the response and others revisit it;
    smaller payloads are all responses. A null html is an empty payload, a null url is
    left out, and line breaks in urls become spaces. Pages whose payload is surely their own,
    by a bitmap of the hashes seen twice, are written where they are read. Only the others
    meet in the join on the digest, which has one row per digest on its other side, and
    whose large partitions of copies are split by Spark."""
    keyed = located(pages).select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.concat_ws("#", "_file", F.lpad("_at", 19, "0")).alias("place"))
    keyed = keyed.withColumn("hash", F.xxhash64("html"))
    twice = keyed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    keyed = sifted(keyed, "hash", sieve(twice, "hash"), "maybe").withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    alone, maybe = (keyed.where(t).drop("hash", "maybe") for t in ("not maybe", "maybe"))
    top = maybe.groupBy("digest").agg(F.max(F.struct("page_id", "place")).alias("top"))
    own = _id(F.col("page_id"), F.col("place"), F.lit("response"))
    size = F.octet_length("html")
    columns = ["page_id", "url", "html", "place", "digest", "top"]
    told = alone.withColumn("top", F.struct("page_id", "place")).select(columns).union(maybe.join(top, "digest").select(columns)).withColumn(
        "revisit", (size >= min_revisit) & ~F.col("top").eqNullSafe(F.struct("page_id", "place")))
    uri = F.regexp_replace("url", "[\r\n]+", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit(BREAK))
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html")))
    target = F.regexp_extract(F.coalesce(uri, F.lit("")), "^[^:]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)),
                     F.lit(" HTTP/1.1\r\nHost: "),
                     F.regexp_extract(F.coalesce(uri, F.lit("")), "^[^:]*://([^/?#]*)", 1), F.lit(BREAK))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    length = lambda c: ("Content-Length", F.octet_length(c).cast("string"))
    common = (("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri))
    records = F.array(
        F.concat(_lines(
            ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _id(F.col("page_id"), F.col("place"), F.lit("request"))),
            ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request")),
            length(asked)), F.lit(BREAK), asked),
        F.concat(_lines(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", own), *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(F.col("revisit"), _id(F.col("top.page_id"), F.col("top.place"), F.lit("response")))),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")), length(block)), F.lit(BREAK), block),
        F.concat(_lines(
            ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _id(F.col("page_id"), F.col("place"), F.lit("metadata"))),
            ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields")),
            length(fields)), F.lit(BREAK), fields))
    (told.select(F.explode(records).alias("value")).write
     .option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", 3 * FILE_CAPTURES).text(path))


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, from what stands between double line breaks.
    A block ends where its length says, whatever breaks it holds."""
    gap = BREAK.encode()
    for chunk in chunks:
        head = chunk.lstrip(b"\r\n")
        while head:
            if not head.startswith(b"WARC/"):
                raise ValueError(f"not a record: {head[:60]!r}")
            pairs = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
            header = {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}
            size = int(header["content-length"])
            parts, have = [], -len(gap)
            while have < size:
                part = next(chunks, None)
                if part is None:
                    raise ValueError("a record is cut off")
                parts.append(part)
                have += len(gap) + len(part)
            block = gap.join(parts)
            yield header, block[:size]
            head = block[size:].lstrip(b"\r\n")


KINDS = ("request", "response", "revisit", "metadata")
RECORD = ("record_id string, kind string, target_uri string, date string, concurrent_to string, refers_to string, "
          "payload_digest string, found_digest string, payload_bytes bigint, block binary")


def read_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The request, response, revisit and metadata records of all archives under `path`.

    payload_digest is what the header says, found_digest (null for other kinds than
    response) what the payload has; payload_bytes is the length of the stored payload.
    Blocks of metadata are always returned, others with `blocks`. Archives stream
    through their task record by record, so their size is no matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (c for b in batches for c in b.column("value").to_pylist())
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
            names = [c.split()[0] for c in RECORD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for header, block in parse(chunks):
            kind = header["warc-type"]
            if kind not in KINDS:
                continue
            payload = block.partition(BREAK.encode())[2] if kind == "response" else b""
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
            digest = header.get("warc-payload-digest")
            keep = block if blocks or kind == "metadata" else None
            rows.append((header.get("warc-record-id"), kind, header.get("warc-target-uri"), header.get("warc-date"),
                         header.get("warc-concurrent-to"), header.get("warc-refers-to"),
                         digest.partition(":")[2] if digest else None, found,
                         len(payload) if kind == "response" else None, keep))
            size += len(keep or b"") + 500
            if size > 8 << 20:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    lines = spark.read.option("lineSep", BREAK).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests, metadata).

    A capture is a response or revisit record. Requests and metadata belong to it when
    they name it as concurrent, when it names them, or when they name a record that so
    belongs; all joins are on record ids. A record that names nothing known belongs to
    no capture and is left out; records with a null id are ignored; an id that repeats
    counts once; a capture without request or metadata has empty arrays; the records of
    one capture are ordered by id; an empty table gives no rows."""
    once = records.where("record_id is not null").dropDuplicates(["record_id"])
    nested = F.struct(*[c for c in records.columns if c != "kind"], "kind")
    mains = once.where(F.col("kind").isin("response", "revisit"))
    others = once.where(F.col("kind").isin("request", "metadata")).select(
        "record_id", "concurrent_to", "kind", nested.alias("record"))
    known = mains.select(F.col("record_id").alias("alias"), F.col("record_id").alias("capture_id")).union(
        mains.where("concurrent_to is not null").select("concurrent_to", "record_id"))
    ties = others.select("record_id", F.explode(F.array_distinct(F.array("concurrent_to", "record_id"))).alias("alias"))
    near = ties.join(known, "alias").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    # one step further: metadata that names a request
    far = (others.select("record_id", "concurrent_to").join(near.select("record_id"), "record_id", "left_anti")
           .join(near.select(F.col("record_id").alias("concurrent_to"), "capture_id"), "concurrent_to")
           .select("record_id", "capture_id"))
    attached = others.join(near.union(far), "record_id").groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "request", F.col("record")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "metadata", F.col("record")))).alias("metadata"))
    empty = F.array().cast(attached.schema["requests"].dataType)
    return mains.select(F.col("record_id").alias("capture_id"), nested.alias("response")).join(
        attached, "capture_id", "left").select(
        "capture_id", "response", F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadata", empty).alias("metadata"))


def archive_and_read(pages: DataFrame, path: str, min_revisit: int = 0) -> DataFrame:
    """Write `pages` to archives, read them back, and give for each capture its page_id,
    the bytes and digest of its full payload, its kind, and the page a revisit refers to."""
    write_captures(pages, path, min_revisit)
    records = kept(read_records(pages.sparkSession, path, blocks=False), "records")
    captures = assemble(records)
    number = F.regexp_extract(F.get("metadata", F.lit(0))["block"].cast("string"), r"page-id: (-?\d+)", 1)
    flat = kept(captures.select(
        "capture_id", F.nullif(number, F.lit("")).cast("bigint").alias("page_id"), F.col("response.kind").alias("record_type"),
        F.coalesce("response.found_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.payload_bytes").alias("own_bytes"), F.col("response.refers_to").alias("to"),
        F.col("response.target_uri").alias("url"), F.size("requests").alias("n_requests")), "captures")
    full = flat.where("record_type = 'response'").select(
        F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("full_bytes"))
    return flat.join(full, "to", "left").select(
        "page_id", F.coalesce("own_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to", "url", "n_requests")
