"""Queries that apply the operators to whole tables, and their SQL twins where SQL can
express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, lmscore, negatives, packing, quality, resample, shards, simhash, tokencount, urls, warc
from .common import arrow_batches, folder, remainder
from .encoders import public

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"),
         ("org/es/", "block"))
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            arrow_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), folder(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HOST = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)


@query("op2_url_filter", f"""
with rest as (select page_id, coalesce({_HOST}, '') as rest from pages),
parts as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path
  from rest),
rules(rule, rule_host, rule_path, verdict) as (values {_RULES}),
fits as (
  select page_id, host, path, rule, verdict,
    row_number() over (partition by page_id order by length(rule) desc, length(rule_host) desc) as n
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and f.n = 1
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = urls.build_index(spark.createDataFrame(RULES, "rule string, verdict string"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), index)


@query("op3_line_crf")
def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, field).drop("content_lines")


# DuckDB has no CRC-32, so the tests compare this query with a plain loop
@query("op4_byte_shards")
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_cross_parsing")
def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.Model(langid.sample(docs.where(remainder("doc_id", 3) != 1)))
    return langid.identify(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_pattern_packing")
def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


@query("op9_backoff_scores")
def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_held_out(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each run, so that every run encodes all distinct texts
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public("piece_bpe_32k.model"), folder(spark, "counts"))


@query("op11_hard_negatives", """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same,
    cast(list_inner_product(a.v, r.v) as bigint) as score
  from sound a join sound r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
found as (
  select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as n
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score
from found where n <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


# on whole tables all pairs of sets are too many for SQL, so the tests compare with all pairs
@query("op12_jaccard_join")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


# DuckDB has no CRC-32, so the tests compare this query with a plain loop
@query("op13_target_resampling")
def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
