"""Autocomplete from stored tables: from what may have been typed to the best titles.

What can be typed is a run of words of a title, the last one possibly only begun. For a
single word, a table holds a row for each of its beginnings, and for each (times it occurs in
a title, words of the title) with the first titles in order of name. For more words, another
holds every title once from each of its words on: what was typed is the beginning of such a
row, found by its first word. An input's score depends on these two numbers and on
frequencies of its words, so its best titles are found by look-ups, whatever the frequencies
have become, and tables of several runs are merged by name alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hangul import is_chosung_query, restore_jamo
from ..functions.text import sanitize
from ..session import materialize
from .chosung import match_stored_chosung
from .postings import (
    DEFAULT_ANALYZER,
    TITLE,
    Analyzer,
    Index,
    build_postings,
    field_stats,
    idf,
    match_keywords,
    prefix_postings,
    prefix_terms,
    term_bucket,
    tf_norm,
)
from .search import match_chosung

TITLE_COLUMN = {"title": "title"}
# between two words of a key, with the distance of their places
STEP = "\x01"


def _titles(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(no, title, dl, w, times) of different titles: their words, and how many times what is
    found in them counts, which is more than once where documents share an id."""
    words = build_postings(docs, TITLE_COLUMN, analyzer).groupBy("doc_id", "dl").agg(
        F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("w"))
    titled = docs.select("doc_id", "title").filter(F.coalesce("title", F.lit("")) != "")
    each = words.join(titled, "doc_id").groupBy("doc_id", "dl", "title").agg(F.first("w").alias("w"), F.count("*").alias("times"))
    return each.select("title", "dl", "w", "times").distinct().withColumn("no", F.monotonically_increasing_id())


def _begun(titles: DataFrame) -> DataFrame:
    """(key, tf, dl, title): every beginning of every word of every title."""
    beginnings = F.flatten(F.transform("w", lambda e: F.transform(
        F.sequence(F.lit(1), F.length(e["term"])), lambda n: F.concat(F.lit(f"0{STEP}"), e["term"].substr(F.lit(1), n)))))
    # the rows of a title are counted where they are made
    return titles.repartition("no").select("no", "title", "dl", "times", F.explode(beginnings).alias("key")).groupBy(
        "no", "key", "title", "dl").agg(F.sum("times").cast("int").alias("tf")).select("key", "tf", "dl", "title")


def _runs(titles: DataFrame) -> DataFrame:
    """(first, key, no, title, dl, times): every title from each of its words but the last on,
    words with their distances from the first."""
    def from_start(i: Column) -> Column:
        rest = F.slice("w", i + 1, F.size("w"))
        said = F.transform(rest, lambda x: F.concat((x["pos"] - rest[0]["pos"]).cast("string"), F.lit(STEP), x["term"]))
        return F.struct(rest[0]["term"].alias("first"), F.array_join(said, STEP).alias("key"))

    starts = F.sequence(F.lit(0), F.size("w") - 2)
    return titles.filter(F.size("w") > 1).select(F.explode(F.transform(starts, from_start)).alias("r"), "no", "title", "dl", "times").select(
        "r.first", "r.key", "no", "title", "dl", "times")


def _write(rows: DataFrame, place: str, name: str, buckets: int) -> None:
    rows.withColumn("term_bucket", term_bucket(F.col(name), buckets)).hint("rebalance", F.col("term_bucket")).sortWithinPartitions(
        "term_bucket", name).write.mode("errorifexists").option("compression", "zstd").partitionBy("term_bucket").parquet(place)


def write_suggestions(docs: DataFrame, path: str, segment: int = 1, k: int = 20, buckets: int = 64,
                      analyzer: Analyzer = DEFAULT_ANALYZER) -> None:
    """Store what `suggest` needs of documents (doc_id, title), as a segment of the tables at
    `path`: `k` titles at most for each begun word and score. Segments must not share documents."""
    titles = materialize(_titles(docs, analyzer), "titles")
    first = Window.partitionBy("key", "tf", "dl").orderBy("title")
    # equal titles have one rank, so the first are told before anything is shuffled
    best = _begun(titles).withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k).drop("n").distinct()
    _write(best, f"{path}/titles/segment={segment}", "key", buckets)
    _write(_runs(titles), f"{path}/runs/segment={segment}", "first", buckets)
    words = build_postings(docs, TITLE_COLUMN, analyzer).select("term", "doc_id", "dl").repartition("doc_id").distinct()
    begun = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.concat(F.lit("^"), F.col("term").substr(F.lit(1), n)))
    found = words.select(F.explode(F.concat(F.array(F.concat(F.lit("="), F.col("term"))), begun)).alias("term"), "doc_id").distinct()
    _write(found.groupBy("term").agg(F.count("*").alias("df")), f"{path}/words/segment={segment}", "term", buckets)
    words.select("doc_id", "dl").distinct().agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.lit(k).alias("k"), F.lit(buckets).alias("buckets")).write.mode(
        "errorifexists").parquet(f"{path}/stats/segment={segment}")


def suggest(prefixes: DataFrame, path: str, docs: DataFrame, grams: str | None = None, k: int = 5, chosung_mode: str = "wildcard",
            analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """(qid, title, rank) as `autocomplete` gives it, for typed prefixes (qid, prefix), from
    the table at `path`; chosung inputs, if there are any, from the gram table `grams`, or by a
    scan of the texts without one. Nothing is tokenised but
    the inputs, and of `docs` only titles of chosung hits are read. A stop word between the
    words of an input stands for any word; such inputs, if there are any, match the titles."""
    spark = prefixes.sparkSession
    stats = spark.read.parquet(f"{path}/stats").agg(
        F.sum("n_docs").alias("n"), F.sum("words").alias("words"), F.min("k").alias("k"), F.min("buckets").alias("buckets")).first()
    if k > stats["k"]:
        raise ValueError(f"the table holds {stats['k']} titles a key, {k} are asked for")
    typed = prefixes.select("qid", restore_jamo(sanitize("prefix")).alias("keyword")).filter(
        F.col("keyword") != "").withColumn("kid", F.lit("p")).withColumn("_c", is_chosung_query("keyword"))
    words = prefix_terms(typed.filter(~F.col("_c")).drop("_c"), analyzer).withColumn("term_bucket", term_bucket(F.col("term"), stats["buckets"]))
    df = spark.read.parquet(f"{path}/words").join(words.select("term_bucket", "term").distinct(), ["term_bucket", "term"], "left_semi").groupBy(
        "term").agg(F.sum("df").alias("df"))
    weight = idf(F.lit(float(stats["n"] or 0)), F.col("df"))
    asked = words.join(df, "term").groupBy("qid").agg(
        F.count("*").alias("found"), F.max("n_terms").alias("n_terms"), F.sum(weight).alias("idf_sum"),
        F.array_sort(F.collect_list(F.struct("qpos", "term"))).alias("w")).filter(F.col("found") == F.col("n_terms"))
    # qpos runs on over stop words
    whole = F.col("w")[F.size("w") - 1]["qpos"] - F.col("w")[0]["qpos"] == F.size("w") - 1
    open_words = asked.filter(~whole).select("qid")
    asked = asked.filter(whole)
    part = F.transform("w", lambda e: F.concat((e["qpos"] - F.col("w")[0]["qpos"]).cast("string"), F.lit(STEP), F.substring(e["term"], 2, 2 ** 30)))
    asked = asked.select("qid", "idf_sum", F.array_join(part, STEP).alias("key"), F.size("w").alias("n"),
                         F.substring(F.col("w")[0]["term"], 2, 2 ** 30).alias("first"))
    avgdl = F.lit((stats["words"] or 0) / max(1, stats["n"] or 0))
    single = asked.filter(F.col("n") == 1).select("qid", "idf_sum", "key").withColumn("term_bucket", term_bucket(F.col("key"), stats["buckets"]))
    several = asked.filter(F.col("n") > 1).select("qid", "idf_sum", F.col("key").alias("typed"), "first").withColumn(
        "term_bucket", term_bucket(F.col("first"), stats["buckets"]))
    begun = spark.read.parquet(f"{path}/titles").join(single, ["term_bucket", "key"]).select("qid", "idf_sum", "title", "tf", "dl")
    runs = spark.read.parquet(f"{path}/runs").join(several, ["term_bucket", "first"]).filter(F.col("key").startswith(F.col("typed"))).groupBy(
        "qid", "segment", "no", "title", "dl").agg(F.max("idf_sum").alias("idf_sum"), F.sum("times").alias("tf"))
    rows = begun.unionByName(runs.select("qid", "idf_sum", "title", "tf", "dl")).select(
        "qid", "title", F.round(F.col("idf_sum") * tf_norm(F.col("tf"), F.col("dl"), avgdl), 6).alias("score"))
    if not open_words.isEmpty():
        others = words.join(open_words, "qid", "left_semi").drop("term_bucket")
        index = Index(prefix_postings(docs, "title", analyzer), field_stats(docs, {TITLE: "title"}, analyzer), analyzer)
        hits = match_keywords(index, others).filter(F.col("phrase_tf") > 0)
        rows = rows.unionByName(hits.join(docs.select("doc_id", "title"), "doc_id").filter(F.coalesce("title", F.lit("")) != "").select(
            "qid", "title", F.round("phrase_score", 6).alias("score")))
    initials = materialize(typed.filter("_c").drop("_c"), "initials")
    if not initials.isEmpty():
        chosung = match_stored_chosung(initials, grams, chosung_mode, 1.0) if grams else match_chosung(initials, docs, chosung_mode, 1.0)
        rows = rows.unionByName(chosung.join(docs.select("doc_id", "title"), "doc_id").filter(
            F.coalesce("title", F.lit("")) != "").select("qid", "title", "score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("title"))
    return rows.groupBy("qid", "title").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= k).select("qid", "title", "rank")
