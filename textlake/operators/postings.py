"""Positional postings, and AND / phrase matching of keyword tables against them.

Matching never joins a query's frequent words against the corpus: each keyword
enters through its rarest word, and its other words are looked up by (field, word,
document), a key no single word dominates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import windows_of
from ..session import materialize

# ---------------------------------------------------------------- fixed values
STOPWORDS = ("에", "대해서", "해주세요", "알려주세요", "의", "를", "은", "는")
BM25_K1 = 1.2
BM25_B = 0.75
# ------------------------------------------------------------------------------
TITLE, BODY = "title", "body"
FIELDS = {TITLE: "title", BODY: "all_text"}


def word_tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cjk_bigram_tokens(col: Column) -> Column:
    """Like `word_tokens`, with Hangul words cut into overlapping bigrams."""
    return F.flatten(F.transform(
        word_tokens(col),
        lambda w: F.when(w.rlike("^[가-힣]{2,}$"), windows_of(w, 2)).otherwise(F.array(w))))


@dataclass(frozen=True)
class Analyzer:
    """Text to words. Removed stop words leave their positions empty, so phrases keep
    their distances. Any column function from text to an array of words will do."""

    tokens: Callable[[Column], Column] = word_tokens
    stopwords: Sequence[str] = STOPWORDS

    def keeps(self, term: Column) -> Column:
        return ~term.isin(*self.stopwords) if self.stopwords else F.lit(True)

    def length(self, tokens: Column) -> Column:
        return F.size(F.filter(tokens, self.keeps))


DEFAULT_ANALYZER = Analyzer()


def _tokenized(docs: DataFrame, fields: dict[str, str], analyzer: Analyzer) -> DataFrame:
    """(doc_id, field, tokens, dl), all fields in one scan."""
    each = F.array(*[
        F.struct(F.lit(name).alias("field"), analyzer.tokens(F.coalesce(F.col(column), F.lit(""))).alias("tokens"))
        for name, column in fields.items()
    ])
    return (
        docs.select("doc_id", F.explode(each).alias("f"))
        .select("doc_id", "f.field", "f.tokens")
        .withColumn("dl", analyzer.length(F.col("tokens")))
    )


def build_postings(docs: DataFrame, fields: dict[str, str] | None = None,
                   analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """(field, term, doc_id, pos, dl): one row per word occurrence; dl is the field's
    length in words. A narrow plan: nothing is shuffled."""
    return (
        _tokenized(docs, fields or FIELDS, analyzer)
        .select("field", "doc_id", "dl", F.posexplode("tokens").alias("pos", "term"))
        .filter(analyzer.keeps(F.col("term")))
        .select("field", "term", "doc_id", "pos", "dl")
    )


def field_stats(docs: DataFrame, fields: dict[str, str] | None = None,
                analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """(field, n_docs, avgdl) over documents with at least one word in the field."""
    return (
        _tokenized(docs, fields or FIELDS, analyzer).filter(F.col("dl") > 0)
        .groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    )


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    stats: DataFrame
    analyzer: Analyzer = field(default=DEFAULT_ANALYZER)
    # of a stored index: into how many buckets its words are dealt, into how many ranges its
    # documents, and the extremes of each (field, term, doc_range)
    buckets: int = 0
    ranges: int = 0
    bounds: DataFrame | None = None
    # of an index for one use: the same postings, all of a document in one partition
    dealt: DataFrame | None = None

    def stat(self, name: str) -> Column:
        """Per-field statistic for the row's `field`; the map has one entry per field."""
        packed = self.stats.agg(
            F.map_from_entries(F.collect_list(F.struct("field", F.col(name).cast("double")))).alias("m"))
        return packed.scalar()[F.col("field")]


def build_index(docs: DataFrame, fields: dict[str, str] | None = None,
                analyzer: Analyzer = DEFAULT_ANALYZER) -> Index:
    """An index for one use. Its statistics, a row a field, are worked out once here."""
    stats = materialize(field_stats(docs, fields, analyzer), "stats")
    return Index(build_postings(docs, fields, analyzer), stats, analyzer, dealt=_dealt(docs, fields, analyzer))


def _dealt(docs: DataFrame, fields: dict[str, str] | None, analyzer: Analyzer) -> DataFrame:
    """`build_postings` with texts dealt out by document first, so that folding the words of a
    document moves no words."""
    texts = docs.select("doc_id", *dict.fromkeys((fields or FIELDS).values()))
    return build_postings(texts.repartition("doc_id"), fields, analyzer)


def doc_range(doc_id: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ranges)).cast("int")


def write_folded(folded: DataFrame, place: str, buckets: int, *within: str, **made: Column) -> None:
    """Rows (field, term, doc_id, ...) in folders by word bucket, in order of (term, `within`,
    document) inside. Partitions are rebalanced by their sizes as they turn out, so that a
    frequent word is spread over several files and nothing is worked out twice for samples.
    Columns that follow from the others are made where the rows are written."""
    order = ["term_bucket", "term", *within, "doc_id"]
    (
        folded.withColumn("term_bucket", term_bucket(F.col("term"), buckets))
        .hint("rebalance", F.col("term_bucket")).withColumns(made).sortWithinPartitions(*order)
        .write.mode("errorifexists").option("compression", "zstd").partitionBy("term_bucket").parquet(place)
    )


def _write_segment(postings: DataFrame, path: str, segment: int, buckets: int, ranges: int) -> None:
    """One segment of a stored index: a row for each (field, word, document) with its
    positions, in folders by word bucket and ordered by (word, range of documents) inside, so
    that a frequent word is spread over several files and a look-up reads the row groups of
    its words only; beside them every field's length in words, from which the statistics are
    had, and the extremes of each (field, word, range), which bound its scores."""
    place = f"{path}/postings/segment={segment}"
    folded = postings.groupBy("field", "term", "doc_id").agg(
        F.max("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))
    write_folded(folded, place, buckets, "doc_range", tf=F.size("positions"), doc_range=doc_range(F.col("doc_id"), ranges))
    stored = postings.sparkSession.read.parquet(place)
    stored.groupBy("field", "doc_id").agg(F.max("dl").alias("dl")).write.mode("errorifexists").parquet(
        f"{path}/lengths/segment={segment}")
    stored.groupBy("term_bucket", "field", "term", "doc_range").agg(
        F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl")).repartition(
        "term_bucket").write.mode("errorifexists").option("compression", "zstd").partitionBy("term_bucket").parquet(
        f"{path}/bounds/segment={segment}")


def write_index(index: Index, path: str, buckets: int = 256, ranges: int = 256) -> None:
    """Store an index for repeated use. The numbers of word buckets and of document ranges
    and the analyser's name are stored with it; `append_index`, `delete_from_index` and
    `merge_index` maintain it."""
    spark = index.postings.sparkSession
    ids = index.postings.select("doc_id").limit(0)
    ids.write.mode("errorifexists").parquet(f"{path}/deleted/segment=0")
    _write_segment(index.postings if index.dealt is None else index.dealt, path, 1, buckets, ranges)
    how = [(buckets, ranges, analyzer_name(index.analyzer))]
    spark.createDataFrame(how, "buckets int, ranges int, analyzer string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/settings")


def _settings(spark: SparkSession, path: str, analyzer: Analyzer) -> tuple[int, int]:
    how = spark.read.parquet(f"{path}/settings").first()
    if how["analyzer"] != analyzer_name(analyzer):
        raise ValueError(f"the index was written with {how['analyzer']}, not {analyzer_name(analyzer)}")
    return how["buckets"], how["ranges"]


def _next_segment(spark: SparkSession, path: str) -> int:
    """Segments are numbered in the order of changes; the numbers are folder names."""
    seen = [spark.read.parquet(f"{path}/{kind}").agg(F.max("segment")).first()[0] or 0 for kind in ("lengths", "deleted")]
    return max(seen) + 1


def append_index(docs: DataFrame, path: str, fields: dict[str, str] | None = None,
                 analyzer: Analyzer = DEFAULT_ANALYZER) -> None:
    """Add documents as a segment of their own. Their ids must not be in the index, or
    have been deleted from it before."""
    spark = docs.sparkSession
    buckets, ranges = _settings(spark, path, analyzer)
    _write_segment(_dealt(docs, fields, analyzer), path, _next_segment(spark, path), buckets, ranges)


def delete_from_index(ids: DataFrame, path: str) -> None:
    """Forget documents (doc_id) that earlier segments hold. Postings stay in their files
    and are left out when read, until a merge drops them."""
    segment = _next_segment(ids.sparkSession, path)
    ids.select("doc_id").where("doc_id is not null").distinct().write.mode("errorifexists").parquet(f"{path}/deleted/segment={segment}")


def living(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of all segments without those of documents deleted later."""
    gone = spark.read.parquet(f"{path}/deleted").groupBy(F.col("doc_id").alias("_gone")).agg(F.max("segment").alias("_until"))
    return spark.read.parquet(f"{path}/{kind}").join(
        gone, (F.col("doc_id") == F.col("_gone")) & (F.col("segment") < F.col("_until")), "left_anti")


def read_index(spark: SparkSession, path: str, analyzer: Analyzer = DEFAULT_ANALYZER) -> Index:
    """The index as its segments and deletions leave it. The bounds of a deleted document
    stay until a merge; they are then wider than need be, never too narrow."""
    buckets, ranges = _settings(spark, path, analyzer)
    lengths = living(spark, path, "lengths").drop("segment")
    stats = materialize(lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")), "stats")
    bounds = spark.read.parquet(f"{path}/bounds").drop("segment")
    return Index(living(spark, path, "postings").drop("segment"), stats, analyzer, buckets, ranges, bounds)


def merge_index(spark: SparkSession, path: str, into: str, analyzer: Analyzer = DEFAULT_ANALYZER) -> None:
    """Write the index at `path` anew at `into`: one segment, deleted documents gone, narrow
    bounds. Word buckets keep their rows, so the merge goes bucket by bucket: a task sorts
    part of one bucket, and nothing is tokenised. Readers of the old index are not
    disturbed; it can go once nobody reads it."""
    buckets, ranges = _settings(spark, path, analyzer)
    write_folded(living(spark, path, "postings").drop("segment"), f"{into}/postings/segment=1", buckets, "doc_range")
    stored = spark.read.parquet(f"{into}/postings/segment=1")
    living(spark, path, "lengths").drop("segment").write.mode("errorifexists").parquet(f"{into}/lengths/segment=1")
    stored.groupBy("term_bucket", "field", "term", "doc_range").agg(
        F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl")).repartition(
        "term_bucket").write.mode("errorifexists").partitionBy("term_bucket").parquet(f"{into}/bounds/segment=1")
    stored.select("doc_id").limit(0).write.mode("errorifexists").parquet(f"{into}/deleted/segment=0")
    how = [(buckets, ranges, analyzer_name(analyzer))]
    spark.createDataFrame(how, "buckets int, ranges int, analyzer string").coalesce(1).write.mode("errorifexists").parquet(f"{into}/settings")


def analyzer_name(analyzer: Analyzer) -> str:
    return f"{analyzer.tokens.__name__}/{','.join(analyzer.stopwords)}"


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def keyword_terms(keywords: DataFrame, analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """(qid, kid, qpos, term, n_terms) of keywords (qid, kid, keyword)."""
    return (
        keywords.withColumn("_tokens", analyzer.tokens(F.coalesce(F.col("keyword"), F.lit(""))))
        .withColumn("n_terms", analyzer.length(F.col("_tokens")))
        .select("qid", "kid", "n_terms", F.posexplode("_tokens").alias("qpos", "term"))
        .filter(analyzer.keeps(F.col("term")))
    )


def of_buckets(rows: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the wanted keys, of which term_bucket is one: only these folders are read."""
    return rows.join(words, keys, "left_semi")


def of_words(rows: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """The rows of the words in question. Where the rows are stored in buckets, only the
    buckets of these words are read."""
    vocabulary = terms.select("term").distinct()
    if "term_bucket" not in rows.columns:
        return rows.join(vocabulary, "term", "left_semi")
    return of_buckets(rows, vocabulary.withColumn("term_bucket", term_bucket(F.col("term"), index.buckets)), ["term_bucket", "term"])


def _occurrences(index: Index, terms: DataFrame) -> DataFrame:
    """(field, term, doc_id, tf, dl, positions) for the words in question. Postings of
    other words are dropped before anything is shuffled; a stored index holds these rows."""
    found = of_words(index.postings, terms, index)
    if index.buckets:
        found = found.select("field", "term", "doc_id", "tf", "dl", "positions")
    else:
        found = found.groupBy("field", "term", "doc_id").agg(
            F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"), F.collect_list("pos").alias("positions"))
    # read three times below (document frequencies, candidates, look-ups): the corpus
    # is tokenised once, and the joins are planned with the real size
    return materialize(found, "occurrences")


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def with_df(occurrences: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """The words of the keywords for each field that holds them, with their idf there."""
    df = occurrences.groupBy("field", "term").agg(F.count("*").alias("df"))
    return terms.join(df, "term").withColumn("idf", idf(index.stat("n_docs"), F.col("df")))


KEYWORD = ["qid", "kid", "field"]


def rarest_words(weighted: DataFrame) -> DataFrame:
    """(qid, kid, field, term, n_terms, idf_sum) of the keywords all of whose words occur in a
    field, with their rarest word there."""
    return (
        weighted.groupBy(*KEYWORD)
        .agg(F.count("*").alias("found"), F.max("n_terms").alias("n_terms"), F.sum("idf").alias("idf_sum"),
             F.min(F.struct("df", "term")).alias("rarest"))
        .filter(F.col("found") == F.col("n_terms"))
        .select(*KEYWORD, F.col("rarest.term").alias("term"), "n_terms", "idf_sum")
    )


def score_fields(full: DataFrame, index: Index) -> DataFrame:
    """(qid, kid, field, doc_id, and_score, phrase_tf, phrase_score) from a row for each word
    of a keyword in each document: qpos, n_terms, idf, idf_sum, tf, dl, positions. Documents
    without all words drop out."""
    avgdl = index.stat("avgdl")
    starts = F.transform("positions", lambda p: p - F.col("qpos"))
    merged = full.groupBy(*KEYWORD, "doc_id").agg(
        F.count("*").alias("found"), F.max("n_terms").alias("n_terms"),
        F.max("idf_sum").alias("idf_sum"), F.max("dl").alias("dl"),
        F.sum(F.col("idf") * tf_norm(F.col("tf"), F.col("dl"), avgdl)).alias("and_score"),
        # one short list per word of the keyword
        F.collect_list(starts).alias("starts"),
    ).filter(F.col("found") == F.col("n_terms"))
    common = F.reduce(
        F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)),
        lambda acc, s: F.array_intersect(acc, s))
    return (
        merged.withColumn("phrase_tf", F.size(common))
        .withColumn("phrase_score", F.when(
            F.col("phrase_tf") > 0,
            F.col("idf_sum") * tf_norm(F.col("phrase_tf"), F.col("dl"), avgdl)).otherwise(0.0))
        .select(*KEYWORD, "doc_id", "and_score", "phrase_tf", "phrase_score")
    )


def match_keywords(index: Index, terms: DataFrame) -> DataFrame:
    """(qid, kid, field, doc_id, and_score, phrase_tf, phrase_score) for every document
    field that holds all words of a keyword. `phrase_tf` counts the places where they
    stand at the keyword's distances; 0 means no phrase match."""
    occurrences = _occurrences(index, terms)
    weighted = with_df(occurrences, terms, index)
    candidates = rarest_words(weighted).join(
        occurrences.select("field", "term", "doc_id"), ["field", "term"]).drop("term", "n_terms")
    full = (
        candidates.join(weighted.select(*KEYWORD, "qpos", "term", "n_terms", "idf"), KEYWORD)
        .join(occurrences, ["field", "term", "doc_id"])
    )
    return score_fields(full, index)


def match_any(index: Index, terms: DataFrame) -> DataFrame:
    """(qid, kid, field, doc_id, or_score): documents with at least one word."""
    occurrences = _occurrences(index, terms)
    weighted = with_df(occurrences, terms, index)
    return (
        weighted.join(occurrences, ["field", "term"])
        .groupBy("qid", "kid", "field", "doc_id")
        .agg(F.sum(F.col("idf") * tf_norm(F.col("tf"), F.col("dl"), index.stat("avgdl"))).alias("or_score"))
    )


def match_and(index: Index, keywords: DataFrame) -> DataFrame:
    """(qid, kid, field, doc_id, and_score)."""
    hits = match_keywords(index, keyword_terms(keywords, index.analyzer))
    return hits.select("qid", "kid", "field", "doc_id", "and_score")


def match_phrase(index: Index, keywords: DataFrame) -> DataFrame:
    """(qid, kid, field, doc_id, phrase_tf, phrase_score)."""
    hits = match_keywords(index, keyword_terms(keywords, index.analyzer))
    return hits.filter(F.col("phrase_tf") > 0).select(
        "qid", "kid", "field", "doc_id", "phrase_tf", "phrase_score")


def strict_hits(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, strict_hits): documents that hold the whole query as a phrase, 0 included."""
    keywords = queries.select("qid", F.lit("q").alias("kid"), F.col("query").alias("keyword"))
    counts = match_phrase(index, keywords).groupBy("qid").agg(F.count_distinct("doc_id").alias("n"))
    return queries.select("qid").join(counts, "qid", "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("strict_hits"))


def prefix_postings(docs: DataFrame, column: str = "title", analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """Postings with every word under "=word" and under "^prefix" for each of its
    prefixes, so that a phrase prefix is an ordinary phrase."""
    base = build_postings(docs, {TITLE: column}, analyzer)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("term")), lambda n: F.concat(F.lit("^"), F.col("term").substr(F.lit(1), n)))
    keys = F.concat(F.array(F.concat(F.lit("="), F.col("term"))), prefixes)
    return base.select("field", F.explode(keys).alias("term"), "doc_id", "pos", "dl")


def prefix_terms(keywords: DataFrame, analyzer: Analyzer = DEFAULT_ANALYZER) -> DataFrame:
    """Terms of a keyword whose last word is only begun."""
    terms = keyword_terms(keywords, analyzer).withColumn("_k", F.struct("qid", "kid"))
    last = terms.groupBy("_k").agg(F.max("qpos").alias("_last"))
    return terms.join(last, "_k").select(
        "qid", "kid", "n_terms", "qpos",
        F.concat(F.when(F.col("qpos") == F.col("_last"), "^").otherwise("="), "term").alias("term"))
