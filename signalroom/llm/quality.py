"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio, all in Spark expressions.

Unigrams and bigrams of a text hash into ``BUCKETS`` buckets. Two multinomials are counted, one over
all documents and one over trusted documents (a bounded sample of rows labelled good). A document's
score is the sum over its n-grams of the bucket's log ratio of trusted to raw, divided by the number
of n-grams. Ratios are rounded to millionths and summed as whole numbers, so a score is the same in
any order of evaluation and the threshold is deterministic.

Driver memory: ``BUCKETS`` counts. Broadcast: ``MAX_TRUSTED`` document ids.

Cases: null and empty texts have no words and fail the base rules; long texts are read whole; repeated
rows count and are judged once each; null or repeated labels are ignored; an empty table gives no
rows; an input column named like the struct that is added gives way to it, and the stage gives the struct a
name that no column has, so it returns all columns as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 16384
#: At most so many labelled documents make the trusted multinomial, those of the smallest hashes.
MAX_TRUSTED = 20_000
#: Documents whose mean log ratio, in millionths, is below this are rejected.
THRESHOLD = -350_000
WINDOW = 5
SCALE = 1_000_000
TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), common.SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more."""

    def covered(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda k, p: F.struct(k.alias("k"), p.alias("p"))))
        same = lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False))
        again = common.let(marked, lambda s: F.filter(s, lambda x, j: same(F.when(j > 0, F.get(s, j - 1)), x) | same(F.get(s, j + 1), x)))
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def of_hashes(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))
        return F.when(F.size(hashes) > WINDOW, common.let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))).otherwise(0)

    return common.let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def base_columns(text: Column) -> Column:
    """The base counts as one struct."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return common.let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"),
            common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of every unigram and bigram."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    put = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return common.let(
        F.transform(tokens, lambda t: F.xxhash64(t)),
        lambda h: F.concat(
            F.transform(h, lambda x: put(x)),
            F.when(F.size(h) > 1, F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: put(a, b))).otherwise(F.array().cast("array<int>")),
        ),
    )


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of a bounded sample of the documents labelled good."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("trusted", F.lit(1))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MAX_TRUSTED) -> list[int]:
    """Each bucket's log ratio of trusted to raw in millionths, both smoothed by one."""
    counted = (
        docs.select("doc_id", "text")
        .join(F.broadcast(trusted_ids(labels, most)), "doc_id", "left")
        .select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted"))
        .collect()
    )
    raw, good = [1] * buckets, [1] * buckets
    for row in counted:
        raw[row["bucket"]] += row["raw"]
        good[row["bucket"]] += row["trusted"]
    all_raw, all_good = sum(raw), sum(good)
    return [round(SCALE * (math.log(g / all_good) - math.log(r / all_raw))) for g, r in zip(good, raw, strict=True)]


def assess(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS, most: int = MAX_TRUSTED, to: str = "quality") -> DataFrame:
    """docs with a struct: the base counts, base_failed, llr (mean log ratio) and kept."""
    docs = common.without(docs, to)
    ratios = common.int_array(log_ratios(docs, labels, buckets, most))

    def verdict(base: Column, score: Column) -> Column:
        failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
        good = score["n"] * threshold <= score["sum"]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        mean = F.when(score["n"] > 0, score["sum"] / score["n"] / SCALE)
        return F.struct(*[base[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & good).alias("kept"), mean.alias("llr"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("n"))
    step = lambda a, b: F.struct((a["sum"] + F.get(ratios, b)).alias("sum"), (a["n"] + 1).alias("n"))
    score = F.aggregate(ngram_buckets(F.col("text"), buckets), start, step)
    return docs.withColumn(to, common.let(base_columns(F.col("text")), lambda b: common.let(score, lambda s: verdict(b, s))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "quality.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass."""
    to = common.free(docs.columns, "_quality")
    return assess(docs, common.table(spark, sf_dir, "labels"), to=to).where(F.col(to)["kept"]).drop(to)
