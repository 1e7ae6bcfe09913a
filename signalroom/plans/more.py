"""Smaller queries: normal forms, chunks, fronts, conversations, inputs and statuses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalroom.functions import text as X
from signalroom.operators import findings
from signalroom.rules import characters as C
from signalroom.rules import phrases as P
from signalroom.sources import files

from . import hidden, style, views

SPACES = "".join(chr(c) for a, b in C.SPACES for c in range(a, b + 1))
FLAG = "\\x{1F3F4}[\\x{E0020}-\\x{E007E}]+\\x{E007F}"


def spaces(spark, sf_dir):
    return hidden.docs(spark, sf_dir).select("doc_id", F.md5(F.translate("t", SPACES, " " * len(SPACES))).alias("digest"))


def flags(spark, sf_dir):
    return hidden.docs(spark, sf_dir).select("doc_id", F.regexp_count("t", F.lit(FLAG)).cast("bigint").alias("flags"))


def normal_form(spark, sf_dir):
    out = hidden.docs(spark, sf_dir).select("doc_id", "t", X.nfkc(F.col("t")).alias("n"))
    return out.select("doc_id", F.char_length("n").cast("bigint").alias("length"), (F.col("n") != F.col("t")).alias("changed"))


def text_chunks(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.regexp_replace("text", "\n", "\n\n"))).alias("place", "chunk"))
    return rows.select("doc_id", F.col("place").cast("bigint").alias("place"), F.char_length("chunk").cast("bigint").alias("length"))


def turn_stats(spark, sf_dir):
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "role", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(P.WORD)).alias("w"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.sum("w").cast("bigint").alias("words"))


def scaled(front):
    """The front with both objectives scaled to 0..1."""
    low_high = front.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), F.min("p_retailprice").alias("c"), F.max("p_retailprice").alias("d"))
    rows = front.crossJoin(F.broadcast(low_high))  # one row
    share = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    return rows.select("p_size", "p_retailprice", share("p_size", "a", "b").alias("x"), share("p_retailprice", "c", "d").alias("y"))


def crowding(spark, sf_dir):
    """How far apart a front's neighbours are; none for its ends. The front holds one row for each size at most."""
    order = Window.partitionBy(F.lit(0)).orderBy("p_size")
    gap = lambda c: F.abs(F.lead(c).over(order) - F.lag(c).over(order))
    return scaled(style.pareto(spark, sf_dir)).select("p_size", F.round(gap("x") + gap("y"), 6).alias("crowding"))


def knee(spark, sf_dir):
    rows = scaled(style.pareto(spark, sf_dir)).withColumn("far", F.hypot(1 - F.col("x"), 1 - F.col("y")))
    return rows.agg(F.min_by("p_size", F.struct("far", "p_size")).alias("p_size"), F.round(F.min("far"), 6).alias("distance"))


def first_inputs(spark, sf_dir):
    path = F.regexp_replace("url", "[?#].*$", "")
    return views.table(spark, sf_dir, "pages").groupBy(path.alias("path")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))


def generated(spark, sf_dir):
    name = F.concat(F.lit("d/f"), "doc_id", F.when(F.col("doc_id") % 4 == 0, ".bak").when(F.col("doc_id") % 4 == 1, ".cleaned.txt").when(F.col("doc_id") % 4 == 2, ".mask.png").otherwise(".txt"))
    return views.table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).where(~files.is_generated(F.col("name")))


def quality(spark, sf_dir):
    k = F.col("event_id")
    return views.table(spark, sf_dir, "events").select("event_id", findings.quality_status(k % 7 == 0, k % 5 == 0, k % 3 == 0, k % 2 == 0).alias("status"))


DOCS = "WITH docs AS (" + views.DOCS_SQL.format(documents="documents") + ")"
FRONT = style.ORACLES["pareto_front"].replace("SELECT * FROM r a WHERE", ", f AS (SELECT * FROM r a WHERE", 1).replace(") , f AS", "), f AS") + "), s AS (SELECT p_size, p_retailprice, CASE WHEN max(p_size) OVER () > min(p_size) OVER () THEN (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) ELSE 0 END AS x, CASE WHEN max(p_retailprice) OVER () > min(p_retailprice) OVER () THEN (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) ELSE 0 END AS y FROM f)"
QUERIES = {
    "layer_a_space_normalize": spaces, "layer_a_flag_spans": flags, "layer_a_nfkc": normal_form, "text_chunks": text_chunks, "conversation_turn_stats": turn_stats, "crowding_distance": crowding,
    "knee_point": knee, "dedupe_inputs": first_inputs, "generated_filter": generated, "quality_status": quality,
}
ORACLES = {
    "layer_a_space_normalize": DOCS + f" SELECT doc_id, md5(translate(t, '{SPACES}', repeat(' ', {len(SPACES)}))) AS digest FROM docs",
    "layer_a_flag_spans": DOCS + f" SELECT doc_id, len(regexp_extract_all(t, '{FLAG}')) AS flags FROM docs",
    "conversation_turn_stats": f"SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{style.W}'))) AS BIGINT) AS words FROM conversations GROUP BY conv_id",
    "crowding_distance": FRONT + " SELECT p_size, round(abs(lead(x) OVER w - lag(x) OVER w) + abs(lead(y) OVER w - lag(y) OVER w), 6) AS crowding FROM s WINDOW w AS (ORDER BY p_size)",
    "knee_point": FRONT + " SELECT p_size, round(sqrt((1 - x) * (1 - x) + (1 - y) * (1 - y)), 6) AS distance FROM s ORDER BY sqrt((1 - x) * (1 - x) + (1 - y) * (1 - y)), p_size LIMIT 1",
    "dedupe_inputs": "SELECT regexp_replace(url, '[?#].*$', '') AS path, min(page_id) AS first, count(*) AS copies FROM pages GROUP BY 1",
    "generated_filter": "SELECT doc_id, 'd/f' || doc_id || '.txt' AS name FROM documents WHERE doc_id % 4 = 3",
    "quality_status": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'FAILED' WHEN event_id % 5 = 0 THEN 'UNSUPPORTED' WHEN event_id % 3 = 0 THEN 'FAILED' WHEN event_id % 2 = 0 THEN 'BEST_EFFORT' ELSE 'VERIFIED' END AS status FROM events",
}
