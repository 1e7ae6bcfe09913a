"""Queries on hidden characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalroom.functions.hidden import hits_of
from signalroom.operators import layer_a
from signalroom.operators.layer_a import Dialect

from . import views

#: The same rules on DuckDB's functions.
DUCKDB = Dialect(
    chars="SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS ch FROM (SELECT doc_id, string_split(t, '') AS a FROM docs WHERE regexp_matches(t, '{suspect}'))",
    rest="",
    code="unicode(ch)",
    matches="regexp_matches({0}, '{1}')",
    char="",
    join_text="string_agg(out_ch, '' ORDER BY pos)",
    first_ten="array_to_string(list(pos ORDER BY pos)[1:10], ',')",
    last="last_value({x} IGNORE NULLS) OVER ({rows} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    next="first_value({x} IGNORE NULLS) OVER ({rows} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
)


def duckdb(statement: str) -> str:
    return "WITH docs AS (" + views.DOCS_SQL.format(documents="documents") + "), " + statement.lstrip().removeprefix("WITH ")


def same(pattern: str) -> str:
    return pattern


def oracle(build, **options) -> str:
    return duckdb(build(DUCKDB, **options, escape=same))


SUM = "SELECT codepoint, kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM hits GROUP BY codepoint, kind"
HITS = duckdb(layer_a.decisions(DUCKDB, strip_bidi=True, escape=same)) + ", hits AS (SELECT doc_id, cp AS codepoint, kind, count(*) AS n FROM result WHERE kind IS NOT NULL GROUP BY doc_id, cp, kind)\n"


def docs(spark, sf_dir):
    return views.marked_documents(spark, sf_dir)


def top_codepoints(spark, sf_dir):
    found = layer_a.inspect(docs(spark, sf_dir))
    return found.groupBy("codepoint", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def report(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.char_length("t").cast("bigint").alias("length"), hits_of(F.col("t"), strip_bidi=True).alias("h"))
    return rows.select("doc_id", "length", F.aggregate("h.n", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("suspicious_total"), F.size("h").cast("bigint").alias("hits"))


def cleaned(**options):
    def run(spark, sf_dir):
        out = layer_a.clean(docs(spark, sf_dir), **options)
        return out.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), "removed", "replaced", "preserved")

    return run


def cleaned_oracle(**options) -> str:
    inner = layer_a.clean_sql(DUCKDB, **options, escape=same)
    head, _, last = inner.rpartition("\nSELECT doc_id, ")
    return duckdb(head) + f", changed AS (SELECT doc_id, {last})\nSELECT d.doc_id, md5(CASE WHEN c.doc_id IS NULL THEN t ELSE cleaned END) AS cleaned_md5, coalesce(removed, 0) AS removed, coalesce(replaced, 0) AS replaced, coalesce(preserved, 0) AS preserved FROM docs d LEFT JOIN changed c ON c.doc_id = d.doc_id"


QUERIES = {
    "layer_a_kind_counts": lambda spark, sf: layer_a.kind_counts(docs(spark, sf)),
    "layer_a_sample_offsets": lambda spark, sf: layer_a.inspect(docs(spark, sf)),
    "layer_a_top_codepoints": top_codepoints,
    "layer_a_doc_report": report,
    "layer_a_confusables": lambda spark, sf: layer_a.inspect(docs(spark, sf), aggressive=True),
    "layer_a_clean": cleaned(),
    "layer_a_clean_forensic": cleaned(strip_bidi=True, strip_emoji_glue=True, preserve_semantic=False, aggressive=True),
    "layer_a_clean_keep_spaces": cleaned(normalize_spaces=False),
    "layer_a_bidi_pairs": lambda spark, sf: layer_a.bidi_pairs(docs(spark, sf)),
}
ORACLES = {
    "layer_a_kind_counts": HITS + "SELECT doc_id, kind, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY doc_id, kind",
    "layer_a_sample_offsets": oracle(layer_a.hits_sql),
    "layer_a_top_codepoints": HITS + SUM,
    "layer_a_doc_report": HITS + "SELECT d.doc_id, length(t) AS length, CAST(coalesce(sum(n), 0) AS BIGINT) AS suspicious_total, count(h.doc_id) AS hits FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id, t",
    "layer_a_confusables": oracle(layer_a.hits_sql, aggressive=True),
    "layer_a_clean": cleaned_oracle(),
    "layer_a_clean_forensic": cleaned_oracle(strip_bidi=True, strip_emoji_glue=True, preserve_semantic=False, aggressive=True),
    "layer_a_clean_keep_spaces": cleaned_oracle(normalize_spaces=False),
    "layer_a_bidi_pairs": oracle(layer_a.pairs_sql),
}
