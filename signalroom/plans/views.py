"""Input views. The standard tables hold no marks, so marks are put in by rules on the key, alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalroom.sources import tables

# What is put before the text, by doc_id modulo their number.
MARKS = [
    "", "‮", "‪‫x‬ y‬ ‬z ", "\U0001f468‍\U0001f469‍\U0001f467 ‍a ", "❤️ a️ ", "\U0001f3f4\U000e0067\U000e0062\U000e007f \U000e0067b ",
    "می‌ر a‌b ", "x⁢y ⁢ ", "葛\U000e0100 b\U000e0101 ", "ᠠ᠋ ᠋k឴ ក឴ ᄀᅠ ᅟ ", "­͏﻿⁠ ", "АСＡ　  ؀  ",
]
PHRASES = [
    "", "Moreover, it is important to note the rich tapestry of this. ", "We delve into a myriad of things. In conclusion, a paradigm shift! ",
    "This plays a pivotal role in today's fast-paced world. ", "Ultimately, not only this, but also serves to harness the power of it.\n```\ncode here. and there.\n```\n",
]


def mark_sql(key: str, marks: list[str]) -> str:
    quoted = ["'" + m.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'" for m in marks]
    return f"CASE {key} % {len(marks)} " + " ".join(f"WHEN {k} THEN {q}" for k, q in enumerate(quoted)) + " END"


DOCS_SQL = f"SELECT doc_id, concat({mark_sql('doc_id', MARKS)}, replace(text, ' th', concat(CASE WHEN doc_id % 6 = 0 THEN '​' ELSE '' END, ' th'))) AS t FROM {{documents}}"
PROSE_SQL = f"SELECT doc_id, lang, concat({mark_sql('doc_id', PHRASES)}, text) AS t FROM {{documents}}"
HTML_MARKS = [
    '<meta name="generator" content="WordPress 6.5">', '<meta name="generator" content="Midjourney v6"><meta name="viewport" content="width=device-width">',
    '<script type="application/ld+json">{"digitalSourceType":"trainedAlgorithmicMedia","c2pa":"x"}</script>', '<div data-ai-model="gpt"></div>', "",
]
PAGES_SQL = f"SELECT page_id, url, concat(html, {mark_sql('page_id', HTML_MARKS)}) AS html FROM {{pages}}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, statement: str, *names: str) -> DataFrame:
    return spark.sql(statement.replace("\\", "\\\\"), **{n: table(spark, sf_dir, n) for n in names})


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DOCS_SQL, "documents")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PROSE_SQL, "documents")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAGES_SQL, "pages")
