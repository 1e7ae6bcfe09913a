"""Measures of style in one pass against the columns that define them, and that no text is worked through by lambdas."""

import random

from pyspark.sql import functions as F

from signalroom.functions import style
from signalroom.functions import text as X
from signalroom.plans import style as plans
from signalroom.rules import phrases as P

PARTS = [
    "a", "B", "_", "-", "'", " ", "  ", "\n", "\r\n", "\t", ".", "!", "?", ",", "\x0b", "\x1c", "\x1e", "\x1f", "\x85", " ", " ", "　", "```", "\n```", "```\n", "é", "İ", "ın the era", "aſ an ai", "Σ", "字", "1", "²",
    "In  the digital world", "xin the world", "in the worlds", "in today's the era", "IT IS IMPORTANT TO NOTE", "as an AI", "as an ais", "Ultimately,", "moreover ", "not only a, b but also serves to", "delved into", "plays a key role", "play a vital role",
    "servesas a reminder", "serves as a reminder", "a myriad of", "aa myriad of", "in conclusion,", "Key", "plays a Key role", "\U0001f600", "word", "word-word", "it's",
]


def test_measures_are_the_columns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.choice([3, 20, 120]))) for _ in range(1500)] + [None, "", " ", "```", "a\n```b. c.\n``` d\ne. f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    t, w, s = F.col("t"), X.words(F.col("t")), X.sentences(F.col("t"))
    n = F.size(w)
    columns = docs.select("doc_id", n.alias("words"), F.size(s).alias("sentences"), X.burstiness(s).alias("cv"), X.mattr(w).alias("ttr"), X.density(X.phrase_counts(t), n).alias("dens"))
    got = docs.select("doc_id", style.measured(t).alias("m")).select("doc_id", "m.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, columns.collect()))


def test_first_words_of_phrases():
    assert [p.pattern.split("(?<!")[0] for _, p, _, _ in style.PHRASES[:5]] == ["delve", "a", "rich", "play", "in"]
    assert all(p.pattern.startswith(P.PHRASES[k][0][2:3]) for k, (_, p, _, _) in enumerate(style.PHRASES))


def test_style_is_measured_once_by_row(spark, tmp_path):
    spark.createDataFrame([(1, "en", "One two. Three!"), (2, None, None)], "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = plans.scored(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    assert found.count() == 2
