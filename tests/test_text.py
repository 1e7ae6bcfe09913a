"""Characters, style and decisions, case by case."""

import pytest
from pyspark.sql import functions as F

from signalroom.functions import text as X
from signalroom.operators import findings, layer_a, markup
from signalroom.plans import style
from signalroom.sources import files
from signalroom.streaming import arrivals

# text, options, cleaned, removed, replaced, preserved
CLEAN = [
    ("a​b­", {}, "ab", 2, 0, 0),
    ("a b　c", {}, "a b c", 0, 2, 0),
    ("x\U000e0041y", {}, "xy", 1, 0, 0),
    ("‮abc", {}, "abc", 1, 0, 0),
    ("❤️‍\U0001f525", {}, "❤️‍\U0001f525", 0, 0, 2),
    ("❤️‍\U0001f525", {"strip_emoji_glue": True}, "❤\U0001f525", 2, 0, 0),
    ("می‌ر ‫x‬", {}, "می‌ر ‫x‬", 0, 0, 3),
    ("‍a‮b", {}, "ab", 2, 0, 0),
    ("f⁡x", {}, "f⁡x", 0, 0, 1),
    ("f ⁡ x", {}, "f  x", 1, 0, 0),
    ("café — ok", {}, "café — ok", 0, 0, 0),
    ("аb", {"aggressive": True}, "ab", 0, 1, 0),
    ("\U0001f3f4\U000e0067\U000e0062\U000e007f \U000e0067", {}, "\U0001f3f4\U000e0067\U000e0062\U000e007f ", 1, 0, 3),
    ("‪‫x‬", {}, "‫x‬", 1, 0, 2) if False else ("‪‭x‬‬", {}, "‪x‬", 2, 0, 2),
    ("葛\U000e0100b\U000e0101", {}, "葛\U000e0100b", 1, 0, 1),
    ("1️⃣", {}, "1️⃣", 0, 0, 1),
]


@pytest.mark.parametrize("k", range(len(CLEAN)))
def test_clean(spark, k):
    text, options, cleaned, removed, replaced, preserved = CLEAN[k]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, t string")
    got = {r.doc_id: r for r in layer_a.clean(docs, **options).collect()}
    assert (got[1].cleaned, got[1].removed, got[1].replaced, got[1].preserved) == (cleaned, removed, replaced, preserved)
    assert got[2].cleaned is None and got[3].cleaned == ""
    again = layer_a.clean(spark.createDataFrame([(1, cleaned)], "doc_id int, t string"), **options).first()
    assert again.cleaned == cleaned


def measured(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(X.words(F.col("t")).alias("w"), X.sentences(F.col("t")).alias("s"), X.phrase_counts(F.col("t")).alias("c"))
    return row.select(F.size("w").alias("n"), "s", X.burstiness(F.col("s")).alias("cv"), X.mattr(F.col("w")).alias("ttr"), X.density(F.col("c"), F.size("w")).alias("d"), "c").first()


def test_style(spark):
    fenced = measured(spark, "One two. Three!\n```\ncode here. more.\n```\nFour five? Six\n\n")
    assert [s.strip() for s in fenced.s] == ["One two.", "Three!", "Four five?", "Six"]
    assert measured(spark, "").cv == 0 and measured(spark, None).ttr == 0
    even = measured(spark, "a b c d e. f g h i j. k l m n o.")
    assert even.cv == 0
    assert measured(spark, "a b. " + "w " * 20 + ". c d.").cv > 0.7
    assert measured(spark, "word " * 100).ttr == pytest.approx(0.02)
    assert measured(spark, " ".join(f"w{k}" for k in range(100))).ttr == 1
    said = measured(spark, "Moreover, it is important to note a testament to a rich tapestry of things.")
    assert sum(said.c) == 4 and said.d == pytest.approx((0.6 + 0.9 + 1.1 + 1.3) / 0.14)
    assert sum(measured(spark, "xmoreover, éa testament to").c) == 0


FINDINGS = [("PNG chunk caBX", "confirmed"), ("info: cms generator: x", "informational"), ("byte-scan C2PA markers", "likely_false_positive"), ("PNG tEXt: Claude", "probable"), ("nothing", "informational")]


def test_findings(spark):
    rows = spark.createDataFrame(FINDINGS, "f string, level string")
    assert rows.where(findings.confidence(F.col("f")) != F.col("level")).count() == 0


# observation, score, threshold, key known, tokens, verdict
DECISIONS = [
    ("DETECTED", 9.2, 0.52, None, None, "DETECTED"), ("DETECTED", 0.54, 0.52, None, None, "DETECTED"), ("DETECTED", None, None, None, None, "DETECTED"),
    ("NOT_DETECTED", 0.25, 0.52, None, 500, "INCONCLUSIVE"), ("NOT_DETECTED", 0.25, 0.52, True, 500, "NOT_DETECTED"), ("NOT_DETECTED", 0.503, 0.52, True, 500, "INCONCLUSIVE"),
    ("NOT_DETECTED", 0.25, 0.52, True, 50, "INCONCLUSIVE"), ("NOT_DETECTED", None, 0.52, True, 500, "ERROR"),
]


def test_decisions(spark):
    rows = spark.createDataFrame(DECISIONS, "seen string, score double, threshold double, known boolean, tokens int, verdict string")
    got = findings.decision(F.col("seen"), F.col("score"), F.col("threshold"), F.col("known"), F.col("tokens"), F.lit(200), F.lit(0.1))
    assert rows.where(got != F.col("verdict")).count() == 0
    worst = spark.createDataFrame([(["VERIFIED", "UNSUPPORTED", "BEST_EFFORT"],), ([],)], "s array<string>").select(findings.worst(F.col("s"))).collect()
    assert [r[0] for r in worst] == ["UNSUPPORTED", "VERIFIED"]


def test_image_risk(spark):
    row = spark.range(1).select(findings.image_risk(F.lit(True), F.lit(True), F.lit(None).cast("double"), F.lit(1)).alias("s"), findings.verdict(F.lit(59)).alias("v")).first()
    assert (row.s, row.v) == (95, "medium")


def test_markup(spark):
    html = '<meta name="generator" content="WordPress"><meta name="generator" content="Claude"><div data-ai-x="1"><img src="data:image/png;base64,QUJD"><img src="data:image/png;base64,!!">'
    rows = spark.createDataFrame([(1, html), (2, None)], "k int, html string")
    got = {r.k: r.f for r in rows.select("k", markup.html_findings(F.col("html")).alias("f")).collect()}
    assert [f.split(":")[0] for f in got[1]] == ["info", "meta", "attr"]
    assert [bytes(r.payload) for r in markup.data_uris(rows, "k", "html").collect()] == [b"ABC"]
    svg = spark.createDataFrame([("<svg><metadata>c2pa</metadata></svg>",)], "s string").select(markup.svg_findings(F.col("s"))).first()[0]
    assert "marker:c2pa" in svg and "svg <metadata> present" in svg
    pdf = spark.createDataFrame([("stream\nClaude\nendstream",), ("/Creator (Claude)",)], "s string").select(markup.pdf_findings(F.col("s"))).collect()
    assert [r[0] for r in pdf] == [[], ["pdf-structured:ai:Claude"]]


def test_sitemap_locations(spark):
    xml = ["<urlset><url><loc> http://a/?x=1&amp;y </loc></url><s:loc xmlns:s='x'>http://b</s:loc></urlset>", "<!DOCTYPE x><loc>http://c</loc>"]
    got = spark.createDataFrame([(x,) for x in xml], "x string").select(files.sitemap_locations(F.col("x"))).collect()
    assert [r[0] for r in got] == [["http://a/?x=1&y", "http://b"], []]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gif").write_bytes(b"GIF89a\1\0\1\0\0\0\0\x3b")
    reports = arrivals.arriving_files(spark, str(tmp_path / "in"))
    arrivals.write_audit(reports, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().format == "gif"


def packed(text, most):
    """The same in plain Python, one unit at a time."""
    import re

    units = []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        units += [p] if 0 < len(p) <= most else [s for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]
    out, now = [], ""
    for u in units:
        if now and len(now) + len(u) + 2 > most:
            out, now = [*out, now], u
        else:
            now = f"{now}\n\n{u}" if now else u
    return [*out, now] if now else out or [text]


def test_chunks(spark):
    texts = ["", "one", "a b.\n\nc d. e f! g?\n \nh" * 3, "long sentence one. " * 20 + "\n\nshort", "  \n\n  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.chunks(F.col("t"), 40)).collect()
    assert [r[0] for r in got] == [packed(t, 40) for t in texts]


def test_nfkc(spark):
    got = spark.createDataFrame([("ﬁ Ａ",), (None,)], "t string").select(X.nfkc(F.col("t"))).collect()
    assert [r[0] for r in got] == ["fi A", None]


def test_long_texts_are_read_whole(spark, tmp_path):
    text = "word " * 400_001 + "\n\nMoreover, the end."
    spark.createDataFrame([(5, "en", text)], "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ask = lambda name: style.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.words, r.distinct_words) for r in ask("words")] == [(400_004, 4)]
    assert [(r.place, r.words) for r in sorted(ask("sentence_lengths"))] == [(0, 400_001), (1, 3)]
    assert [(r.phrase, r.n) for r in ask("phrase_hits")] == [("moreover,", 1)]
    assert [(r.words, r.sentences) for r in ask("stylometry_score")] == [(400_004, 2)]
