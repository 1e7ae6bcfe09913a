"""Queries on style and similarity of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalroom.functions import style
from signalroom.functions import text as X
from signalroom.operators import nearest
from signalroom.rules import phrases as P

from . import views

WHITE = f"[{P.WHITE}]"


def measured(spark, sf_dir):
    """doc_id, lang, and the measures of each text."""
    return views.prose(spark, sf_dir).select("doc_id", "lang", style.measured(F.col("t")).alias("m")).select("doc_id", "lang", "m.*")


def scored(spark, sf_dir):
    rows = measured(spark, sf_dir)
    enough = F.col("words") >= 30
    score = F.when(enough, X.composite(F.col("cv"), F.col("dens"), F.col("ttr"), F.col("words"))).otherwise(0.0)
    return rows.withColumn("score", score).select(
        "doc_id", "lang", "words", "sentences", *[F.round(F.when(enough, F.col(c)).otherwise(0.0), 6).alias(c) for c in ("cv", "dens")], F.round("ttr", 6).alias("ttr"),
        F.round("score", 6).alias("score"), X.tier(F.round("score", 9)).alias("tier"), F.when(enough, "ok").otherwise("insufficient_length").alias("status"),
    )


def words_query(spark, sf_dir):
    docs = views.prose(spark, sf_dir).select("doc_id", X.words(F.col("t")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_words"))


def sentence_lengths(spark, sf_dir):
    docs = views.prose(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("t"))).alias("place", "s"))
    return docs.select("doc_id", F.col("place").cast("bigint").alias("place"), F.regexp_count("s", F.lit(P.WORD)).cast("bigint").alias("words"))


def phrase_hits(spark, sf_dir):
    labels = F.array(*[F.lit(label) for _, label, _ in P.PHRASES])
    docs = views.prose(spark, sf_dir).select("doc_id", F.explode(F.arrays_zip(labels.alias("phrase"), X.phrase_counts(F.col("t")).alias("n"))).alias("h"))
    return docs.where("h.n > 0").select("doc_id", "h.phrase", F.col("h.n").cast("bigint").alias("n"))


def phrase_samples(spark, sf_dir):
    """The first three places of each phrase that a text has, as they are written."""
    docs = views.prose(spark, sf_dir).select("doc_id", F.explode(X.phrase_samples(F.col("t"))).alias("h"))
    bare = F.transform("h.samples", lambda x: F.regexp_replace(x, "^\\W+|\\W+$", ""))
    return docs.select("doc_id", "h.phrase", F.array_join(bare, "|").alias("samples"))


def by_lang(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lang", "tier").agg(F.count("*").alias("docs"), F.round(F.avg("score"), 4).alias("mean_score"))


def ascii_words(column, apostrophe: bool = True):
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[A-Za-z0-9']+" if apostrophe else "[A-Za-z0-9]+"), F.lit(0))


def ngram_diversity(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", ascii_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.round(F.size(X.ngrams(F.col("w"), 3)) / F.greatest(F.size("w") - 2, F.lit(1)), 6).alias("diversity"))


def likely_tokens(spark, sf_dir):
    """Mean log chance of a word by its kind: common, or short to long."""
    chance = lambda w: F.when(w.isin(P.COMMON), 0.9).when(F.length(w) <= 4, 0.6).when(F.length(w) <= 7, 0.4).otherwise(0.2)
    docs = views.table(spark, sf_dir, "documents").select("doc_id", ascii_words(F.col("text")).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, w: a + F.log(chance(w)))
    return docs.select("doc_id", F.round(F.when(F.size("w") > 0, total / F.size("w")).otherwise(0.0), 6).alias("mean_log"))


def turns(spark, sf_dir):
    """Each turn against the one before it in its conversation."""
    rows = views.table(spark, sf_dir, "conversations")
    before = rows.select(F.col("conv_id"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    both = rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", ascii_words(F.col("text"), False).alias("b"), ascii_words(F.col("earlier"), False).alias("a"))
    return both.select("conv_id", "turn", F.round(X.bigram_divergence(F.col("a"), F.col("b")), 6).alias("divergence"))


def shingle_jaccard(spark, sf_dir):
    """Similarity of each document to the next by number, on shingles of three words."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", ascii_words(F.col("text")).alias("w")).select("doc_id", X.ngrams(F.col("w"), 3).alias("g"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h")), "doc_id")
    return pairs.select("doc_id", F.round(X.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


def lexical_diversity(spark, sf_dir):
    """Share of a document's runs of three words that the next document doesn't have."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", ascii_words(F.col("text")).alias("w")).select("doc_id", X.ngrams(F.col("w"), 3).alias("g"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h")), "doc_id")
    shared = F.size(F.array_intersect("g", "h"))
    return pairs.select("doc_id", F.round(F.when(F.size("g") == 0, 0.0).otherwise(1 - shared / F.size("g")), 6).alias("diversity"))


def cosine_next(spark, sf_dir):
    """Cosine of each vector with the next by number."""
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b")))
    return pairs.select("vec_id", F.round(F.when(norms > 0, dot(F.col("a"), F.col("b")) / norms).otherwise(0.0), 6).alias("cosine"))


def cosine_topk(spark, sf_dir, k: int = 5):
    """The k vectors nearest by cosine to each vector whose id is divisible by 100."""
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    number = rows.schema["vec_id"].dataType
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = rows.where(F.col("vec_id").isNotNull() & (dot(F.col("a"), F.col("a")) > 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), "a")
    met = nearest.nearest(rows, rows.where("vec_id % 100 = 0"), k)
    found = met.select(F.col("query_id").cast(number).alias("query_id"), F.col("vec_id").cast(number).alias("vec_id"), F.round("cosine", 6).alias("cosine"))
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("place", F.row_number().over(best).cast("bigint")).where(F.col("place") <= k)


def lexical_diversity_benchmark(spark, sf_dir):
    """Share of a document's runs of three words that its benchmark item, by number in turn, doesn't have."""
    items = views.table(spark, sf_dir, "benchmark").select("item_id", X.ngrams(ascii_words(F.col("text")), 3).alias("h"))
    turn = views.table(spark, sf_dir, "benchmark").agg((F.max("item_id") + 1).alias("n")).first()["n"]
    docs = views.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % F.lit(turn)).alias("item_id"), X.ngrams(ascii_words(F.col("text")), 3).alias("g"))
    shared = F.size(F.array_intersect("g", "h"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(F.when(F.size("g") == 0, 0.0).otherwise(1 - shared / F.size("g")), 6).alias("diversity"))


def pareto(spark, sf_dir):
    """Parts that no other part beats in both size and price: the best price so far, from the largest size down."""
    rows = views.table(spark, sf_dir, "part").groupBy("p_size").agg(F.max("p_retailprice").alias("p_retailprice"))
    best = rows.join(rows.select(F.col("p_size").alias("s"), F.col("p_retailprice").alias("p")), (F.col("s") > F.col("p_size")) & (F.col("p") >= F.col("p_retailprice")), "left_anti")
    return best.select("p_size", "p_retailprice")


PROSE = "WITH docs AS (" + views.PROSE_SQL.format(documents="documents") + "), cut AS (SELECT doc_id, lang, t FROM docs)"
SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{P.LINE_ENDS}', chr(10), 'g'),
  '{P.FENCED}', chr(10), 'g'), '{WHITE}*\\n{WHITE}*', chr(10), 'g'), '([.!?]){WHITE}+|\\n+', '\\1' || chr(30), 'g'), chr(30)), lambda s: regexp_replace(s, '^{WHITE}+|{WHITE}+$', '', 'g')), lambda s: s <> '')"""
COUNTS = "[" + ", ".join("len(regexp_extract_all(t, '{}'))".format(P.re2(p).replace("'", "''")) for p, _, _ in P.PHRASES) + "]"
W = P.WORD.replace("'", "''")
MEASURED = PROSE + f""", parts AS (
  SELECT doc_id, lang, regexp_extract_all(lower(t), '{W}') AS w, {SENTENCES} AS s, {COUNTS} AS c FROM cut),
sized AS (SELECT *, len(w) AS n, list_filter(list_transform(s, lambda x: len(regexp_extract_all(x, '{W}'))), lambda k: k > 0) AS lens FROM parts),
measured AS (
  SELECT doc_id, lang, n AS words, len(s) AS sentences, CASE WHEN len(lens) < 2 THEN 0 ELSE list_stddev_samp(lens) / list_avg(lens) END AS cv,
    CASE WHEN n = 0 THEN 0 WHEN n <= 50 THEN len(list_distinct(w)) / n ELSE list_sum(list_transform(range(1, n - 48), lambda i: len(list_distinct(w[i:i + 49])))) / 50 / (n - 49) END AS ttr,
    CASE WHEN n > 0 THEN list_sum(list_transform(list_zip(c, [{', '.join(str(w) for _, _, w in P.PHRASES)}]), lambda z: z[1] * z[2])) / (n / 100.0) ELSE 0 END AS dens FROM sized)"""
SCORED = MEASURED + """, raw AS (
  SELECT *, CASE WHEN words < 30 THEN 0 ELSE least(1, greatest(0, ((CASE WHEN cv < 0.25 THEN 0.95 WHEN cv < 0.35 THEN 0.8 WHEN cv < 0.45 THEN 0.5 WHEN cv < 0.55 THEN 0.25 ELSE 0.05 END) * 0.45
    + (CASE WHEN dens >= 2 THEN 1 WHEN dens >= 1 THEN 0.75 WHEN dens >= 0.5 THEN 0.45 WHEN dens > 0 THEN 0.2 ELSE 0 END) * 0.45 + (CASE WHEN ttr BETWEEN 0.68 AND 0.76 THEN 0.4 ELSE 0.1 END) * 0.1)
    * (CASE WHEN words < 100 THEN 0.4 + 0.6 * ((words - 30) / 70.0) ELSE 1 END))) END AS score FROM measured),
scored AS (
  SELECT doc_id, lang, words, sentences, round(CASE WHEN words >= 30 THEN cv ELSE 0 END, 6) AS cv, round(CASE WHEN words >= 30 THEN dens ELSE 0 END, 6) AS dens, round(ttr, 6) AS ttr, round(CAST(score AS DOUBLE), 6) AS score,
    CASE WHEN round(CAST(score AS DOUBLE), 9) >= 0.75 THEN 'HIGH' WHEN round(CAST(score AS DOUBLE), 9) >= 0.5 THEN 'MEDIUM' WHEN round(CAST(score AS DOUBLE), 9) >= 0.25 THEN 'LOW' ELSE 'CLEAN' END AS tier, CASE WHEN words >= 30 THEN 'ok' ELSE 'insufficient_length' END AS status FROM raw)"""
GRAMS = "SELECT {id} AS id, regexp_extract_all(lower(coalesce({text}, '')), '[A-Za-z0-9'']+') AS w FROM {table}"
SETS = "WITH a AS (" + GRAMS.format(id="doc_id", text="text", table="documents") + "), g AS (SELECT id, w, CASE WHEN len(w) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM a)"
COMMON_SQL = ", ".join(f"'{w}'" for w in P.COMMON)
BIGRAMS = "CASE WHEN len({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len({0})), lambda i: array_to_string({0}[i:i + 1], ' '))) END"

QUERIES = {
    "phrase_samples": phrase_samples, "words": words_query, "sentence_lengths": sentence_lengths, "burstiness": lambda s, d: scored(s, d).select("doc_id", "cv", "sentences"),
    "mattr": lambda s, d: scored(s, d).select("doc_id", "ttr"), "phrase_hits": phrase_hits, "phrase_density": lambda s, d: scored(s, d).select("doc_id", "dens"),
    "stylometry_score": scored, "stylometry_by_lang": by_lang, "ngram_diversity": ngram_diversity, "heuristic_pll": likely_tokens,
    "bigram_divergence_turns": turns, "shingle_jaccard_pairs": shingle_jaccard, "lexical_diversity_next": lexical_diversity, "cosine_next": cosine_next, "cosine_topk": cosine_topk, "lexical_diversity_benchmark": lexical_diversity_benchmark, "pareto_front": pareto,
}
FIRST = "[" + ", ".join("regexp_extract_all(t, '{}')[1:3]".format(P.re2(p).replace("'", "''")) for p, _, _ in P.PHRASES) + "]"
ORACLES = {
    "phrase_samples": PROSE + f" SELECT doc_id, phrase, array_to_string(list_transform(f, lambda x: regexp_replace(x, '^\\W+|\\W+$', '', 'g')), '|') AS samples FROM (SELECT doc_id, unnest({FIRST}) AS f, unnest([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for _, x, _ in P.PHRASES)}]) AS phrase FROM cut) WHERE len(f) > 0",
    "words": PROSE + f" SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, regexp_extract_all(lower(t), '{W}') AS w FROM cut)",
    "sentence_lengths": PROSE + f" SELECT doc_id, place - 1 AS place, len(regexp_extract_all(x, '{W}')) AS words FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS place FROM (SELECT doc_id, {SENTENCES} AS s FROM cut))",
    "burstiness": SCORED + " SELECT doc_id, cv, sentences FROM scored",
    "mattr": SCORED + " SELECT doc_id, ttr FROM scored",
    "phrase_density": SCORED + " SELECT doc_id, dens FROM scored",
    "phrase_hits": PROSE + f" SELECT doc_id, phrase, n FROM (SELECT doc_id, unnest({COUNTS}) AS n, unnest([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for _, x, _ in P.PHRASES)}]) AS phrase FROM cut) WHERE n > 0",
    "stylometry_score": SCORED + " SELECT * FROM scored",
    "stylometry_by_lang": SCORED + " SELECT lang, tier, count(*) AS docs, round(avg(score), 4) AS mean_score FROM scored GROUP BY lang, tier",
    "ngram_diversity": SETS + " SELECT id AS doc_id, round(len(g) / greatest(len(w) - 2, 1), 6) AS diversity FROM g",
    "heuristic_pll": SETS + f" SELECT id AS doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: ln(CASE WHEN x IN ({COMMON_SQL}) THEN 0.9 WHEN length(x) <= 4 THEN 0.6 WHEN length(x) <= 7 THEN 0.4 ELSE 0.2 END))) / len(w) END, 6) AS mean_log FROM g",
    "bigram_divergence_turns": f"WITH r AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+') AS w FROM conversations), p AS (SELECT b.conv_id, b.turn, a.w AS aw, b.w AS bw, {BIGRAMS.format('a.w')} AS ag, {BIGRAMS.format('b.w')} AS bg FROM r b JOIN r a ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn) SELECT conv_id, turn, round(CASE WHEN len(aw) = 0 AND len(bw) = 0 THEN 0 WHEN len(aw) = 0 OR len(bw) = 0 THEN 1 WHEN len(ag) + len(bg) = 0 THEN 0 ELSE 1 - len(list_intersect(ag, bg)) / (len(ag) + len(bg) - len(list_intersect(ag, bg))) END, 6) AS divergence FROM p",
    "shingle_jaccard_pairs": SETS + " SELECT a.id AS doc_id, round(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END, 6) AS similarity FROM g a JOIN g b ON b.id = a.id + 1",
    "lexical_diversity_next": SETS + " SELECT a.id AS doc_id, round(CASE WHEN len(a.g) = 0 THEN 0 ELSE 1 - len(list_intersect(a.g, b.g)) / len(a.g) END, 6) AS diversity FROM g a JOIN g b ON b.id = a.id + 1",
    "cosine_next": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(CASE WHEN list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) > 0 THEN list_cosine_similarity(a.v, b.v) ELSE 0 END, 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "cosine_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS cosine FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v) > 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM p) WHERE place <= 5",
    "lexical_diversity_benchmark": SETS + ", b AS (SELECT item_id, g AS h FROM (SELECT id AS item_id, CASE WHEN len(w) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM (" + GRAMS.format(id="item_id", text="text", table="benchmark") + "))), n AS (SELECT max(item_id) + 1 AS n FROM benchmark) SELECT g.id AS doc_id, item_id, round(CASE WHEN len(g.g) = 0 THEN 0 ELSE 1 - len(list_intersect(g.g, h)) / len(g.g) END, 6) AS diversity FROM g, n JOIN b ON item_id = g.id % n.n",
    "pareto_front": "WITH r AS (SELECT p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.p_size > a.p_size AND b.p_retailprice >= a.p_retailprice)",
}
