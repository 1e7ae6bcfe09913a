"""Queries on findings, audits, kinds of files and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalroom.functions.hidden import hits_of
from signalroom.operators import findings, layer_a, markup
from signalroom.rules import markers as M
from signalroom.sources import files

from . import hidden, views


def pages(spark, sf_dir):
    return views.marked_pages(spark, sf_dir)


def page_findings(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(markup.html_findings(F.col("html"))).alias("place", "finding"))
    return rows.select("page_id", F.col("place").cast("bigint").alias("place"), "finding", findings.confidence(F.col("finding")).alias("level"))


def page_items(spark, sf_dir):
    """Audit items of pages."""
    rows = pages(spark, sf_dir).select("page_id", F.col("url").alias("path"), markup.html_has_manifest(F.col("html")).alias("has_c2pa"), markup.html_findings(F.col("html")).alias("findings"), files.url_kind(F.col("url"), F.lit("text/html"), F.col("html")).alias("kind"))
    levels = F.transform("findings", findings.confidence)
    return rows.withColumn("levels", levels).withColumn("has_ai", F.exists("findings", lambda f: ~f.startswith("info:"))).withColumn("suspicious_total", F.lit(0))


def text_items(spark, sf_dir):
    """Audit items of documents, from their hidden characters."""
    rows = hidden.docs(spark, sf_dir).select("doc_id", hits_of(F.col("t"), strip_bidi=True).alias("h"))
    found = F.transform("h", lambda x: F.concat(F.lit("layer-a ["), x["kind"], F.lit("] "), F.format_string("U+%04X", x["codepoint"]), F.lit(" x"), x["n"]))
    total = F.aggregate("h.n", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc/"), "doc_id").alias("path"), F.lit(False).alias("has_c2pa"), found.alias("findings"), F.lit("text").alias("kind"), F.transform("h.kind", layer_a.confidence).alias("levels"), F.lit(False).alias("has_ai"), total.alias("suspicious_total"))


def items(spark, sf_dir):
    return page_items(spark, sf_dir).unionByName(text_items(spark, sf_dir))


def audit_items(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.select("path", "kind", "has_c2pa", "has_ai", F.col("suspicious_total").cast("bigint").alias("suspicious_total"), F.size("findings").cast("bigint").alias("findings"), findings.actionable(F.col("has_c2pa"), F.col("levels")).alias("actionable"))


def sarif(spark, sf_dir):
    return findings.sarif_results(items(spark, sf_dir)).groupBy("rule_id", "level").agg(F.count("*").alias("results"), F.countDistinct("uri").alias("uris"))


def by_level(spark, sf_dir):
    """Findings by level, with levels that have none."""
    levels = spark.createDataFrame([(v,) for v in M.LEVELS], "level string")
    counted = items(spark, sf_dir).select(F.explode("levels").alias("level")).groupBy("level").count()
    return F.broadcast(levels).join(counted, "level", "left").select("level", F.coalesce("count", F.lit(0)).cast("bigint").alias("findings"))


SAMPLE_FINDINGS = [
    "PNG chunk caBX (possible C2PA container)", "JPEG APP11 segment", "digitalSourceType: x", "info: cms generator: y", "byte-scan C2PA markers: jumb", "PNG tEXt: Claude",
    "frontmatter key: model", "XMP packet present", "SVG <metadata> present", "customXml parts: 2", "something else", "layer-a [strip] U+00AD x1",
]


def finding_confidence(spark, sf_dir):
    rows = spark.createDataFrame([(f,) for f in SAMPLE_FINDINGS], "finding string")
    return rows.select("finding", findings.confidence(F.col("finding")).alias("level"))


def front_matter(spark, sf_dir):
    text = F.concat(F.lit("---\ntitle: x\n"), F.when(F.col("doc_id") % 2 == 0, "model: m\n").otherwise("author: made with Claude\n"), F.lit("---\n"), "text")
    rows = views.table(spark, sf_dir, "documents").select("doc_id", markup.front_findings(text).alias("f"))
    return rows.select("doc_id", F.array_join("f", "; ").alias("findings"))


def data_uris(spark, sf_dir):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<img src=\"data:image/png;base64,"), F.base64(F.encode(F.concat(F.lit("page "), F.col("page_id")), "UTF-8")), F.lit("\">"))).otherwise("")
    rows = views.table(spark, sf_dir, "pages").select("page_id", F.concat("html", body).alias("html"))
    found = markup.data_uris(rows, "page_id", "html")
    return found.select("page_id", "mime", F.octet_length("payload").cast("bigint").alias("bytes"), F.md5("payload").alias("digest"))


def binding(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"label": "c2pa.soft-binding"} https://contentcredentials.example/manifest/'), "doc_id", F.lit(" "))).when(F.col("doc_id") % 4 == 1, "remote-manifest https://plain.example/x ").otherwise("")
    rows = views.table(spark, sf_dir, "documents").select("doc_id", markup.soft_binding(F.concat(mark, "text")).alias("b"))
    return rows.select("doc_id", "b.has_c2pa", "b.found", F.array_join("b.labels", ",").alias("labels"), F.array_join("b.urls", ",").alias("urls"))


def kinds(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", files.url_kind(F.col("url"), F.when(F.col("page_id") % 7 == 0, "image/png; q=1"), F.col("html")).alias("kind"))


def origins(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages")
    base = F.concat(F.regexp_extract("url", "^[a-z]+", 0), F.lit("://www.thering.example.org/"))
    return rows.select("page_id", files.origin(F.col("url")).alias("origin"), files.same_origin(F.col("url"), base).alias("allowed"))


def guard(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("61006200"))).when(F.col("doc_id") % 5 == 2, F.unhex(F.lit("504B0304")))
    content = F.when(lead.isNotNull(), F.concat(lead, F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    path = F.concat(F.lit("a/b"), F.col("doc_id") % 3, F.when(F.col("doc_id") % 6 == 0, ".PDF").when(F.col("doc_id") % 6 == 1, ".md").otherwise(""))
    return views.table(spark, sf_dir, "documents").select("doc_id", files.binary_reason(content).alias("reason"), files.asset_kind(path, content).alias("kind"), files.image_format(content).alias("format"))


def risk(spark, sf_dir):
    rows = hidden.docs(spark, sf_dir).select("doc_id", hits_of(F.col("t"), strip_bidi=True).alias("h"))
    score = findings.text_risk(F.col("h.kind"))
    return rows.select("doc_id", score.cast("bigint").alias("score"), findings.verdict(score).alias("verdict"))


def decisions(spark, sf_dir):
    k = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "DETECTED").otherwise("NOT_DETECTED").alias("seen"), F.when(k % 11 != 0, (k % 100) / 100.0).alias("score"), F.when(k % 13 != 0, 0.52).alias("threshold"), (k % 3 > 0).alias("known"), F.when(k % 7 != 0, k % 500).alias("tokens"))
    return rows.select("event_id", findings.decision(F.col("seen"), F.col("score"), F.col("threshold"), F.col("known"), F.col("tokens"), F.lit(200), F.lit(0.1)).alias("verdict"))


def statuses(spark, sf_dir):
    k = F.col("event_id")
    rank = findings.detector_rank(k % 3 != 0, k % 2 == 0, F.when(k % 17 == 0, True).when(k % 5 == 0, False), F.when(k % 4 == 1, "NOT_DETECTED").when(k % 4 == 2, "INCONCLUSIVE").when(k % 29 == 0, "DETECTED"))
    rows = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(rank).alias("r"), F.collect_set(F.element_at(F.array(*map(F.lit, findings.STATUSES)), (k % 5 + 1).cast("int"))).alias("s"))
    return rows.select("user_id", findings.detector_status(F.col("r")).alias("status"), findings.worst(F.col("s")).alias("worst"))


SITEMAP = "WITH map AS (SELECT 'root' AS parent, concat('part', CAST(page_id % 5 AS STRING)) AS loc FROM {pages} UNION SELECT concat('part', CAST(page_id % 5 AS STRING)), url FROM {pages})"
WALK = SITEMAP.replace("WITH map", "WITH RECURSIVE map") + ", walk(loc, depth) AS (SELECT 'root', 0 UNION ALL SELECT m.loc, w.depth + 1 FROM walk w JOIN map m ON m.parent = w.loc WHERE w.depth < 3) SELECT loc, min(depth) AS depth FROM walk GROUP BY loc"


def walk(spark, sf_dir):
    """Pages reached from a sitemap index, at most three steps deep."""
    return spark.sql(WALK, pages=views.table(spark, sf_dir, "pages"))


PAGES = "WITH pages2 AS (" + views.PAGES_SQL.format(pages="pages") + ")"
q = lambda s: s.replace("'", "''")
CONFIDENCE = "CASE WHEN " + " OR ".join(f"contains(lower({{0}}), '{q(x)}')" for x in M.CONFIRMED) + " THEN 'confirmed' WHEN starts_with(lower({0}), 'info:') OR " + " OR ".join(f"contains(lower({{0}}), '{q(x)}')" for x in M.CONTEXT) + " THEN 'informational' WHEN contains(lower({0}), 'byte-scan') THEN 'likely_false_positive' WHEN " + " OR ".join(f"contains(lower({{0}}), '{q(x)}')" for x in M.PROBABLE) + " THEN 'probable' ELSE 'informational' END"
ATTR = f"list_filter(list_zip(regexp_extract_all(g, '(?i){q(M.ATTRIBUTE)}', 1), regexp_extract_all(g, '(?i){q(M.ATTRIBUTE)}', 2)), lambda z: lower(z[1]) = '{{0}}')"
NAMED = "lower(coalesce(" + ", ".join(f"nullif(({ATTR.format(n)})[-1][2], '')" for n in ("name", "property", "generator")) + ", ''))"
LD = "'(?is)<script\\b[^>]*application/ld\\+json[^>]*>.*?</script>'"
BLOCK = f"regexp_matches(b, '(?i){M.NAMES}|DigitalSourceType|trainedAlgorithmicMedia|SoftwareAgent')"
FINDINGS = f"""list_concat(list_concat(
  list_filter(list_transform(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda g: CASE WHEN {NAMED} = 'generator' AND NOT regexp_matches(g, '(?i){M.MAKERS}') THEN 'info: cms generator: ' || left(g, 120)
    WHEN regexp_matches(g, '(?i){M.NAMES}|{M.TAG_HINTS}') THEN 'meta: ' || left(g, 120) END), lambda f: f IS NOT NULL),
  list_transform(list_filter(regexp_extract_all(html, {LD}), lambda b: {BLOCK}), lambda b: 'json-ld provenance-like block')),
  list_transform(regexp_extract_all(html, '(?i)\\bdata-ai[\\w-]*\\s*=\\s*["''][^"'']*["'']'), lambda a: 'attr: ' || left(a, 80)))"""
FOUND = PAGES + f", found AS (SELECT page_id, url, {FINDINGS} AS f, len(list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda g: regexp_matches(g, '(?i)c2pa|content.?credential'))) > 0 OR len(list_filter(regexp_extract_all(html, {LD}), lambda b: {BLOCK} AND regexp_matches(b, '(?i)c2pa|contentcredential'))) > 0 AS has_c2pa FROM pages2)"
TEXT_HITS = hidden.HITS
ITEMS = TEXT_HITS + ", " + FOUND.removeprefix("WITH ") + f""", msgs AS (
  SELECT url AS path, 'p' || page_id AS id, unnest(f) AS msg, has_c2pa FROM found),
graded AS (SELECT path, id, msg, has_c2pa, {CONFIDENCE.format('msg')} AS level FROM msgs
  UNION ALL SELECT 'doc/' || doc_id, 'd' || doc_id, printf('layer-a [%s] U+%04X x%d', kind, codepoint, n), false, CASE WHEN kind = 'space' THEN 'informational' ELSE 'probable' END FROM hits),
items AS (
  SELECT url AS path, 'p' || page_id AS id, 'html' AS kind, has_c2pa, len(list_filter(f, lambda x: NOT starts_with(x, 'info:'))) > 0 AS has_ai, 0 AS suspicious_total FROM found
  UNION ALL SELECT 'doc/' || d.doc_id, 'd' || d.doc_id, 'text', false, false, coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = d.doc_id), 0) FROM docs d),
totals AS (SELECT id, count(*) AS findings, count_if(level IN ('confirmed', 'probable')) AS strong FROM graded GROUP BY id),
whole AS (SELECT i.*, coalesce(findings, 0) AS findings, has_c2pa OR coalesce(strong, 0) > 0 AS actionable FROM items i LEFT JOIN totals s ON s.id = i.id)
"""
RULED = """, ruled AS (SELECT path, level, CASE WHEN contains(lower(msg), 'c2pa') OR contains(lower(msg), 'jumbf') OR has_c2pa THEN 'AI-WATERMARK-C2PA' WHEN contains(lower(msg), 'layer-a') THEN 'AI-WATERMARK-UNICODE-LAYER-A'
  WHEN contains(lower(msg), 'stylometry') THEN 'AI-STYLES-HIGH-PROBABILITY' ELSE 'AI-WATERMARK-METADATA' END AS rule_id FROM graded)"""
PATH = "lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"
HOST, PORT = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))", "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1)"
ORIGIN = "lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || " + HOST + " || ':' || CASE WHEN " + PORT + " <> '' THEN " + PORT + " WHEN starts_with({0}, 'https') THEN '443' ELSE '80' END"

QUERIES = {
    "html_meta_findings": page_findings, "audit_items": audit_items, "audit_summary": lambda s, d: findings.summary(items(s, d)),
    "audit_by_kind": lambda s, d: findings.by_kind(items(s, d)).select("kind", F.col("count").alias("items")), "findings_by_confidence": by_level, "sarif_results": sarif,
    "audit_exit_code": lambda s, d: findings.exit_code(items(s, d), F.lit(False)).select(F.col("exit_code").cast("bigint").alias("exit_code")), "finding_confidence": finding_confidence,
    "markdown_frontmatter_keys": front_matter, "data_uri_extract": data_uris, "soft_binding": binding, "url_kind": kinds, "same_origin": origins, "binary_guard": guard,
    "risk_score": risk, "detector_decision": decisions, "detector_status": statuses, "sitemap_recursive": walk,
}
ORACLES = {
    "html_meta_findings": FOUND + f" SELECT page_id, place - 1 AS place, finding, {CONFIDENCE.format('finding')} AS level FROM (SELECT page_id, unnest(f) AS finding, generate_subscripts(f, 1) AS place FROM found)",
    "audit_items": ITEMS + "SELECT path, kind, has_c2pa, has_ai, CAST(suspicious_total AS BIGINT) AS suspicious_total, findings, actionable FROM whole",
    "audit_summary": ITEMS + "SELECT (SELECT count(*) FROM whole) AS total, (SELECT count(*) FROM whole WHERE has_c2pa) AS with_c2pa, (SELECT count(*) FROM whole WHERE has_ai) AS with_ai, (SELECT count(*) FROM whole WHERE suspicious_total > 0) AS with_suspicious_text, (SELECT count(*) FROM whole WHERE actionable) AS actionable, " + ", ".join(f"(SELECT count(*) FROM graded WHERE level = '{v}') AS {v}" for v in M.LEVELS),
    "audit_by_kind": ITEMS + "SELECT kind, count(*) AS items FROM whole GROUP BY kind",
    "findings_by_confidence": ITEMS + "SELECT v.level, count(l.level) AS findings FROM (VALUES " + ", ".join(f"('{v}')" for v in M.LEVELS) + ") v(level) LEFT JOIN graded l ON l.level = v.level GROUP BY v.level",
    "sarif_results": ITEMS + RULED + " SELECT rule_id, CASE WHEN rule_id = 'AI-WATERMARK-C2PA' THEN 'error' WHEN rule_id LIKE '%LAYER-A' THEN CASE WHEN level IN ('confirmed', 'probable') THEN 'warning' ELSE 'note' END WHEN rule_id LIKE 'AI-STYLES%' THEN 'note' WHEN level = 'confirmed' THEN 'error' WHEN level = 'informational' THEN 'note' ELSE 'warning' END AS level, count(*) AS results, count(DISTINCT path) AS uris FROM ruled GROUP BY 1, 2",
    "audit_exit_code": ITEMS + "SELECT CAST(max(CASE WHEN actionable THEN 1 ELSE 0 END) AS BIGINT) AS exit_code FROM whole",
    "finding_confidence": "SELECT finding, " + CONFIDENCE.format("finding") + " AS level FROM (VALUES " + ", ".join(f"('{q(x)}')" for x in SAMPLE_FINDINGS) + ") v(finding)",
    "markdown_frontmatter_keys": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'frontmatter key: model' ELSE 'frontmatter value hit on author' END AS findings FROM documents",
    "data_uri_extract": "SELECT page_id, 'png' AS mime, strlen('page ' || page_id) AS bytes, md5('page ' || page_id) AS digest FROM pages WHERE page_id % 3 = 0",
    "soft_binding": "SELECT doc_id, doc_id % 4 = 0 OR regexp_matches(text, '(?i)" + "|".join(m.replace(".", "\\.") for m in M.MANIFEST) + "') AS has_c2pa, doc_id % 4 = 0 AS found, CASE WHEN doc_id % 4 = 0 THEN 'c2pa.soft-binding' ELSE '' END AS labels, CASE WHEN doc_id % 4 = 0 THEN 'https://contentcredentials.example/manifest/' || doc_id ELSE '' END AS urls FROM documents",
    "url_kind": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'png' " + " ".join(f"WHEN ends_with({PATH}, '.{x}') THEN '{k}'" for x, k in files.SUFFIXES) + " WHEN starts_with(lower(html), '%pdf') THEN 'pdf' WHEN starts_with(ltrim(left(html, 100)), '<') AND contains(lower(left(html, 500)), 'svg') THEN 'svg' WHEN contains(lower(left(html, 2000)), '<html') OR starts_with(ltrim(left(html, 100)), '<') THEN 'html' ELSE 'text' END AS kind FROM pages",
    "same_origin": f"WITH o AS (SELECT page_id, {ORIGIN.format('url')} AS origin, regexp_extract(url, '^[a-z]+') AS scheme FROM pages) SELECT page_id, origin, origin = scheme || '://www.thering.example.org:' || CASE WHEN scheme = 'https' THEN '443' ELSE '80' END OR (scheme = 'http' AND origin = 'https://www.thering.example.org:443') AS allowed FROM o",
    "binary_guard": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a PNG image' WHEN 1 THEN 'binary data (contains NUL bytes)' WHEN 2 THEN 'a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)' WHEN 3 THEN CASE WHEN starts_with(text, 'BM') THEN 'a BMP image' WHEN starts_with(text, 'MM') THEN NULL END END AS reason, CASE WHEN doc_id % 6 <= 1 THEN 'container' WHEN doc_id % 5 = 0 THEN 'image' WHEN doc_id % 5 = 2 OR contains(left(text, 4092), '# ') THEN 'container' ELSE 'unknown' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'png' ELSE 'unknown' END AS format FROM documents",
    "risk_score": hidden.HITS + ", k AS (SELECT doc_id, count(DISTINCT kind) AS n FROM hits GROUP BY doc_id), r AS (SELECT d.doc_id, 5 + least(60, 20 * coalesce(n, 0)) AS score FROM docs d LEFT JOIN k ON k.doc_id = d.doc_id) SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'medium' ELSE 'high' END AS verdict FROM r",
    "detector_decision": "WITH e AS (SELECT event_id, event_id % 4 = 0 AS seen, CASE WHEN event_id % 11 <> 0 THEN (event_id % 100) / 100.0 END AS score, CASE WHEN event_id % 13 <> 0 THEN 0.52 END AS threshold, event_id % 3 > 0 AS known, CASE WHEN event_id % 7 <> 0 THEN event_id % 500 END AS tokens FROM events) SELECT event_id, CASE WHEN seen THEN 'DETECTED' WHEN score IS NULL OR threshold IS NULL THEN 'ERROR' WHEN abs(score - threshold) / threshold < 0.1 OR NOT known OR tokens IS NULL OR tokens < 200 THEN 'INCONCLUSIVE' ELSE 'NOT_DETECTED' END AS verdict FROM e",
    "detector_status": "WITH e AS (SELECT user_id, event_id AS k FROM events), r AS (SELECT user_id, k % 5 AS s, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 2 WHEN k % 3 = 0 THEN 0 WHEN k % 17 = 0 OR (k % 29 = 0 AND k % 4 NOT IN (1, 2)) THEN 3 WHEN k % 4 = 1 OR (k % 17 <> 0 AND k % 5 = 0 AND k % 4 <> 2) THEN 1 ELSE 2 END AS rank FROM e) SELECT user_id, (['NOT_RUN', 'NOT_DETECTED', 'INCONCLUSIVE', 'DETECTED'])[max(rank) + 1] AS status, (['VERIFIED', 'BEST_EFFORT', 'RESIDUAL_RISK', 'UNSUPPORTED', 'FAILED'])[max(s) + 1] AS worst FROM r GROUP BY user_id",
    "sitemap_recursive": WALK.format(pages="pages").replace("STRING", "VARCHAR"),
}
