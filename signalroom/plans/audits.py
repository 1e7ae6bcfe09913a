"""Queries on landed files: inspection by format, items, reports, and what selects and surrounds inputs.

The expected values of the files' reports are written out by file in EXPECTED; they come from the formats'
rules, not from the code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from signalroom.functions import text as X
from signalroom.operators import audit, detectors, findings, layer_a, markup, selection
from signalroom.sources import files

from . import hidden, samples, views

INFO, PROBABLE, CONFIRMED = "informational", "probable", "confirmed"
#: By place in SAMPLES: kind, has_c2pa, has_ai, suspicious characters, findings and levels.
EXPECTED: list[tuple[str, bool, bool, int, list[tuple[str, str]]]] = [
    ("png", False, False, 0, []), ("png", True, True, 0, [("PNG chunk caBX (possible C2PA container)", CONFIRMED)]), ("png", False, False, 0, [("CRC mismatch in chunk IDAU", INFO)]),
    ("png", False, False, 0, [("multiple IHDR chunks", INFO)]), ("png", False, False, 0, [("missing IDAT", INFO)]), ("jpeg", False, True, 0, [("JPEG APP1: trainedAlgorithmicMedia, algorithmicMedia", CONFIRMED)]),
    ("jpeg", True, True, 0, [("JPEG APP11: c2pa, jumb", PROBABLE)]), ("webp", False, True, 0, [("WebP XMP : SynthID", PROBABLE)]), ("bmp", False, True, 0, [("BMP trailing metadata: Generated by", INFO)]),
    ("gif", False, True, 0, [("GIF comment: AIGC", INFO)]), ("tiff", False, True, 0, [("TIFF tag 305: OpenAI", INFO), ("TIFF tag 305 (Software) present", INFO)]),
    ("heif", True, True, 0, [("brands: heic", INFO), ("C2PA/JUMBF box 'uuid' at offset 20", INFO), ("no iinf item table (or unsupported version)", INFO)]),
    ("avif", False, False, 0, [("brands: avif", INFO), ("no iinf item table (or unsupported version)", INFO)]), ("pdf", False, False, 0, []), ("pdf", False, True, 0, [("pdf-structured: ai:Generated by, ai:Claude", PROBABLE)]),
    ("docx", False, False, 0, []), ("docx", False, True, 0, [("docProps/app.xml: ai:Claude", PROBABLE)]), ("xlsx", False, True, 0, [("xl/media/image1.png: PNG tEXt: AI generator (Software=ChatGPT)", PROBABLE)]),
    ("odt", False, True, 0, [("meta.xml generator-like fields", INFO)]), ("epub", False, True, 0, [("a.xhtml: ai:SynthID", PROBABLE)]), ("zip", False, False, 0, [("not a valid zip zip: File is not a zip file", INFO)]),
    ("svg", False, False, 0, [("svg <metadata> present", INFO)]), ("text", False, False, 3, [("layer-a [zwj_family] U+200B ZERO WIDTH SPACE (Cf) x2", PROBABLE), ("layer-a [strip] U+00AD SOFT HYPHEN (Cf) x1", PROBABLE)]),
    ("text", False, False, 0, []), ("markdown", False, True, 0, [("frontmatter key: model", PROBABLE)]), ("html", False, True, 0, [("embedded data:image/png: PNG tEXt: AI generator (Software=ChatGPT)", PROBABLE)]),
    ("html", False, False, 0, [("info: cms generator: <meta name='generator' content='WordPress 6'>", INFO)]), ("text", False, False, 0, []), ("unknown", False, False, 0, []), ("error", False, False, 0, []),
    ("text", False, False, 1, [("stylometry [high_probability] score 0.89 (HIGH)", PROBABLE)]),
]
KINDS = ["png", "jpeg", "webp", "bmp", "gif", "tiff", "heif", "avif", "pdf", "docx", "xlsx", "odt", "epub", "zip", "svg", "text", "markdown", "html"]


def items(spark, sf_dir):
    return audit.items(samples.landed(spark, sf_dir), stylometry=True)


def reports(spark, sf_dir):
    found = items(spark, sf_dir)
    return found.select("path", "kind", "has_c2pa", "has_ai", "suspicious_total", F.array_join("findings", "; ").alias("findings"), F.array_join("levels", ",").alias("levels"), "skipped")


def magic(spark, sf_dir):
    """Raster formats by first bytes."""
    return samples.landed(spark, sf_dir).select("path", files.image_format(F.col("content")).alias("format"))


def of_kind(kind):
    return lambda spark, sf_dir: reports(spark, sf_dir).where(F.col("kind") == kind).drop("kind", "skipped")


def sarif(spark, sf_dir):
    """What the SARIF documents hold, read back from their JSON."""
    schema = "`$schema` string, version string, runs array<struct<tool struct<driver struct<name string, rules array<struct<id string>>>>, results array<struct<ruleId string, level string, message struct<text string>>>>>"
    docs = audit.sarif_documents(items(spark, sf_dir)).select(F.from_json("sarif", schema).alias("s"))
    rows = docs.select("s.version", F.size(F.col("s.runs")[0]["tool"]["driver"]["rules"]).alias("rules"), F.explode(F.col("s.runs")[0]["results"]).alias("r"))
    return rows.groupBy("version", F.col("rules").cast("bigint").alias("rules"), F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level")).agg(F.count("*").alias("results"))


def lines(spark, sf_dir):
    return audit.human_lines(items(spark, sf_dir)).select("path", F.col("place").cast("bigint").alias("place"), "line")


def json_items(spark, sf_dir):
    told = audit.item_json(items(spark, sf_dir)).select("path", F.from_json("item", "kind string, findings array<string>, skipped boolean").alias("j"))
    return told.select("path", "j.kind", F.size("j.findings").cast("bigint").alias("findings"), "j.skipped")


def kind_of_risk(spark, sf_dir):
    """Whether a risk is judged from an image's marks or from text, and an image's score."""
    rows = items(spark, sf_dir)
    image = F.col("kind").isin("png", "jpeg", "heif", "avif")
    score = findings.image_risk(F.col("has_c2pa"), F.col("has_ai"), F.lit(0.0), F.size("findings"))
    return rows.select("path", F.when(image, "image").otherwise("text").alias("judged_as"), F.when(image, score).cast("bigint").alias("score"))


#: Texts in turn by doc_id: overlapping windows of two marks, a label that isn't structured, a structured one, addresses too far away or of other kinds, and no manifest.
BINDINGS = [
    ("c2pa remote-manifest" + "." * 4000 + "REMOTE-MANIFEST " + "." * 3000 + " https://a.example/manifest/1 ", True, True, "", "https://a.example/manifest/1"),
    ("c2pa the words c2pa.soft-binding https://b.example/manifest/2 ", True, False, "", ""),
    ("jumb {'label' : 'C2PA.soft-binding'} https://c.example/verify) https://c.example/other ", True, True, "c2pa.soft-binding", "https://c.example/verify"),
    ("c2pa remote_manifest" + "." * 5000 + " https://d.example/manifest ", True, False, "", ""),
    ("remote-manifest https://e.example/credential ", False, False, "", "https://e.example/credential"),
    ("c2pa https://f.example/c2pa" + "." * 200 + " remote-manifest ", True, True, "", "https://f.example/c2pa" + "." * 200),
]


def bindings(spark, sf_dir):
    table = spark.createDataFrame([(k, b[0]) for k, b in enumerate(BINDINGS)], "k int, mark string")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(BINDINGS)).cast("int").alias("k"))
    rows = docs.join(F.broadcast(table), "k").select("doc_id", markup.soft_binding(F.col("mark")).alias("b"))
    return rows.select("doc_id", "b.has_c2pa", "b.found", F.array_join("b.labels", ",").alias("labels"), F.array_join("b.urls", ",").alias("urls"))


#: Payloads in turn by page_id, and the bytes they stand for, in hexadecimal; none for a corrupt one.
PAYLOADS = [(";base64,AAEC", "000102"), (";base64,AA E=", "0001"), (";base64,AAECA", None), (",a+b%FF%41%zz", "612B62FF41257A7A"), (";charset=x;base64,/+8", "FFEF"), (",%e2%82%ac", "E282AC")]


def payloads(spark, sf_dir):
    text = F.concat(F.lit("<img src='data:image/X"), F.element_at(F.array(*[F.lit(p) for p, _ in PAYLOADS]), (F.col("page_id") % len(PAYLOADS) + 1).cast("int")), F.lit("'>"))
    found = markup.data_uris(views.table(spark, sf_dir, "pages").select("page_id", text.alias("t")), "page_id", "t")
    return found.select("page_id", "mime", F.hex("payload").alias("payload"))


def detector_reports(spark, sf_dir):
    """Reports of each document by each detector, with settings in turn by doc_id."""
    key = lambda k, name: F.when(F.col("doc_id") % k == 0, F.map_from_arrays(F.array(F.lit(name)), F.array(F.lit(" x ")))).otherwise(F.create_map().cast("map<string,string>"))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return detectors.reports(docs, F.map_concat(key(2, "gemini_key"), key(3, "markllm_dir")))


#: Replies in turn by page_id: body, is_watermarked, score, error.
REPLIES = [
    ('{"candidates":[{"content":{"parts":[{"text":"Likely AI-generated"}]}}]}', "true", None, None), ('{"candidates":[{"content":{"parts":[{"text":"Not watermarked"}]},"score":0.9}]}', "false", 0.9, None),
    ('{"candidates":[{"attributionMetadata":{"syntheticText":{"confidence":0.5}}}]}', "true", 0.5, None), ('{"candidates":[{"index":0}],"score":0.25}', "false", 0.25, None),
    ('{"promptFeedback":{"blockReason":"SAFETY"}}', None, None, "blocked: SAFETY"), ('{"candidates":[]}', None, None, "no candidates"), ('{"candidates":[{"index":0}]}', None, None, "no verdict or score"), ("no json", None, None, "no candidates"),
]


def replies(spark, sf_dir):
    body = F.element_at(F.array(*[F.lit(r[0]) for r in REPLIES]), (F.col("page_id") % len(REPLIES) + 1).cast("int"))
    return views.table(spark, sf_dir, "pages").select("page_id", detectors.reply(body).alias("r")).select("page_id", "r.is_watermarked", "r.score", "r.error")


def selected(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.when(k % 3 == 0, "in/./a/").when(k % 3 == 1, "in/a/b/../").otherwise("in/skip/"), (k - k % 3).cast("string"), F.when(k % 5 == 0, ".PNG").when(k % 5 == 1, ".exe").otherwise(".md"))
    return selection.select_inputs(views.table(spark, sf_dir, "documents").select("doc_id", name.alias("path")), ["png", "md"], ["in/skip/"]).select("path", "resolved")


def outputs(spark, sf_dir):
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("a/../x"), k)).when(k % 4 == 1, F.concat(F.lit("x//"), k - k % 8)).when(k % 4 == 2, F.concat(F.lit("/x"), k)).otherwise(F.concat(F.lit("./y"), k))
    return selection.output_status(views.table(spark, sf_dir, "documents").select("doc_id", name.alias("relative")), "out/").select("doc_id", "output", "status")


def sidecars(spark, sf_dir):
    k = F.col("doc_id")
    docs = views.table(spark, sf_dir, "documents")
    own = docs.select(F.concat(F.lit("f"), k).alias("path"), F.lit(1).cast("bigint").alias("length"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    told = F.when(k % 4 == 0, '{"scheme":"kgw"}').when(k % 4 == 1, "not json")
    side = docs.where(k % 4 < 3).select(F.concat(F.lit("f"), k, F.lit(".wm.json")).alias("path"), F.when(k % 4 == 2, 2_000_000).otherwise(20).cast("bigint").alias("length"), F.encode(told, "UTF-8").alias("content"))
    found = selection.with_sidecars(own.unionByName(side))
    return found.select("path", F.col("sidecar").isNotNull().alias("has_sidecar"), F.col("sidecar")["scheme"].alias("scheme"))


def settings(spark, sf_dir):
    k = F.col("event_id")
    one = selection.setting(F.when(k % 2 == 0, "e"), F.when(k % 3 == 0, ""), F.when(k % 5 == 0, "p"), F.lit("d"))
    return views.table(spark, sf_dir, "events").select("event_id", one.alias("s")).select("event_id", "s.value", "s.source")


def fronts(spark, sf_dir):
    rows = views.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return selection.fronts(rows, "p_brand", "p_size", "p_retailprice").select("p_partkey", "front")


def walk(spark, sf_dir):
    """The first pages that a root sitemap leads to, through parsed indexes; a foreign one is an error."""
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.format_string("https://s.example/p%06d", "page_id").alias("loc"), F.format_string("https://s.example/m%d.xml", F.col("page_id") % 4).alias("url"))
    xml = lambda tag, inner: F.encode(F.concat(F.lit(f"<?xml version='1.0'?><{tag} xmlns='http://x'>"), inner, F.lit(f"</{tag}>")), "UTF-8")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("loc")), lambda x: F.concat(F.lit("<url><loc> "), x, F.lit(" </loc></url>"))), "")
    maps = pages.groupBy("url").agg(listed.alias("inner")).select("url", xml("urlset", F.col("inner")).alias("content"))
    index = [f"https://s.example/m{k}.xml" for k in range(4)] + ["https://elsewhere.example/m.xml"]
    root = spark.range(1).select(F.lit("https://s.example/root.xml").alias("url"), xml("sitemapindex", F.lit("".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in index))).alias("content"))
    return files.walk_sitemaps(files.sitemaps(maps.unionByName(root)), "https://s.example/root.xml", 150)


def decoded(spark, sf_dir):
    k = F.col("doc_id")
    content = F.when(k % 4 == 0, F.unhex(F.lit("61FF62"))).when(k % 4 == 1, F.unhex(F.lit("255044462D"))).when(k % 4 == 2, F.lit(b"")).otherwise(F.encode(F.lit("é"), "UTF-8"))
    return views.table(spark, sf_dir, "documents").select("doc_id", files.decoded(content, k % 8 == 5).alias("d")).select("doc_id", "d.text", "d.valid", "d.refused")


def labels(spark, sf_dir):
    found = layer_a.inspect(hidden.docs(spark, sf_dir)).select("codepoint").distinct()
    return found.select("codepoint", X.code_point_label(F.col("codepoint")).alias("label"))


def ordered_hits(spark, sf_dir):
    """Hits of each document in the order of reports: most frequent first, then by code point."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "codepoint", "kind")
    return layer_a.inspect(hidden.docs(spark, sf_dir)).select("doc_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"), "codepoint", "kind", "n")


text_ = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
N = len(samples.SAMPLES)
ITEMS = (
    "WITH s(k, name, kind, has_c2pa, has_ai, suspicious_total, findings, levels, n) AS (VALUES "
    + ", ".join(f"({k}, {text_(name)}, {text_(e[0])}, {e[1]}, {e[2]}, {e[3]}, {text_('; '.join(f for f, _ in e[4]))}, {text_(','.join(v for _, v in e[4]))}, {len(e[4])})" for k, ((name, _), e) in enumerate(zip(samples.SAMPLES, EXPECTED, strict=True)))
    + f"), items AS (SELECT 'f' || page_id || '/' || name AS path, s.* FROM pages JOIN s ON page_id % {N} = k)"
)
EACH = ITEMS + ", each(k, place, finding, level) AS (VALUES " + ", ".join(f"({k}, {p}, {text_(f)}, {text_(v)})" for k, e in enumerate(EXPECTED) for p, (f, v) in enumerate(e[4])) + ")"
RULE = "CASE WHEN has_c2pa OR contains(lower(finding), 'c2pa') THEN 'AI-WATERMARK-C2PA' WHEN starts_with(finding, 'layer-a') THEN 'AI-WATERMARK-UNICODE-LAYER-A' WHEN starts_with(finding, 'stylometry') THEN 'AI-STYLES-HIGH-PROBABILITY' ELSE 'AI-WATERMARK-METADATA' END"
# Names of the code points that the marked documents hold.
NAMES = {
    0x00AD: "SOFT HYPHEN (Cf)", 0x034F: "COMBINING GRAPHEME JOINER (Mn)", 0x0600: "ARABIC NUMBER SIGN (Cf)", 0x115F: "HANGUL CHOSEONG FILLER (Lo)", 0x1160: "HANGUL JUNGSEONG FILLER (Lo)", 0x17B4: "KHMER VOWEL INHERENT AQ (Mn)",
    0x180B: "MONGOLIAN FREE VARIATION SELECTOR ONE (Mn)", 0x200B: "ZERO WIDTH SPACE (Cf)", 0x200C: "ZERO WIDTH NON-JOINER (Cf)", 0x200D: "ZERO WIDTH JOINER (Cf)", 0x202A: "LEFT-TO-RIGHT EMBEDDING (Cf)", 0x202B: "RIGHT-TO-LEFT EMBEDDING (Cf)",
    0x202C: "POP DIRECTIONAL FORMATTING (Cf)", 0x202D: "LEFT-TO-RIGHT OVERRIDE (Cf)", 0x202E: "RIGHT-TO-LEFT OVERRIDE (Cf)", 0x2060: "WORD JOINER (Cf)", 0x2062: "INVISIBLE TIMES (Cf)", 0x3000: "IDEOGRAPHIC SPACE (Zs)", 0xFE0F: "VARIATION SELECTOR-16 (Mn)",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE (Cf)", 0xE0062: "TAG LATIN SMALL LETTER B (Cf)", 0xE0067: "TAG LATIN SMALL LETTER G (Cf)", 0xE007F: "CANCEL TAG (Cf)", 0xE0101: "VARIATION SELECTOR-18 (Mn)", 0x00A0: "NO-BREAK SPACE (Zs)", 0x2061: "FUNCTION APPLICATION (Cf)", 0x2003: "EM SPACE (Zs)", 0x202F: "NARROW NO-BREAK SPACE (Zs)", 0xE000: "UNKNOWN (Co)",
}
SELECTED = "CASE doc_id % 3 WHEN 0 THEN 'in/./a/' WHEN 1 THEN 'in/a/b/../' ELSE 'in/skip/' END || (doc_id - doc_id % 3) || CASE WHEN doc_id % 5 = 0 THEN '.PNG' WHEN doc_id % 5 = 1 THEN '.exe' ELSE '.md' END"
RELATIVE = "CASE doc_id % 4 WHEN 1 THEN 'out/x/' || (doc_id - doc_id % 8) WHEN 3 THEN 'out/y' || doc_id END"

QUERIES = {
    "magic_classify": magic, "file_reports": reports, **{f"inspect_{k}": of_kind(k) for k in KINDS},
    "file_audit_summary": lambda s, d: findings.summary(items(s, d)), "file_audit_exit_code": lambda s, d: audit.exit_code(items(s, d)).select(F.col("exit_code").cast("bigint").alias("exit_code")),
    "file_sarif": sarif, "file_lines": lines, "file_json": json_items, "file_suspicious": lambda s, d: audit.suspicious(items(s, d)), "file_notes": lambda s, d: items(s, d).select("path", F.array_join("notes", ";").alias("notes"), "error"),
    "file_risk": kind_of_risk, "soft_binding_windows": bindings, "data_uri_bytes": payloads, "input_selection": selected, "output_paths": outputs, "sidecar_join": sidecars, "detector_reports": detector_reports, "detector_replies": replies, "inspect_roll_up": lambda s, d: audit.rolled_up(items(s, d)), "setting_precedence": settings,
    "non_dominated_rank": fronts, "sitemap_walk": walk, "text_decoded": decoded, "code_point_labels": labels, "layer_a_hit_order": ordered_hits,
}
ORACLES = {
    "magic_classify": ITEMS + " SELECT path, CASE WHEN kind IN ('png', 'jpeg', 'webp', 'bmp', 'gif', 'tiff', 'heif', 'avif') THEN kind ELSE 'unknown' END AS format FROM items",
    "file_reports": ITEMS + " SELECT path, kind, has_c2pa, has_ai, CAST(suspicious_total AS BIGINT) AS suspicious_total, findings, levels, kind = 'error' AS skipped FROM items",
    **{f"inspect_{k}": ITEMS + f" SELECT path, has_c2pa, has_ai, CAST(suspicious_total AS BIGINT) AS suspicious_total, findings, levels FROM items WHERE kind = '{k}'" for k in KINDS},
    "file_audit_summary": EACH + " SELECT count(*) AS total, count_if(has_c2pa) AS with_c2pa, count_if(has_ai) AS with_ai, count_if(suspicious_total > 0) AS with_suspicious_text, count_if(has_c2pa OR contains(levels, 'confirmed') OR contains(levels, 'probable')) AS actionable, "
    + ", ".join(f"(SELECT count(*) FROM items i JOIN each e ON e.k = i.k WHERE level = '{v}') AS {v}" for v in ("confirmed", "probable", "informational", "likely_false_positive")) + " FROM items",
    "file_audit_exit_code": ITEMS + " SELECT CAST(CASE WHEN count_if(kind = 'error') > 0 THEN 3 WHEN count_if(has_c2pa OR contains(levels, 'confirmed') OR contains(levels, 'probable')) > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM items",
    "file_sarif": EACH + f", r AS (SELECT {RULE} AS rule_id, level FROM items i JOIN each e ON e.k = i.k) SELECT '2.1.0' AS version, CAST(4 AS BIGINT) AS rules, rule_id, CASE WHEN rule_id = 'AI-WATERMARK-C2PA' THEN 'error' WHEN rule_id LIKE '%LAYER-A' THEN 'warning' WHEN rule_id LIKE 'AI-STYLES%' THEN 'note' WHEN level = 'confirmed' THEN 'error' WHEN level = 'informational' THEN 'note' ELSE 'warning' END AS level, count(*) AS results FROM r GROUP BY ALL",
    "file_lines": EACH + " SELECT path, CAST(place AS BIGINT) AS place, '  [' || level || '] ' || path || ': ' || finding AS line FROM items i JOIN each e ON e.k = i.k",
    "file_json": ITEMS + " SELECT path, kind, CAST(n AS BIGINT) AS findings, kind = 'error' AS skipped FROM items",
    "file_suspicious": ITEMS + " SELECT path, suspicious_total > 0 OR has_c2pa OR has_ai AS suspicious FROM items",
    "file_notes": ITEMS + " SELECT path, CASE WHEN name = 'latin.txt' THEN 'bytes that are not UTF-8 were replaced' WHEN name = 'other.bin' THEN 'unrecognized format; not scanned' ELSE '' END AS notes, CASE WHEN name = 'lost.txt' THEN 'too large or not readable' END AS error FROM items",
    "file_risk": ITEMS + " SELECT path, CASE WHEN kind IN ('png', 'jpeg', 'heif', 'avif') THEN 'image' ELSE 'text' END AS judged_as, CAST(CASE WHEN kind IN ('png', 'jpeg', 'heif', 'avif') THEN least(100, 5 + CASE WHEN has_c2pa THEN 40 ELSE 0 END + CASE WHEN has_ai THEN 35 ELSE 0 END + 15 * n) END AS BIGINT) AS score FROM items",
    "soft_binding_windows": "WITH s(k, has_c2pa, found, labels, urls) AS (VALUES " + ", ".join(f"({k}, {b[1]}, {b[2]}, {text_(b[3])}, {text_(b[4])})" for k, b in enumerate(BINDINGS)) + f") SELECT doc_id, has_c2pa, found, labels, urls FROM documents JOIN s ON doc_id % {len(BINDINGS)} = k",
    "data_uri_bytes": "WITH s(k, payload) AS (VALUES " + ", ".join(f"({k}, {text_(p)})" for k, (_, p) in enumerate(PAYLOADS)) + f") SELECT page_id, 'x' AS mime, payload FROM pages JOIN s ON page_id % {len(PAYLOADS)} = k",
    "input_selection": f"WITH p AS (SELECT {SELECTED} AS path FROM documents), r AS (SELECT path, 'in/a/' || regexp_extract(path, '[^/]*$') AS resolved FROM p WHERE NOT starts_with(path, 'in/skip') AND NOT ends_with(path, '.exe')) SELECT min(path) AS path, resolved FROM r GROUP BY resolved",
    "output_paths": f"WITH o AS (SELECT doc_id, {RELATIVE} AS output FROM documents) SELECT doc_id, output, CASE WHEN output IS NULL THEN 'unsafe' WHEN count(*) OVER (PARTITION BY output) > 1 THEN 'collision' ELSE 'ok' END AS status FROM o",
    "sidecar_join": "SELECT 'f' || doc_id AS path, doc_id % 4 < 2 AS has_sidecar, CASE WHEN doc_id % 4 = 0 THEN 'kgw' END AS scheme FROM documents",
    "detector_reports": "WITH d(detector, vendor) AS (VALUES ('gemini-synthid-text', 'google'), ('markllm', 'open-source'), ('claude-text', 'anthropic')) SELECT doc_id, detector, vendor, false AS available, detector = 'markllm' AND doc_id % 3 = 0 AS configured, false AS skipped, CASE WHEN detector = 'claude-text' THEN 'no public endpoint' WHEN (detector = 'markllm' AND doc_id % 3 = 0) OR (starts_with(detector, 'gemini') AND doc_id % 2 = 0) THEN 'no endpoint of this detector can be called' ELSE 'not configured' END AS reason FROM documents, d",
    "detector_replies": "WITH s(k, is_watermarked, score, error) AS (VALUES " + ", ".join(f"({k}, {r[1] or 'NULL'}, {'NULL' if r[2] is None else r[2]}, {text_(r[3])})" for k, r in enumerate(REPLIES)) + f") SELECT page_id, CAST(is_watermarked AS BOOLEAN) AS is_watermarked, CAST(score AS DOUBLE) AS score, error FROM pages JOIN s ON page_id % {len(REPLIES)} = k",
    "inspect_roll_up": ITEMS + " SELECT count(*) AS total, count_if(suspicious_total > 0 OR has_c2pa OR has_ai) AS suspicious, count_if(kind IN ('error', 'unknown')) AS unscanned, CAST(CASE WHEN count_if(kind IN ('error', 'unknown')) > 0 THEN 3 WHEN count_if(suspicious_total > 0 OR has_c2pa OR has_ai) > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM items",
    "setting_precedence": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'e' WHEN event_id % 3 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'p' ELSE 'd' END AS value, CASE WHEN event_id % 2 = 0 THEN 'environment' WHEN event_id % 3 = 0 THEN 'dotenv' WHEN event_id % 5 = 0 THEN 'project' ELSE 'default' END AS source FROM events",
    "non_dominated_rank": "WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand AS g, p_size AS a, p_retailprice AS b FROM part), beats AS (SELECT x.k AS winner, y.k AS loser FROM p x JOIN p y ON x.g = y.g AND x.a >= y.a AND x.b >= y.b AND (x.a > y.a OR x.b > y.b)), chain(k, front) AS (SELECT k, 0 FROM p UNION SELECT loser, front + 1 FROM chain JOIN beats ON winner = chain.k) SELECT k AS p_partkey, CAST(max(front) AS BIGINT) AS front FROM chain GROUP BY k",
    "sitemap_walk": "SELECT * FROM (SELECT printf('https://s.example/p%06d', page_id) AS page, 1 AS depth, CAST(NULL AS VARCHAR) AS error FROM pages ORDER BY page_id % 4, page_id LIMIT 150) UNION ALL SELECT 'https://elsewhere.example/m.xml', 0, 'cross-origin sitemap URL is not allowed'",
    "text_decoded": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' || chr(65533) || 'b' WHEN doc_id % 8 = 5 THEN '%PDF-' WHEN doc_id % 4 = 2 THEN '' WHEN doc_id % 4 = 3 THEN 'é' END AS text, doc_id % 4 <> 0 AS valid, CASE WHEN doc_id % 8 = 1 THEN 'a PDF' END AS refused FROM documents",
    "code_point_labels": hidden.HITS + "SELECT DISTINCT codepoint, printf('U+%04X ', codepoint) || CASE codepoint " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in NAMES.items()) + " END AS label FROM hits",
    "layer_a_hit_order": hidden.HITS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, codepoint, kind) - 1 AS place, codepoint, kind, n FROM hits",
}
