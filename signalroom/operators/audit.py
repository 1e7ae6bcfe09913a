"""The audit of files: every file becomes an item with findings and levels, and items roll up to reports.

An item depends on its own bytes alone, and is made where they lie. Nothing is gathered but counts; SARIF documents hold a bounded number of results each.

Cases: a file without content, and one over the limit, is skipped and makes an error item; empty files are
text without findings or of unknown kind; bytes that aren't UTF-8 are replaced and noted; repeated paths are
items of their own; an empty table gives no items; columns other than path, length and content aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalroom.functions import hidden, style
from signalroom.functions import text as X
from signalroom.operators import findings, layer_a, markup
from signalroom.sources import files, media

#: From this score on, style is a finding.
STYLE = 0.65


def none() -> Column:
    return F.array().cast("array<string>")


def routes(path: Column, content: Column) -> Column:
    """How a file is looked at: text, html, markdown, svg, binary or unknown."""
    kind, ext = files.asset_kind(path, content), files.extension(path)
    low = F.lower(F.ltrim(F.decode(F.substring(content, 1, 1024), "ISO-8859-1")))
    page = low.startswith("<") & (F.contains(low, F.lit("<html")) | low.startswith("<!doctype html"))
    markup_kind = (
        F.when(ext.isin("html", "htm"), "html").when(ext.isin("md", "markdown", "mdx"), "markdown").when(ext == "svg", "svg")
        .when(files.begins(content, "25504446") | files.begins(content, "504B"), "binary").when(ext != "", "binary").when(page, "html").when(low.startswith("<"), "svg").otherwise("markdown")
    )
    return F.when(kind == "text", "text").when(kind == "image", "binary").when(kind == "container", markup_kind).otherwise("unknown")


def style_score(measured: Column) -> Column:
    """The score of a text's measures; 0 below 30 words."""
    score = X.composite(measured["cv"], measured["dens"], measured["ttr"], measured["words"])
    return F.when(measured["words"] >= 30, score).otherwise(0.0)


def items(rows: DataFrame, stylometry: bool = False) -> DataFrame:
    """An item of every file (path, length, content; content null where it wasn't read).

    path, kind, has_c2pa, has_ai, suspicious_total, findings, levels, notes, skipped and error.
    """
    readable = F.when(F.col("length") <= files.MOST_BYTES, F.col("content"))
    routed = rows.select("path", readable.alias("content")).withColumn("route", routes(F.col("path"), F.col("content")))
    seen = media.inspect_routed(routed)
    scanned = F.col("route").isin("text", "html", "markdown")
    joined = seen.withColumn("layer", hidden.findings_of(F.when(scanned, F.col("text"))))
    layer_levels = F.transform("layer.kinds", layer_a.confidence)
    own = F.when(F.col("route") == "html", markup.html_findings(F.col("text"))).when(F.col("route") == "markdown", markup.front_findings(F.col("text"))).otherwise(none())
    styles = joined.withColumn("style", style.measured(F.when(scanned, F.col("text")))) if stylometry else joined
    whole = styles.withColumn("own", own).withColumn("score", F.when(scanned, style_score(F.col("style"))).otherwise(0.0) if stylometry else F.lit(0.0))
    styled = F.col("score") >= STYLE
    said = F.when(styled, F.array(F.format_string("stylometry [high_probability] score %.2f (%s)", "score", X.tier(F.col("score"))))).otherwise(none())
    marked = F.concat("own", "findings")
    manifest = F.col("has_c2pa") | F.when(F.col("route") == "html", markup.html_has_manifest(F.col("text"))).otherwise(False)
    return whole.select(
        "path",
        F.when(F.col("status") == "skipped", "error").otherwise(F.col("format")).alias("kind"),
        manifest.alias("has_c2pa"),
        (F.col("has_ai") | manifest | F.exists("own", lambda f: ~f.startswith("info:"))).alias("has_ai"),
        (F.coalesce("layer.total", F.lit(0)) + styled.cast("int")).cast("bigint").alias("suspicious_total"),
        F.concat(marked, F.coalesce("layer.findings", none()), said).alias("findings"),
        F.concat(F.transform(marked, findings.confidence), F.coalesce(layer_levels, none()), F.transform(said, lambda _: F.lit("probable"))).alias("levels"),
        F.when(F.col("status") == "unknown", F.array(F.lit("unrecognized format; not scanned"))).when(~F.col("valid"), F.array(F.lit("bytes that are not UTF-8 were replaced"))).otherwise(none()).alias("notes"),
        (F.col("status") == "skipped").alias("skipped"),
        F.when(F.col("status") == "skipped", "too large or not readable").otherwise(F.col("error")).alias("error"),
    )


def exit_code(found: DataFrame) -> DataFrame:
    """3 if any file was skipped, else 1 if any is actionable, else 0."""
    return findings.exit_code(found, F.col("skipped"))


def rolled_up(found: DataFrame) -> DataFrame:
    """What a plain inspection of files ends with: how many, how many suspicious or not scanned, and 3, 1 or 0 as its code."""
    unscanned = F.col("skipped") | (F.col("kind") == "unknown")
    bad = (F.col("suspicious_total") > 0) | F.col("has_c2pa") | F.col("has_ai")
    code = F.when(unscanned, 3).when(bad, 1).otherwise(0)
    return found.agg(F.count("*").alias("total"), F.count_if(bad).alias("suspicious"), F.count_if(unscanned).alias("unscanned"), F.coalesce(F.max(code), F.lit(0)).cast("bigint").alias("exit_code"))


def suspicious(found: DataFrame) -> DataFrame:
    """path, and whether a service would call the file suspicious: hidden characters, a manifest, metadata or style."""
    return found.select("path", ((F.col("suspicious_total") > 0) | F.col("has_c2pa") | F.col("has_ai")).alias("suspicious"))


def item_json(found: DataFrame) -> DataFrame:
    """path and the item as one JSON object, for a sink of JSON lines."""
    return found.select("path", F.to_json(F.struct(*found.columns)).alias("item"))


def human_lines(found: DataFrame) -> DataFrame:
    """path, place and a line for each finding, as a person reads them."""
    each = found.select("path", F.posexplode(F.arrays_zip(F.col("findings").alias("msg"), F.col("levels").alias("level"))).alias("place", "f"))
    return each.select("path", "place", F.format_string("  [%s] %s: %s", "f.level", "path", "f.msg").alias("line"))


# The rules of the SARIF reports, as id, name, level and tags.
RULES = [
    ("AI-WATERMARK-C2PA", "C2PAManifestDetected", "error", ["provenance", "c2pa", "watermark"]), ("AI-WATERMARK-METADATA", "AIMetadataMarkerDetected", "warning", ["provenance", "ai-generated"]),
    ("AI-WATERMARK-UNICODE-LAYER-A", "InvisibleUnicodeWatermarkCarrier", "warning", ["watermark", "unicode", "layer-a"]), ("AI-STYLES-HIGH-PROBABILITY", "HighProbabilityAITextCadence", "note", ["stylometry", "ai-text"]),
]
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
PER_DOCUMENT = 10_000


def sarif_documents(found: DataFrame, version: str = "1", per_document: int = PER_DOCUMENT) -> DataFrame:
    """Whole SARIF documents: the envelope with tool and rules, and about per_document results each."""
    results = findings.sarif_results(found)
    number = max(1, -(-results.count() // per_document))
    one = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
    )
    dealt = results.select(F.pmod(F.xxhash64("uri", "message"), F.lit(number)).alias("document"), one.alias("r"))
    every = results.sparkSession.range(number).select(F.col("id").alias("document"))
    grouped = every.join(dealt.groupBy("document").agg(F.array_sort(F.collect_list("r")).alias("results")), "document", "left")
    rules = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.struct(F.lit(v).alias("level")).alias("defaultConfiguration"), F.struct(F.array(*map(F.lit, t)).alias("tags")).alias("properties")) for i, n, v, t in RULES])
    driver = F.struct(F.lit("signalroom").alias("name"), F.lit(version).alias("version"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.coalesce("results", F.array().cast(dealt.groupBy().agg(F.collect_list("r").alias("r")).schema["r"].dataType)).alias("results"))
    return grouped.select("document", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
