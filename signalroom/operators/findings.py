"""Findings: how strong each is, audit items rolled up, SARIF results, risk, and detector decisions. All are columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalroom.rules import markers as M


def any_of(value: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(p)) for p in parts])


def confidence(finding: Column) -> Column:
    t = F.lower(finding)
    return (
        F.when(any_of(t, M.CONFIRMED), "confirmed").when(t.startswith("info:") | any_of(t, M.CONTEXT), "informational")
        .when(F.contains(t, F.lit("byte-scan")), "likely_false_positive").when(any_of(t, M.PROBABLE), "probable").otherwise("informational")
    )


def actionable(has_manifest: Column, levels: Column) -> Column:
    return F.coalesce(has_manifest, F.lit(False)) | F.exists(levels, lambda c: c.isin("confirmed", "probable"))


def summary(items: DataFrame) -> DataFrame:
    """One row over audit items (kind, has_c2pa, has_ai, suspicious_total, levels)."""
    level = lambda name: F.sum(F.size(F.filter("levels", lambda c: c == name))).cast("bigint").alias(name)
    return items.agg(
        F.count("*").alias("total"), F.count_if("has_c2pa").alias("with_c2pa"), F.count_if("has_ai").alias("with_ai"),
        F.count_if(F.col("suspicious_total") > 0).alias("with_suspicious_text"), F.count_if(actionable(F.col("has_c2pa"), F.col("levels"))).alias("actionable"), *map(level, M.LEVELS),
    )


def by_kind(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("kind", F.lit("error")).alias("kind")).count()


def sarif_rule(finding: Column, has_manifest: Column) -> Column:
    t = F.lower(finding)
    manifest = any_of(t, ["c2pa", "jumbf"]) | F.coalesce(has_manifest, F.lit(False))
    return (
        F.when(manifest, "AI-WATERMARK-C2PA").when(F.contains(t, F.lit("layer-a")), "AI-WATERMARK-UNICODE-LAYER-A")
        .when(F.contains(t, F.lit("stylometry")), "AI-STYLES-HIGH-PROBABILITY").otherwise("AI-WATERMARK-METADATA")
    )


def sarif_level(rule: Column, level: Column) -> Column:
    return (
        F.when(rule == "AI-WATERMARK-C2PA", "error").when(rule == "AI-WATERMARK-UNICODE-LAYER-A", F.when(level.isin("confirmed", "probable"), "warning").otherwise("note"))
        .when(rule == "AI-STYLES-HIGH-PROBABILITY", "note").when(level == "confirmed", "error").when(level == "informational", "note").otherwise("warning")
    )


def sarif_results(items: DataFrame) -> DataFrame:
    """rule_id, level, message and uri of each finding of items (path, has_c2pa, findings, levels)."""
    rows = items.select("path", "has_c2pa", F.explode(F.arrays_zip(F.col("findings").alias("msg"), F.col("levels").alias("conf"))).alias("f"))
    rule = sarif_rule(F.col("f.msg"), F.col("has_c2pa"))
    return rows.select(rule.alias("rule_id"), sarif_level(rule, F.col("f.conf")).alias("level"), F.col("f.msg").alias("message"), F.replace("path", F.lit("\\"), F.lit("/")).alias("uri"))


def sarif_json(results: DataFrame) -> DataFrame:
    """Each result as the JSON object of the format."""
    place = F.struct(F.struct(F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"))
    return results.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def exit_code(items: DataFrame, skipped: Column) -> DataFrame:
    """3 if anything was skipped, else 1 if anything is actionable, else 0."""
    code = F.when(skipped, 3).when(actionable(F.col("has_c2pa"), F.col("levels")), 1).otherwise(0)
    return items.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def text_risk(kinds: Column) -> Column:
    """5, and 20 for each kind of hidden character up to 60."""
    return F.lit(5) + F.least(F.lit(60), 20 * F.size(F.array_distinct(kinds)))


def image_risk(has_manifest: Column, has_ai: Column, spectral: Column, n_findings: Column) -> Column:
    points = F.lit(5) + F.when(has_manifest, 40).otherwise(0) + F.when(has_ai, 35).otherwise(0) + F.when(spectral >= 0.2, 45).otherwise(0) + 15 * n_findings
    return F.least(F.lit(100), points)


def verdict(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "medium").otherwise("high")


def decision(seen: Column, score: Column, threshold: Column, key_known: Column, tokens: Column, least: Column, band: Column) -> Column:
    """What an observation means: a negative counts only with a key, outside the band, and on enough tokens."""
    near = (band > 0) & (threshold != 0) & (F.abs(score - threshold) / F.abs(threshold) < band)
    short = (least > 0) & (tokens.isNull() | (tokens < least))
    return (
        F.when(seen == "DETECTED", "DETECTED").when(score.isNull() | threshold.isNull(), "ERROR")
        .when(near | ~F.coalesce(key_known, F.lit(False)) | short, "INCONCLUSIVE").otherwise("NOT_DETECTED")
    )


def detector_rank(available: Column, configured: Column, marked: Column, said: Column) -> Column:
    """3 detected, 2 unresolved, 1 not detected, 0 not run: the largest of a document's reports is its status."""
    on = F.coalesce(available, F.lit(False))
    found = F.coalesce(marked, F.lit(False)) | F.coalesce(said == "DETECTED", F.lit(False))
    clean = F.coalesce(said == "NOT_DETECTED", F.lit(False)) | (F.coalesce(marked == F.lit(False), F.lit(False)) & ~F.coalesce(said.isin("INCONCLUSIVE", "UNSUPPORTED", "ERROR"), F.lit(False)))
    return F.when(~on & F.coalesce(configured, F.lit(False)), 2).when(~on, 0).when(found, 3).when(clean, 1).otherwise(2)


def detector_status(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ["NOT_RUN", "NOT_DETECTED", "INCONCLUSIVE", "DETECTED"])), F.coalesce(rank, F.lit(0)) + 1)


STATUSES = ["VERIFIED", "BEST_EFFORT", "RESIDUAL_RISK", "UNSUPPORTED", "FAILED"]


def worst(statuses: Column) -> Column:
    """The worst of an array of statuses; VERIFIED if there is none."""
    ranks = F.transform(statuses, lambda s: F.array_position(F.array(*map(F.lit, STATUSES)), s).cast("int"))
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce(F.array_max(ranks), F.lit(1)))


def quality_status(failed: Column, unavailable: Column, outside: Column, unsure: Column) -> Column:
    return F.when(failed, "FAILED").when(unavailable, "UNSUPPORTED").when(outside, "FAILED").when(unsure, "BEST_EFFORT").otherwise("VERIFIED")
