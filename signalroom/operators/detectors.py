"""Text detectors as a registry of rows, their reports, and what replies of a detector service say. No service is called.

A report says whether a detector is available and configured, whether the text was passed over, and why. Reports of a
text roll up to one status in operators/findings.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The detectors, who makes them, and the setting that configures each; none can run here.
DETECTORS = [("gemini-synthid-text", "google", "gemini_key"), ("markllm", "open-source", "markllm_dir"), ("claude-text", "anthropic", None)]
#: Texts of more characters are passed over by the first.
MOST_CHARS = 1_000_000


def registry(settings: Column) -> Column:
    """The detectors as an array of detector, vendor and configured, by a map of settings."""
    has = lambda key: F.coalesce(F.trim(F.try_element_at(settings, F.lit(key))) != "", F.lit(False)) if key else F.lit(False)
    return F.array(*[F.struct(F.lit(n).alias("detector"), F.lit(v).alias("vendor"), has(k).alias("configured")) for n, v, k in DETECTORS])


def reports(docs: DataFrame, settings: Column) -> DataFrame:
    """doc_id and one report for each detector of every text (doc_id, t): available, configured, skipped and reason."""
    each = docs.select("doc_id", F.coalesce(F.char_length("t"), F.lit(0)).alias("n"), F.explode(registry(settings)).alias("d")).select("doc_id", "n", "d.*")
    first = F.col("detector") == DETECTORS[0][0]
    skipped = first & F.col("configured") & (F.col("n") > MOST_CHARS)
    reason = (
        F.when(skipped, F.lit(f"text longer than {MOST_CHARS} chars")).when(first & ~F.col("configured"), "not configured")
        .when(F.col("detector") == "claude-text", "no public endpoint").when(~F.col("configured"), "not configured").otherwise("no endpoint of this detector can be called")
    )
    return each.select("doc_id", "detector", "vendor", skipped.alias("available"), (F.col("configured") & (skipped | ~first)).alias("configured"), skipped.alias("skipped"), reason.alias("reason"))


# Where a reply may hold a score, in the order in which it is looked for, and words of a positive verdict.
KEYS = ["syntheticTextScore", "synthetic_text_score", "watermarkScore", "watermark_score", "score"]
SCORES = [f"$.candidates[0].{k}" for k in KEYS] + [f"$.{k}" for k in KEYS]
SCORES += [f"$.candidates[0].attributionMetadata.{k}" for k in ("syntheticTextScore", "synthetic_text_score", "score", "syntheticText.score", "syntheticText.confidence")]
POSITIVE = ["watermarked", "ai-generated", "ai generated", "likely ai"]


def reply(body: Column) -> Column:
    """What a detector's JSON reply says: is_watermarked, score, verdict, or an error. A verdict in words goes before a score of 0.5 or more."""
    at = lambda path: F.get_json_object(body, path)
    number = lambda x: F.when(x.rlike("^-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$"), x.cast("double"))
    score = F.coalesce(*[number(at(p)) for p in SCORES])
    verdict = at("$.candidates[0].content.parts[0].text")
    low = F.lower(F.trim(verdict))
    positive = F.lit(False)
    for word in POSITIVE:
        positive = positive | F.contains(low, F.lit(word))
    worded = F.when(F.coalesce(verdict, F.lit("")) == "", None).when(low.rlike("\\b(unlikely|no|not)\\b"), False).otherwise(positive)
    blocked = at("$.promptFeedback.blockReason")
    none = at("$.candidates[0]").isNull() | (at("$.candidates[0]") == "{}")
    error = (
        F.when(none & blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked)).when(none, "no candidates").when(verdict.isNull() & score.isNull(), "no verdict or score")
    )
    good = error.isNull()
    return F.struct(F.when(good, F.coalesce(worded, score >= 0.5)).alias("is_watermarked"), F.when(good, score).alias("score"), F.when(good, verdict).alias("verdict"), error.alias("error"))
