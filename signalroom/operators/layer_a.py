"""Hidden characters: which ones a text holds, and the text without them.

Each row's text is answered by itself, where it lies, by the fold in ``functions/hidden``: nothing is shuffled, and
neither repeated nor null ids mix texts. The statements below say the same rules in SQL, as one CASE over every
character and its neighbours, for an engine that checks them; what differs between engines comes from a dialect.

Input: doc_id and t. A null text has no characters; rows that repeat are answered one by one; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalroom.functions import hidden
from signalroom.rules import characters as C
from signalroom.rules.characters import within


@dataclass(frozen=True)
class Dialect:
    """The names that engines give to what the rules need."""

    chars: str
    rest: str
    code: str
    matches: str
    char: str
    join_text: str
    first_ten: str
    last: str
    next: str


def spark_literal(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def suspect_class(aggressive: bool) -> str:
    """What makes a text suspect, as a bracket expression."""
    return C.SUSPECT[:-1] + (C.char_class([(ord(c), ord(c)) for c in C.CYRILLIC], [(0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]) if aggressive else "") + "]"


def decisions(d: Dialect, *, strip_bidi: bool, aggressive: bool = False, strip_emoji_glue: bool = False, normalize_spaces: bool = True, preserve_semantic: bool = True, escape=spark_literal) -> str:
    """SQL that gives every character of suspect texts its action, what comes out, and its kind if it is suspicious.

    Rules in order, the first that holds decides. "Kept before" means the last earlier character that is
    neither glue nor stripped; glue alone asks for it, and glue never becomes it, so a running last value
    over the other characters finds it.
    """
    match = lambda x, p: d.matches.format(x, escape(p))
    suspect = suspect_class(aggressive)
    chars = d.chars.format(suspect=escape(suspect))
    script = lambda cp, ch: "CASE WHEN NOT " + match(ch, "^[\\p{L}\\p{M}]$") + " THEN NULL " + " ".join(f"WHEN {cp} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in C.SCRIPTS) + " END"
    visible = lambda cp, ch: f"({ch} IS NOT NULL AND {cp} > 31 AND NOT {cp} BETWEEN 127 AND 159 AND NOT {match(ch, '^[\\p{C}\\p{Z}]$')})"
    glue_rules = "" if strip_emoji_glue else f"""
      WHEN prev_cp IS NOT NULL AND {within('cp', [(0xE0100, 0xE01EF)])} AND {within('prev_cp', C.IDEOGRAPHS)} THEN 'keep'
      WHEN prev_cp IS NOT NULL AND cp BETWEEN {0x180B} AND {0x180D} AND {within('prev_cp', C.MONGOLIAN)} THEN 'keep'
      WHEN prev_cp IS NOT NULL AND cp BETWEEN {0xFE00} AND {0xFE0D} AND {within('prev_cp', C.IDEOGRAPHS)} THEN 'keep'
      WHEN cp IN ({0xFE0E}, {0xFE0F}) AND prev_cp IS NOT NULL AND {within('prev_cp', C.EMOJI_BASES)} THEN 'keep'
      WHEN cp = {0x200D} AND kept_cp IS NOT NULL AND next_cp IS NOT NULL AND {within('kept_cp', C.EMOJI_BASES)} AND {within('next_cp', C.EMOJI_BASES)} THEN 'keep'
      WHEN cp IN ({0x200C}, {0x200D}) AND prev_script IS NOT NULL AND prev_script = next_script THEN 'keep'
      WHEN cp BETWEEN {0xE0020} AND {0xE007F} AND in_flag THEN 'keep'
      WHEN cp BETWEEN {0x180B} AND {0x180D} AND {within('kept_cp', C.MONGOLIAN)} AND {match('kept_ch', '^\\p{L}$')} THEN 'keep'
      WHEN cp IN ({0x17B4}, {0x17B5}) AND {within('kept_cp', C.KHMER)} AND {match('kept_ch', '^\\p{L}$')} THEN 'keep'
      WHEN cp IN ({0x115F}, {0x1160}) AND {within('kept_cp', C.JAMO)} THEN 'keep'
      WHEN {within('cp', C.ORTHOGRAPHIC)} THEN 'keep'"""
    bidi_rules = "" if strip_bidi else f"WHEN in_pair THEN 'keep' WHEN {within('cp', C.KEPT_BIDI)} THEN 'keep'"
    math_rule = f"WHEN {within('cp', C.MATH)} AND prev_visible AND next_visible THEN 'keep'" if preserve_semantic else ""
    space_rule = f"WHEN {within('cp', C.SPACES)} THEN 'space'" if normalize_spaces else ""
    confusable = " OR ".join(f"cp = {ord(c)}" for c in C.CYRILLIC) + " OR cp BETWEEN 65313 AND 65338 OR cp BETWEEN 65345 AND 65370"
    confusable_rule = f"WHEN ({confusable}) THEN 'confusable'" if aggressive else ""
    alone = f"CASE {bidi_rules if not strip_bidi else ''} WHEN {within('cp', C.STRIP)} THEN 'strip' {space_rule} {confusable_rule} WHEN {match('ch', '^\\p{Cf}$')} AND NOT {within('cp', C.SPACES)} THEN 'strip' ELSE 'keep' END"
    latin = "".join(C.CONFUSABLES.values())
    rows = "PARTITION BY doc_id ORDER BY pos"
    side = lambda f, what, step: f"CASE WHEN {f}(pos) OVER ({rows}) = pos {step} THEN {f}({what}) OVER ({rows}) END"
    # All windows but one run over the places of a text, so that one sort serves them; a pair's mate is its neighbour
    # among the turns of its level, found by lead and lag over levels.
    before = f"({rows} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    levels = "PARTITION BY doc_id, level ORDER BY pos"
    # A character that isn't glue is decided without what was kept before, so 'alone' is exact for it; orthographic
    # marks and operators between visible characters are the two others that context keeps.
    return f"""
WITH chars AS ({chars}),
coded AS (SELECT doc_id, pos, ch, {d.code} AS cp FROM chars),
near AS (
  SELECT *, {side('lag', 'cp', '- 1')} AS prev_cp, {side('lead', 'cp', '+ 1')} AS next_cp, {side('lag', 'ch', '- 1')} AS prev_ch, {side('lead', 'ch', '+ 1')} AS next_ch,
    CASE WHEN cp IN (8234, 8235, 8237, 8238) THEN 1 WHEN cp = 8236 THEN -1 ELSE 0 END AS turn,
    cp BETWEEN {0xE0020} AND {0xE007E} AS is_tag
  FROM coded),
sums AS (SELECT *, sum(turn) OVER ({rows} ROWS UNBOUNDED PRECEDING) AS total FROM near),
lows AS (
  SELECT *, coalesce(least(0, min(total) OVER {before}), 0) AS low_before, least(0, min(total) OVER ({rows} ROWS UNBOUNDED PRECEDING)) AS low,
    {d.last.format(x='''CASE WHEN NOT is_tag THEN cp END''', rows=rows)} AS flag_before, {d.next.format(x='''CASE WHEN NOT is_tag THEN cp END''', rows=rows)} AS flag_after,
    lag(is_tag) OVER ({rows}) AS tag_before
  FROM sums),
leveled AS (
  SELECT *, CASE WHEN turn = 1 THEN total - low WHEN turn = -1 AND low = low_before THEN total - low + 1 END AS level FROM lows),
paired AS (
  SELECT *, CASE WHEN level IS NOT NULL THEN lead(pos) OVER ({levels}) END AS mate, CASE WHEN level IS NOT NULL THEN lead(cp) OVER ({levels}) END AS mate_cp,
    CASE WHEN level IS NOT NULL THEN lag(cp) OVER ({levels}) END AS opened_by
  FROM leveled),
pairs AS (SELECT doc_id, pos AS opener, mate AS closer FROM paired WHERE cp IN (8234, 8235) AND mate_cp = 8236),
ready AS (
  SELECT *, coalesce((cp IN (8234, 8235) AND mate_cp = 8236) OR (cp = 8236 AND opened_by IN (8234, 8235)), false) AS in_pair,
    coalesce((is_tag AND flag_before = {0x1F3F4} AND flag_after = {0xE007F}) OR (cp = {0xE007F} AND tag_before AND flag_before = {0x1F3F4}), false) AS in_flag,
    {script('prev_cp', 'prev_ch')} AS prev_script, {script('next_cp', 'next_ch')} AS next_script,
    coalesce({visible('prev_cp', 'prev_ch')}, false) AS prev_visible, coalesce({visible('next_cp', 'next_ch')}, false) AS next_visible
  FROM paired),
marked AS (
  SELECT *, {within('cp', C.GLUE)} AS is_glue,
    CASE WHEN {within('cp', C.ORTHOGRAPHIC)} AND {'false' if strip_emoji_glue else 'true'} THEN 'keep' {math_rule} ELSE {alone} END AS first_action
  FROM ready),
based AS (
  SELECT *, {d.last.format(x='''CASE WHEN NOT is_glue AND first_action <> 'strip' THEN CASE first_action WHEN 'space' THEN 32 ELSE cp END END''', rows=rows)} AS kept_cp,
    {d.last.format(x='''CASE WHEN NOT is_glue AND first_action <> 'strip' THEN ch END''', rows=rows)} AS kept_ch
  FROM marked),
decided AS (
  SELECT *, CASE {bidi_rules} {glue_rules} {math_rule}
      WHEN {within('cp', C.STRIP)} THEN 'strip' {space_rule} {confusable_rule}
      WHEN {match('ch', '^\\p{Cf}$')} AND NOT {within('cp', C.SPACES)} THEN 'other' ELSE 'keep' END AS action
  FROM based),
result AS (
  SELECT doc_id, pos, ch, cp, CASE WHEN action IN ('strip', 'other') THEN 'strip' WHEN action = 'keep' THEN 'keep' ELSE 'replace' END AS action,
    CASE action WHEN 'keep' THEN ch WHEN 'space' THEN ' ' WHEN 'confusable' THEN translate(ch, '{"".join(C.CONFUSABLES)}', '{latin}') ELSE '' END AS out_ch,
    CASE action WHEN 'keep' THEN NULL WHEN 'space' THEN 'space' WHEN 'confusable' THEN 'confusable' WHEN 'other' THEN 'other_cf'
      ELSE CASE WHEN {within('cp', C.TAGS)} THEN 'tag_chars' WHEN {within('cp', C.SELECTORS)} THEN 'variation_selector' WHEN {within('cp', C.BIDI)} THEN 'bidi'
        WHEN {within('cp', C.ZERO_WIDTH)} THEN 'zwj_family' WHEN {within('cp', C.PRIVATE)} THEN 'private_use' ELSE 'strip' END END AS kind,
    action = 'keep' AND ({within('cp', C.STRIP)} OR is_glue) AS preserved
  FROM decided)"""


def hits_sql(d: Dialect, **options) -> str:
    """Suspicious code points of each document: count and the first ten places."""
    return decisions(d, strip_bidi=True, **options) + f"""
SELECT doc_id, cp AS codepoint, kind, count(*) AS n, {d.first_ten} AS places FROM result WHERE kind IS NOT NULL GROUP BY doc_id, cp, kind"""


def inspect(docs: DataFrame, **options) -> DataFrame:
    """doc_id, codepoint, kind, n and places."""
    return docs.select("doc_id", F.explode(hidden.hits_of(F.col("t"), strip_bidi=True, **options)).alias("h")).select("doc_id", "h.*")


def kind_counts_sql(d: Dialect) -> str:
    return decisions(d, strip_bidi=True) + "\nSELECT doc_id, kind, count(*) AS n FROM result WHERE kind IS NOT NULL GROUP BY doc_id, kind"


def kind_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(hidden.kind_counts_of(F.col("t"), strip_bidi=True)).alias("h")).select("doc_id", "h.*")


def clean_sql(d: Dialect, **options) -> str:
    """The rebuilt text of suspect documents, and how many characters went, changed, or were kept as meaningful."""
    escape = options.get("escape", spark_literal)
    rest = d.rest.format(suspect=escape(suspect_class(options.get("aggressive", False))))
    return decisions(d, strip_bidi=options.pop("strip_bidi", False), **options) + f""", whole AS (SELECT doc_id, pos, ch, out_ch, action, preserved FROM result{rest})
SELECT doc_id, {d.join_text} AS cleaned, count(CASE WHEN action = 'strip' THEN 1 END) AS removed,
  count(CASE WHEN action = 'replace' THEN 1 END) AS replaced, count(CASE WHEN preserved THEN 1 END) AS preserved FROM whole GROUP BY doc_id"""


def clean(docs: DataFrame, **options) -> DataFrame:
    """doc_id, cleaned, removed, replaced, preserved of all documents; texts that aren't suspect stay as they are."""
    every = docs.select("doc_id", "t", hidden.cleaned_of(F.col("t"), **({"strip_bidi": False} | options)).alias("c"))
    counts = [F.coalesce(f"c.{n}", F.lit(0)).cast("bigint").alias(n) for n in ("removed", "replaced", "preserved")]
    return every.select("doc_id", F.when(F.col("c").isNull(), F.col("t")).otherwise(F.col("c.cleaned")).alias("cleaned"), *counts)


def pairs_sql(d: Dialect, **options) -> str:
    return decisions(d, strip_bidi=False, **options) + "\nSELECT doc_id, opener, closer FROM pairs"


def bidi_pairs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(hidden.pairs_of(F.col("t"))).alias("p")).select("doc_id", "p.*")


def confidence(kind):
    """How strong a hit is: spaces are context, all else a carrier."""
    return F.when(kind == "space", "informational").otherwise("probable")
