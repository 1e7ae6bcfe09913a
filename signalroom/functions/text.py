"""Words, sentences and measures of style as columns. A null text counts as empty."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from signalroom.rules import phrases as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def scanned(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(scanned(text)), F.lit(P.WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences outside fenced blocks."""
    white = f"[{P.WHITE}]"
    lines = F.regexp_replace(F.regexp_replace(scanned(text), P.LINE_ENDS, "\n"), P.FENCED, "\n")
    joined = F.regexp_replace(lines, f"{white}*\\n{white}*", "\n")
    marked = F.regexp_replace(joined, f"([.!?]){white}+|\\n+", "$1\u001e")
    trimmed = F.transform(F.split(marked, "\u001e"), lambda s: F.regexp_replace(s, f"^{white}+|{white}+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def burstiness(found: Column) -> Column:
    """Coefficient of variation of the sentences' words: sample deviation over mean, 0 for fewer than two."""
    sizes = F.filter(F.transform(found, lambda s: F.regexp_count(s, F.lit(P.WORD)).cast("double")), lambda n: n > 0)

    def of(lens: Column) -> Column:
        n = F.size(lens).cast("double")
        mean = F.aggregate(lens, F.lit(0.0), lambda a, x: a + x) / n
        return let(mean, lambda m: F.sqrt(F.aggregate(lens, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (n - 1)) / m)

    return let(sizes, lambda lens: F.when(F.size(lens) < 2, F.lit(0.0)).otherwise(of(lens)))


def mattr(found: Column, window: int = 50) -> Column:
    """Moving-average type-token ratio.

    A word is a window's first of its kind in the windows that begin after its last occurrence, so one sort of
    the words by kind and place gives the sum of all windows' distinct words.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        last = n - window

        def firsts(s: Column) -> Column:
            def gained(e: Column, j: Column) -> Column:
                before = F.get(s, j - 1)
                since = F.when((j > 0) & (before["w"] == e["w"]), before["i"] + 1).otherwise(0)
                return F.greatest(F.lit(0), F.least(e["i"], last) - F.greatest(since, e["i"] - (window - 1)) + 1)

            return F.aggregate(F.transform(s, gained), F.lit(0).cast("bigint"), lambda a, x: a + x)

        slides = let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), firsts)
        return F.when(n == 0, F.lit(0.0)).when(n <= window, F.size(F.array_distinct(w)) / n).otherwise(slides / F.lit(window) / (n - (window - 1)))

    return let(found, of)


def phrase_counts(text: Column) -> Column:
    """How often each phrase occurs, in the order of the table. A phrase is searched for only where the letters it needs occur."""

    def of(t: Column, low: Column) -> Column:
        count = lambda pattern: F.regexp_count(t, F.lit(P.java(pattern)))
        return F.array(*[F.when(F.contains(low, F.lit(need)), count(p)).otherwise(0) if need else count(p) for (p, _, _), need in zip(P.PHRASES, P.NEEDS, strict=True)])

    return let(scanned(text), lambda t: let(F.lower(t), lambda low: of(t, low)))


def phrase_samples(text: Column, most: int = 3) -> Column:
    """The phrases that occur, each with its first places as they are written."""

    def of(t: Column, low: Column) -> Column:
        first = lambda p: F.slice(F.regexp_extract_all(t, F.lit(P.java(p)), F.lit(0)), 1, most)
        each = lambda p, label, need: F.struct(F.lit(label).alias("phrase"), (F.when(F.contains(low, F.lit(need)), first(p)).otherwise(F.array().cast("array<string>")) if need else first(p)).alias("samples"))
        return F.filter(F.array(*[each(p, label, need) for (p, label, _), need in zip(P.PHRASES, P.NEEDS, strict=True)]), lambda h: F.size(h["samples"]) > 0)

    return let(scanned(text), lambda t: let(F.lower(t), lambda low: of(t, low)))


def density(counts: Column, n_words: Column) -> Column:
    """Weighted phrases in 100 words."""
    weights = F.array(*[F.lit(w) for _, _, w in P.PHRASES])
    total = F.aggregate(F.zip_with(counts, weights, lambda c, w: c * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(n_words > 0, total / (n_words / 100.0)).otherwise(0.0)


def steps(value: Column, cuts: list[tuple[float, float]], rest: float, below: bool) -> Column:
    """The value of the first cut that holds."""
    out = None
    for cut, given in cuts:
        holds = value < cut if below else value >= cut
        out = F.when(holds, given) if out is None else out.when(holds, given)
    return out.otherwise(rest)


def composite(cv: Column, dens: Column, ttr: Column, n: Column) -> Column:
    """The score of texts of 30 words or more."""
    even = steps(cv, [(0.25, 0.95), (0.35, 0.80), (0.45, 0.50), (0.55, 0.25)], 0.05, True)
    formula = F.when(dens >= 2.0, 1.0).when(dens >= 1.0, 0.75).when(dens >= 0.5, 0.45).when(dens > 0, 0.20).otherwise(0.0)
    uniform = F.when(ttr.between(0.68, 0.76), 0.4).otherwise(0.1)
    damped = F.when(n < 100, 0.4 + 0.6 * ((n - 30) / 70.0)).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (even * 0.45 + formula * 0.45 + uniform * 0.10) * damped))


def tier(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.50, "MEDIUM").when(score >= 0.25, "LOW").otherwise("CLEAN")


def ngrams(found: Column, n: int) -> Column:
    """Distinct runs of n words."""
    runs = let(found, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def bigram_divergence(a: Column, b: Column) -> Column:
    """1 less the Jaccard similarity of bigrams of ASCII words; texts without words: both 0, one 1."""

    def of(x: Column, y: Column) -> Column:
        gx, gy = ngrams(x, 2), ngrams(y, 2)
        both, union = F.size(F.array_intersect(gx, gy)), F.size(F.array_union(gx, gy))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 0.0).when((F.size(x) == 0) | (F.size(y) == 0), 1.0).when(union == 0, 0.0).otherwise(1.0 - both / union)

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def chunks(text: Column, most: int = 1200) -> Column:
    """Paragraphs, or the sentences of long ones, packed in order to about ``most`` characters; a text without any stays whole."""
    trim = lambda p: F.regexp_replace(p, f"^[{P.WHITE}]+|[{P.WHITE}]+$", "")
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), f"\\n[{P.WHITE}]*\\n"), trim), lambda p: p != "")
    cut = lambda p: F.filter(F.split(F.regexp_replace(p, f"([.!?])[{P.WHITE}]+", "$1\u001e"), "\u001e"), lambda s: trim(s) != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.char_length(p) <= most, F.array(p)).otherwise(cut(p))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, u: Column) -> Column:
        full = (a["now"] != "") & (F.char_length(a["now"]) + F.char_length(u) + 2 > most)
        longer = F.when(a["now"] == "", u).otherwise(F.concat(a["now"], F.lit("\n\n"), u))
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), F.when(full, u).otherwise(longer).alias("now"))

    packed = F.aggregate(units, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return let(packed, lambda c: F.when(F.size(c) == 0, F.array(F.coalesce(text, F.lit("")))).otherwise(c))


def nfkc(text: Column) -> Column:
    """Compatibility normal form, which Spark has no function for."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(run, "string")(text)


def code_point_label(codepoint: Column) -> Column:
    """``U+XXXX NAME (Category)`` of a code point, from the names that Spark has no function for; meant for few rows."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda c: f"U+{c:04X} {unicodedata.name(chr(c), 'UNKNOWN')} ({unicodedata.category(chr(c))})")

    return F.pandas_udf(run, "string")(codepoint)
