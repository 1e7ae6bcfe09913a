"""The measures of style of a text in one pass where its row lies, as the functions of ``text`` define them.

Phrases are searched for in small letters by their first word; a text with signs that fold to letters only when
case is ignored is searched as it is. Sums are added in the order of those functions, so results are the same.
"""

from __future__ import annotations

import math
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from signalroom.rules import phrases as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

WORD = re.compile(r"\w+(?:['-]+\w+)*")
FENCED = re.compile(r"(?ms)^\s*```.*?(?:^\s*```[^\n]*$|\Z)")
ENDS = re.compile(r"[.!?](?=\s)")
#: Signs that match a plain letter when case is ignored, but aren't that letter in small letters.
FOLDING = re.compile("[İıſ]")
WINDOW = 50


def led(pattern: str) -> re.Pattern:
    """A phrase for small letters that begins with plain letters, which are found fast; the word's start is looked at after them."""
    first = re.match(r"\\b([a-z]+?)(?=[a-z][?*+]|[^a-z?*+]|$)", pattern)
    return re.compile(f"{first[1]}(?<!\\w{first[1]}){pattern[first.end() :]}")


#: Needed letters, the phrase for small letters and for any, and its weight.
PHRASES = [(need, led(p), re.compile(p, re.IGNORECASE), weight) for (p, _, weight), need in zip(P.PHRASES, P.NEEDS, strict=True)]


def sentences(t: str) -> list[str]:
    """Sentences outside fenced blocks: parts of lines after a mark and white space."""
    lines = FENCED.sub("\n", "\n".join(t.splitlines())).split("\n") if "```" in t else t.splitlines()
    out = []
    for line in lines:
        start = 0
        for m in ENDS.finditer(line):
            out.append(line[start : m.end()].strip())
            start = m.end()
        out.append(line[start:].strip())
    return [s for s in out if s]


def burstiness(found: list[str]) -> float:
    sizes = [float(n) for s in found if (n := len(WORD.findall(s)))]
    if len(sizes) < 2:
        return 0.0
    mean, squares = float(sum(map(int, sizes))) / len(sizes), 0.0
    for n in sizes:
        squares += (n - mean) * (n - mean)
    return math.sqrt(squares / (len(sizes) - 1)) / mean


def mattr(words: list[str]) -> float:
    n = len(words)
    if n <= WINDOW:
        return len(set(words)) / n if n else 0.0
    last, total, seen = n - WINDOW, 0, {}
    for i, w in enumerate(words):
        since = seen.get(w, -1) + 1
        low, high = i - (WINDOW - 1), i if i < last else last
        low = low if low > since else since
        if high >= low:
            total += high - low + 1
        seen[w] = i
    return total / WINDOW / (n - (WINDOW - 1))


def weighed(t: str, low: str) -> float:
    """Sum of the weights of the phrases that occur."""
    any_case, total = not t.isascii() and FOLDING.search(t) is not None, 0.0
    for need, small, whole, weight in PHRASES:
        if need in low:
            total += (len(whole.findall(t)) if any_case else len(small.findall(low))) * weight
    return total


def measures(t: str) -> tuple[int, int, float, float, float]:
    """Words, sentences, burstiness, moving-average type-token ratio, and weighted phrases in 100 words."""
    low = t.lower()
    words, found = WORD.findall(low), sentences(t)
    return len(words), len(found), burstiness(found), mattr(words), weighed(t, low) / (len(words) / 100.0) if words else 0.0


def measured(text: Column) -> Column:
    """words, sentences, cv, ttr and dens of a text; a null one counts as empty."""
    arrow = [("words", pa.int64()), ("sentences", pa.int64()), ("cv", pa.float64()), ("ttr", pa.float64()), ("dens", pa.float64())]

    def run(texts: pa.Array) -> pa.Array:
        rows = [measures((b or b"").decode("utf-8", "replace")) for b in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, arrow, strict=True)], [n for n, _ in arrow])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<words:bigint,sentences:bigint,cv:double,ttr:double,dens:double>")(text.cast("binary"))
