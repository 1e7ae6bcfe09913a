"""The rules of hidden characters as a fold over a text's suspect runs, and the columns built on it.

A text is decided where its row lies, in one pass: only its suspect characters are visited, each with its
neighbours and the character kept before it. A character that no context can change is decided once. Bytes that
aren't UTF-8 count as replacement characters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from signalroom.rules import characters as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

STRIP, TAGS, SELECTORS, BIDI, KEPT_BIDI, ZERO_WIDTH, PRIVATE, SPACES = C.STRIP, C.TAGS, C.SELECTORS, C.BIDI, C.KEPT_BIDI, C.ZERO_WIDTH, C.PRIVATE, C.SPACES
EMOJI_BASES, IDEOGRAPHS, ORTHOGRAPHIC, JAMO, MONGOLIAN, KHMER, SCRIPTS = C.EMOJI_BASES, C.IDEOGRAPHS, C.ORTHOGRAPHIC, C.JAMO, C.MONGOLIAN, C.KHMER, C.SCRIPTS
GLUE, MATH, CONFUSABLES = C.GLUE, C.MATH, C.CONFUSABLES
FLAG = "\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f"
TURNS = "[\u202a\u202b\u202c\u202d\u202e]"
#: Kinds of stripped characters, the first that holds.
KINDS = [("tag_chars", TAGS), ("variation_selector", SELECTORS), ("bidi", BIDI), ("zwj_family", ZERO_WIDTH), ("private_use", PRIVATE)]

#: Place, character, what comes out, kind if it is suspicious, and whether it was kept as meaningful.
Mark = tuple[int, str, str, str | None, bool]


def within(ch: str | None, table: list[tuple[int, int]]) -> bool:
    return ch is not None and any(a <= ord(ch) <= b for a, b in table)


def category(ch: str | None, kinds: str) -> bool:
    return ch is not None and unicodedata.category(ch)[0] in kinds


def script(ch: str | None) -> str | None:
    return next((n for n, a, b in SCRIPTS if a <= ord(ch) <= b), None) if category(ch, "LM") else None


def visible(ch: str | None) -> bool:
    return ch is not None and not category(ch, "CZ")


def embeddings(t: str) -> list[tuple[int, int]]:
    """Places of embeddings and of what closes them; overrides take a pop but aren't kept."""
    stack, out = [], []
    for m in re.finditer(TURNS, t):
        if m[0] != "\u202c":
            stack.append(m.start())
        elif stack and t[opener := stack.pop()] in "\u202a\u202b":
            out.append((opener, m.start()))
    return sorted(out)


def suspect_class(aggressive: bool) -> str:
    """What makes a text suspect, as a bracket expression of Python's."""
    points = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cf", "Co")} | {c for t in (STRIP, SPACES) for a, b in t for c in range(a, b + 1)}
    points |= set(map(ord, CONFUSABLES)) if aggressive else set()
    ends = sorted(c for c in points if c + 1 not in points)
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(sorted(c for c in points if c - 1 not in points), ends, strict=True)) + "]"


CLASSES = {aggressive: suspect_class(aggressive) for aggressive in (False, True)}


class Rules:
    """What happens to each character, by the first rule that holds."""

    def __init__(self, *, strip_bidi: bool, aggressive: bool = False, strip_emoji_glue: bool = False, normalize_spaces: bool = True, preserve_semantic: bool = True) -> None:
        self.strip_bidi, self.aggressive, self.no_glue, self.spaces, self.meaning = strip_bidi, aggressive, strip_emoji_glue, normalize_spaces, preserve_semantic
        self.runs = re.compile(CLASSES[aggressive] + "+")
        self.known: dict[str, tuple[str, str | None, bool] | None] = {}

    def _alone(self, ch: str) -> tuple[str, str | None, bool]:
        """What comes out, kind, and whether it is kept as meaningful, by the rules without context."""
        if (not self.strip_bidi and within(ch, KEPT_BIDI)) or (not self.no_glue and within(ch, ORTHOGRAPHIC)):
            return ch, None, within(ch, STRIP)
        if within(ch, STRIP):
            return "", next((n for n, t in KINDS if within(ch, t)), "strip"), False
        if within(ch, SPACES):
            return (" ", "space", False) if self.spaces else (ch, None, False)
        if self.aggressive and ch in CONFUSABLES:
            return CONFUSABLES[ch], "confusable", False
        return ("", "other_cf", False) if unicodedata.category(ch) == "Cf" else (ch, None, False)

    def _first(self, ch: str) -> tuple[str, str | None, bool] | None:
        """As _alone; none for a character that asks for its context."""
        asks = (not self.no_glue and within(ch, GLUE)) or (self.meaning and within(ch, MATH)) or (not self.strip_bidi and ch in "\u202a\u202b\u202c")
        self.known[ch] = None if asks else self._alone(ch)
        return self.known[ch]

    def _glued(self, ch: str, before: str | None, after: str | None, kept: str | None, in_flag: Callable[[], bool]) -> bool:
        """Whether what an invisible character belongs to keeps it."""
        if "\U000e0100" <= ch <= "\U000e01ef" or "\ufe00" <= ch <= "\ufe0d":
            return within(before, IDEOGRAPHS)
        if "\u180b" <= ch <= "\u180d":
            return within(before, MONGOLIAN) or (within(kept, MONGOLIAN) and category(kept, "L"))
        if ch in "\ufe0e\ufe0f":
            return within(before, EMOJI_BASES)
        if ch in "\u200c\u200d":
            joins = ch == "\u200d" and within(kept, EMOJI_BASES) and within(after, EMOJI_BASES)
            return joins or (script(before) is not None and script(before) == script(after))
        if ch in "\u17b4\u17b5":
            return within(kept, KHMER) and category(kept, "L")
        return within(kept, JAMO) if ch in "\u115f\u1160" else in_flag()

    def marks(self, t: str) -> Iterator[Mark]:
        """The suspect characters of a text, in order."""
        pairs: set[int] | None = None
        flags: set[int] | None = None
        known = self.known
        for run in self.runs.finditer(t):
            start, end = run.span()
            kept = t[start - 1] if start else None
            for i in range(start, end):
                ch = t[i]
                found = known[ch] if ch in known else self._first(ch)
                if found is None:
                    before, after = t[i - 1] if i else None, t[i + 1] if i + 1 < len(t) else None
                    if ch in "\u202a\u202b\u202c":
                        pairs = {p for pair in embeddings(t) for p in pair} if pairs is None else pairs
                        keep = i in pairs
                    elif within(ch, MATH):
                        keep = visible(before) and visible(after)
                    else:
                        if flags is None and ch >= "\U000e0020":
                            flags = {p for m in re.finditer(FLAG, t) for p in range(m.start() + 1, m.end())}
                        keep = self._glued(ch, before, after, kept, lambda: i in flags)  # noqa: B023
                    found = (ch, None, True) if keep else self._alone(ch)
                    if keep and not within(ch, GLUE):
                        kept = ch
                elif found[0] and not within(ch, GLUE):
                    kept = " " if found[1] == "space" else ch
                yield i, ch, *found


def hits(rules: Rules, t: str) -> list[tuple[int, str, int, str]]:
    """Suspicious code points: code point, kind, count and the first ten places."""
    found: dict[tuple[int, str], list[int]] = {}
    for i, ch, _, kind, _ in rules.marks(t):
        if kind is not None:
            found.setdefault((ord(ch), kind), []).append(i)
    return [(c, kind, len(at), ",".join(map(str, at[:10]))) for (c, kind), at in found.items()]


def kind_counts(rules: Rules, t: str) -> list[tuple[str, int]]:
    found: dict[str, int] = {}
    for _, _, _, kind, _ in rules.marks(t):
        if kind is not None:
            found[kind] = found.get(kind, 0) + 1
    return list(found.items())


def cleaned(rules: Rules, t: str) -> tuple[str, int, int, int] | None:
    """The text without what goes, and how many characters went, changed, or were kept as meaningful; none if nothing is suspect."""
    out, last, removed, replaced, preserved, seen = [], 0, 0, 0, 0, False
    for i, _, put, kind, meant in rules.marks(t):
        seen = True
        preserved += meant
        if kind is not None:
            out += (t[last:i], put)
            last = i + 1
            removed, replaced = removed + (not put), replaced + bool(put)
    return ("".join(out) + t[last:], removed, replaced, preserved) if seen else None


def pairs(rules: Rules, t: str) -> list[tuple[int, int]]:
    return embeddings(t)


def label(codepoint: int) -> str:
    return f"U+{codepoint:04X} {unicodedata.name(chr(codepoint), 'UNKNOWN')} ({unicodedata.category(chr(codepoint))})"


def findings(rules: Rules, t: str) -> tuple[list[str], list[str], int] | None:
    """Findings, most frequent first, the kinds they are of, and how many characters they are."""
    found = sorted((-n, c, kind) for c, kind, n, _ in hits(rules, t))
    return ([f"layer-a [{kind}] {label(c)} x{-n}" for n, c, kind in found], [kind for _, _, kind in found], -sum(n for n, _, _ in found)) if found else None


def column(of: Callable[[Rules, str], object], result: str, arrow: pa.DataType, text: Column, **options) -> Column:
    """What a function finds in each text. A null text, and one that is plain ASCII, holds nothing."""
    rules, nothing = Rules(**options), [] if pa.types.is_list(arrow) else None
    fields = [f.name for f in (arrow.value_type if pa.types.is_list(arrow) else arrow)]
    named = lambda v: [dict(zip(fields, x, strict=True)) for x in v] if isinstance(v, list) else v and dict(zip(fields, v, strict=True))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([nothing if b is None or b.isascii() else named(of(rules, b.decode("utf-8", "replace"))) for b in texts.to_pylist()], arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, result)(text.cast("binary"))


def listed(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(fields))


def hits_of(text: Column, **options) -> Column:
    arrow = listed(codepoint=pa.int32(), kind=pa.string(), n=pa.int64(), places=pa.string())
    return column(hits, "array<struct<codepoint:int,kind:string,n:bigint,places:string>>", arrow, text, **options)


def kind_counts_of(text: Column, **options) -> Column:
    return column(kind_counts, "array<struct<kind:string,n:bigint>>", listed(kind=pa.string(), n=pa.int64()), text, **options)


def cleaned_of(text: Column, **options) -> Column:
    arrow = pa.struct({"cleaned": pa.string(), "removed": pa.int64(), "replaced": pa.int64(), "preserved": pa.int64()})
    return column(cleaned, "struct<cleaned:string,removed:bigint,replaced:bigint,preserved:bigint>", arrow, text, **options)


def pairs_of(text: Column) -> Column:
    return column(pairs, "array<struct<opener:int,closer:int>>", listed(opener=pa.int32(), closer=pa.int32()), text, strip_bidi=False)


def findings_of(text: Column) -> Column:
    arrow = pa.struct({"findings": pa.list_(pa.string()), "kinds": pa.list_(pa.string()), "total": pa.int64()})
    return column(findings, "struct<findings:array<string>,kinds:array<string>,total:bigint>", arrow, text, strip_bidi=True)
