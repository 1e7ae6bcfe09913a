"""Hidden characters against a fold over characters in plain Python, written from the rule list alone, and rows against texts."""

import random
import re
import unicodedata
from types import SimpleNamespace

import pytest

from signalroom.operators import layer_a

SPANS = {
    "strip": "00AD 034F 061C 115F-1160 17B4-17B5 180B-180E 200B-200F 202A-202E 2060-2064 2066-206F FE00-FE0F FEFF FFF9-FFFB E0001-E007F E0100-E01EF E000-F8FF F0000-FFFFD 100000-10FFFD",
    "space": "00A0 1680 2000-200A 202F 205F 3000", "kept_bidi": "061C 200E-200F 2066-2069", "cjk": "3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF", "mongol": "1800-18AF", "khmer": "1780-17FF",
    "emoji": "1F000-1FAFF 2190-27BF 2B00-2BFF 00A9 00AE 2122 3030 303D 3297 3299 0023 002A 0030-0039", "jamo": "1100-11FF A960-A97C D7B0-D7C6", "ortho": "0600-0605 06DD 070F 08E2 110BD 110CD",
    "glue": "200C-200D FE00-FE0F E0100-E01EF 180B-180D E0020-E007F 17B4-17B5 115F-1160", "tag": "E0001-E007F", "selector": "E0100-E01EF FE00-FE0F 180B-180D", "bidi": "061C 200E-200F 202A-202E 2066-2069",
    "zero": "200B-200D 2060 FEFF 180E", "private": "E000-F8FF F0000-FFFFD 100000-10FFFD", "math": "2061-2064",
}
RANGES = {n: [tuple(int(x, 16) for x in (p.split("-") * 2)[:2]) for p in s.split()] for n, s in SPANS.items()}
SCRIPTS = [(0x600, 0x8FF), (0x900, 0xDFF), (0xF00, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF)]
LOOKALIKE = dict(zip("АВЕКМНОРСТХаеорсухі", "ABEKMHOPCTXaeopcyxi", strict=True))


def of(name, ch):
    return ch is not None and any(a <= ord(ch) <= b for a, b in RANGES[name])


def script(ch):
    return next((k for k, (a, b) in enumerate(SCRIPTS) if ch is not None and a <= ord(ch) <= b and unicodedata.category(ch)[0] in "LM"), None)


def visible(ch):
    return ch is not None and unicodedata.category(ch)[0] not in "CZ"


def embedded(text):
    """Places of embeddings closed by a pop; overrides take a pop but aren't kept."""
    stack, out = [], set()
    for i, ch in enumerate(text):
        if ch in "‪‫‭‮":
            stack.append(i)
        elif ch == "‬" and stack:
            j = stack.pop()
            out |= {i, j} if text[j] in "‪‫" else set()
    return out


def fold(text, spaces=True, lookalikes=False, no_glue=False, no_bidi=False, meaning=True):
    pairs = embedded(text)
    flags = {i for m in re.finditer("\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f", text) for i in range(m.start() + 1, m.end())}
    before, out = None, []
    for i, ch in enumerate(text):
        c = SimpleNamespace(prev=text[i - 1] if i else None, next=text[i + 1] if i + 1 < len(text) else None)
        letter = before is not None and unicodedata.category(before)[0] == "L"
        rules = [
            (not no_bidi and (i in pairs or of("kept_bidi", ch)), "keep"),
            (not no_glue and of("cjk", c.prev) and ("\U000e0100" <= ch <= "\U000e01ef" or "︀" <= ch <= "︍"), "keep"),
            (not no_glue and of("mongol", c.prev) and "᠋" <= ch <= "᠍", "keep"),
            (not no_glue and ch in "︎️" and of("emoji", c.prev), "keep"),
            (not no_glue and ch == "‍" and of("emoji", before) and of("emoji", c.next), "keep"),
            (not no_glue and ch in "‌‍" and script(c.prev) is not None and script(c.prev) == script(c.next), "keep"),
            (not no_glue and i in flags, "keep"),
            (not no_glue and "᠋" <= ch <= "᠍" and of("mongol", before) and letter, "keep"),
            (not no_glue and ch in "឴឵" and of("khmer", before) and letter, "keep"),
            (not no_glue and ch in "ᅟᅠ" and of("jamo", before), "keep"),
            (not no_glue and of("ortho", ch), "keep"),
            (meaning and of("math", ch) and visible(c.prev) and visible(c.next), "keep"),
            (of("strip", ch), "strip"),
            (spaces and of("space", ch), "space"),
            (lookalikes and (ch in LOOKALIKE or "Ａ" <= ch <= "Ｚ" or "ａ" <= ch <= "ｚ"), "confusable"),
            (unicodedata.category(ch) == "Cf" and not of("space", ch), "other_cf"),
        ]
        action = next((a for holds, a in rules if holds), "keep")
        put = {"keep": ch, "space": " ", "confusable": LOOKALIKE.get(ch) or chr(ord(ch) - 0xFEE0 if ord(ch) > 0xFEE0 else 63)}.get(action, "")
        kind = action
        if action == "strip":
            kind = next((k for k, n in (("tag_chars", "tag"), ("variation_selector", "selector"), ("bidi", "bidi"), ("zwj_family", "zero"), ("private_use", "private")) if of(n, ch)), "strip")
        if put and (action != "keep" or not of("glue", ch)):
            before = put
        out.append((ch, action, put, kind))
    return out


LETTERS = (
    "ab 1#\n.é葛漢ᠠᡳកខᄀ가بیका👨👩❤🏴АеＡａ" "­͏؜ᅟᅠ឴᠋᠎​‌‍‎‪‫‬‭‮⁠⁡⁤⁦⁩︀︎️﻿￹؀۝  　"
    "\U000e0001\U000e0067\U000e0062\U000e007f\U000e0100\U000f0000؅"
)


def texts():
    rng = random.Random(11)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 60))) for _ in range(500)]


@pytest.mark.parametrize("own", [{}, {"aggressive": True, "strip_bidi": True, "strip_emoji_glue": True, "preserve_semantic": False}, {"normalize_spaces": False}])
def test_clean_is_the_fold(spark, own):
    rows = texts()
    names = {"aggressive": "lookalikes", "strip_bidi": "no_bidi", "strip_emoji_glue": "no_glue", "preserve_semantic": "meaning", "normalize_spaces": "spaces"}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, t string")
    for r in layer_a.clean(docs, **own).collect():
        expected = fold(rows[r.doc_id], **{names[k]: v for k, v in own.items()})
        assert r.cleaned == "".join(e[2] for e in expected), ascii(rows[r.doc_id])
        assert (r.removed, r.replaced) == (sum(not e[2] for e in expected), sum(e[1] in ("space", "confusable") for e in expected))


def test_inspect_is_the_fold(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, t string")
    found = sorted((r.doc_id, r.codepoint, r.kind, r.n, r.places) for r in layer_a.inspect(docs).collect())
    expected: dict = {}
    for k, t in enumerate(rows):
        for i, (ch, action, _, kind) in enumerate(fold(t, no_bidi=True)):
            if action != "keep":
                expected.setdefault((k, ord(ch), kind), []).append(i)
    assert found == sorted((*k, len(v), ",".join(map(str, v[:10]))) for k, v in expected.items())


def test_rows_are_answered_one_by_one(spark):
    rows = [(1, "a​b"), (1, "c­d"), (None, "e​f"), (None, None), (2, ""), (3, "plain"), (1, "a​b"), (4, "‪x‬")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id int, t string, kind string")
    cleaned = sorted(map(repr, ((r.doc_id, r.cleaned, r.removed) for r in layer_a.clean(docs).collect())))
    assert cleaned == sorted(map(repr, [(1, "ab", 1), (1, "cd", 1), (None, "ef", 1), (None, None, 0), (2, "", 0), (3, "plain", 0), (1, "ab", 1), (4, "‪x‬", 0)]))
    hits = sorted(map(repr, ((r.doc_id, r.codepoint, r.n, r.places) for r in layer_a.inspect(docs).collect())))
    assert hits == sorted(map(repr, [(1, 0x200B, 1, "1"), (1, 0xAD, 1, "1"), (None, 0x200B, 1, "1"), (1, 0x200B, 1, "1"), (4, 0x202A, 1, "0"), (4, 0x202C, 1, "2")]))
    assert [tuple(r) for r in layer_a.bidi_pairs(docs).collect()] == [(4, 0, 2)]
    assert layer_a.inspect(docs.limit(0)).count() == layer_a.clean(docs.limit(0)).count() == 0
