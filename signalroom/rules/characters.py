"""Code-point classes of the character rules, as ranges and regular-expression classes that Java and RE2 read alike."""

from __future__ import annotations

# Code points that are stripped, by themselves or as ranges (first, last).
STRIP = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFF9, 0xFFFB), (0xE0001, 0xE007F), (0xE0100, 0xE01EF), (0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD),
]
TAGS = [(0xE0001, 0xE007F)]
SELECTORS = [(0xE0100, 0xE01EF), (0xFE00, 0xFE0F), (0x180B, 0x180D)]
BIDI = [(0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)]
KEPT_BIDI = [(0x061C, 0x061C), (0x200E, 0x200F), (0x2066, 0x2069)]
ZERO_WIDTH = [(0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0x180E, 0x180E)]
PRIVATE = [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]
SPACES = [(0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
EMOJI_BASES = [
    (0x1F000, 0x1FAFF), (0x2190, 0x27BF), (0x2B00, 0x2BFF), (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x2122, 0x2122),
    (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x0023, 0x0023), (0x002A, 0x002A), (0x0030, 0x0039),
]
IDEOGRAPHS = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]
ORTHOGRAPHIC = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
JAMO = [(0x1100, 0x11FF), (0xA960, 0xA97C), (0xD7B0, 0xD7C6)]
MONGOLIAN, KHMER = [(0x1800, 0x18AF)], [(0x1780, 0x17FF)]
SCRIPTS = [("arabic", 0x0600, 0x08FF), ("indic", 0x0900, 0x0DFF), ("south-asian", 0x0F00, 0x109F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF)]
#: Invisible characters that belong to a base: they never become the base of others.
GLUE = [(0x200C, 0x200D), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x180B, 0x180D), (0xE0020, 0xE007F), (0x17B4, 0x17B5), (0x115F, 0x1160)]
MATH = [(0x2061, 0x2064)]
# Cyrillic letters and the Latin ones they look like.
CYRILLIC = "АВЕКМНОРСТХаеорсухі"
LATIN = "ABEKMHOPCTXaeopcyxi"
#: Fullwidth Latin letters lie at a fixed distance from the plain ones.
FULLWIDTH = {chr(c + 0xFEE0): chr(c) for c in [*range(65, 91), *range(97, 123)]}
CONFUSABLES = dict(zip(CYRILLIC, LATIN, strict=True)) | FULLWIDTH


def char_class(*tables: list[tuple[int, int]]) -> str:
    """The inside of a bracket expression for ranges."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for t in tables for a, b in t)


def within(column: str, table: list[tuple[int, int]]) -> str:
    """SQL: whether a code point lies in one of the ranges."""
    return "(" + " OR ".join(f"{column} = {a}" if a == b else f"{column} BETWEEN {a} AND {b}" for a, b in table) + ")"


#: Texts without any of these hold nothing to report (confusables aside).
SUSPECT = "[\\p{Cf}\\p{Co}" + char_class(STRIP, SPACES) + "]"
