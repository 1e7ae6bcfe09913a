"""Phrases of formulaic prose, and the words a token guess calls common."""

from __future__ import annotations

# Fixed values: (regular expression in Python's dialect, label, weight).
PHRASES = [
    (r"\bdelve(?:s|d)?\s+into\b", "delve into", 1.2),
    (r"\ba\s+testament\s+to\b", "a testament to", 1.1),
    (r"\brich\s+tapestry(?:\s+of)?\b", "rich tapestry", 1.3),
    (r"\bplays?\s+a\s+(?:pivotal|crucial|vital|key)\s+role\b", "plays a pivotal/crucial role", 1.0),
    (r"\bin\s+(?:today'?s|the)\s+(?:(?:fast-paced|ever-evolving|digital|rapidly\s+changing)\s+)*(?:world|landscape|era|environment)\b", "in today's fast-paced world/landscape", 1.4),
    (r"\bit\s+is\s+(?:important|essential|crucial|worth\s+noting)\s+to\s+(?:note|remember|consider|highlight)\b", "it is important/crucial to note", 0.9),
    (r"\bnot\s+only\b[\w\s,]+\bbut\s+(?:also\s+)?(?:serves\s+to|acts\s+as|highlights)\b", "not only ... but also serves to", 0.8),
    (r"\bserve(?:s|d)?\s+as\s+a\s+(?:beacon|reminder|catalyst|cornerstone)\b", "serves as a beacon/catalyst/cornerstone", 1.1),
    (r"\bunderscore(?:s|d)?\s+the\s+(?:importance|need|significance)\b", "underscores the importance/need", 0.9),
    (r"\bfoster(?:s|ing|ed)?\s+a\s+(?:sense|culture|deeper\s+understanding)\b", "fosters a sense/culture", 0.9),
    (r"\bseamlessly\s+(?:integrates?|integrated|blends?|combine[sd]?)\b", "seamlessly integrates/blends", 1.0),
    (r"\bnavigat(?:e|ing|es|ed)\s+the\s+(?:complexities|intricacies|nuances)\b", "navigating the complexities/nuances", 1.0),
    (r"\bmultifaceted\s+(?:nature|approach|landscape)\b", "multifaceted nature/approach", 1.0),
    (r"\bharness(?:ing|ed|es)?\s+the\s+power\s+of\b", "harnessing the power of", 1.0),
    (r"\ba\s+myriad\s+of\b", "a myriad of", 0.8),
    (r"\bparadigm\s+shift\b", "paradigm shift", 0.9),
    (r"\bholistic\s+(?:approach|view|perspective)\b", "holistic approach/perspective", 0.9),
    (r"\bin\s+conclusion\b[,\s]", "in conclusion", 0.8),
    (r"\bto\s+summarize\b[,\s]", "to summarize", 0.8),
    (r"\bultimately\b[,\s]", "ultimately,", 0.6),
    (r"\bfurthermore\b[,\s]", "furthermore,", 0.6),
    (r"\bmoreover\b[,\s]", "moreover,", 0.6),
    (r"\bas\s+an\s+ai\b", "as an AI", 1.5),
    (r"\bi\s+hope\s+this\s+helps\b", "I hope this helps", 1.2),
]
# Words that count as common.
COMMON = "the a an and or but of to in on for with as at by from is are was were be been it its this that these those i you he she we they not no do does did have has had will would can could should may might must".split()
#: What a text in small letters must hold for each phrase to occur; letters that other signs fold to are left out.
NEEDS = [
    "delve", "tament", "tape", "role", "", "", "only", "erve", "under", "ter", "eamle", "nav", "faceted", "harne", "myr", "parad", "hol", "concl",
    "ummar", "ult", "furthermore", "moreover", "", "hope",
]
#: White space as Python's \s has it, for the inside of brackets.
WHITE = "\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}"
WORD_CHARS = "\\p{L}\\p{N}_"
WORD = f"[{WORD_CHARS}](?:[{WORD_CHARS}'-]*[{WORD_CHARS}])?"
LINE_ENDS = "\\r\\n|[\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
#: A fenced block, or one that is never closed.
FENCED = f"(?ms)^[{WHITE}]*```.*?(?:^[{WHITE}]*```[^\\n]*$|\\z)"


def translated(pattern: str, before: str, after: str) -> str:
    """A phrase pattern with explicit classes; word boundaries become ``before`` a word and ``after`` one."""
    out, at = "", 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == "\\b":
            starts = pattern[at + 2 : at + 3].isalpha()
            out += before if starts else after
            at += 2
        elif two == "\\s":
            inside = out.rfind("[") > out.rfind("]")
            out += WHITE if inside else f"[{WHITE}]"
            at += 2
        elif two == "\\w":
            out += WORD_CHARS
            at += 2
        else:
            out += pattern[at]
            at += 1
    return out


def java(pattern: str) -> str:
    return "(?iu)" + translated(pattern, f"(?<![{WORD_CHARS}])", f"(?![{WORD_CHARS}])")


def re2(pattern: str) -> str:
    """Without look-around: the neighbours are consumed, which differs only for phrases that share one."""
    first, rest = pattern[:2], pattern[2:]
    body = translated(rest, f"(?:^|[^{WORD_CHARS}])", f"(?:$|[^{WORD_CHARS}])" if not rest.endswith("[,\\s]") else "")
    return "(?i)" + (f"(?:^|[^{WORD_CHARS}])" if first == "\\b" else first) + body
