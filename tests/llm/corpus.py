"""A small corpus with the hard cases: nulls, empty and long texts, ties, repeated rows, copies and clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, ids string"
WORDS = ["the", "sea", "of", "grass", "ran", "on", "under", "wide", "skies", "and", "no", "road", "crossed", "it", "élan", "über", "niño", "stone"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", str(rng.randrange(40))]) for _ in range(n)).capitalize() + "."


def texts() -> list[tuple[int | None, str | None]]:
    long_ = prose(1, 30_000)
    base, passage = prose(2, 300), prose(3, 40)
    edited = base.split()
    edited[150] = "changed"
    rows = [
        (0, base), (1, None), (2, ""), (3, "   \n\t "), (4, base), (5, " ".join(edited)), (6, long_), (7, long_[:4000] + " tail"), (8, prose(4, 60) + "\n" + passage),
        (9, passage + "\n" + prose(5, 60)), (10, "word"), (11, "Two words"), (12, "a b c"), (13, "A B C"), (14, "a b c d"), (15, "x" * 400), (16, "x" * 60), (17, "\U0001f600" * 40 + " é"),
        (18, "<|endoftext|> and <|startoftext|>'s don't ÉÀ ΣΑΣ 12 ½ ..."), (None, base), (None, None), (19, "lines\nlines\nlines\n\nof #*$ text & | <more>"),
        (20, "one two three four five six " * 12), (22, "Released under the MIT Licence."), (23, "Copyright 2020 Somebody\nLicensed under CC BY-NC 4.0"),
    ]
    rows += [(30 + k, prose(100 + k, 80)) for k in range(30)]
    return [*rows, (10, "word"), (4, base)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 0.5, True, "x") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows):
    """Rows as comparable tuples, in a stable order."""
    return sorted(tuple(r) for r in rows) if all(None not in tuple(r) for r in rows) else sorted(map(repr, map(tuple, rows)))
