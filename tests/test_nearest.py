"""Nearest by cosine against all pairs in plain Python, in several passes and small blocks."""

import math
import random

import numpy as np
import pytest

from signalroom.operators import nearest
from signalroom.plans import style


def answer(rows, k=5):
    out = []
    for q, a in rows:
        if q is None or q % 100 or a is None or not any(a):
            continue
        found = []
        for v, b in rows:
            if v is None or v == q or b is None or not any(b) or len(a) != len(b):
                continue
            dot = lambda x, y: sum((p * r for p, r in zip(x, y, strict=True)), 0.0)
            found.append((round(dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))), 6), v))
        out += [(q, c, v) for c, v in found]
    best = []
    for q in {q for q, *_ in out}:
        best += [(q, v, c, k0 + 1) for k0, (c, v) in enumerate(sorted(((c, v) for p, c, v in out if p == q), key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(best)


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(tuple(r) for r in style.cosine_topk(spark, str(tmp_path)).select("query_id", "vec_id", "cosine", "place").collect())


@pytest.mark.parametrize("asked", [65_536, 3])
def test_nearest_is_all_pairs(spark, tmp_path, monkeypatch, asked):
    for name, value in (("ASKED", asked), ("QUERIES", 4), ("ROWS", 16), ("PAIRS", 7)):
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = [(k * 25, base[rng.randrange(60)] if k % 3 else [x + rng.gauss(0, 1e-4) for x in base[0]]) for k in range(120)]
    rows += [(100, base[3]), (100, base[3]), (7, None), (None, base[1]), (9, [0.0] * 6), (300, [1.0, 2.0]), (11, [2.0, 1.0]), (13, [1e200, 0.0])]
    expected = [r for r in answer([r for r in rows if r[0] != 13]) if r[0] != 300]
    assert [r for r in stored(spark, tmp_path, rows) if r[0] != 300] == expected


def test_a_block_is_one_product(monkeypatch):
    """What is measured pair by pair doesn't grow with queries times rows, copies of a vector neither."""
    pairs = []
    take = nearest.Best._take
    monkeypatch.setattr(nearest.Best, "_take", lambda self, q, *rest: (pairs.append(len(q)), take(self, q, *rest))[1])
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 16))
    x[::2] = x[0]
    best = nearest.Best(np.arange(0, 6000, 100), x[::100], 5)
    for a in range(0, 6000, 1000):
        best.meet(np.arange(a, a + 1000), x[a : a + 1000])
    assert sum(pairs) < 60 * 6000 / 20
    assert best.found[1].tolist() == [0, 2, 4, 6, 8]
