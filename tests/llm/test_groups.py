"""Operators across rows, and the registry, against plain Python."""

import base64
import hashlib
import json
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from signalroom.llm import ann, common, minhash, registry, warc
from signalroom.llm.components import components

from . import corpus


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


@pytest.mark.parametrize(("paired", "block", "turns"), [(12, 512, 3), (2, 3, 0), (2, 4, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, paired, block, turns):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "TURNS", turns)
    monkeypatch.setattr(minhash, "FEW", 1)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(corpus.texts())
    base = corpus.prose(77, 120).split()
    for k in range(40):  # copies that drift apart: some are alike only through others
        copy = list(base)
        for j in range(k % 9):
            copy[(j * 13 + k) % len(copy)] = f"w{k}x{j}"
        rows.append((200 + k, " ".join(copy)))
    sets = defaultdict(set)
    for i, t in rows:
        sets[i] |= shingles(t, 4) if i is not None else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    found = minhash.group(corpus.documents(spark, rows), k=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert {r.component_id for r in found if r.doc_id is None} == {0, None}
    assert minhash.group(corpus.empty(spark)).count() == 0


def test_blocks_meet_once_unless_of_one_component(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    comps = [0] * 40 + [1000] * 9 + list(range(2000, 2011))
    members = [(k, c, 7 if k < 50 else 8, b"r", b"s") for k, c in enumerate(comps)]
    first, second = minhash.cells(spark.createDataFrame(members, "rep bigint, comp bigint, family bigint, registers binary, shingles binary"))
    left, right = ({(r.family, r.p, r.q): set() for r in side.collect()} for side in (first, second))
    for side, rows in ((left, first.collect()), (right, second.collect())):
        for r in rows:
            side[r.family, r.p, r.q].add(r.rep)
    met = set()
    for cell in left.keys() & right.keys():
        for a in left[cell]:
            for b in right[cell]:
                if a != b and (cell[1] != cell[2] or a < b):
                    assert (min(a, b), max(a, b)) not in met
                    met.add((min(a, b), max(a, b)))
    wanted = {(a, b) for a, x, f, *_ in members for b, y, g, *_ in members if a < b and f == g and x != y}
    assert wanted <= met and not any(comps[a] == comps[b] for a, b in met)
    assert sum(len(v) for v in left.values()) < 150  # the large component is not copied once per block of its own


def test_near_stage_decides_by_row(spark):
    base, other, third = (corpus.prose(k, 120) for k in (501, 502, 503))
    rows = [(None, ""), (None, base), (None, base + " tail"), (1, other), (2, other + " tail"), (2, third), (None, third + " tail"), (None, other.replace("a", "A"))]
    found = minhash.stage(spark, corpus.documents(spark, rows), "").collect()
    assert {(r.doc_id, r.text) for r in found} - {(None, base), (None, base + " tail")} == {(None, ""), (1, other), (2, third)}
    assert len(found) == 4


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        guesses = []
        for _ in range(40):
            common = rng.integers(0, 2**63, 400, dtype=np.uint64)
            own = int(400 * (1 / share - 1) / 2)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, own, dtype=np.uint64)])) for _ in range(2)]
            x, y = minhash.sketch(sets)
            n = np.array([len(sets[0])])
            guesses.append(minhash.corrected((x == y).mean(), (minhash.spans(n) * minhash.spans(n)).sum() / 2**minhash.MANTISSA))
        assert abs(np.mean(guesses) - share) < 0.03


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 20)] + [(300, 200), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(1, 51)} | {100 + k: 100 for k in range(1, 20)} | {300: 200}


def vectors(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 24)) * rng.uniform(0.5, 2, (n, 1))
    return x.astype(np.float32)


def test_nearest_recall_and_order(spark):
    x = vectors()
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None] + [0.0] * 22), (904, [1.0, 2.0]), (None, [1.0] * 24), (905, [float("inf")] * 24)]
    same = [(1000 + k, x[7].tolist()) for k in range(30)]
    table = spark.createDataFrame(rows + odd + same, "vec_id bigint, embedding array<float>")
    found = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    every = {i: np.array(v, np.float64) for i, v in rows + same}
    hits = total = 0
    for q in {r.query_id for r in found}:
        mine = [r for r in found if r.query_id == q]
        scores = {i: float((v * every[q]).sum()) for i, v in every.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len(set(best) & {r.vec_id for r in mine})
        total += 20
    assert hits / total >= 0.9
    assert {r.query_id for r in found} == {i for i in every if i % 20 == 0}
    assert ann.nearest(table.where("vec_id < 0"), table, 20).count() == 0


def test_nearest_within_each_length(spark):
    wide, narrow = vectors(60), vectors(40, seed=4)[:, :7]
    every = {k: v.astype(np.float64) for k, v in enumerate([*wide, *narrow])}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in every.items()], "vec_id bigint, embedding array<float>")
    found = ann.nearest(table, table.where("vec_id in (3, 70, 99)"), 5).collect()
    for q in (3, 70, 99):
        scores = {i: float((v * every[q]).sum()) for i, v in every.items() if i != q and len(v) == len(every[q])}
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == sorted(scores, key=lambda i: (-scores[i], i))[:5]
    assert len(found) == 15


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 2**16, (300, ann.PARTS), dtype=np.uint16)
    codes[100:200] = codes[:100] ^ rng.integers(0, 2, (100, ann.PARTS), dtype=np.uint16)
    asked = codes[:20] ^ np.uint16(1)
    raw = lambda x: pa.array([c.tobytes() for c in x])
    for bits in (0, 2):
        for radius in (0, 10, 20, 37, 100, 256):
            flips, found = ann.masks(bits, bits), []
            for part in range(ann.PARTS):
                for prefix in range(1 << bits):
                    mine = np.flatnonzero(codes[:, part] >> (ann.WIDTH - bits) == prefix) if bits else np.arange(len(codes))
                    left = pa.table({"part": [part] * len(mine), "rep": pa.array(mine, pa.int64()), "code": raw(codes[mine])})
                    may = int(ann.allowed(np.array([radius]))[0, part])
                    near = [q for q in range(20) if bin((int(asked[q, part]) >> (ann.WIDTH - bits) if bits else 0) ^ prefix).count("1") <= may]
                    right = pa.table({"q": pa.array(near, pa.int64()), "code": raw(asked[near]), "radius": pa.array([radius] * len(near), pa.int64())})
                    out = ann.search_cell(left, right)
                    found += [(q, r) for q, r in zip(out.column("q").to_pylist(), out.column("rep").to_pylist(), strict=True) if r is not None]
            assert len(flips) == 1 << bits and len(found) == len(set(found))
            far = np.bitwise_count(asked[:, None] ^ codes[None]).sum(axis=2)
            assert set(found) == set(map(tuple, np.argwhere(far <= radius).tolist()))


def test_clustered_vectors_are_not_scanned(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "CELL", 300)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 32))[np.arange(2400) % 40] + 0.02 * rng.standard_normal((2400, 32))
    x[:1000:20] = x[0]  # one vector that many rows have, queries too
    rows = [(k, v.tolist(), 1, 2.0, "x") for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, q bigint, score double, rep string")
    found = ann.nearest(table, table.where("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, 2400, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(2400), -scores))[:20].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert len(found) == 120 * 20 and hits / len(found) >= 0.9
    assert np.mean([r.met for r in found]) < 1200
    hot = [r.vec_id for r in sorted((r for r in found if r.query_id == 40), key=lambda r: r["rank"])]
    assert hot == [k for k in range(0, 1000, 20) if k != 40][:20]


def test_nearest_writes_little_beside_its_vectors(spark):
    common.clean_up(spark)
    x = np.random.default_rng(4).standard_normal((3000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = ann.nearest(table, table.where("vec_id % 20 = 0"))
    assert found.count() == 150 * 20
    written = [Path(p.removeprefix("file://")) for p in common._written]
    assert sum(f.stat().st_size for p in written for f in p.rglob("*.parquet")) < 1.5 * x.nbytes
    common.clean_up(spark)


def test_equal_vectors_of_many_blocks_and_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 50)
    x = np.random.default_rng(5).integers(-3, 4, (400, 8)).astype(float)
    x[::4] = x[0]
    ids = np.r_[np.arange(300), np.full(100, 20)]  # the last hundred rows repeat a query's id
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    found = ann.nearest(table, table.where("vec_id in (0, 20, 40, 41)"), 5).collect()
    asked = {int(q): x[q] for q in (0, 40, 41)} | {20: np.array(min(x[ids == 20].tolist()))}
    for q, y in asked.items():
        expected = sorted((-float(v @ y), int(i)) for i, v in zip(ids, x, strict=True) if i != q and v.any())[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == expected


PAGES = [(1, "http://a.example/x y", "<p>one</p>"), (2, None, None), (3, "http://b.example/", ""), (4, "http://c.example/", "<p>one</p>"), (5, "http://d.example/", "é" * 30000), (5, "http://d.example/", "é" * 30000), (None, "http://e.example/", "<p>one</p>"), (None, "http://f.example/", "alone")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, path, roll=500)
    rows = warc.captures(manifest, path).collect()
    assert len(rows) == len(PAGES)
    read = sorted((repr(r.page_id), r.url or "", r.payload_bytes, r.response.payload_digest, r.response.record_type) for r in rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    expected = sorted((repr(i), u or "", len((h or "").encode()), digest(h), "revisit" if (i, h) in ((3, ""), (4, "<p>one</p>"), (None, "<p>one</p>")) else "response") for i, u, h in PAGES)
    assert read == expected
    for r in rows:
        assert r.response.intact and r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id
        assert r.response.payload is None if r.response.record_type == "revisit" else len(r.response.payload) == r.payload_bytes
        assert json.loads(bytes(r.metadata.block).decode().removeprefix("capture: "))["url"] == r.url
    (tmp_path / "warc" / "stray.warc.gz").write_bytes(b"left by a task that was lost")
    assert warc.captures(manifest, path).count() == len(PAGES)


def test_warc_least_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/warc"
    kinds = {r.response.record_type for r in warc.captures(warc.write(pages, path, least=100), path).collect()}
    assert kinds == {"response"}


def test_shared_folder_and_clean_up(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(f"{common.shared_dir(spark)}/kept-by-others")
    common.clean_up(spark)
    made = common.materialize(spark.range(5), "some")
    assert made.count() == 5 and common.clean_up(spark) == 1 and common.clean_up(spark) == 0
    assert spark.read.parquet(f"{common.shared_dir(spark)}/kept-by-others").count() == 3

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Cluster)


def test_registry_has_each_operator_once():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_the_rest_imports_without_this_package():
    code = "import sys; sys.modules['signalroom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
