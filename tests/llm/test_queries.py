"""Every registered query and every pipeline stage over whole tables of hard cases, against plain Python."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalroom.llm import common, quality, registry, toxicity

from . import corpus
from .test_groups import PAGES, shingles
from .test_texts import base_counts

LABELS = [(k, int(k % 2 == 0), int(k % 3 == 0)) for k in range(30, 60)] + [(None, 1, 1), (0, None, None), (31, 1, 0), (900, 1, 0)]
#: Names that operators use themselves, as further columns of documents.
EXTRA = ["quality", "kept", "score", "_score", "_quality", "_mark", "_id", "_kept", "_chunk", "ids", "license_id", "salt", "rank", "virtual_slot", "component_id"]
RNG = np.random.default_rng(12)
VECTORS = [(k, RNG.standard_normal(16).tolist()) for k in range(130)] + [(200, None), (220, [0.0] * 16), (240, [float("nan")] * 16), (None, [1.0] * 16), (20, [0.5] * 16)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables with hard cases, and the same without rows."""
    top = tmp_path_factory.mktemp("tables")
    docs = corpus.documents(spark).drop("score", "kept", "ids").select("*", *[F.lit(f"own {n}").alias(n) for n in EXTRA])
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int"),
        "pages": spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit("own")),
        "embeddings": spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<double>").withColumn("query_id", F.lit(1)).withColumn("score", F.lit(0.0)),
    }
    for name, table in tables.items():
        table.coalesce(2).write.parquet(f"{top}/full/{name}.parquet")
        table.limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return f"file://{top}/full", f"file://{top}/none"


TEXTS = corpus.texts()


def result(spark, folders, number):
    name = next(n for n in registry.QUERIES if n.startswith(f"op{number}_"))
    empty = registry.QUERIES[name](spark, folders[1])
    assert empty.count() == 0
    found = registry.QUERIES[name](spark, folders[0])
    assert [f.dataType for f in found.schema] == [f.dataType for f in empty.schema]
    return found.collect()


def test_op1(spark, folders):
    rows = result(spark, folders, 1)
    assert len(rows) == len(TEXTS) and {r.doc_id: r.license_id for r in rows if r.license_id} == {22: "MIT", 23: "CC-BY-NC-4.0"}


def test_op2(spark, folders):
    seen: dict = {}
    for i, t in TEXTS:
        data = (t or "").encode()
        for j in range(len(data) - 49) if i is not None else ():
            seen[data[j : j + 50]] = min(i, seen.get(data[j : j + 50], i))
    expected = []
    for i, t in TEXTS:
        data, gone = (t or "").encode(), np.zeros(len((t or "").encode()) + 1, bool)
        for j in range(len(data) - 49) if i is not None else ():
            if seen[data[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[: len(data)]])
        expected.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert corpus.by_row([tuple(r)[:5] for r in result(spark, folders, 2)]) == corpus.by_row(expected)


def test_op3(spark, folders):
    rows = result(spark, folders, 3)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = [(i, *(c := base_counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for i, t in TEXTS]
    assert corpus.by_row([tuple(r[n] for n in names) for r in rows]) == corpus.by_row(expected)
    assert all(r.kept == (not r.base_failed and r.llr * 1e6 >= quality.THRESHOLD) for r in rows)


def test_op4(spark, folders):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    sha, expected = (lambda s: hashlib.sha256(s.encode()).hexdigest()), []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, folders, 4)]
    assert corpus.by_row(found) == corpus.by_row(expected)


def roots(sets):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_op5(spark, folders):
    sets = {i: shingles(t, 4) for i, t in TEXTS if i is not None}
    top = roots(sets)
    rows = result(spark, folders, 5)
    expected = [(i, len(sets[i]), top[i], top[i] == i) for i, _ in TEXTS if i is not None]
    assert corpus.by_row([tuple(r)[:4] for r in rows if r.doc_id is not None]) == corpus.by_row(expected)
    assert sorted(r.n_shingles for r in rows if r.doc_id is None) == sorted(len(shingles(t, 4)) for i, t in TEXTS if i is None)


def test_op6(spark, folders):
    rows = result(spark, folders, 6)
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1 if r.doc_id is not None else None)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1


def packed_ids(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(places)


def pieces(library, texts):
    out = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    return out


def best_fit(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def test_op7(spark, folders):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = result(spark, folders, 7)
    expected = pieces(library, TEXTS)
    assert corpus.by_row([tuple(r)[:5] for r in rows]) == corpus.by_row(expected)
    assert packed_ids(rows, 4096) == best_fit([p[3] for p in expected], 4096)


def test_op8(spark, folders):
    rows = result(spark, folders, 8)
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS]
    assert corpus.by_row([(r.doc_id, r["size"], r.text_crc32) for r in rows]) == corpus.by_row(expected)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and {r.shard for r in rows} <= set(range(16))
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_op9(spark, folders):
    rows = result(spark, folders, 9)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first: dict = {}
    for i, _, h in PAGES:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    expected = []
    for i, _, h in PAGES:
        again = digest(h) in first and i != first[digest(h)]
        expected.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first[digest(h)] if again else None))
    assert corpus.by_row([tuple(r)[:5] for r in rows]) == corpus.by_row(expected)
    assert all(r.intact and r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id for r in rows)


def test_op10(spark, folders):
    rows = result(spark, folders, 10)
    usable = [(i, np.array(v)) for i, v in VECTORS if i is not None and v is not None and np.isfinite(v).all() and any(v)]
    asked = {i: min((tuple(v) for j, v in usable if j == i)) for i, _ in usable if i % 20 == 0}
    expected = []
    for q, v in asked.items():
        best = sorted(((-float(np.dot(x, v)), i) for i, x in usable if i != q))[:20]
        expected += [(q, k, i, s) for k, (s, i) in enumerate(best, 1)]
    found = sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in rows)
    assert [f[:3] for f in found] == sorted(e[:3] for e in expected)  # so few are all compared
    assert max(abs(f[3] - e[3]) for f, e in zip(found, sorted(expected), strict=True)) < 1e-12


def stage_rows(spark, folders, k, docs):
    name, stage = corpus_pipeline.STAGES[k]
    out = common.materialize(stage(spark, docs, folders[0]), "stage")
    if name != "packing":
        assert out.columns == docs.columns
        assert {r[n] for n in EXTRA for r in out.select(n).collect()} <= {f"own {n}" for n in EXTRA}
    return out


def test_stages_and_the_pipeline(spark, folders, monkeypatch):
    """Each stage on what the one before kept, against plain Python; and run() gives the rows of the last."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(quality, "THRESHOLD", -10_000_000)  # so small a corpus says little about good words
    monkeypatch.setattr(quality.assess, "__defaults__", (-10_000_000, *quality.assess.__defaults__[1:]))
    docs = common.table(spark, folders[0], "documents")
    pairs = lambda df: corpus.by_row([(r.doc_id, r.text) for r in df.collect()])

    good = stage_rows(spark, folders, 0, docs)
    passed = [(i, t) for i, t in TEXTS if not ((c := base_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0])]
    assert pairs(good) == corpus.by_row(passed) and len(passed) < len(TEXTS)

    mild = stage_rows(spark, folders, 1, good)
    scores = toxicity.score(good.select("doc_id", "text"), common.table(spark, folders[0], "labels")).collect()
    passed = [(r.doc_id, r.text) for r in scores if r.score < toxicity.THRESHOLD]
    assert pairs(mild) == corpus.by_row(passed)

    single = stage_rows(spark, folders, 2, mild)
    numbered = sorted(set(passed), key=lambda x: (x[0] is None, x[0] or 0, minhash_mark(x[1])))
    sets = {k: shingles(t, 5) for k, (_, t) in enumerate(numbered)}
    passed = [numbered[k] for k, top in roots(sets).items() if k == top]
    assert pairs(single) == corpus.by_row(passed)

    short = stage_rows(spark, folders, 3, single)
    seen: dict = {}
    for i, t in passed:
        for j in range(len(t.encode()) - 49) if i is not None else ():
            seen[t.encode()[j : j + 50]] = min(i, seen.get(t.encode()[j : j + 50], i))
    left = []
    for i, t in passed:
        data, gone = t.encode(), set()
        for j in range(len(data) - 49) if i is not None else ():
            if seen[data[j : j + 50]] < i:
                gone |= set(range(j, j + 50))
        left.append((i, bytes(c for j, c in enumerate(data) if j not in gone).decode(errors="ignore")))
    assert pairs(short) == corpus.by_row(left) and left != passed
    assert all(r.n_chars == len(r.text) for r in short.collect())

    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    expected = pieces(library, left)
    last = stage_rows(spark, folders, 4, short).collect()
    assert corpus.by_row([tuple(r)[:5] for r in last]) == corpus.by_row(expected)
    assert packed_ids(last, 4096) == best_fit([p[3] for p in expected], 4096)

    whole = corpus_pipeline.run(spark, folders[0]).collect()
    assert corpus.by_row([tuple(r)[:5] for r in whole]) == corpus.by_row(expected)
    assert corpus_pipeline.run(spark, folders[1]).count() == 0


def minhash_mark(text):
    return hashlib.md5(text.encode()).digest()
