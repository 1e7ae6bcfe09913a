"""Operators on one text at a time, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalroom.llm import bpe, licenses, packing, quality, sharding, suffixes, toxicity

from . import corpus

SPACE = "[^\x20\x09-\x0d]+"


def base_counts(text):
    w = re.findall(SPACE, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_and_verdict(spark):
    docs = corpus.documents(spark)
    labels = spark.createDataFrame([(i, 1 if i >= 30 else 0, 0) for i in range(20, 60)] + [(None, 1, 0), (31, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.assess(docs, labels).select("doc_id", "text", "quality.*").collect()
    assert len(rows) == len(corpus.texts())
    for r in rows:
        n, chars, symbols, dup, repeat = base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed and r.llr * 1e6 >= quality.THRESHOLD)
    assert quality.assess(corpus.empty(spark), labels).count() == 0
    mean = lambda rs: sum(r.llr for r in rs) / len(rs)
    assert mean([r for r in rows if (r.doc_id or 0) >= 30]) > mean([r for r in rows if r.doc_id in (19, 20)])


def test_quality_ratios_are_those_of_the_counts(spark):
    xxhash = pytest.importorskip("xxhash")
    docs = corpus.documents(spark, [(1, "good words here"), (2, "bad ## bad"), (3, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    ratios = quality.log_ratios(docs, labels, buckets=64)

    def hashed(*longs):
        h = 42
        for x in longs:
            h = xxhash.xxh64(x.to_bytes(8, "little", signed=True), seed=h & (2**64 - 1)).intdigest()
            h -= 2**64 if h >= 2**63 else 0
        return h

    def word(t):
        h = xxhash.xxh64(t.encode(), seed=42).intdigest()
        return h - 2**64 if h >= 2**63 else h

    def buckets(tokens):
        h = [word(t) for t in tokens]
        return [hashed(x) % 64 for x in h] + [hashed(a, b) % 64 for a, b in zip(h, h[1:], strict=False)]

    good, raw = Counter(buckets(["good", "words", "here"])), Counter(buckets(["good", "words", "here"]) + buckets(["bad", "##", "bad"]))
    total = sum(good.values()) + 64, sum(raw.values()) + 64
    expected = [round(1e6 * (np.log((good[b] + 1) / total[0]) - np.log((raw[b] + 1) / total[1]))) for b in range(64)]
    assert max(abs(a - b) for a, b in zip(ratios, expected, strict=True)) <= 1


def test_bpe_round_trip_and_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = corpus.documents(spark).drop("ids")
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(corpus.texts())
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(corpus.empty(spark).drop("ids")).count() == 0
    again = bpe.encode(corpus.documents(spark))  # a column of that name gives way
    assert again.columns == [*docs.columns, "ids"] and again.count() == len(rows)


def test_automaton_refuses_improper_merges():
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "abc": 4}
    with pytest.raises(ValueError, match="merge 0"):
        bpe.Automaton(vocab, [("ab", "c"), ("a", "b")], list("abc"))


def test_automaton_on_nested_repeats():
    vocab = {"a": 0, "b": 1, "aa": 2, "aab": 3, "aaaa": 4}
    merges = [("a", "a"), ("aa", "b"), ("aa", "aa")]
    automaton = bpe.Automaton(vocab, merges, ["a", "b"])

    def plain(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    words = [format(k, "b").replace("0", "a").replace("1", "b") for k in range(1, 600)] + ["a" * n for n in range(1, 30)]
    symbols = np.array(["ab".index(c) for w in words for c in w])
    ids, counts = automaton.encode(symbols, np.array(list(map(len, words))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(w) for w in words]


def test_round_trip_is_one_python_step(spark):
    docs = corpus.documents(spark)
    apart = bpe.decode(bpe.encode(docs)).drop("text")
    both = bpe.round_trip(docs)
    assert sorted(both.columns) == sorted(apart.columns)
    assert corpus.by_row(both.select(apart.columns).collect()) == corpus.by_row(apart.collect())
    assert bpe.round_trip(corpus.empty(spark)).count() == 0
    plan = bpe.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_words_in_use_are_learned_once(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 200)
    codec, learned = bpe.Codec(bpe.tokenizer_spec()), []
    plain, encode = bpe.Codec(bpe.tokenizer_spec()), codec.automaton.encode
    monkeypatch.setattr(codec.automaton, "encode", lambda symbols, sizes: learned.append(len(sizes)) or encode(symbols, sizes))
    common_words = " ".join(f"often{chr(97 + k)}x" for k in range(26))
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    for k in range(40):
        texts = [common_words, " ".join(f"rare{letters(100 * k + j)}" for j in range(20)) + " ! " + common_words, "", None]
        plain.kept.clear()
        assert codec.encode_batch(texts) == plain.encode_batch(texts)
        assert len(codec.kept) <= 200 // 2 + 2 * 46 + 3
    assert sum(learned) == 26 + 40 * 20 + 1


def test_packing_places_every_piece_once(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = packing.pack_documents(corpus.documents(spark), 64).select(packing.ORDER).collect()
    expected = []
    for doc_id, text in corpus.texts():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(doc_id, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert corpus.by_row([r[:5] for r in rows]) == corpus.by_row(expected)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(corpus.empty(spark)).count() == 0


def test_packing_plan_is_best_fit():
    counts = {6: 3, 4: 3, 5: 2, 1: 1}
    rows, used = packing.plan(counts, 10)
    assert used == 5 and sum(r[2] for r in rows) == sum(counts.values())
    many = {n: 1 + n * 7 % 11 for n in range(1, 65)}
    rooms: list[int] = []
    for n in sorted(many, reverse=True):  # the same, one piece at a time
        for _ in range(many[n]):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 64) - n)
    assert packing.plan(many, 64)[1] == len(rooms)


def test_ranks_are_gapless_with_small_groups(spark):
    pieces = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 3 + 1).alias("length"), F.lit(0).cast("bigint").alias("ids_crc32"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    found = packing.ranked(pieces, counts, group=50).groupBy("length").agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("most")).collect()
    assert {r.length: (r.n, r.most + 1) for r in found} == {n: (c, c) for n, c in counts.items()}


def test_shards(spark):
    rows = sharding.shard_documents(corpus.documents(spark)).collect()
    assert len(rows) == len(corpus.texts())
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus.texts()]
    assert corpus.by_row([(r.doc_id, r["size"], r.text_crc32) for r in rows]) == corpus.by_row(expected)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard_documents(corpus.empty(spark)).count() == 0


def test_resharding_moves_only_rows_of_moved_slots(spark, tmp_path):
    texts = [(k, corpus.prose(k, 10 + k % 40)) for k in range(400)] + [(None, corpus.prose(900 + k, 20)) for k in range(50)] + [(7, corpus.prose(990 + k, 20)) for k in range(50)]
    measured = sharding.measure(corpus.documents(spark, texts), 256).cache()
    path = f"file://{tmp_path}/map"
    sizes = sharding.slot_bytes(measured)
    first = sharding.place(measured, sharding.store_map(spark, sharding.plan_map(sizes, 4, 256), 1, path)).collect()
    second = sharding.reshard(measured, path, 5).collect()
    one, two = sharding.read_map(spark, path, 1)[0], sharding.read_map(spark, path)
    assert two[1] == 2 and {r.map_version for r in second} == {2} and {r.map_version for r in first} == {1}
    moved = {s for s in range(256) if one[s] != two[0][s]}
    assert moved and {two[0][s] for s in moved} == {4}
    key = lambda r: (repr(r.doc_id), r["size"], r.text_crc32, r.virtual_slot)
    before, after = {key(r): r.shard for r in first}, {key(r): r.shard for r in second}
    assert {k for k in before if before[k] != after[k]} == {k for k in before if k[3] in moved}
    for rows in (first, second):
        load = [sum(r["size"] for r in rows if r.shard == s) for s in {r.shard for r in rows}]
        assert max(load) - min(load) < 2500
        for shard in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len({r.virtual_slot for r in first if r.doc_id is None}) > 20 and len({r.virtual_slot for r in first if r.doc_id == 7}) > 20


def test_shards_are_an_independent_plan(spark):
    rows = sharding.shard_documents(corpus.documents(spark), 3, 64).collect()
    size: dict = {}
    for r in rows:
        size[r.virtual_slot] = size.get(r.virtual_slot, 0) + r["size"]
    load, owner = [0, 0, 0], {}
    for slot, n in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        owner[slot] = min(range(3), key=lambda k: (load[k], sum(v == k for v in owner.values()), k))
        load[owner[slot]] += n
    assert {r.virtual_slot: r.shard for r in rows} == owner


def test_shard_map_balances_and_moves_little():
    sizes = {s: 1 + s * 37 % 101 for s in range(4000)}
    owner = sharding.plan_map(sizes, 16, 4000)
    load = np.bincount(owner, weights=[sizes[s] for s in range(4000)])
    assert load.max() - load.min() <= 101
    grown = sharding.rebalance(owner, sizes, 17)
    moved = [s for s in range(4000) if owner[s] != grown[s]]
    assert all(grown[s] == 16 for s in moved)
    load = np.bincount(grown, weights=[sizes[s] for s in range(4000)], minlength=17)
    assert load.max() - load.min() <= 3 * 101


def test_licenses(spark):
    rows = {r.doc_id: r for r in licenses.scan(corpus.documents(spark), licenses.known_licenses(spark)).collect()}
    assert rows[22].license_id == "MIT" and rows[22].notices == "MIT"
    assert rows[23].license_id == "CC-BY-NC-4.0" and rows[23].notice_lines == 1
    assert rows[0].license_id is None and rows[1].notices == ""
    whole = corpus.documents(spark, [(1, "Copyright (c) 2019 A. Person\n" + licenses.MIT.upper().replace("SUBLICENSE", "sub-license")), (2, licenses.ISC + " more")])
    found = {r.doc_id: r.license_id for r in licenses.scan(whole, licenses.known_licenses(spark)).collect()}
    assert found == {1: "MIT", 2: None}
    assert licenses.scan(corpus.empty(spark), licenses.known_licenses(spark)).count() == 0


@pytest.mark.parametrize("most", [10_000, 2])
def test_licenses_in_lines_and_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "MAX_BROADCAST", most)  # beyond it, lines are joined
    rows = [
        (1, "x\nSPDX-License-Identifier: MIT\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (1, "Released under CC0 1.0."), (None, "SPDX-License-Identifier: MIT"), (2, None), (3, ""),
        (4, "Copyright (c) [year] [fullname]\n" + licenses.MIT), (5, "Copyright Jane Doe\nCopyright Acme Inc.\n" + licenses.MIT), (6, "Copyright (c) Jane\n" + licenses.ISC), (1, "Released under CC0 1.0."),
    ]
    names = ["canonical_sha256", "license_id", "notices", "notice_lines", "line_ids", "_known", "_id", "_lines", "_text", "digest", "line", "n"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("own").alias(n) for n in names])
    out = licenses.scan(docs, licenses.known_licenses(spark))
    assert sorted(out.columns) == sorted(["doc_id", "text", *names])
    found = corpus.by_row(out.select("doc_id", "license_id", "notice_lines", "notices").collect())
    expected = [(1, None, 3, "CC-BY-4.0,MIT"), (1, "CC0-1.0", 1, "CC0-1.0"), (1, "CC0-1.0", 1, "CC0-1.0"), (None, "MIT", 1, "MIT"), (2, None, 0, ""), (3, None, 0, ""), (4, "MIT", 0, ""), (5, "MIT", 0, ""), (6, "ISC", 0, "")]
    assert found == corpus.by_row(expected)
    assert {r[0] for r in out.select("digest").collect()} == {"own"}


def test_license_digests_are_those_of_the_public_files(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(k, (folder / f).read_text()) for k, f in enumerate(files) if (folder / f).exists()]
    if not texts:
        pytest.skip("no licence files here")
    texts += [(100 + k, "  " + re.sub(r"\bLicense\b", "LICENCE", t.replace("\n", " \r\n"))) for k, t in texts]
    found = {r.doc_id: r.license_id for r in licenses.scan(corpus.documents(spark, texts), licenses.known_licenses(spark)).collect()}
    assert found == {k: list(files.values())[k % 100] for k, _ in texts}


def test_suffixes_against_all_windows(spark):
    docs = corpus.documents(spark)
    rows = suffixes.remove_repeats(docs, keep_text=True).collect()
    assert len(rows) == len(corpus.texts())
    seen: dict = {}
    for doc_id, text in corpus.texts():
        if doc_id is not None:
            data = (text or "").encode()
            for j in range(len(data) - 49):
                seen[data[j : j + 50]] = min(doc_id, seen.get(data[j : j + 50], doc_id))
    for r in rows:
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - 49):
            if r.doc_id is not None and seen[data[j : j + 50]] < r.doc_id:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        assert (r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) == (len(data), sum(gone), spans, kept), r.doc_id
        assert r._kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert suffixes.remove_repeats(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize(("chunk", "range_"), [(3_000, 2_000), (40_000, 500)])
def test_suffixes_over_many_chunks_and_ranges(spark, monkeypatch, chunk, range_):
    """A passage in every document, copies, null and repeated ids, and columns with the names of the added ones."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "RANGE", range_)
    shared, rows = corpus.prose(5, 15), []
    for k in range(60):
        rows.append((k, corpus.prose(300 + k, 12) + " " + shared + " " + corpus.prose(400 + k % 7, 14)))
    rows += [(None, shared), (None, shared), (None, None), (3, rows[20][1]), (3, rows[20][1]), (5, "z" * 300), (61, "z" * 200), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("own").alias(n) for n in ("_chunk", "_kept", "_n_bytes", "c0", "blob", "_c1")])
    out = suffixes.remove_repeats(docs, keep_text=True)
    assert out.columns == ["doc_id", "text", "_chunk", "c0", "blob", "_c1", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_kept"]
    seen: dict = {}
    for i, data in [(i, (t or "").encode()) for i, t in rows if i is not None]:
        for j in range(len(data) - 49):
            seen[data[j : j + 50]] = min(i, seen.get(data[j : j + 50], i))
    found = out.collect()
    assert len(found) == len(rows) and {r.c0 + r["_chunk"] for r in found} == {"ownown"}
    for r in found:
        data, gone = (r.text or "").encode(), set()
        for j in range(len(data) - 49) if r.doc_id is not None else ():
            if seen[data[j : j + 50]] < r.doc_id:
                gone |= set(range(j, j + 50))
        assert bytes(r._kept) == bytes(c for j, c in enumerate(data) if j not in gone), r.doc_id
        assert r._n_removed == len(gone)
    staged = suffixes.stage(spark, docs, "")
    assert staged.columns == docs.columns and {r._kept for r in staged.collect()} == {"own"}


def test_suffix_query_writes_no_file_for_each_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 3_000)
    monkeypatch.setattr(suffixes, "RANGE", 40_000)
    docs = spark.createDataFrame([(k, corpus.prose(300 + k, 40)) for k in range(200)] + [(k, corpus.prose(k, 40)) for k in (310, 320)], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in/documents.parquet")
    suffixes.query(spark, f"{tmp_path}/in").write.parquet(f"{tmp_path}/out")
    expected = suffixes.remove_repeats(docs).select("doc_id", *[f"_{n}" for n in suffixes.ADDED])
    assert docs.selectExpr("sum(octet_length(text))").first()[0] > 15 * suffixes.CHUNK
    assert len(list((tmp_path / "out").glob("part-*.parquet"))) <= 4
    assert corpus.by_row(spark.read.parquet(f"{tmp_path}/out").collect()) == corpus.by_row(expected.collect())


def test_loser_tree_merges_and_counts_shared_bytes():
    rng = np.random.default_rng(5)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(rng.integers(1, 40))) for _ in range(7)]
    coded = []
    for run in runs:
        before, out = b"", []
        for entry in run:
            n = next((i for i, (a, b) in enumerate(zip(before, entry, strict=False)) if a != b), min(len(before), len(entry)))
            out.append((entry, n))
            before = entry
        coded.append(iter(out))
    order, shared = suffixes.merge(coded)
    at, merged = [0] * len(runs), []
    for r in order:
        merged.append(runs[r][at[r]])
        at[r] += 1
    assert merged == sorted(e for r in runs for e in r)
    for k in range(1, len(merged)):
        a, b = merged[k - 1], merged[k]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_whole_characters(spark):
    cut = spark.createDataFrame([(bytearray("é".encode()[:1] + "abc€".encode()[:-1]),), (bytearray("plain é".encode()),), (None,)], "d binary")
    assert [r[0] for r in cut.select(suffixes.whole_characters(F.col("d"))).collect()] == ["abc", "plain é", None]


def test_toxicity_on_held_out(spark):
    bad = ["grobnik", "vlastor", "smirkle"]
    rows, marks = [], []
    for k in range(900):
        text = corpus.prose(1000 + k, 70)
        if k % 4 == 0:
            parts = text.split()
            for j in range(3):
                parts[(7 + 19 * j + k) % len(parts)] = bad[(j + k) % 3]
            text = " ".join(parts)
        rows.append((k, text))
        marks.append((k, 1, int(k % 4 == 0)))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (0, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = corpus.documents(spark, [*rows, (5000, None), (5001, "")]).drop("score")
    found = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    right = sum((found[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held)
    assert right / len(held) > 0.95
    assert all(0 <= s <= 1 for s in found.values()) and found[5000] == found[5001]
    assert toxicity.score(corpus.empty(spark).drop("score"), labels).count() == 0
    none = toxicity.score(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0


def test_toxicity_follows_the_two_lengths():
    rows = []
    for k in range(1200):
        parts = corpus.prose(4000 + k, 70).split()
        for j in range(3 * (k % 2)):
            parts[(5 + 21 * j + k) % len(parts)] = ["grobnik", "vlastor", "smirkle"][(j + k) % 3]
        rows.append((" ".join(parts), k % 2))
    words = [(toxicity.words(t), y) for t, y in rows]
    plain, bad = toxicity.dictionaries([w for w, y in words[:600] if y], [w for w, y in words[:600] if not y])
    assert plain != bad and len(plain) == len(bad) and b"grobnik" in bad and b"grobnik" not in plain

    def auc(first, second):
        s = toxicity.Scorer(first, second)
        s.calibrate(np.array([s.differences(t) for t, _ in rows[600:900]]), np.array([y for _, y in rows[600:900]]), np.ones(300))
        found = s.scores([t for t, _ in rows[900:]])
        y = np.array([y for _, y in rows[900:]])
        return (found[y == 1][:, None] > found[y == 0][None, :]).mean() + (found[y == 1][:, None] == found[y == 0][None, :]).mean() / 2

    assert auc(plain, bad) > 0.95
    assert abs(auc(plain, plain) - 0.5) < 0.1 and abs(auc(bad, bad) - 0.5) < 0.1
    s = toxicity.Scorer(plain, bad)
    gaps = [(s.differences(t) * np.arange(toxicity.LOW, toxicity.HIGH + 1)).sum() for t, _ in rows[900:]]
    assert np.mean(gaps[1::2]) > np.mean(gaps[::2])


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(k, corpus.prose(k, 30)) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id bigint, quality int, toxic int")
    docs = corpus.documents(spark, [*rows, (0, "a much longer text than the other one " * 20), (None, "x")])
    every, counts = toxicity.sample(docs, labels)
    usable = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(t for t, _ in every) == sorted(rows[k][1] for k in usable) and counts == (sum(k % 2 == 0 for k in usable), sum(k % 2 for k in usable))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    few, _ = toxicity.sample(docs, labels)
    for y in (0, 1):
        assert 0 < sum(len(t.encode()) for t, z in few if z == y) <= 1000
    assert set(few) < set(every)
