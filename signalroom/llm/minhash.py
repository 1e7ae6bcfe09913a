"""Near-duplicate groups by HyperMinHash.

1. Every text becomes its set of word shingles (64-bit hashes). Texts of one set form a class, which
   goes on as one row, with a key from the set; its smallest doc_id, null last, is who may stay.
2. A class has REGISTERS registers. A shingle falls into one register, which keeps the smallest hash,
   stored as its count of leading zeros and MANTISSA further bits. A register that got none takes the
   value of the first filled one in an order of its own, so bands of short texts are as selective as
   those of long ones.
3. Registers are banded by ROWS. In each bucket, members meet its smallest member; each class's
   smallest such partner is confirmed on full sets. These links make the first components.
4. Buckets whose members lie in several components are worked through exactly. Of buckets of at most
   PAIRED members all pairs meet. In larger ones, of more than FEW blocks' members together, members first meet a
   member drawn anew in each of at most TURNS turns, one each, and what is confirmed joins components, so that copies and near copies are joined
   by a number of pairs that grows with their number. Buckets that are still of several components are
   finished: the classes that they connect are a family, which is dealt into blocks. A component of more than
   a block has blocks of its own, which never meet each other; all others do, within a task. Every pair that
   shares a band, is not connected yet and isn't ruled out by the collision-corrected estimate (MARGIN
   standard deviations below the threshold) is confirmed on full sets.
5. Links give components by contraction; classes carry them to documents.

No group is gathered in one task, no list of pairs within a group is written, and nothing that grows
with the input reaches the driver or is broadcast. A pair at the threshold shares no band with
probability (1 - 0.8^5)^40, about 1e-7.

Cases: null and empty texts have no shingles, link with nothing and are kept; long texts count whole;
repeated rows and equal texts are one class; rows without a doc_id link like others, and null names a
component only if none of its rows has a doc_id; the texts of a repeated doc_id link each for itself; an empty table gives no rows; only named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common, hashing
from .components import components, roots

REGISTERS, ROWS, MANTISSA = 200, 5, 10
BANDS = REGISTERS // ROWS
MARGIN = 4.5
#: Buckets of so many members or fewer give their pairs.
PAIRED = 12
#: A family has a block for so many members, or bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 4_000_000
#: How often the members of large buckets meet one drawn member before all pairs that are left meet.
TURNS = 3
#: Of at most so many blocks' members, all pairs of blocks meet at once.
FEW = 32
#: For each register, the order in which it asks the others for a value.
DONORS = np.argsort(hashing.mix(np.arange(REGISTERS**2, dtype=np.uint64) + np.uint64(7)).reshape(REGISTERS, REGISTERS), axis=1)
FACTORS = hashing.mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    words, bounds = hashing.words([(t or "").encode() for t in texts])
    sums = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        sums += words[i : i + len(sums)] * FACTORS[i]
    shingles = hashing.mix(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(hashing.mix(np.array([short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set, uint16: leading zeros, mantissa, plus one; 0 throughout for an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    register = ((every >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, np.uint64(2**64 - 1))
    value = hashing.mix(every * np.uint64(0xA0761D6478BD642F))
    np.minimum.at(least, owner * REGISTERS + register, value)
    filled = np.zeros(len(least), bool)
    filled[owner * REGISTERS + register] = True
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 53).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.where(filled, ((zeros << np.uint64(MANTISSA)) | mantissa) + np.uint64(1), 0).astype("<u2").reshape(-1, REGISTERS)
    filled = filled.reshape(-1, REGISTERS)
    row, slot = np.nonzero(~filled & (sizes > 0)[:, None])
    for turn in range(REGISTERS):
        if not len(row):
            break
        donor = DONORS[slot, turn]
        found = filled[row, donor]
        out[row[found], slot[found]] = out[row[found], donor[found]]
        row, slot = row[~found], slot[~found]
    return out


def spans(n: np.ndarray) -> np.ndarray:
    """How likely a register of a set of n shingles has each count of leading zeros."""
    per = n[:, None] / REGISTERS
    return (1 - 0.5 ** np.arange(1, 54)) ** per - (1 - 0.5 ** np.arange(0, 53)) ** per


def corrected(same, chance):
    """A Jaccard estimate from the share of registers that agree and how likely disjoint sets' do."""
    return (same - chance) / (1 - chance)


def least_estimate(n, m, percent: int):
    """Estimates of pairs at the threshold lie above this but for one in 100,000."""
    return percent / 100 - MARGIN * np.sqrt(0.2 / np.minimum(np.maximum(n, m), REGISTERS))


def mark(text: str) -> Column:
    """What tells the texts under one doc_id, or under none, apart."""
    return F.unhex(F.md5(text)).alias("mark")


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark of the text, n_shingles, digest of the set, and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.pieces_of(whole, "text", 2_000_000):
                sets = shingle_sets(batch.column(1).to_pylist(), k)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                registers = pa.array([r.tobytes() for r in sketch(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, digests, registers], names=["doc_id", "mark", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", mark("text")).mapInArrow(run, "doc_id bigint, mark binary, n_shingles bigint, digest binary, registers binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """The key of a set and its sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.pieces_of(whole, "text", 2_000_000):
                sets = shingle_sets(batch.column(1).to_pylist(), k)
                digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "digest binary, shingles binary").select(F.xxhash64("digest").alias("rep"), "shingles")


def band_rows(classes: DataFrame) -> DataFrame:
    """rep and key for each band."""
    width = 2 * ROWS
    part = lambda j: F.substring(F.col("registers"), j * width + 1, F.lit(width))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, part(j)))
    return classes.select("rep", F.explode(keys).alias("key"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common_ >= percent * (small + large - common_)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, parent) that the estimate doesn't rule out."""
    side = lambda id_, n, r: classes.select(F.col("rep").alias(id_), F.col("n_shingles").alias(n), F.col("registers").alias(r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("x", "y"))
            chance = (spans(n) * spans(m)).sum(axis=1) / 2**MANTISSA
            keep = corrected((x == y).mean(axis=1), chance) >= least_estimate(n, m, percent)
            yield batch.select(["node", "parent"]).filter(pa.array(keep))

    both = pairs.join(side("node", "n", "x"), "node").join(side("parent", "m", "y"), "parent")
    return both.select("node", "parent", "n", "m", "x", "y").mapInArrow(run, "node bigint, parent bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, parent) whose full sets are alike."""
    left = sets.toDF("node", "x")
    right = sets.toDF("parent", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
            keep = pa.array([alike(a, b, percent) for a, b in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["node", "parent"]).filter(keep)

    both = pairs.join(left, "node").join(right, "parent").select("node", "parent", "x", "y")
    return both.mapInArrow(run, "node bigint, parent bigint")


def cells(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (rep, comp, family, registers, shingles) dealt into the blocks of their family, as the two sides of each pair of blocks that may link."""
    need = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    sizes = common.materialize(sizes.withColumn("own", need(F.col("n"), F.col("bytes"))), "sizes")
    whole = F.col("own") > 1  # the components that have blocks of their own, after those that the others share
    families = sizes.groupBy("family").agg(need(F.sum(F.when(~whole, F.col("n")).otherwise(0)), F.sum(F.when(~whole, F.col("bytes")).otherwise(0))).alias("mixed"), F.sum(F.when(whole, F.col("own")).otherwise(0)).cast("int").alias("more"))
    before = Window.partitionBy("family").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.where(whole).select("family", "comp", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("first"))
    dealt = members.join(families, "family").join(starts, ["family", "comp"], "left")
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    alone = F.col("own").isNotNull()
    dealt = dealt.withColumn("block", F.when(alone, F.col("mixed") + F.col("first") + part(F.col("own"))).otherwise(part(F.greatest("mixed", F.lit(1)))))
    dealt = dealt.withColumn("low", F.when(alone, F.col("mixed") + F.col("first")).otherwise(F.col("block") + 1)).withColumn("high", F.when(alone, F.col("low") + F.col("own")).otherwise(F.col("block")))
    upto = lambda a, b: F.explode(F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>")))
    rest = ["family", "rep", "comp", "registers", "shingles"]
    first = dealt.select(*rest, F.col("block").alias("p"), upto(F.col("high"), F.col("mixed") + F.col("more")).alias("q"))
    second = dealt.select(*rest, upto(F.lit(0), F.col("low")).alias("p"), F.col("block").alias("q"))
    return first, second.toDF(*second.columns)


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """Of members (rep, key, comp), those in buckets of several components, with the bucket's smallest component and size."""
    sizes = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high").drop("high")
    return placed.join(sizes, "key")


def drawn(large: DataFrame, turn: int) -> DataFrame:
    """Pairs (node, parent): each member with one that a bucket of its has drawn and that lies in another component."""
    one = F.min_by(F.struct("rep", "comp"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep")).alias("one")
    met = large.select("key", "rep", "comp").join(large.groupBy("key").agg(one), "key").where("comp <> one.comp")
    return met.groupBy(F.col("rep").alias("node")).agg(F.min_by("one.rep", F.struct(F.xxhash64("one.rep", F.lit(turn)), "one.rep")).alias("parent"))


def meet(x: pa.Table, y: pa.Table, percent: int) -> pa.Table:
    """Links between components of the members of two blocks: enough to connect all that are alike."""
    links = []
    if x.num_rows and y.num_rows:
        rx, ry = (np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS) for t in (x, y))
        sx, sy = ([np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()] for t in (x, y))
        nx, ny = (np.array([len(v) for v in s]) for s in (sx, sy))
        cx, cy = (t.column("comp").to_numpy() for t in (x, y))
        ids, others = x.column("rep").to_numpy(), y.column("rep").to_numpy()
        agree = np.zeros((len(rx), len(ry)), np.int16)
        shared = np.zeros(agree.shape, bool)
        for band in range(BANDS):
            now = np.zeros(agree.shape, np.int16)
            for k in range(band * ROWS, band * ROWS + ROWS):
                now += rx[:, k, None] == ry[None, :, k]
            agree += now
            shared |= now == ROWS
        guess = corrected(agree / REGISTERS, spans(nx) @ spans(ny).T / 2**MANTISSA)
        shared &= (cx[:, None] != cy[None, :]) & (guess >= least_estimate(nx[:, None], ny[None, :], percent))
        if x.column("p")[0].as_py() == x.column("q")[0].as_py():
            shared &= ids[:, None] < others[None, :]
        i, j = np.nonzero(shared)
        order = np.argsort(-guess[i, j], kind="stable")
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
            a, b = top(int(cx[p])), top(int(cy[q]))
            if a != b and alike(sx[p], sy[q], percent):
                parent[max(a, b)] = min(a, b)
                links.append((int(cx[p]), int(cy[q])))
    return pa.Table.from_arrays([pa.array([c[k] for c in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def with_component(rows: DataFrame, found: DataFrame, node: str = "rep", to: str = "comp") -> DataFrame:
    return rows.join(found.toDF(node, "_root"), node, "left").withColumn(to, F.coalesce("_root", node)).drop("_root")


def marked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    rows = common.materialize(features(docs, k), "features")
    classes = rows.where("n_shingles > 0").groupBy(F.xxhash64("digest").alias("rep"), "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"))
    classes = common.materialize(classes, "classes")
    bands = band_rows(classes)
    shared = bands.groupBy("key").agg(F.min("rep").alias("root"), F.max("rep").alias("other")).where("root < other").drop("other")
    members = common.materialize(bands.join(shared, "key"), "members")
    found = links = spark.createDataFrame([], "node bigint, root bigint")
    if not members.isEmpty():
        wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").where("not least.none").select("least.doc_id").distinct()
        texts = docs.select("doc_id", "text")
        sets = full_sets(texts.join(wanted, "doc_id", "left_semi").unionByName(texts.where("doc_id is null")), k)
        sets = common.materialize(sets.dropDuplicates(["rep"]), "sets")
        pairs = members.groupBy(F.col("rep").alias("node")).agg(F.min("root").alias("parent")).where("parent < node")
        found = roots(confirmed(possible(pairs, classes, percent), sets, percent))
        placed = with_component(members.select("rep", "key"), found)
        left = common.materialize(mixed_buckets(placed), "mixed")
        small = left.where(F.col("size") <= PAIRED).select("key", "rep", "comp")
        two = small.toDF("key", "node", "node_comp").join(small.toDF("key", "parent", "parent_comp"), "key").where("node > parent and node_comp <> parent_comp")
        apart = two.select("node", "parent").distinct()
        linked = lambda pairs: common.materialize(with_component(with_component(confirmed(possible(pairs, classes, percent), sets, percent), found, "node", "a"), found, "parent", "b").select("a", "b"), "near")
        near = linked(apart)
        all_large = left.where(F.col("size") > PAIRED).select("key", "rep", "comp", "low")
        large = all_large
        for turn in range(TURNS):
            if large.select("rep").distinct().count() <= FEW * BLOCK:  # all pairs of blocks are cheaper than a turn
                break
            near = near.unionByName(linked(drawn(large, turn)))
            moved = with_component(all_large.select("key", "rep", F.col("comp").alias("was")), components(near), "was", "comp")
            large = common.materialize(mixed_buckets(moved.select("key", "rep", "comp")), "large")
        if not large.isEmpty():
            families = components(large.select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct())
            own = with_component(large.select("rep", "comp").distinct(), families, "comp", "family").join(classes.select("rep", "registers"), "rep").join(sets, "rep")
            first, second = (side.groupBy("family", "p", "q") for side in cells(common.materialize(own, "families")))
            near = near.unionByName(first.cogroup(second).applyInArrow(lambda x, y: meet(x, y, percent), "a bigint, b bigint"))
        links = components(near)
    reps = with_component(with_component(classes.select("digest", "rep", "least"), found), links, "comp", "root").select("digest", "root", "least")
    reps = common.materialize(reps, "reps")
    stays = reps.groupBy("root").agg(F.min("least").alias("stays"))
    known = rows.join(reps.join(stays, "root").select("digest", "stays"), "digest", "left")
    alone = F.col("stays").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & F.col("mark").eqNullSafe(F.col("stays.mark")))
    return known.select("doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("component_id"), kept.alias("kept"))


def group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return marked(docs, k, percent).drop("mark")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents"), k=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that of the smallest doc_id (null last), then of the least mark of its text."""
    own, id_, mark_ = (common.free(docs.columns, n) for n in ("_mark", "_id", "_kept"))
    kept = marked(docs, 5, 80).where("kept").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).distinct()
    rows = docs.withColumn(own, mark("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col(own).eqNullSafe(F.col(mark_))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
