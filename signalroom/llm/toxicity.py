"""Toxicity by compression distance between two zstandard dictionaries.

Training, on a bounded sample of labelled rows, half by half:

* zstandard trains a base on windows of ordinary text; both dictionaries begin with it and its entropy
  tables. What the base doesn't hold of each class's texts is left over, and on that zstandard trains one
  dictionary for each class, by the same procedure. The ordinary dictionary is the base with what was
  trained on ordinary text, the toxic one the base with what was trained on toxic text. So a window's
  lengths under the two differ only by what the classes' own dictionaries hold. (Two dictionaries without
  a common base differ mostly in which ordinary passages they happen to hold: that found 0.05 of the toxic
  texts instead of 0.9.)
* Every run of WORDS words is a window, so a word lies in WORDS windows (fewer at the ends), and the sum
  of their differences is the word's. On the other half, the distribution of that sum over the words of
  either class gives a log ratio for each sum; a logistic fit on a text's total of these, its largest
  sums and its number of words gives a calibrated score.

Scoring reads every word of every text.

Sample: at most TRAIN_TOXIC and TRAIN_ORDINARY labelled texts of at most TRAIN_BYTES bytes, those of the
smallest hashes, and of these in turn as many as have SAMPLE_BYTES bytes together for each class; weights
restore the classes' shares. The driver holds that sample, and the dictionaries (about 120 kB each) are
broadcast.

Cases: null and empty texts have no words and get the score of that; long texts are read whole;
repeated rows score alike, and of an id with several texts the shortest may be in the sample; null ids aren't; with no labelled rows of one class every score is 0; an empty table gives no
rows; columns pass through, one named like the score gives way to it, and the stage gives the score a name
that no column has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

WORDS = 6
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 3000, 5000, 200_000
SAMPLE_BYTES = 64_000_000
#: Bytes of the base and of a class's own dictionary, and how zstandard cuts samples for them: segments and runs.
BASE, BASE_CUT = 112_640, {"k": 64, "d": 8}
OWN, OWN_CUT = 2348, {"k": 16, "d": 8}
#: zstandard finds no match of fewer bytes.
GRAM = 5
LOW, HIGH = -12, 40
THRESHOLD = 0.7
#: ASCII capitals become small; all else in ASCII but letters becomes a space.
PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PLAIN).split()


def windows(found: list[bytes], shift: int) -> list[bytes]:
    first = [b" %b " % b" ".join(found[:shift])] if shift and found else []
    return first + [b" %b " % b" ".join(found[i : i + WORDS]) for i in range(shift, len(found), WORDS)]


def trained(size: int, samples: list[bytes], cut: dict[str, int]) -> tuple[bytes, bytes]:
    """A dictionary as zstandard trains it: entropy tables and content; the samples' last bytes if they are too few to train on."""
    try:
        whole = zstandard.train_dictionary(size, samples, level=3, **cut).as_bytes()
        head = whole.index(b"\1\0\0\0\4\0\0\0\x08\0\0\0") + 12  # entropy tables end in the three first offsets
        return whole[:head], whole[head:]
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[-size:]


def left_over(texts: list[list[bytes]], held: set[bytes]) -> list[bytes]:
    """Of each text, the parts of its words that no match with the held runs can cover."""
    known: dict[bytes, bytes] = {}

    def of(word: bytes) -> bytes:
        if word not in known:
            spaced, out = b" %b " % word, []
            for i in range(len(spaced) - GRAM + 1):
                if spaced[i : i + GRAM] not in held:
                    if out and i <= out[-1][1]:
                        out[-1][1] = i + GRAM
                    else:
                        out.append([i, i + GRAM])
            known[word] = b"".join(spaced[a:b] for a, b in out)
        return known[word]

    return [x for x in (b"".join(map(of, t)) for t in texts) if len(x) > 8]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    tables, base = trained(BASE, [w for t in ordinary for w in windows(t, 0)], BASE_CUT)
    held = {base[i : i + GRAM] for i in range(len(base) - GRAM + 1)}
    own = [trained(OWN, left_over(texts, held), OWN_CUT)[1] for texts in (ordinary, toxic)]
    size = max(64, *map(len, own))
    plain, bad = (x.rjust(size) for x in own)
    return tables + base + plain, tables + base + bad


class Scorer:
    """Both dictionaries and the calibration."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary, toxic)
        self.ratios, self.fit = np.zeros(HIGH - LOW + 1), None
        self.ready = None

    def __getstate__(self):
        return self.contents, self.ratios, self.fit

    def __setstate__(self, state):
        self.contents, self.ratios, self.fit = state
        self.ready = None

    def compressors(self):
        if self.ready is None:
            out = []
            for content in self.contents:
                kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                held = zstandard.ZstdCompressionDict(content, dict_type=kind)
                how = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                held.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress)
            self.ready = tuple(out)
        return self.ready

    def differences(self, text: str | None) -> np.ndarray:
        """How many words have each sum of differences of compressed lengths, from LOW to HIGH."""
        plain, toxic = self.compressors()
        found = words(text)
        n = len(found)
        total = np.zeros(n, np.int64)
        for shift in range(WORDS):
            every = windows(found, shift)
            gaps = np.array(list(map(len, map(plain, every))), np.int64) - np.array(list(map(len, map(toxic, every))), np.int64)
            total += gaps[(np.arange(n) + (WORDS - shift) * (shift > 0)) // WORDS]
        return np.bincount(np.clip(total, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Of each text: the total of log ratios, the largest sum and the WORDS-th largest, log of the number of words, and one."""
        total = counts.sum(axis=1)
        down = counts[:, ::-1].cumsum(axis=1)
        top = [np.where(total >= k, HIGH - (down >= k).argmax(axis=1), LOW) / WORDS for k in (1, WORDS)]
        return np.stack([counts @ self.ratios / WORDS, *top, np.log1p(total), np.ones(len(total))], axis=1)

    def calibrate(self, counts: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> None:
        own = [np.log((counts[toxic == k].sum(axis=0) + 0.5) / (counts[toxic == k].sum() + 0.5 * counts.shape[1])) for k in (0, 1)]
        self.ratios = own[1] - own[0]
        x = self.features(counts)
        b, penalty = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [0])
        for _ in range(50):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (weights * (toxic - p)) - penalty @ b
            step = np.linalg.solve(x.T @ (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]) + penalty + 1e-9 * np.eye(len(b)), slope)
            b += np.clip(step, -2, 2)
        self.fit = b

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.fit is None or not texts:
            return np.zeros(len(texts))
        counts = np.array([self.differences(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.features(counts) @ self.fit, -30, 30)))


def train(rows: list[tuple[str, int]], shares_: tuple[int, int]) -> Scorer:
    """rows: texts with 0 or 1; shares_: how many labelled rows of 0 and 1 there are in all."""
    halves = [[r for k, r in enumerate(rows) if k % 2 == h] for h in (0, 1)]
    by = [[words(t) for t, y in halves[0] if y == c] for c in (0, 1)]
    if not all(by) or {y for _, y in halves[1]} != {0, 1}:
        return Scorer(b"", b"")
    out = Scorer(*dictionaries(by[1], by[0]))
    del by
    toxic = np.array([y for _, y in halves[1]])
    weight = np.array(shares_) / np.bincount(toxic, minlength=2)
    out.calibrate(np.array([out.differences(t) for t, _ in halves[1]]), toxic, (weight / weight.max())[toxic])
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """A bounded sample of labelled texts that aren't held out, in the order of their hashes."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [usable.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most TRAIN_TOXIC + TRAIN_ORDINARY rows
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(ids, "doc_id")
    least = F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("t")
    texts = common.materialize(texts.groupBy("doc_id", "toxic").agg(least).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"), "t.*"), "sample")
    chosen, total = [], [0, 0]
    for r in sorted(texts.select("h", "doc_id", "toxic", "size").collect()):
        if total[r["toxic"]] + r["size"] <= SAMPLE_BYTES:
            total[r["toxic"]] += r["size"]
            chosen.append((r["doc_id"],))
    kept = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint"))  # at most TRAIN_TOXIC + TRAIN_ORDINARY rows
    rows = texts.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(kept, "doc_id").collect()
    rows.sort(key=lambda r: (r["toxic"], r["h"], r["doc_id"]))
    return [(r["text"], r["toxic"]) for r in rows], (counts.get(0, 0), counts.get(1, 0))


def score(docs: DataFrame, labels: DataFrame, to: str = "score") -> DataFrame:
    """docs with a score of each whole text."""
    docs = common.without(docs, to)
    shared = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for whole in batches:
            for batch in bpe.pieces_of(whole, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield bpe.append(batch, to, pa.array(scorer.scores(texts), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic."""
    to = common.free(docs.columns, "_score")
    return score(docs, common.table(spark, sf_dir, "labels"), to).where(F.col(to) < THRESHOLD).drop(to)
