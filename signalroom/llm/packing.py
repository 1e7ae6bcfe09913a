"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``CAPACITY``. The driver sees only how many pieces there are
of each length, at most CAPACITY numbers, and plans best-fit decreasing over these counts: sequences
alike so far are handled together. The plan says for each length which ranks go to which sequences at
which offset. Pieces are ranked within their length, in salted groups where a length is frequent, and
take the planned place of their rank.

Driver memory and broadcast: the histogram and the plan, bounded by CAPACITY and not by the input.

Cases: a null or empty text is a piece of the end token alone; long texts are cut into full pieces
and a rest; pieces of equal length are ranked by doc_id, piece and checksum, so repeated rows get
places of their own; an empty table gives no rows; only the named columns are read, so further columns
cannot clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

CAPACITY = 4096
END_ID = 1
#: A length with more pieces than this is ranked in several groups.
GROUP = 1_000


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids) of the pieces of each text, which end_id ends."""
    shared = bpe.shared_codec(docs.sparkSession, path)
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for batch in bpe.pieces_of(whole, "text"):
                rows: list[tuple] = []
                for doc_id, blob in zip(batch.column(0).to_pylist(), codec.encode_batch(batch.column(1).to_pylist()), strict=True):
                    blob += end
                    for k, at in enumerate(range(0, len(blob), step)):
                        piece = blob[at : at + step]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece))
                *columns, blobs = map(list, zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, bpe.ids_array(blobs)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, offset), and the number of sequences.

    ``open_``: sequences by the room they have, as ranges (first sequence, number).
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # rooms that have sequences, ascending
    used = 0

    def put_back(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            each = room // length
            full, rest = divmod(min(left, number * each), each)
            for k in range(each):
                number_k = full + (k < rest)
                if number_k:
                    rows.append((length, rank, number_k, first, capacity - room + k * length))
                    rank += number_k
                    left -= number_k
            put_back(room - each * length, first, full)
            put_back(room - rest * length, first + full, 1 if rest else 0)
            put_back(room, first + full + bool(rest), number - full - bool(rest))
    return rows, used


def ranked(pieces: DataFrame, counts: dict[int, int], group: int = GROUP) -> DataFrame:
    """Adds rank, from 0 within each length. No window holds much more than ``group`` pieces."""
    salts = [max(1, -(-counts.get(n, 0) // group)) for n in range(max(counts, default=0) + 1)]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(common.int_array(salts), F.col("length").cast("int"))).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("place")).drop("salt", "first", "place")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and others), given as a table that can be read twice."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows, _ = plan(counts, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    found = ranked(pieces, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            out = bpe.append(batch, "sequence_id", pa.array(sequences[at] + rank - ranks[at], pa.int64()))
            yield bpe.append(out, "offset", pa.array(offsets[at], pa.int64()))

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return found.mapInArrow(run, T.StructType([*found.schema.fields, *added])).drop("rank")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(common.materialize(cut(docs, capacity), "pieces"), capacity)


ORDER = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents")).select(ORDER)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack_documents(docs).select(ORDER)
