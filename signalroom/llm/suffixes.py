"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a WINDOW-byte string that covers it also starts in a document of smaller doc_id.

The suffix array is sparse: of a window's q-grams the one of least hash (the leftmost of equals) is its
anchor, so equal windows have equal anchors, and only suffixes that start at anchors are sorted. No
match is lost, for every window has an anchor, and an entry carries the bytes left and right of its
anchor that the anchor's windows cover.

1. Documents are dealt into chunks. Each chunk sends the hashes of its anchors' q-grams, and learns one
   bit for each: whether another document has it. Without that, nothing can repeat.
2. Each chunk sorts the suffixes at its remaining anchors, equal contexts as one entry with the smallest
   document that has it, and sends its sorted runs front-coded: the length of the prefix shared with the
   entry before, and the rest. The places of its entries don't go to the ranges; they wait for step 5.
3. Each range of anchors merges its runs with a loser tree that keeps, for each loser, how much it
   shares with the entry put out last: entries that share different lengths are decided without a look
   at their bytes, and others are compared from the shared length on.
4. In merged order, the prefix shared with either neighbour bounds which windows of an entry can
   repeat. Those are matched, and the smallest document of each decides. A range answers each run with two
   bytes for each entry: which part of it a smaller document elsewhere has.
5. Chunks apply the answers to the places of their entries, and join the removed intervals.

All steps read one shuffle of the documents by chunk. Bounds: a chunk has CHUNK bytes or one document,
which is hashed SEGMENT bytes at a time; there is a range for so many bytes of text too, so what a range
holds doesn't grow with the table or with how often a string recurs: of each string a chunk sends one entry.
Chunks are dealt by id and text, and rows without an id anyhow, so no id fills a chunk; only rows that repeat
both share one.

Cases: null and empty texts have no bytes, and texts of fewer than WINDOW bytes lose none; a row with a
null doc_id loses nothing and takes nothing; rows that repeat a doc_id take nothing from each other; an
empty table gives no rows; further columns pass through, but for those named like the added ones, which
give way; the stage adds under names that no column has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing

WINDOW, GRAM = 50, 16
SPAN = WINDOW - GRAM + 1
CHUNK = 4_000_000
RANGE = 4_000_000
#: A range's answer for entries of which nothing repeats in a smaller document elsewhere.
NOTHING = 255
SEGMENT = 200_000
KEY_BITS = 48
#: Merged entries that are matched at a time.
SLICE = 20_000


class Chunk:
    """The documents of a chunk in an order of their own, cut to pieces that overlap by WINDOW - 1 bytes."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        data = [(t or "").encode() for t in texts]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, data[i]))
        self.ids = [ids[i] for i in self.order]
        self.texts = [data[i] for i in self.order]

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes of some pieces, with the document and the place in it that each piece starts at, and where pieces end."""
        held, size = [], 0
        for doc, (i, text) in enumerate(zip(self.ids, self.texts, strict=True)):
            if i is None:
                continue
            for at in range(0, max(1, len(text) - WINDOW + 1), SEGMENT):
                piece = text[at : at + SEGMENT + WINDOW - 1]
                if len(piece) < WINDOW:
                    continue
                if held and size + len(piece) > SEGMENT + WINDOW:
                    yield self._segment(held)
                    held, size = [], 0
                held.append((doc, at, piece))
                size += len(piece)
        if held:
            yield self._segment(held)

    @staticmethod
    def _segment(held: list) -> tuple:
        sizes = np.array([len(p) for _, _, p in held], np.int64)
        return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.array([h[0] for h in held]), np.array([h[1] for h in held]), sizes

    def anchors(self, contexts: bool) -> dict[str, np.ndarray]:
        """Of every anchor: key of its q-gram, document, and with contexts its place, how far its windows reach
        to the left and right, and a hash of that context; besides the bytes of all segments."""
        out: dict[str, list] = {n: [] for n in ("key", "doc", "place", "left", "right", "context", "at")}
        data, base = [], 0
        for text, docs, firsts, sizes in self.segments():
            sums = hashing.prefix_sums(text)
            grams = np.arange(len(text) - GRAM + 1)
            hashes = hashing.substrings(sums, grams, GRAM)
            ranks = (hashes & ~np.uint64(0x3FFFF)) | grams.astype(np.uint64)
            least = ranks
            for step in (1, 2, 4, 8, 16):
                least = np.minimum(least[:-step], least[step:])
            least = np.minimum(least[: len(least) - SPAN + 32], least[SPAN - 32 :])
            ends = np.cumsum(sizes)
            piece = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[piece[: len(least)]])
            anchor = (least[starts] & np.uint64(0x3FFFF)).astype(np.int64)
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (piece[starts[1:]] != piece[starts[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            at = anchor[first]
            out["key"].append(hashing.mix(hashes[at]) >> np.uint64(64 - KEY_BITS))  # anchors have small hashes, keys are spread evenly
            out["doc"].append(docs[piece[at]])
            if contexts:
                low, high = starts[first], starts[last] + WINDOW
                out["place"].append(at - (ends - sizes)[piece[at]] + firsts[piece[at]])
                out["left"].append(at - low)
                out["right"].append(high - at)
                out["context"].append(hashing.mix(hashing.substrings(sums, low, high - low) + (at - low).astype(np.uint64)))
                out["at"].append(at + base)
                data.append(text)
                base += len(text)
        kinds = {"key": np.uint64, "context": np.uint64}
        found = {n: np.concatenate(x) if x else np.empty(0, kinds.get(n, np.int64)) for n, x in out.items()}
        return found | {"data": np.concatenate(data) if data else np.empty(0, np.uint8)}

    def keys(self, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order, and whether two documents of this chunk have each."""
        order = np.argsort(found["key"], kind="stable")
        key, doc = found["key"][order], found["doc"][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(key) else np.empty(0, bool)
        return key[first], several


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def press(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays or bytes as one compressed blob; each with its length before it."""
    parts = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
        parts += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpress(blob: bytes) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.tobytes(), kind)


def blobs_table(name: str, rows: list[tuple[int, int, bytes]], other: str) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[name, other, "blob"])


def send_keys(rows: pa.Table, ranges: int) -> pa.Table:
    """Step 1: the keys of a chunk by range."""
    chunk = Chunk(rows)
    keys, several = chunk.keys(chunk.anchors(False))
    bounds = np.searchsorted(ranges_of(keys, ranges), np.arange(ranges + 1))
    number, out = rows.column("_chunk")[0].as_py(), []
    for r in range(ranges):
        part = keys[bounds[r] : bounds[r + 1]]
        if len(part):
            out.append((r, number, press(planes(np.diff(part, prepend=np.uint64(0))), np.packbits(several[bounds[r] : bounds[r + 1]]))))
    return blobs_table("range", out, "chunk")


def judge_keys(rows: pa.Table) -> pa.Table:
    """Step 1, in a range: a bit for each key of each chunk."""
    chunks, keys, several = rows.column("chunk").to_pylist(), [], []
    for blob in rows.column("blob"):
        a, b = unpress(blob.as_py())
        keys.append(np.cumsum(unplanes(a, np.uint64), dtype=np.uint64))
        several.append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(keys[-1])).astype(bool))
    _, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    live = (count[which] > 1) | np.concatenate(several)
    parts = np.split(live, np.cumsum([len(k) for k in keys])[:-1])
    number = rows.column("range")[0].as_py()
    return blobs_table("_chunk", [(c, number, press(np.packbits(p))) for c, p in zip(chunks, parts, strict=True)], "range")


def send_runs(rows: pa.Table, bits: pa.Table, ranges: int) -> pa.Table:
    """Step 2: the sorted, front-coded runs of a chunk by range."""
    if not rows.num_rows or not bits.num_rows:
        return blobs_table("range", [], "chunk")
    chunk = Chunk(rows)
    found = chunk.anchors(True)
    keys, _ = chunk.keys(found)
    bounds = np.searchsorted(ranges_of(keys, ranges), np.arange(ranges + 1))
    live = np.zeros(len(keys), bool)
    for r, blob in zip(bits.column("range").to_pylist(), bits.column("blob"), strict=True):
        n = bounds[r + 1] - bounds[r]
        live[bounds[r] : bounds[r + 1]] = np.unpackbits(np.frombuffer(unpress(blob.as_py())[0], np.uint8), count=n)
    pick = np.flatnonzero(live[np.searchsorted(keys, found["key"])])
    data = found.pop("data")
    found = {n: x[pick] for n, x in found.items()}
    if not len(pick):
        return blobs_table("range", [], "chunk")
    # equal contexts are one entry; its places are in order of the documents
    places = np.lexsort((found["place"], found["doc"], found["context"]))
    found = {n: x[places] for n, x in found.items()}
    first = np.flatnonzero(np.append(True, found["context"][1:] != found["context"][:-1]))
    count = np.diff(np.append(first, len(places)))
    at, left, right, range_ = found["at"][first], found["left"][first], found["right"][first], ranges_of(found["key"][first], ranges)
    raw = data.tobytes()
    suffixes = [raw[a : a + n] for a, n in zip(at.tolist(), right.tolist(), strict=True)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
    order = order[np.argsort(range_[order], kind="stable")]
    bounds = np.searchsorted(range_[order], np.arange(ranges + 1))
    ids = np.array([-1 if i is None else i for i in chunk.ids], np.int64)
    number, out = rows.column("_chunk")[0].as_py(), []
    columns = np.arange(WINDOW)
    for r in np.unique(range_).tolist():
        run = order[bounds[r] : bounds[r + 1]]
        size = right[run]
        text = np.where(columns < size[:, None], data[np.minimum(at[run][:, None] + columns, len(data) - 1)], 0)
        shared = np.zeros(len(run), np.int64)
        apart = (text[1:] != text[:-1]) | (columns >= np.minimum(size[1:], size[:-1])[:, None])
        shared[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), WINDOW)
        tails = text[(columns >= shared[:, None]) & (columns < size[:, None])]
        lefts = data[spread(at[run] - left[run], left[run])]
        out.append((r, number, press(shared.astype(np.uint8), size.astype(np.uint8), tails, left[run].astype(np.uint8), lefts, planes(ids[found["doc"][first[run]]]))))
    # the places go round the ranges, as a group of their own, and come back with the answers
    own = spread(first[order], count[order])
    small = (left[order].astype(np.uint8), right[order].astype(np.uint8), planes(count[order].astype(np.uint32)), planes(found["doc"][own].astype(np.uint32)), planes(found["place"][own].astype(np.uint32)))
    out.append((-1 - number, number, press(*small)))
    return blobs_table("range", out, "chunk")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, sizes of them, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def decoded(shared: bytes, sizes: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """The entries of a front-coded run and what each shares with the one before."""
    entry, at = b"", 0
    for n, size in zip(shared, sizes, strict=True):
        end = at + size - n
        entry = entry[:n] + tails[at:end]
        at = end
        yield entry, n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> tuple[list[int], list[int]]:
    """The run of each entry in merged order, and how much it shares with the entry before it.

    A loser tree: ``loser[k]`` lost at node k, ``shares[r]`` is how much run r's head shares with the entry
    that beat it last, and so with the last one put out when it plays again.
    """
    n = 1
    while n < len(runs):
        n *= 2
    steps = [r.__next__ for r in runs]
    heads: list[bytes | None] = [None] * n
    shares = [0] * n
    loser = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs whose heads share shares[.] with the same earlier entry."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = shares[a], shares[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        x, y = x[p:], y[p:]
        if x == y:
            a, b = (a, b) if a < b else (b, a)
            shares[b] = p + len(x)
            return a, b
        m = min(len(x), len(y))
        gap = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
        same = p + m - (gap.bit_length() + 7) // 8
        if x < y:
            shares[b] = same
            return a, b
        shares[a] = same
        return b, a

    for r, step in enumerate(steps):
        heads[r] = next(iter([step()]), (None, 0))[0]
    winners = list(range(n))
    level = n
    while level > 1:
        level //= 2
        nxt = []
        for k in range(level):
            w, lost = play(winners[2 * k], winners[2 * k + 1])
            loser[level + k] = lost
            nxt.append(w)
        winners = nxt
    top = winners[0]
    order, common_ = [], []
    while heads[top] is not None:
        order.append(top)
        common_.append(shares[top])
        try:
            heads[top], shares[top] = steps[top]()
        except StopIteration:
            heads[top] = None
        k = (n + top) // 2
        while k:
            rival = loser[k]
            y = heads[rival]
            if y is not None:
                if heads[top] is None or shares[rival] > shares[top]:
                    loser[k], top = top, rival
                elif shares[rival] == shares[top]:
                    top, loser[k] = play(top, rival)
            k //= 2
    return order, common_


def merge_runs(rows: pa.Table) -> pa.Table:
    """Steps 3 and 4, in a range: for each run's entries, how far the first and the last repeated window begin left of the anchor."""
    chunks, mine = rows.column("chunk").to_pylist(), rows.column("range")[0].as_py()
    if mine < 0:  # a chunk's places
        return blobs_table("_chunk", [(chunks[0], mine, rows.column("blob")[0].as_py())], "range")
    runs = [unpress(b.as_py()) for b in rows.column("blob")]
    order, common_ = merge([decoded(r[0], r[1], r[2]) for r in runs])
    order, shared = np.array(order, np.int64), np.array(common_ + [0], np.int64)
    # all runs' columns in a row; where lists the entries in merged order
    sizes = np.array([len(r[0]) for r in runs], np.int64)
    starts = np.cumsum(sizes) - sizes
    where = starts[order] + ranks_within(order)
    column = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in runs])
    right, left = column(1, np.uint8).astype(np.int64), column(3, np.uint8).astype(np.int64)
    lefts = column(4, np.uint8)
    smallest = np.concatenate([unplanes(r[5], np.int64) for r in runs])
    first_left = np.cumsum(left) - left
    reach = np.maximum(shared[:-1], shared[1:])  # bytes shared with either neighbour
    far, near = np.full(len(where), NOTHING, np.uint8), np.full(len(where), NOTHING, np.uint8)
    cuts = np.flatnonzero(shared[:-1] < GRAM)
    rights = None
    for a, b in slices(cuts, len(where)):
        part = where[a:b]
        low = np.maximum(WINDOW - right[part], WINDOW - reach[a:b])  # least and most bytes of a window left of its anchor
        high = left[part]
        use = np.flatnonzero(low <= high)
        if not len(use):
            continue
        if rights is None:
            rights = all_suffixes(runs)
            first_right = np.cumsum(right) - right
        part, low, high = part[use], low[use], high[use]
        both = left[part] + right[part]
        bounds = np.cumsum(both) - both
        text = np.empty(int(both.sum()), np.uint8)
        text[spread(bounds, left[part])] = lefts[spread(first_left[part], left[part])]
        text[spread(bounds + left[part], right[part])] = rights[spread(first_right[part], right[part])]
        number = high - low + 1
        entry = np.repeat(np.arange(len(part)), number)
        offset = spread(low, number)
        keys = hashing.substrings(hashing.prefix_sums(text), bounds[entry] + left[part][entry] - offset, WINDOW)
        by = np.argsort(keys, kind="stable")
        groups = np.flatnonzero(np.append(True, keys[by[1:]] != keys[by[:-1]]))
        least = np.empty(len(keys), np.int64)
        least[by] = np.repeat(np.minimum.reduceat(smallest[part][entry][by], groups), np.diff(np.append(groups, len(by))))
        hit = np.flatnonzero(least < smallest[part][entry])
        if not len(hit):
            continue
        # windows of an entry that repeat all hold its anchor, so what they cover is one interval
        firsts = np.flatnonzero(np.append(True, entry[hit[1:]] != entry[hit[:-1]]))
        lasts = np.append(firsts[1:], len(hit)) - 1
        chosen = part[entry[hit[firsts]]]
        near[chosen], far[chosen] = offset[hit[firsts]], offset[hit[lasts]]
    parts = zip(chunks, starts.tolist(), (starts + sizes).tolist(), strict=True)
    return blobs_table("_chunk", [(c, mine, press(far[a:b], near[a:b])) for c, a, b in parts], "range")


def ranks_within(labels: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones stand before it."""
    by = np.argsort(labels, kind="stable")
    out = np.empty(len(labels), np.int64)
    sizes = np.bincount(labels) if len(labels) else np.empty(0, np.int64)
    out[by] = spread(np.zeros(len(sizes), np.int64), sizes)
    return out


def slices(cuts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE entries that begin at cuts."""
    at = 0
    while at < n:
        k = np.searchsorted(cuts, at + SLICE)
        end = int(cuts[k]) if k < len(cuts) else n
        yield at, end
        at = end


def all_suffixes(runs: list[list[bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join(e for r in runs for e, _ in decoded(r[0], r[1], r[2])), np.uint8)


def removed_of(chunk: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and ends of what goes, in order, from the places of a chunk's entries and the ranges' answers."""
    blobs = {r: unpress(b.as_py()) for r, b in zip(answers.column("range").to_pylist(), answers.column("blob"), strict=True)}
    own = [b for r, b in blobs.items() if r < 0]
    if not own:
        return (np.empty(0, np.int64),) * 3
    left, right = (np.frombuffer(x, np.uint8).astype(np.int64) for x in own[0][:2])
    count, doc, place = (unplanes(x, np.uint32).astype(np.int64) for x in own[0][2:])
    far, near = (np.concatenate([np.frombuffer(blobs[r][k], np.uint8) for r in sorted(blobs) if r >= 0]).astype(np.int64) for k in (0, 1))
    entry = np.repeat(np.arange(len(count)), count)
    ids = np.array([-1 if i is None else i for i in chunk.ids], np.int64)[doc]
    later = ids > ids[np.cumsum(count) - count][entry]  # places are in order of doc_id; in later ones the entry itself repeats
    use = np.flatnonzero(later | (far[entry] != NOTHING))
    entry, later, doc, place = entry[use], later[use], doc[use], place[use]
    low = place - np.where(later, left[entry], far[entry])
    high = place + np.where(later, right[entry], WINDOW - near[entry])
    by = np.lexsort((low, doc))
    return doc[by], low[by], high[by]


def finish(rows: pa.Table, answers: pa.Table, keep_text: bool) -> pa.Table:
    """Step 5: rows with what is left of each text."""
    chunk = Chunk(rows)
    doc, low, high = removed_of(chunk, answers)
    bounds = np.searchsorted(doc, np.arange(len(chunk.ids) + 1))
    columns: dict[str, list] = {n: [None] * len(chunk.ids) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for k, row in enumerate(chunk.order):
        text, spans = chunk.texts[k], []
        for a, b in zip(low[bounds[k] : bounds[k + 1]].tolist(), high[bounds[k] : bounds[k + 1]].tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        edges = [0, *(x for s in spans for x in s), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        values = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)
        for name, value in zip(columns, values, strict=True):
            columns[name][row] = value
    if not keep_text:
        del columns["kept"]
        rows = rows.drop_columns(["text"])
    kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
    for name, values in columns.items():
        rows = rows.append_column(f"_{name}", pa.array(values, kinds.get(name, pa.int64())))
    return rows.drop_columns(["_chunk"])


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, keep_text: bool = False, prefix: str = "_") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 behind the prefix, and either kept, the bytes left, or no text."""
    docs = common.without(docs, *[prefix + n for n in (*ADDED, "kept")])
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, ranges = max(1, -(-total // CHUNK)), max(1, -(-total // RANGE))
    named = docs.select("doc_id", "text", *[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(others)])
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "text"))
    dealt = named.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(chunks))).repartition(chunks, "_chunk")
    blob = "range bigint, chunk bigint, blob binary"
    back = "_chunk bigint, range bigint, blob binary"
    keys = dealt.groupBy("_chunk").applyInArrow(lambda t: send_keys(t, ranges), blob)
    bits = keys.repartition(ranges, "range").groupBy("range").applyInArrow(judge_keys, back)
    runs = dealt.groupBy("_chunk").cogroup(bits.repartition(chunks, "_chunk").groupBy("_chunk")).applyInArrow(lambda t, b: send_runs(t, b, ranges), blob)
    answers = runs.repartition(ranges, "range").groupBy("range").applyInArrow(merge_runs, back)
    schema = [T.StructField(f.name, f.dataType) for f in named.schema.fields if keep_text or f.name != "text"]
    added = [T.StructField(f"_{n}", T.LongType()) for n in ADDED[:3]] + [T.StructField("_kept_sha256", T.StringType())]
    added += [T.StructField("_kept", T.BinaryType())] * keep_text
    done = dealt.groupBy("_chunk").cogroup(answers.repartition(chunks, "_chunk").groupBy("_chunk")).applyInArrow(lambda t, r: finish(t, r, keep_text), T.StructType(schema + added))
    inner = {c: f"c{i}" for i, c in enumerate(others)}
    shown = [F.col(inner.get(c, c)).alias(c) for c in docs.columns if keep_text or c != "text"]
    return done.select(*shown, *[F.col(f.name).alias(prefix + f.name[1:]) for f in added])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    # a chunk's rows are short without their texts: a file each would be many small files
    return out.select("doc_id", *[F.col(f"_{n}").alias(n) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]).hint("rebalance")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what is left of their texts; characters cut in two go, and n_chars is counted anew."""
    prefix = "_"
    while {(prefix + n).lower() for n in (*ADDED, "kept")} & {c.lower() for c in docs.columns}:
        prefix += "_"
    out = remove_repeats(docs, keep_text=True, prefix=prefix)
    left = out.withColumn("text", F.when(F.col("text").isNotNull(), whole_characters(F.col(f"{prefix}kept"))))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return left.select([f"`{c.replace('`', '``')}`" for c in docs.columns])


def whole_characters(data):
    """Bytes as text without the bytes of characters that were cut in two."""
    return F.when(F.is_valid_utf8(data), data.cast("string")).otherwise(F.replace(F.make_valid_utf8(data), F.lit("�"), F.lit("")))
