"""The k nearest by cosine, exactly: all rows against blocks of queries, by matrix products where rows are read.

Products only choose whom to look at: what may be among the best is measured again as a sum from the first
element to the last, as Spark's functions would, and ranked by that cosine's rounded value and the smaller id.
Queries reach the tasks in passes of at most ASKED, and a task keeps k rows of each query, so neither grows
with the table; time grows with queries times rows. Equal vectors of a batch are met once.

Cases: ids and vectors must not be null, norms must be above 0; vectors of another length than the query's have
no cosine and are not found; repeated ids are rows of their own, and never found for their own id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Queries of one pass over the table, and how many of them and of the rows meet in one product.
ASKED, QUERIES, ROWS = 65_536, 1024, 2048
#: Pairs that are measured again at a time.
PAIRS = 32_768
PLACES = 6
ONE = 10.0**PLACES


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], flat[ends[at][:, None] + np.arange(size)]


def folded(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right."""
    return np.cumsum(x, axis=1)[:, -1]


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms, unit vectors, and which rows are so large or small that products don't tell their cosines."""
    with np.errstate(all="ignore"):
        norms = np.sqrt(folded(x * x))
        odd = ~((norms > 1e-100) & (norms < 1e100))
        return norms, np.where(odd[:, None], 0.0, x / norms[:, None]), odd


def places(cosines: np.ndarray) -> np.ndarray:
    """Cosines rounded half up, counted in units of the last place; one that isn't a number is above all."""
    v = cosines * ONE + 0.5
    out = np.floor(v)
    for i in np.flatnonzero(np.abs(v - np.rint(v)) < 1e-3):
        out[i] = float(Decimal(repr(float(cosines[i]))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP).scaleb(PLACES))
    return np.where(np.isnan(cosines), np.inf, out)


def distinct(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only rows of the k + 1 smallest ids, k of each at most: no others can be among k nearest."""
    _, kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    g, i = kind[order], ids[order]
    n = np.arange(len(g))
    head = np.r_[True, g[1:] != g[:-1]]
    new = head | np.r_[True, i[1:] != i[:-1]]
    nth = np.cumsum(new) - np.maximum.accumulate(np.where(head, np.cumsum(new), 0))
    keep = order[(nth <= k) & (n - np.maximum.accumulate(np.where(new, n, 0)) < k)]
    return ids[keep], x[keep]


class Best:
    """The k best rows of each query so far, the best first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.norms, self.unit, self.odd = scaled(x)
        self.place, self.found, self.cosine = (np.full((len(ids), k), v) for v in (-np.inf, np.iinfo(np.int64).max, np.nan))

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        ids, x = distinct(ids, x, self.k)
        for a in range(0, len(ids), ROWS):
            part = ids[a : a + ROWS], x[a : a + ROWS]
            sized = scaled(part[1])
            for q in range(0, len(self.ids), QUERIES):
                self._block(slice(q, q + QUERIES), *part, *sized)

    def _block(self, at: slice, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, unit: np.ndarray, odd: np.ndarray) -> None:
        near = self.unit[at] @ unit.T
        unsure = (self.odd[at][:, None] | odd) if odd.any() or self.odd[at].any() else None
        if unsure is not None:
            near[unsure] = -np.inf
        shared = np.flatnonzero(np.isin(ids, self.ids[at]))
        own = np.nonzero(self.ids[at][:, None] == ids[shared])
        near[own[0], shared[own[1]]] = -np.inf
        last = self.place[at, -1]
        least = last / ONE - 1 / ONE
        if np.isneginf(last).any() and len(ids) >= self.k:
            least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k] - 2 / ONE)
        if unsure is not None:
            near[unsure] = np.inf
            near[own[0], shared[own[1]]] = -np.inf
        q, r = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        v = near[q, r] * ONE + 0.5
        whole = np.floor(v)
        q, r = (z[~np.isfinite(v) | (whole > last[q]) | ((whole == last[q]) & (ids[r] < self.found[at][q, -1])) | (np.abs(v - np.where(np.isfinite(v), np.rint(v), 0)) < 1e-3)] for z in (q, r))
        for a in range(0, len(q), PAIRS):
            self._take(at.start + q[a : a + PAIRS], r[a : a + PAIRS], ids, x, norms)

    def _take(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            cosines = folded(self.x[q] * x[r]) / (self.norms[q] * norms[r])
        held = np.unique(q)
        query = np.r_[np.repeat(held, self.k), q]
        place, found, cosine = (np.r_[old[held].ravel(), new] for old, new in ((self.place, places(cosines)), (self.found, ids[r]), (self.cosine, cosines)))
        order = np.lexsort((found, -place, query))
        sorted_ = query[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        top = order[rank < self.k]  # k of each query held, in its order
        for mine, all_ in ((self.place, place), (self.found, found), (self.cosine, cosine)):
            mine[held] = all_[top].reshape(len(held), self.k)


def one_pass(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    table = asked.toArrow().combine_chunks()
    for ids, x in (g for b in table.to_batches() for g in by_length(b)):
        old = queries.get(x.shape[1])
        queries[x.shape[1]] = (ids, x) if old is None else (np.r_[old[0], ids], np.r_[old[1], x])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(*q, k) for size, q in queries.items()}
        for batch in batches:
            for ids, x in by_length(batch):
                if x.shape[1] in best:
                    best[x.shape[1]].meet(ids, x)
        for b in best.values():
            q, nth = np.nonzero(b.place > -np.inf)
            for a in range(0, len(q), PAIRS):
                s = q[a : a + PAIRS], nth[a : a + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[s[0]]), pa.array(b.found[s]), pa.array(b.cosine[s], from_pandas=False)], ["query_id", "vec_id", "cosine"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, cosine double")


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and cosine: among them the k nearest rows of each query. rows and asked: vec_id bigint, a array<double>."""
    passes = max(1, -(-asked.count() // ASKED))
    parts = (asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p) for p in range(passes))
    return reduce(DataFrame.unionAll, [one_pass(rows, part, k) for part in parts])
