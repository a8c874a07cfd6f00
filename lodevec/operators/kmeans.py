"""Deterministic k-means: distributed Lloyd iterations over partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Numbers that a block of rows x centroids holds, and components of centroids that are sent to the executors at most.
BLOCK_NUMBERS = 4_000_000
MAX_COMPONENTS = 50_000_000


def check_centroids(k: int, dimension: int) -> None:
    if k * dimension > MAX_COMPONENTS:
        raise ValueError(f"{k} centroids of {dimension} components are more than the {MAX_COMPONENTS} numbers that executors share")


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid by squared L2, the first of equals.

    A matrix product ranks them; rows with several centroids that are equally near up to its rounding are compared by
    differences."""
    half = (centroids * centroids).sum(1) / 2
    step = max(1, BLOCK_NUMBERS // max(1, len(centroids)))
    out = np.zeros(len(x), np.int64)
    for s in range(0, len(x), step):
        part = x[s : s + step]
        score = half - part @ centroids.T
        best = score.argmin(1)
        edge = score[np.arange(len(part)), best] + 1e-10 * (1 + (part * part).sum(1) + half.max())
        close = score <= edge[:, None]
        rows = np.flatnonzero(close.sum(1) > 1)
        if len(rows):
            i, j = np.nonzero(close[rows])
            gap = part[rows[i]] - centroids[j]
            order = np.lexsort((j, (gap * gap).sum(1), i))
            first = order[np.searchsorted(i[order], np.arange(len(rows)))]
            best[rows] = j[first]
        out[s : s + step] = best
    return out


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int = 1234) -> np.ndarray:
    """On one matrix: start from k rows drawn with replacement; an empty cell restarts at a row chosen by its number."""
    rng = np.random.default_rng(seed)
    start = rng.integers(0, len(x), k)
    c = x[start].astype(np.float64).copy()
    for it in range(rounds):
        at = assign(x, c)
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            sums = np.bincount(at, weights=x[:, j], minlength=k)
            c[:, j] = np.where(n > 0, sums / np.maximum(n, 1), c[:, j])
        for j in np.flatnonzero(n == 0):
            c[j] = x[(start[0] + (it + 1) * k + j) % len(x)]
    return c


def one_iteration(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, counts) after assigning every row of ``rows`` (v): tasks send one partial sum each per centroid."""
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    small = centroids.size <= BLOCK_NUMBERS

    def sums_of(at, x):
        order = np.argsort(at, kind="stable")
        use, start = np.unique(at[order], return_index=True)
        return use, np.diff(np.r_[start, len(at)]), np.add.reduceat(x[order], start, axis=0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        n, s = (np.zeros(len(c), np.int64), np.zeros_like(c)) if small else (None, None)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                use, count, total = sums_of(assign(x, c), x)
                if small:
                    n[use] += count
                    s[use] += total
                else:  # too many to keep: a batch sends those it met
                    yield packed(use, count, total)
        if small:
            use = np.flatnonzero(n)
            yield packed(use, n[use], s[use])

    def packed(use, count, total):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32) * centroids.shape[1]), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(use), pa.array(count), lists], names=["c", "n", "s"])

    def add(key, t):
        total = t.column("s").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
        return pa.table({"c": pa.array([key[0].as_py()]), "n": pa.array([int(t.column("n").to_numpy().sum())]), "s": pa.array([total], pa.list_(pa.float64()))})

    schema = "c bigint, n bigint, s array<double>"
    means, counts = centroids.copy(), np.zeros(len(centroids), np.int64)
    for r in rows.select("v").mapInArrow(partial, schema).groupBy("c").applyInArrow(add, schema).collect():
        means[r.c], counts[r.c] = np.array(r.s) / r.n, r.n
    return means, counts


def fit(rows: DataFrame, k: int, rounds: int = 15, seed: int = 1234, vector: str = "embedding") -> np.ndarray:
    """k centroids over all rows: starts from a bounded hash sample, each iteration is one pass with partial sums."""
    v = rows.select(F.col(vector).alias("v"))
    n = v.count()
    first = v.first()
    if first is None:
        raise ValueError("no rows to train on")
    check_centroids(k, len(first.v))
    few = max(k, min(20 * k, BLOCK_NUMBERS // len(first.v)))
    share = min(1.0, float(few) / n)
    pick = v.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * few).collect() or v.limit(k).collect()
    pool = np.unique(np.array([r.v for r in pick], np.float64), axis=0)
    c = pool[np.random.default_rng(seed).integers(0, len(pool), k)].copy()
    for it in range(rounds):
        c, counts = one_iteration(v, c)
        for j in np.flatnonzero(counts == 0):
            c[j] = pool[((it + 1) * k + j) % len(pool)]
    return c
