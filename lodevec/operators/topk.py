"""Exact nearest neighbours of a stated set of queries, rankings and padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import check_metric, check_results

#: Components of query vectors that go to the executors at once; a larger query set is searched in blocks.
QUERY_COMPONENTS = 4_000_000


def ranked(scored: DataFrame, k: int, by: list[Column], group: str = "query_id") -> DataFrame:
    """The first k rows of each group with ``rank`` from 1; the group limit runs before the shuffle."""
    w = Window.partitionBy(group).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    if (n == 0).any():
        raise ValueError("the zero vector has no direction under cosine")
    return (x / n).astype(np.float32).astype(np.float64)


def candidates(q: np.ndarray, x: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of all rows that may be among a query's best k: a matrix product finds them, with what may tie
    with the k-th, and their distances are computed from the vectors themselves. Vectors are of unit length for cosine.
    ``bound``: each query's k-th distance so far, where it is known."""
    rough = (x * x).sum(1)[None] + (q * q).sum(1)[:, None] - 2 * q @ x.T if metric == "l2" else 1 - q @ x.T
    if bound is not None:
        i, j = np.nonzero(rough <= (bound + 1e-9 * (1 + np.abs(bound)))[:, None])
    elif rough.shape[1] > k:
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(rough <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(rough.shape))
    return i, j, ((x[j] - q[i]) ** 2).sum(1) if metric == "l2" else 1 - (x[j] * q[i]).sum(1)


def best_of(i: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k entries of each query ``i``, by distance and id."""
    order = np.lexsort((ids, dist, i))
    at = i[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return order[rank < k]


#: Numbers in a block of queries x rows.
BLOCK_NUMBERS = 8_000_000


def _scan(queries, metric: str, k: int):
    """Batches of (id, vector) to each query's best k rows of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        best_q, best_i, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            if not np.isfinite(x).all():
                raise ValueError("vectors must be finite")
            ids = b.column(0).to_numpy()
            if metric == "cosine":
                x = _unit(x)
            parts = [(best_q, best_i, best_d)]
            step = max(1, BLOCK_NUMBERS // len(x))
            for s in range(0, len(q), step):
                i, j, dist = candidates(q[s : s + step], x, k, metric, None if bound is None else bound[s : s + step])
                parts.append((s + i, ids[j], dist))
            best_q, best_i, best_d = (np.concatenate(c) for c in zip(*parts))
            keep = best_of(best_q, best_i, best_d, k)
            best_q, best_i, best_d = best_q[keep], best_i[keep], best_d[keep]
            if len(best_q) == k * len(q):  # by query and distance
                bound = best_d.reshape(len(q), k)[:, -1]
        yield pa.RecordBatch.from_arrays([pa.array(qid[best_q]), pa.array(best_i), pa.array(best_d)], names=["query_id", "id", "distance"])

    return run


def nearest(
    records: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, key: str = "id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, distance): the exact k nearest records of each query, ties to the smaller id.

    ``queries``: query_id, embedding. The query set goes to every task in blocks of a bounded size and the records stay
    where they are: each task keeps k rows per query, which is all that is shuffled. ``where`` filters before the search.
    """
    check_results(k), check_metric(metric)
    spark = records.sparkSession
    rows = records if where is None else records.where(where)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    found = None
    held: list = []

    def flush():
        nonlocal found, held
        qid = np.array([r[0] for r in held], np.int64)
        q = np.array([r[1] for r in held], np.float64)
        if not np.isfinite(q).all():
            raise ValueError("vectors must be finite")
        q = _unit(q) if metric == "cosine" else q
        part = rows.mapInArrow(_scan(spark.sparkContext.broadcast((qid, q)), metric, k), "query_id bigint, id bigint, distance double")
        found = part if found is None else found.union(part)
        held = []

    size = 0
    for r in queries.select(F.col("query_id").cast("bigint"), "embedding").toLocalIterator():
        held.append(r)
        size += len(r[1])
        if size >= QUERY_COMPONENTS:
            flush()
            size = 0
    if held:
        flush()
    if found is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, distance double, rank bigint")
    return ranked(found, k, [F.col("distance"), F.col("id")])


def padded(results: DataFrame, queries: DataFrame, k: int, value: str = "distance", fill: float = 0.0) -> DataFrame:
    """Exactly k rows for each query: missing places get the id -1 and ``fill``."""
    places = queries.select("query_id").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k)).cast("array<bigint>")))
    got = places.join(results, ["query_id", "rank"], "left")
    return got.withColumn("id", F.coalesce("id", F.lit(-1))).withColumn(value, F.coalesce(value, F.lit(float(fill))))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact (query_id, id) pairs that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg((F.count("hit") / F.count("*")).alias("recall"))
