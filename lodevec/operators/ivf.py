"""Inverted files: rows by coarse list, exact or product-quantised, searched by an equi-join on the list number."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quant
from ..types import between, check_metric, check_results
from ..util import settle
from . import kmeans, topk
from .topk import ranked


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def with_list(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v, list_no): the list of the nearest centroid by squared L2, the first of equals."""
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = kmeans.assign(_matrix(b.column(1)), shipped.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], names=["id", "v", "list_no"])

    return rows.select("id", "v").mapInArrow(run, "id bigint, v array<float>, list_no int")


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str) -> DataFrame:
    """(query_id, q, list_no): the nprobe best lists of each query under the metric, smaller number first on ties."""
    shipped = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column(1))
                step = max(1, topk.BLOCK_NUMBERS // len(c))
                for s in range(0, len(q), step):
                    part = q[s : s + step]
                    i, j, d = topk.candidates(part, c, nprobe, "l2" if metric == "l2" else "ip")
                    keep = topk.best_of(i, j, d, nprobe)
                    at = pa.array(s + i[keep])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(j[keep].astype(np.int32))], names=["query_id", "q", "list_no"])

    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("q")).mapInArrow(
        run, "query_id bigint, q array<float>, list_no int"
    )


def _prepare(records: DataFrame, metric: str, key: str, vector: str, where: Column | None) -> DataFrame:
    from ..functions.vectors import normalised

    rows = records if where is None else records.where(where)
    v = F.col(vector).cast("array<float>")
    return rows.select(F.col(key).cast("bigint").alias("id"), (normalised(v) if metric == "cosine" else v).alias("v")).where("v is not null")


#: Rows of a list and queries that meet in one task.
SLICE_ROWS = 100_000
QUERY_ROWS = 4_096
#: Components of probing queries, each as often as it probes lists, that go to the tasks (64 MB).
PROBE_COMPONENTS = 16_000_000


def meet_lists(lists: DataFrame, asked: DataFrame, kernel, k: int, dimension: int) -> DataFrame:
    """(query_id, id, distance): each query's best k of what ``kernel(list_no, rows, queries)`` finds for Arrow tables of what
    meets in a list: ``lists`` (list_no, id, ..), ``asked`` (list_no, query_id, q).

    Up to PROBE_COMPONENTS the probes go to where the rows are, which then aren't shuffled. More of them meet the rows in a
    cogroup by list.
    """
    most = PROBE_COMPONENTS // dimension
    probing = asked.select("list_no", "query_id", "q").limit(most + 1).toArrow()
    if probing.num_rows > most:
        return _cogrouped(lists, asked, kernel)
    number = probing.column("list_no").to_numpy()
    order = np.argsort(number, kind="stable")
    probing = probing.take(pa.array(order)).select(["query_id", "q"]).combine_chunks()
    names, first = np.unique(number[order], return_index=True)
    places = {int(n): (int(s), int(e - s)) for n, s, e in zip(names, first, [*first[1:], len(order)])}
    shipped = lists.sparkSession.sparkContext.broadcast((probing, places))
    fields = [c for c in lists.columns if c != "list_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probing, places = shipped.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            order = np.argsort(at, kind="stable")
            rows = pa.Table.from_batches([b.select(fields).take(pa.array(order))])
            names, first = np.unique(at[order], return_index=True)
            parts = [held]
            for n, s, e in zip(names.tolist(), first, [*first[1:], len(order)]):
                if n in places:
                    found = kernel(n, rows.slice(s, e - s), probing.slice(*places[n]))
                    parts.append([found.column(c).to_numpy() for c in range(3)])
            held = [np.concatenate(c) for c in zip(*parts)]
            keep = topk.best_of(held[0], held[1], held[2], k)
            held = [c[keep] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query_id", "id", "distance"])

    return lists.select("list_no", *fields).mapInArrow(run, _FOUND)


def _cogrouped(lists: DataFrame, asked: DataFrame, kernel) -> DataFrame:
    """A list is cut into slices and its queries into blocks, so that each task holds a bounded part of both: rows go to all
    query blocks of their list and queries to all slices, one of each as a rule. Lists that no query probes stay out. The
    table of cuts has a row for each list.
    """
    rows = lists.groupBy("list_no").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("slices"))
    cuts = rows.join(asked.groupBy(F.col("list_no").alias("of")).agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks")), F.col("list_no") == F.col("of"))
    cuts = F.broadcast(cuts.select(F.col("list_no").alias("of"), "slices", "blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    here = lists.join(cuts, F.col("list_no") == F.col("of")).withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).withColumn("block", every("blocks"))
    there = asked.join(cuts, F.col("list_no") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("slice", every("slices"))
    keys = ["list_no", "slice", "block"]
    empty = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]).empty_table()

    def run(key, a, b):
        return kernel(key[0].as_py(), a, b) if a.num_rows and b.num_rows else empty

    here, there = here.select(*keys, *[c for c in lists.columns if c != "list_no"]), there.select(*keys, "query_id", "q")
    return here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(run, _FOUND)


_FOUND = "query_id bigint, id bigint, distance double"


def _found(qid, i, ids, dist, k) -> pa.Table:
    keep = topk.best_of(i, ids, dist, k)
    return pa.table({"query_id": qid[i[keep]], "id": ids[keep], "distance": dist[keep]})


def search_flat(
    records: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, nprobe: int = 1, metric: str = "l2", where: Column | None = None,
    key: str = "id", vector: str = "embedding",
) -> DataFrame:
    """IVF-Flat: (query_id, rank, id, distance), exact distances within the probed lists; ``where`` is honoured."""
    check_results(k), check_metric(metric), between("nprobe", nprobe, 1, len(centroids))
    return _search_lists(with_list(_prepare(records, metric, key, vector, where), centroids), queries, centroids, k, nprobe, metric)


def _search_lists(lists: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, nprobe: int, metric: str) -> DataFrame:
    asked = probes(_prepare(queries.withColumnRenamed("query_id", "id"), metric, "id", "embedding", None).select(F.col("id").alias("query_id"), F.col("v").alias("embedding")), centroids, nprobe, metric)

    def exact(_, rows, queries):
        x, ids = _matrix(rows.column("v").combine_chunks()), rows.column("id").to_numpy()
        qid, q = queries.column("query_id").to_numpy(), _matrix(queries.column("q").combine_chunks())
        step = max(1, topk.BLOCK_NUMBERS // len(x))
        parts = []
        for s in range(0, len(q), step):
            i, j, dist = topk.candidates(q[s : s + step], x, k, metric)
            parts.append((s + i, ids[j], dist))
        return _found(qid, *(np.concatenate(c) for c in zip(*parts)), k)

    found = meet_lists(lists.select("list_no", "id", "v"), asked, exact, k, centroids.shape[1])
    return ranked(found, k, [F.col("distance"), F.col("id")]).select("query_id", "rank", "id", "distance")


#: Rows from which lists are fitted and queries by which the number of probed lists is measured.
FIT_ROWS, MEASURED_QUERIES = 100_000, 256


class MeasuredLists:
    """Inverted lists whose probes reach a recall: a sub-linear search of whole vectors.

    About sqrt(n) lists are fitted on a bounded sample, every row is in one. Of a sample of rows the nearest are found by
    brute force, and as many lists are probed as the share ``recall`` of these asks for, be it all of them. Rows are written
    by list, so that a search shuffles probes and what the probed lists hold.
    """

    def __init__(self, rows: DataFrame, metric: str = "l2", recall: float = 0.99, key: str = "id", vector: str = "embedding", nlist: int = 0, k: int = 10, rounds: int = 8):
        self.metric = check_metric(metric)
        if not 0 < recall <= 1:
            raise ValueError("recall must lie in (0, 1]")
        prepared = _prepare(rows, metric, key, vector, None)
        n = prepared.count()
        self.rows, self.centroids, self.nprobe, self.nlist = None, None, 0, 0
        if not n:
            return
        picked = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        fit = prepared.where(picked < min(1.0, FIT_ROWS / n)).limit(2 * FIT_ROWS)
        self.nlist = min(n, nlist or max(1, int(math.sqrt(n))))
        kmeans.check_centroids(self.nlist, len(prepared.first().v))
        self.centroids = kmeans.fit(settle(fit, "fit"), self.nlist, rounds, vector="v")
        self.rows = settle(with_list(prepared, self.centroids).repartition("list_no").sortWithinPartitions("list_no"), "lists")
        sample = self.rows.where(picked < min(1.0, MEASURED_QUERIES / n)).limit(2 * MEASURED_QUERIES).select(F.col("id").alias("query_id"), F.col("v").alias("embedding")).collect()
        if not sample:
            sample = self.rows.limit(MEASURED_QUERIES).select(F.col("id").alias("query_id"), F.col("v").alias("embedding")).collect()
        queries = rows.sparkSession.createDataFrame(sample, "query_id bigint, embedding array<float>")
        true = topk.nearest(self.rows, queries, min(k + 1, 2048), "ip" if metric == "cosine" else metric, vector="v")
        lists = true.join(self.rows.select(F.col("id").alias("of"), "list_no"), F.col("id") == F.col("of")).select("query_id", "list_no").collect()
        q = np.array([r.embedding for r in sample], np.float64)
        gap = ((self.centroids * self.centroids).sum(1)[None] - 2 * q @ self.centroids.T) if metric == "l2" else -(q @ self.centroids.T)
        place = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1)
        at = {r.query_id: i for i, r in enumerate(sample)}
        needs = [int(place[at[r.query_id], r.list_no]) + 1 for r in lists]
        self.nprobe = int(np.quantile(needs, recall, method="higher"))

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, distance) by exact distances within the probed lists; ``allowed`` (id) filters first."""
        check_results(k)
        if self.rows is None:
            return queries.sparkSession.createDataFrame([], "query_id bigint, rank bigint, id bigint, distance double")
        lists = self.rows if allowed is None else self.rows.join(allowed.select("id"), "id", "left_semi")
        return _search_lists(lists, queries, self.centroids, k, self.nprobe, self.metric)


@dataclass
class IVFPQ:
    """A compressed collection: codes of residuals by list. ``codes``: (id, list_no, code)."""

    dimension: int
    metric: str = "l2"
    nlist: int = 64
    m: int = 8
    nprobe: int = 0
    ksub: int = 256
    centroids: np.ndarray | None = None
    books: list[np.ndarray] | None = None
    codes: DataFrame | None = None

    def __post_init__(self):
        check_metric(self.metric)
        between("nlist", self.nlist, 1, 1_000_000)
        kmeans.check_centroids(self.nlist, self.dimension)
        between("ksub", self.ksub, 1, 256)
        if self.dimension % self.m:
            raise ValueError("the parts must divide the dimension")
        self.nprobe = self.nprobe or min(10, self.nlist)
        between("nprobe", self.nprobe, 1, min(self.nlist, 65_536))

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    def set_nprobe(self, nprobe: int) -> None:
        self.nprobe = between("nprobe", nprobe, 1, self.nlist)

    def train(self, records: DataFrame, key: str = "id", vector: str = "embedding", rounds: int = 15, fit_rows: int = 50_000) -> IVFPQ:
        """Coarse centroids over all rows, codebooks on the residuals of a bounded sample; a second call changes nothing."""
        if self.is_trained:
            return self
        rows = _prepare(records, self.metric, key, vector, None)
        n = rows.count()
        if n < max(self.nlist, self.ksub):
            raise ValueError(f"training needs at least {max(self.nlist, self.ksub)} rows")
        self.centroids = kmeans.fit(rows, self.nlist, rounds, vector="v")
        share = min(1.0, fit_rows / n)
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
        self.books = quant.pq_train(self._residuals(with_list(sample, self.centroids)), self.m, self.ksub, rounds)
        return self

    def _residuals(self, listed: DataFrame) -> DataFrame:
        shipped = listed.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    r = _matrix(b.column(1)) - shipped.value[b.column(2).to_numpy()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(r.astype(np.float32)), pa.list_(pa.float32()))], names=["id", "v"])

        return listed.select("id", "v", "list_no").mapInArrow(run, "id bigint, v array<float>")

    def add(self, records: DataFrame, key: str = "id", vector: str = "embedding") -> IVFPQ:
        """Encode rows; keys that repeat, here or from earlier calls, raise. The first call trains if need be."""
        self.train(records, key, vector)
        rows = _prepare(records, self.metric, key, vector, None)
        ids = rows.select("id") if self.codes is None else rows.select("id").union(self.codes.select("id"))
        if ids.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("ids must be unique")
        shipped = rows.sparkSession.sparkContext.broadcast((self.centroids, self.books))

        def run(batches):
            for b in batches:
                if b.num_rows:
                    c, books = shipped.value
                    x = _matrix(b.column(1))
                    at = kmeans.assign(x, c)
                    codes = quant.pq_encode_matrix(x - c[at], books)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(list(codes), pa.list_(pa.int16()))], names=["id", "list_no", "code"])

        new = rows.select("id", "v").mapInArrow(run, "id bigint, list_no int, code array<smallint>")
        self.codes = new if self.codes is None else self.codes.union(new)
        return self

    def query(self, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, distance) by asymmetric distances to the codes of the probed lists.

        A slice of a list meets a block of its queries in one task. Each query's table of distances from its parts to all
        codewords is looked up by the codes; the best k of each slice come out.
        """
        check_results(k)
        codes = self.codes if allowed is None else self.codes.join(allowed.select("id"), "id", "left_semi")
        q = _prepare(queries.withColumnRenamed("query_id", "id"), self.metric, "id", "embedding", None).select(F.col("id").alias("query_id"), F.col("v").alias("embedding"))
        asked = probes(q, self.centroids, self.nprobe, self.metric)
        shipped = codes.sparkSession.sparkContext.broadcast((self.centroids, self.books))
        metric = self.metric

        def look_up(n, rows, block):
            c, books = shipped.value
            ids, code = rows.column("id").to_numpy(), rows.column("code").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(rows.num_rows, -1)
            qid, q = block.column("query_id").to_numpy(), _matrix(block.column("q").combine_chunks())
            out = []
            for at, x in enumerate(q):
                table, base = quant.adc_table(x - c[n] if metric == "l2" else x, books, metric), 0.0 if metric == "l2" else 1.0 - float(x @ c[n])
                dist = np.full(len(code), base)
                for m in range(len(books)):
                    dist += table[m][code[:, m]]
                few = np.arange(len(dist))
                if len(dist) > k:
                    few = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
                out.append((np.full(len(few), at), ids[few], dist[few]))
            return _found(qid, *(np.concatenate(p) for p in zip(*out)), k)

        found = meet_lists(codes.select("list_no", "id", "code"), asked, look_up, k, self.dimension)
        return ranked(found, k, [F.col("distance"), F.col("id")]).select("query_id", "rank", "id", "distance")

    def stats(self) -> dict:
        count = 0 if self.codes is None else self.codes.count()
        return {"count": count, "dimension": self.dimension, "metric": self.metric, "nlist": self.nlist, "pq_subvectors": self.m, "nprobe": self.nprobe, "is_trained": self.is_trained}

    def save(self, path: str) -> None:
        """Codes as Parquet, centroids and codebooks beside them; the settings come last."""
        root = Path(path)
        root.mkdir(parents=True, exist_ok=True)
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(str(root / "codes"))
        keys = ("dimension", "metric", "nlist", "m", "nprobe", "ksub")
        state = {k: getattr(self, k) for k in keys} | {"codes": self.codes is not None}
        state |= {"centroids": self.centroids.tolist(), "books": [b.tolist() for b in self.books]} if self.is_trained else {}
        (root / ".settings").write_text(json.dumps(state))
        os.replace(root / ".settings", root / "settings.json")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVFPQ:
        """What ``save`` wrote; every id must be in exactly one list that exists."""
        try:
            s = json.loads((Path(path) / "settings.json").read_text())
        except FileNotFoundError:
            raise ValueError(f"no compressed collection at {path}") from None
        has_codes, centroids, books = s.pop("codes"), s.pop("centroids", None), s.pop("books", None)
        out = cls(**s)
        if centroids is not None:
            out.centroids, out.books = np.array(centroids), [np.array(b) for b in books]
        if has_codes:
            out.codes = spark.read.parquet(str(Path(path) / "codes"))
            bad = out.codes.groupBy("id").count().where("count > 1").limit(1).count() + out.codes.where((F.col("list_no") < 0) | (F.col("list_no") >= out.nlist)).limit(1).count()
            if bad:
                raise ValueError(f"the codes at {path} are damaged")
        return out
