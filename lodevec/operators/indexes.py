"""Indexes over vectors alone: flat, SQ8 with exact reranking, per-dimension and half-float quantisers, inverted files.

Each takes DataFrames (id, embedding) and queries (query_id, embedding) and returns (query_id, rank, id, distance). As in
low-level indexes, an inner-product index returns the raw product, larger first. ``allowed`` (id) limits what is found.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quant
from ..functions import vectors as V
from ..types import check_dimension, check_ef, check_links, check_metric, check_results
from ..util import settle
from . import ivf, kmeans, topk


class _Index:
    kind = "index"

    def __init__(self, dimension: int, metric: str = "l2"):
        self.dimension, self.metric = check_dimension(dimension), check_metric(metric)
        self.rows: DataFrame | None = None

    @property
    def ntotal(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    @property
    def is_trained(self) -> bool:
        return True

    def train(self, rows: DataFrame) -> None:
        """Nothing to learn here."""

    def add(self, rows: DataFrame) -> None:
        if not self.is_trained:
            raise ValueError("train the index before adding to it")
        bad = F.raise_error(F.lit(f"vectors must be finite and have {self.dimension} components")).cast("array<float>")
        v = F.col("embedding").cast("array<float>")
        sound = rows.select(F.col("id").cast("bigint").alias("id"), F.when((F.size(v) == self.dimension) & V.is_finite(v), v).otherwise(bad).alias("embedding"))
        self.rows = settle(sound if self.rows is None else self.rows.union(sound), "index")

    def _held(self, allowed: DataFrame | None) -> DataFrame:
        if self.rows is None:
            raise ValueError("the index is empty")
        return self.rows if allowed is None else self.rows.join(allowed.select("id"), "id", "left_semi")

    def _public(self, found: DataFrame) -> DataFrame:
        value = F.lit(1.0) - F.col("distance") if self.metric == "ip" else F.col("distance")
        return found.select("query_id", "rank", "id", value.alias("distance"))

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def _state(self) -> dict:
        return {"kind": self.kind, "dimension": self.dimension, "metric": self.metric}

    def save(self, path: str) -> None:
        """Rows as Parquet, settings last and by an atomic rename: a folder without them is no index."""
        root = Path(path)
        root.mkdir(parents=True, exist_ok=True)
        if self.rows is not None:
            self.rows.write.mode("overwrite").parquet(str(root / "rows"))
        (root / ".settings").write_text(json.dumps({**self._state(), "rows": self.rows is not None}))
        os.replace(root / ".settings", root / "settings.json")


class IndexFlat(_Index):
    kind = "flat"

    def search(self, queries, k, allowed=None):
        return self._public(topk.nearest(self._held(allowed), queries, k, self.metric))


class IndexHNSW(_Index):
    """Takes the settings of a graph index; searches exactly, or with a ``recall`` below 1 inverted lists whose probes reach it,
    measured when the first search after an addition needs them. ``M`` and the two ``ef`` are checked and kept: a graph that is walked row by row
    has no place on many executors."""

    kind = "hnsw"

    def __init__(self, dimension, metric="l2", M=32, ef_construction=40, ef_search=16, recall=1.0):  # noqa: N803
        super().__init__(dimension, metric)
        self.links, self.ef_construction, self.ef_search, self.recall = check_links(M), check_ef("ef_construction", ef_construction), check_ef("ef_search", ef_search), recall
        self._lists: ivf.MeasuredLists | None = None

    def add(self, rows):
        super().add(rows)
        self._lists = None

    def search(self, queries, k, allowed=None):
        if self.recall >= 1:
            return self._public(topk.nearest(self._held(allowed), queries, k, self.metric))
        self._held(None)
        if self._lists is None:
            self._lists = ivf.MeasuredLists(self.rows, self.metric, self.recall)
        return self._public(self._lists.search(queries, k, allowed))

    def _state(self):
        return super()._state() | {"M": self.links, "ef_construction": self.ef_construction, "ef_search": self.ef_search, "recall": self.recall}


class IndexFlatSQ8(_Index):
    """One byte per component under global bounds; ``rerank`` candidates per result are ranked exactly (0: codes decide)."""

    kind = "sq8"

    def __init__(self, dimension, metric="l2", rerank=2):
        super().__init__(dimension, metric)
        self.rerank = rerank

    def _state(self):
        return super()._state() | {"rerank": self.rerank}

    def codes(self, allowed=None) -> DataFrame:
        """(id, embedding: codes, unit). Bounds are those of all rows held."""
        b = F.broadcast(quant.sq8_bounds(self.rows))
        v = F.col("embedding")
        if self.metric == "l2":
            return self._held(allowed).crossJoin(b).select("id", quant.sq8_affine(v, F.col("lo"), F.col("scale")).alias("embedding"), F.col("scale").alias("unit"))
        v = V.normalised(v) if self.metric == "cosine" else v
        unit = F.lit(1.0 / 127) if self.metric == "cosine" else F.col("sym")
        return self._held(allowed).crossJoin(b).select("id", quant.sq8_symmetric(v, unit).alias("embedding"), unit.alias("unit"))

    def search(self, queries, k, allowed=None):
        check_results(k)
        b = F.broadcast(quant.sq8_bounds(self.rows))
        v = F.col("embedding")
        if self.metric == "l2":
            code, unit = quant.sq8_affine(v, F.col("lo"), F.col("scale")), F.col("scale")
        else:
            unit = F.lit(1.0 / 127) if self.metric == "cosine" else F.col("sym")
            code = quant.sq8_symmetric(V.normalised(v) if self.metric == "cosine" else v, unit)
        asked = queries.crossJoin(b).select("query_id", code.alias("embedding"))
        pool = min(2048, k * self.rerank) if self.rerank else k
        metric = "l2" if self.metric == "l2" else "ip"
        found = topk.nearest(self.codes(allowed), asked, pool, metric)
        if not self.rerank:
            square = F.col("unit") * F.col("unit")
            scaled = F.col("distance") * square if metric == "l2" else F.lit(1.0) - (F.lit(1.0) - F.col("distance")) * square
            units = self.codes().select("unit").limit(1)
            return self._public(found.crossJoin(F.broadcast(units)).select("query_id", "rank", "id", scaled.alias("distance")))
        q = queries.select(F.col("query_id").cast("bigint").alias("q"), F.col("embedding").alias("qe"))
        both = found.select("query_id", "id").join(self.rows, "id").join(q, F.col("query_id") == F.col("q"))
        exact = both.select("query_id", "id", V.distance(self.metric, v, F.col("qe")).alias("distance"))
        return self._public(topk.ranked(exact, k, [F.col("distance"), F.col("id")]))


class IndexScalarQuantizer(_Index):
    """Eight bits per component between each dimension's bounds, or half floats; distances are to the decoded vectors."""

    kind = "sq"

    def __init__(self, dimension, metric="l2", bits="8bit"):
        super().__init__(dimension, metric)
        if bits not in ("8bit", "fp16"):
            raise ValueError("bits must be 8bit or fp16")
        self.bits, self.bounds = bits, None

    @property
    def is_trained(self):
        return self.bits == "fp16" or self.bounds is not None

    def train(self, rows):
        if self.bits == "8bit":
            r = quant.as_arrays(quant.dimension_bounds(rows)).first()
            self.bounds = (list(r.vmins), list(r.vdiffs))

    def _state(self):
        return super()._state() | {"bits": self.bits, "bounds": self.bounds}

    def decoded(self, allowed=None) -> DataFrame:
        rows = self._held(allowed)
        if self.bits == "fp16":
            return quant.fp16_round_trip(rows).withColumnRenamed("half", "embedding")
        lows, widths = (F.array(*[F.lit(float(x)) for x in b]) for b in self.bounds)
        return rows.select("id", quant.sq_decode(quant.sq_encode(F.col("embedding"), lows, widths), lows, widths).alias("embedding"))

    def search(self, queries, k, allowed=None):
        return self._public(topk.nearest(self.decoded(allowed), queries, k, self.metric))


class IndexIVFFlat(_Index):
    kind = "ivfflat"

    def __init__(self, dimension, metric="l2", nlist=64, nprobe=1):
        super().__init__(dimension, metric)
        self.nlist, self.nprobe, self.centroids = nlist, nprobe, None

    @property
    def is_trained(self):
        return self.centroids is not None

    def train(self, rows):
        self.centroids = kmeans.fit(rows.withColumn("embedding", V.normalised(F.col("embedding"))) if self.metric == "cosine" else rows, self.nlist)

    def _state(self):
        return super()._state() | {"nlist": self.nlist, "nprobe": self.nprobe, "centroids": None if self.centroids is None else self.centroids.tolist()}

    def search(self, queries, k, allowed=None):
        return self._public(ivf.search_flat(self._held(allowed), queries, self.centroids, k, self.nprobe, self.metric))


def load(spark: SparkSession, path: str) -> _Index:
    """What ``save`` wrote."""
    try:
        s = json.loads((Path(path) / "settings.json").read_text())
    except FileNotFoundError:
        raise ValueError(f"no index at {path}") from None
    kind = {c.kind: c for c in (IndexFlat, IndexHNSW, IndexFlatSQ8, IndexScalarQuantizer, IndexIVFFlat)}[s.pop("kind")]
    rows, bounds, centroids = s.pop("rows"), s.pop("bounds", None), s.pop("centroids", None)
    index = kind(**s)
    if bounds is not None:
        index.bounds = tuple(bounds)
    if centroids is not None:
        index.centroids = np.array(centroids)
    if rows:
        index.rows = spark.read.parquet(str(Path(path) / "rows"))
    return index
