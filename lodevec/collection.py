"""Managed collections: id to (embedding, typed metadata, document), with mutations, searches and durability."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .functions import vectors
from .functions import where as W
from .operators import bm25, ivf, mutations, topk
from .operators.indexes import IndexFlatSQ8
from .sources.readers import packed
from .types import METADATA, between, check_dimension, check_ef, check_links, check_metric, check_ratio, check_results, BOOLEAN, FLOAT, INTEGER, STRING
from .util import drop_settled, numbered, settle

ROW = f"seq bigint, pos bigint, op string, id bigint, embedding array<float>, metadata {METADATA}, document string"
STATE = f"id bigint, internal_id bigint, embedding array<float>, metadata {METADATA}, document string"


def tagged(metadata: dict | None) -> dict | None:
    """A metadata dict as a map of tagged values; None values are left out, other than scalar values raise."""
    if metadata is None:
        return None
    out = {}
    for key, v in metadata.items():
        if v is None:
            continue
        kind = W.kind_of(v)
        out[key] = (kind, v if kind == STRING else None, v if kind == INTEGER else None, float(v) if kind == FLOAT else None, v if kind == BOOLEAN else None)
    return out


class Metadata(dict):
    """The metadata of a record: a dict of scalars with typed readers that raise on a value of another kind."""

    def _typed(self, key: str, kind: int):
        if key not in self:
            raise KeyError(key)
        if W.kind_of(self[key]) != kind:
            raise TypeError(f"{key} is of another kind")
        return self[key]

    def get_string(self, key: str) -> str:
        return self._typed(key, STRING)

    def get_int(self, key: str) -> int:
        return self._typed(key, INTEGER)

    def get_float(self, key: str) -> float:
        return self._typed(key, FLOAT)

    def get_bool(self, key: str) -> bool:
        return self._typed(key, BOOLEAN)

    def contains(self, key: str) -> bool:
        return key in self

    def count(self) -> int:
        return len(self)


def untagged(metadata) -> Metadata:
    slot = {STRING: "s", INTEGER: "i", FLOAT: "f", BOOLEAN: "b"}
    return Metadata({k: v[slot[v["kind"]]] for k, v in (metadata or {}).items()})


class Client:
    """Factory of collections in one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def create_collection(self, name: str, dimension: int, metric: str = "l2", **settings) -> Collection:
        return Collection(self.spark, name, dimension, metric, **settings)

    def create_ivfpq_collection(self, dimension: int, **settings):
        from .operators.ivf import IVFPQ

        return IVFPQ(check_dimension(dimension), **settings)


def to_result_dict(found: DataFrame, n_queries: int) -> dict:
    """A result as nested lists by query, for results that fit the driver."""
    value = "distance" if "distance" in found.columns else "score"
    out: dict = {k: [[] for _ in range(n_queries)] for k in ("ids", value + "s", "metadatas", "documents")}
    for r in found.orderBy("query_id", "rank").collect():
        out["ids"][r.query_id].append(r.id)
        out[value + "s"][r.query_id].append(r[value])
        out["metadatas"][r.query_id].append(untagged(r.metadata))
        out["documents"][r.query_id].append(r.document or "")
    return out


#: Batches after which the written base takes in the tail.
FOLD_BATCHES = 16


class Collection:
    """State is a written base of active records and a tail of mutation batches.

    A mutation writes its own rows only. ``records`` folds the tail over the base: rows of the base that no batch touches are
    read as they are, and the touched ids go through the mutation algebra. After ``FOLD_BATCHES`` batches the fold is written
    as the new base; the base before it stays until the next, for results that are still to be read.

    ``M`` and ``ef_construction`` are checked and reported; the search is exact, or with ``recall`` one of inverted lists whose
    probes reach it. A ``quantized`` collection scans one-byte codes and ranks the best max(ef_search, 2 k) by the vectors
    themselves.
    """

    def __init__(self, spark: SparkSession, name: str, dimension: int, metric: str = "l2", quantized: bool = False, M: int = 32, ef_construction: int = 200, ef_search: int = 96):  # noqa: N803
        self.spark, self.name = spark, name
        self.dimension, self.metric, self.quantized = check_dimension(dimension), check_metric(metric), quantized
        self.links, self.ef_construction, self.ef_search = check_links(M), check_ef("ef_construction", ef_construction), check_ef("ef_search", ef_search)
        self.identity = uuid.uuid4().hex
        self._base: DataFrame = spark.createDataFrame([], STATE)
        self._former: DataFrame | None = None
        self._tail: list[DataFrame] = []
        self.sequence, self.next_internal, self.deleted = 0, 0, 0
        self.epochs: dict[str, int] = {}
        self.log: store.Log | None = None
        self._index: bm25.TextIndex | None = None
        self._lists: tuple | None = None  # lists, and what they were measured for

    def __repr__(self) -> str:
        return f"Collection(name={self.name!r}, dimension={self.dimension}, metric={self.metric!r}, storage_kind={self.storage_kind!r}, sequence={self.sequence})"

    @property
    def storage_kind(self) -> str:
        return "sq8" if self.quantized else "flat"

    @property
    def is_quantized(self) -> bool:
        return self.quantized

    @property
    def records(self) -> DataFrame:
        """The active records: id, internal_id, embedding, metadata, document."""
        if not self._tail:
            return self._base
        tail = reduce(DataFrame.unionByName, self._tail)
        touched = tail.select(F.col("id").alias("touched"))
        same = F.col("id") == F.col("touched")
        old = self._base.join(touched, same, "left_semi").select(F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("pos"), F.lit("add").alias("op"), *self._base.columns)
        v = vectors.normalised(F.col("embedding")) if self.metric == "cosine" else F.col("embedding")
        now = mutations.fold(old.unionByName(tail.withColumn("embedding", v)), ["metadata", "document"], latest=("embedding",))
        now = now.withColumn("metadata", F.when(F.size("metadata") > 0, F.col("metadata"))).withColumn("document", F.nullif("document", F.lit("")))
        return self._base.join(touched, same, "left_anti").unionByName(now.select(*self._base.columns))

    def _rebase(self, rows: DataFrame) -> None:
        """``rows`` are the state from now on."""
        if self._former is not None:
            drop_settled(self._former)
        self._former, self._base, self._tail, self._index = self._base, rows, [], None

    # mutations

    def _batch(self, op: str, ids, embeddings=None, metadatas=None, documents=None) -> DataFrame:
        ids = list(ids)
        n = len(ids)
        if any(isinstance(i, bool) or not isinstance(i, int) or not -(2**63) <= i < 2**63 for i in ids):
            raise ValueError("ids are 64-bit whole numbers")
        if op != "delete":
            if len(set(ids)) != n:
                raise ValueError("ids of a batch must be unique")
            rows = _nested(embeddings, self.dimension)
            for what in (rows, metadatas, documents):
                if what is not None and len(what) != n:
                    raise ValueError("all parts of a batch must have one length")
            for v in rows:
                if not all(map(math.isfinite, v)):
                    raise ValueError("vectors must be finite")
                if self.metric == "cosine" and not any(v):
                    raise ValueError("the zero vector has no direction under cosine")
        else:
            rows = [None] * n
        data = [
            (self.sequence + 1, p, op, i, rows[p], tagged(metadatas[p]) if metadatas is not None else None, documents[p] if documents is not None else None)
            for p, i in enumerate(ids)
        ]
        return self.spark.createDataFrame(data, ROW)

    def frame_batch(self, op: str, rows: DataFrame) -> DataFrame:
        """A batch from a DataFrame with id, embedding and perhaps document, in the order of its partitions and rows.

        Metadata are a column ``metadata`` (tagged map), or else all other scalar columns by their names; a NULL is a missing
        field. A NULL document, or no metadata columns at all, supply none.
        """
        types = dict(rows.dtypes)
        others = [c for c in rows.columns if c not in ("id", "embedding", "document", "metadata")]
        if "metadata" in types:
            meta = F.col("metadata").cast(METADATA)
        else:
            meta = packed({c: types[c] for c in others}) if others else F.lit(None).cast(METADATA)
        doc = F.col("document").cast("string") if "document" in types else F.lit(None).cast("string")
        numbered = rows.withColumn("__m", F.monotonically_increasing_id())
        return numbered.select(
            F.lit(self.sequence + 1).cast("bigint").alias("seq"), F.col("__m").alias("pos"), F.lit(op).alias("op"), F.col("id").cast("bigint").alias("id"),
            F.col("embedding").cast("array<float>").alias("embedding"), meta.alias("metadata"), doc.alias("document"),
        )

    def apply(self, op: str, batch: DataFrame, fault=store._no_fault, note: dict | None = None) -> int:
        """Check a batch against the state, commit it to the log if there is one, and take it into the tail. Returns its rows.

        An empty batch is none: it gets no sequence number.
        """
        batch = settle(batch, "batch")
        v = F.col("embedding")
        bad = v.isNull() | (F.size(v) != self.dimension) | ~vectors.is_finite(v)
        zero = v.isNotNull() & ~F.exists(v, lambda x: x != 0)
        n, distinct, bad, zero, last = batch.agg(
            F.count("*"), F.countDistinct("id"), F.count_if(F.coalesce(bad, F.lit(True))), F.count_if(F.coalesce(zero, F.lit(False))), F.max("pos"),
        ).first()
        if not n:
            return 0
        if op != "delete":
            if bad:
                raise ValueError("vectors must be finite and of the collection's dimension")
            if zero and self.metric == "cosine":
                raise ValueError("the zero vector has no direction under cosine")
            if distinct != n:
                raise ValueError("ids of a batch must be there and unique")
        known = self.records.select("id").join(batch.select("id"), "id", "left_semi").count()
        if op == "add" and known:
            raise ValueError("add: an id exists already")
        if op == "update" and known != n:
            raise ValueError("update: an id doesn't exist")
        if op == "delete":
            placed = batch.withColumn("internal_id", F.lit(-1).cast("bigint"))
        elif last == n - 1:  # already numbered from 0
            placed = batch.withColumn("internal_id", F.col("pos") + self.next_internal)
        else:
            placed = numbered(batch, ["pos"], "internal_id", self.next_internal).withColumn("pos", F.col("internal_id") - self.next_internal)
        placed = placed.select("seq", "pos", "op", "id", "internal_id", "embedding", "metadata", "document")
        if self.log is not None:
            self.log.append(self.sequence + 1, placed, fault, {"op": op, "rows": n, **(note or {})})
        self._tail.append(placed)
        self.deleted += known
        self.next_internal += 0 if op == "delete" else n
        self.sequence += 1
        self._index = None
        self._noted(note or {})
        if len(self._tail) >= FOLD_BATCHES:
            self._rebase(settle(self.records, "state"))
        return n

    def _noted(self, note: dict) -> None:
        if "source" in note:
            self.epochs[note["source"]] = max(note["epoch"], self.epochs.get(note["source"], -1))

    def add(self, ids, embeddings, metadatas=None, documents=None) -> int:
        return self.apply("add", self._batch("add", ids, embeddings, metadatas, documents))

    def upsert(self, ids, embeddings, metadatas=None, documents=None) -> int:
        return self.apply("upsert", self._batch("upsert", ids, embeddings, metadatas, documents))

    def update(self, ids, embeddings, metadatas=None, documents=None) -> int:
        return self.apply("update", self._batch("update", ids, embeddings, metadatas, documents))

    def delete(self, ids) -> int:
        return self.apply("delete", self._batch("delete", ids))

    def ingest(self, batches: Iterable[DataFrame], operation: str = "add") -> int:
        """Batches in turn, each by itself atomic; returns the rows."""
        if operation not in ("add", "upsert"):
            raise ValueError("operation must be add or upsert")
        return sum(self.apply(operation, self.frame_batch(operation, b)) for b in batches)

    def add_from(self, path: str, batch_size: int | None = None, **options) -> int:
        """Files as one batch, which is atomic; ``batch_size`` is checked only. ``metadata_columns`` become typed metadata; an
        empty or missing document counts as none."""
        from .sources.readers import read_vectors

        between("batch_size", 1 if batch_size is None else batch_size, 1, 2**31 - 1)
        return self.ingest([read_vectors(self.spark, path, dimension=self.dimension, packed=True, **options)], "add")

    def upsert_from(self, path: str, batch_size: int | None = None, **options) -> int:
        from .sources.readers import read_vectors

        between("batch_size", 1 if batch_size is None else batch_size, 1, 2**31 - 1)
        return self.ingest([read_vectors(self.spark, path, dimension=self.dimension, packed=True, **options)], "upsert")

    def add_numpy(self, ids, embeddings) -> int:
        from .sources.readers import from_arrays

        return self.ingest([from_arrays(self.spark, ids, embeddings)], "add")

    def upsert_numpy(self, ids, embeddings) -> int:
        from .sources.readers import from_arrays

        return self.ingest([from_arrays(self.spark, ids, embeddings)], "upsert")

    def add_mappings(self, rows: Iterable[dict], **options) -> int:
        """Rows of any iterable of dicts, batch by batch."""
        from .sources.readers import from_mappings

        return self.ingest(from_mappings(self.spark, rows, dimension=self.dimension, packed=True, **options), "add")

    def upsert_mappings(self, rows: Iterable[dict], **options) -> int:
        from .sources.readers import from_mappings

        return self.ingest(from_mappings(self.spark, rows, dimension=self.dimension, packed=True, **options), "upsert")

    def add_huggingface(self, dataset, split: str = "train", config: str | None = None, streaming: bool = True, load_kwargs: dict | None = None, **options) -> int:
        """A split of a dataset by name (through the installed ``datasets`` package), or one that is already open."""
        from .sources.readers import opened_dataset

        return self.add_mappings(opened_dataset(dataset, split, config, streaming, load_kwargs), **options)

    def upsert_huggingface(self, dataset, split: str = "train", config: str | None = None, streaming: bool = True, load_kwargs: dict | None = None, **options) -> int:
        from .sources.readers import opened_dataset

        return self.upsert_mappings(opened_dataset(dataset, split, config, streaming, load_kwargs), **options)

    add_with_metadata, upsert_with_metadata, update_with_metadata = add, upsert, update
    upsert_batch, upsert_batch_numpy = upsert, upsert_numpy

    def compact(self) -> dict:
        """Renumber the active rows densely and forget the dead; a report of before and after."""
        before = self.stats()
        if self.deleted:
            self._rebase(settle(mutations.compacted(self.records), "state"))
            self.next_internal, self.deleted = self._base.count(), 0
        return {"before": before, "after": self.stats()}

    def compact_if_needed(self, ratio: float = 0.25) -> dict | None:
        check_ratio(ratio)
        return self.compact() if self.deleted and self.deleted_ratio() >= ratio else None

    # inspection

    def count(self) -> int:
        return self.records.count()

    def count_deleted(self) -> int:
        return self.deleted

    def deleted_ratio(self) -> float:
        total = self.count() + self.deleted
        return self.deleted / total if total else 0.0

    def stats(self) -> dict:
        active = self.count()
        total = active + self.deleted
        return {
            "active": active, "deleted": self.deleted, "total": total, "deleted_ratio": self.deleted / total if total else 0.0, "dimension": self.dimension,
            "is_quantized": self.quantized, "M": self.links, "ef_construction": self.ef_construction, "ef_search": self.ef_search,
        }

    def set_ef_search(self, ef: int) -> None:
        self.ef_search = check_ef("ef_search", ef)

    def get_metadata(self, id_: int) -> dict:
        row = self.records.where(F.col("id") == id_).select("metadata").first()
        if row is None:
            raise KeyError(id_)
        return untagged(row.metadata)

    def get_document(self, id_: int) -> str:
        row = self.records.where(F.col("id") == id_).select("document").first()
        if row is None or row.document is None:
            raise KeyError(id_)
        return row.document

    # searches

    def _queries(self, embeddings) -> DataFrame:
        rows = _nested(embeddings, self.dimension)
        for v in rows:
            if not all(map(math.isfinite, v)):
                raise ValueError("vectors must be finite")
            if self.metric == "cosine" and not any(v):
                raise ValueError("the zero vector has no direction under cosine")
        return self.spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "query_id bigint, embedding array<float>")

    def _texts(self, texts: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")

    def _candidates(self, where) -> DataFrame:
        return self.records if where is None else self.records.where(W.on_map(where))

    def _text_index(self) -> bm25.TextIndex:
        if self._index is None:
            self._index = bm25.TextIndex(self.records, "internal_id", "document")
        return self._index

    def query(self, embeddings=None, texts=None, n_results: int = 10, where=None, pad: bool = False, recall: float = 1.0) -> DataFrame:
        """(query_id, rank, id, distance or score, metadata, document). Ties go to the record written first.

        ``recall`` below 1 lets a vector search probe inverted lists, which are built once for each state of the collection.
        """
        check_results(n_results)
        if embeddings is not None and texts is None and len(embeddings) and isinstance(embeddings[0], str):
            embeddings, texts = None, embeddings
        if (embeddings is None) == (texts is None):
            raise ValueError("pass either embeddings or texts")
        if texts is not None:
            queries = self._texts(texts)
            allowed = None if where is None else self._candidates(where).select(F.col("internal_id").alias("id"))
            found, value = self._text_index().search(queries, n_results, allowed), "score"
        else:
            queries = self._queries(embeddings)
            found, value = self._nearest(queries, n_results, where, recall), "distance"
        return self._finished(found, queries, value, n_results, pad)

    def _nearest(self, queries: DataFrame, n: int, where, recall: float = 1.0) -> DataFrame:
        if recall < 1:
            version = (self.sequence, self.next_internal, recall)
            if self._lists is None or self._lists[0] != version:
                self._lists = version, ivf.MeasuredLists(self.records, self.metric, recall, key="internal_id")
            allowed = None if where is None else self._candidates(where).select(F.col("internal_id").alias("id"))
            return self._lists[1].search(queries, n, allowed)
        if not self.quantized:
            return topk.nearest(self._candidates(where), queries, n, self.metric, key="internal_id")
        index = IndexFlatSQ8(self.dimension, self.metric, rerank=-(-min(2048, max(self.ef_search, 2 * n)) // n))
        index.rows = self.records.select(F.col("internal_id").alias("id"), "embedding")
        allowed = None if where is None else self._candidates(where).select(F.col("internal_id").alias("id"))
        found = index.search(queries, n, allowed)
        return found.withColumn("distance", F.lit(1.0) - F.col("distance")) if self.metric == "ip" else found

    def query_hybrid(self, embeddings, texts, n_results: int = 10, where=None, rrf_k: int = 60, candidate_multiplier: int = 4, pad: bool = False) -> DataFrame:
        vectors_, texts_ = self._queries(embeddings), self._texts(texts)
        if len(texts) != vectors_.count():
            raise ValueError("as many vectors as texts are needed")
        candidates = self._candidates(where).withColumn("id", F.col("internal_id"))
        allowed = None if where is None else W.on_map(where)
        found = bm25.hybrid(self.records.withColumn("id", F.col("internal_id")) if allowed is not None else candidates, self._text_index(), vectors_, texts_, n_results, self.metric, allowed, rrf_k, candidate_multiplier)
        return self._finished(found, vectors_, "score", n_results, pad)

    def _finished(self, found: DataFrame, queries: DataFrame, value: str, n: int, pad: bool) -> DataFrame:
        payload = self.records.select(F.col("internal_id").alias("at"), F.col("id").alias("user_id"), "metadata", "document")
        out = found.join(payload, F.col("id") == F.col("at")).select("query_id", "rank", F.col("user_id").alias("id"), value, "metadata", "document")
        return topk.padded(out, queries, n, value) if pad else out

    query_batch = query

    def query_numpy(self, embeddings, n_results: int = 10) -> tuple:
        """(ids, distances) as arrays of one row per query, padded with -1 and 0.0."""
        import numpy as np

        rows = self.query(embeddings=embeddings, n_results=n_results, pad=True).select("query_id", "rank", "id", "distance").toPandas().sort_values(["query_id", "rank"])
        shape = (-1, n_results)
        return rows["id"].to_numpy(np.int64).reshape(shape), rows["distance"].to_numpy(np.float64).reshape(shape)

    query_batch_numpy = query_numpy

    # durability

    def _settings(self) -> dict:
        return {
            "name": self.name, "dimension": self.dimension, "metric": self.metric, "quantized": self.quantized, "M": self.links, "ef_construction": self.ef_construction,
            "ef_search": self.ef_search, "identity": self.identity, "sequence": self.sequence, "next_internal": self.next_internal, "deleted": self.deleted, "epochs": self.epochs,
        }

    def save(self, path: str, fault=store._no_fault) -> dict:
        """Write a generation and read the state from it from now on."""
        manifest = store.write_generation(path, self.records, self._settings(), fault)
        index = self._index
        self._rebase(self.spark.read.parquet(str(Path(path) / manifest["generation"])))
        self._index = index
        return manifest

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        rows, m = store.read_generation(spark, path)
        c = cls(spark, m["name"], m["dimension"], m["metric"], m["quantized"], m["M"], m["ef_construction"], m["ef_search"])
        c._base, c.identity, c.sequence, c.next_internal, c.deleted, c.epochs = rows, m["identity"], m["sequence"], m["next_internal"], m["deleted"], m.get("epochs", {})
        return c

    def snapshot(self, path: str) -> Collection:
        """An independent reader of the present state."""
        store.write_generation(path, self.records, self._settings() | {"keep_generations": True})
        return Collection.load(self.spark, path)

    def enable_log(self, path: str, durability: int = store.SYNC) -> None:
        """Commit each batch to ``path`` before it counts; ``durability``: store.ASYNC or store.SYNC."""
        self.log = store.Log(path, self.identity, self.sequence, create=True, durability=durability)

    @property
    def log_enabled(self) -> bool:
        return self.log is not None

    @property
    def log_sequence(self) -> int:
        return self.sequence

    def flush_log(self) -> None:
        if self.log is not None:
            self.log.flush()

    def disable_log(self) -> None:
        self.log = None

    def checkpoint(self, path: str) -> None:
        self.save(path)
        if self.log is not None:
            self.log.rotate(self.sequence)

    @classmethod
    def recover(cls, spark: SparkSession, snapshot: str, log: str) -> Collection:
        """The snapshot and all committed batches after it; a batch without its marker never happened.

        The batches become the tail as they are; two counts settle how many rows are dead.
        """
        c = cls.load(spark, snapshot)
        wal = store.Log(log, c.identity)
        rows = wal.read(spark, c.sequence)
        if rows is not None:
            notes = {s: x for s, x in wal.notes().items() if s > c.sequence}
            got = {r.seq: r.n for r in rows.groupBy("seq").agg(F.count("*").alias("n")).collect()}
            lost = [s for s in notes if got.get(s, 0) == 0 or got[s] != notes[s].get("rows", got[s])]
            if lost:
                raise ValueError(f"the committed batch {min(lost)} is damaged")
            written = sum(n for s, n in got.items() if notes[s].get("op") != "delete")
            before = c.count()
            c._tail = [rows]
            c.deleted += before + written - c.count()
            c.next_internal, c.sequence = c.next_internal + written, max(notes)
            for s in sorted(notes):
                c._noted(notes[s])
            c._rebase(settle(c.records, "state"))
        c.log = wal
        return c


def _nested(embeddings, dimension: int) -> list[list[float]]:
    """Nested or flat numbers as rows of the dimension."""
    if hasattr(embeddings, "tolist"):
        embeddings = embeddings.tolist()
    rows = list(embeddings)
    if rows and not hasattr(rows[0], "__len__"):
        if len(rows) % dimension:
            raise ValueError("the numbers don't fill whole vectors")
        rows = [rows[i : i + dimension] for i in range(0, len(rows), dimension)]
    rows = [[float(x) for x in r] for r in rows]
    if any(len(r) != dimension for r in rows):
        raise ValueError(f"vectors must have {dimension} components")
    return rows
