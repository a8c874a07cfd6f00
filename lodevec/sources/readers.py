"""Vector files as DataFrames (id, embedding, document, then metadata columns): text, columnar and array formats."""

from __future__ import annotations

import io
import math
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import between, BOOLEAN, FLOAT, INTEGER, MAX_DIMENSION, METADATA, METADATA_VALUE, STRING
from ..util import numbered, numbered_lines

# Suffixes that name a format.
FORMATS = {
    "csv": "csv", "tsv": "tsv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet", "arrow": "arrow", "feather": "arrow",
    "ipc": "arrow", "npy": "npy", "npz": "npz", "fvecs": "fvecs", "ivecs": "ivecs",
}
SCALARS = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass(frozen=True)
class ImportOptions:
    """How the columns of a file map to a record."""

    file_format: str | None = None
    dimension: int | None = None
    id_column: str | None = None
    embedding_column: str = "embedding"
    embedding_columns: tuple[str, ...] | None = None
    document_column: str | None = None
    metadata_columns: tuple[str, ...] | None = None
    id_start: int = 0
    max_rows: int | None = None
    embeddings_key: str = "embeddings"
    ids_key: str = "ids"
    documents_key: str = "documents"


def infer_format(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {suffix}")
    return FORMATS[suffix]


def tagged_value(c: Column, kind: str) -> Column:
    """A scalar as a tagged metadata value."""
    slots = {STRING: ("s", "string"), INTEGER: ("i", "bigint"), FLOAT: ("f", "double"), BOOLEAN: ("b", "boolean")}
    number = {"string": STRING, "boolean": BOOLEAN, "float": FLOAT, "double": FLOAT}.get(kind, INTEGER)
    parts = [F.lit(number).cast("tinyint").alias("kind")]
    for slot, (name, to) in slots.items():
        parts.append((c.cast(to) if slot == number else F.lit(None).cast(to)).alias(name))
    return F.struct(*parts).cast(METADATA_VALUE)


def packed(types: dict[str, str]) -> Column:
    """Columns (name to Spark type) as one map of tagged values; a NULL is a missing field."""
    bad = [c for c, t in types.items() if t not in SCALARS]
    if bad:
        raise ValueError(f"metadata column {bad[0]} is not scalar")
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("key"), tagged_value(F.col(f"`{c}`"), t).alias("value"))) for c, t in types.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull())).cast(METADATA)


def read_vectors(spark: SparkSession, path: str, options: ImportOptions | None = None, packed: bool = False, **how) -> DataFrame:
    """Read ``path`` by its suffix or ``file_format``. A row that can't be coerced fails the read with a reason.

    The result is (id, embedding, document) and the metadata columns, or with ``packed`` a column ``metadata`` that holds
    them as tagged values, so that no name can clash; a document column's NULL is then an empty text.
    """
    o = options or ImportOptions(**how)
    form = o.file_format or infer_format(path)
    form = FORMATS.get(form)
    if form is None:
        raise ValueError(f"unsupported file format: {o.file_format}")
    if form in ("csv", "tsv"):
        raw = spark.read.option("header", True).option("sep", "," if form == "csv" else "\t").option("mode", "FAILFAST").option("escape", '"').csv(path)
    elif form == "jsonl":
        raw = _json_lines(spark, path)
    elif form == "json":
        raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        if "data" in raw.columns and dict(raw.dtypes)["data"].startswith("array<struct"):
            raw = raw.select(F.explode("data").alias("r")).select("r.*")
    elif form == "parquet":
        raw = spark.read.parquet(path)
    elif form == "arrow":
        raw = _arrow(spark, path)
    elif form == "npz":
        return _npz(spark, path, o, packed)
    else:
        reader = {"npy": read_npy, "fvecs": read_fvecs, "ivecs": read_ivecs}[form]
        out = reader(spark, path, o.id_start, o.max_rows or 100_000_000)
        out = out.withColumn("embedding", F.col("embedding").cast("array<float>"))
        return _sized(out, o.dimension).withColumn("document", F.lit(None).cast("string"))
    return mapped(raw, o, packed)


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, blank lines skipped; a line that isn't one fails the read with its file and number."""
    raw = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    if "__bad" not in raw.columns:
        return raw
    schema = "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in raw.schema) + ">"
    line = numbered_lines(spark, path).select("file", "line_no", F.from_json("value", schema, {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    first = line.where(F.col("r.__bad").isNotNull()).orderBy("file", "line_no").first()
    if first is None:
        return raw.drop("__bad")
    raise ValueError(f"{first.file}: line {first.line_no} is no JSON object")


def mapped(raw: DataFrame, o: ImportOptions, pack: bool = False) -> DataFrame:
    """Coerce the columns of any DataFrame to a record."""
    if o.max_rows is not None:
        raw = raw.limit(o.max_rows)
    types = dict(raw.dtypes)
    lost = [c for c in (o.id_column, o.document_column, *(o.metadata_columns or ()), *(o.embedding_columns or (o.embedding_column,))) if c and c not in types]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    for c in o.metadata_columns or ():
        if types[c] not in SCALARS:
            raise ValueError(f"metadata column {c} is not scalar")
    if o.id_column is None:
        raw = numbered(raw, [], "__id", o.id_start)
    number = record_id(F.col(o.id_column), types[o.id_column]) if o.id_column else F.col("__id")
    if o.embedding_columns:
        vector = F.array(*[_number(F.col(c), c) for c in o.embedding_columns])
    else:
        vector = embedding_of(F.col(o.embedding_column), types[o.embedding_column])
    document = F.nullif(F.col(o.document_column).cast("string"), F.lit("")) if o.document_column else F.lit(None).cast("string")
    meta = [F.col(c) for c in o.metadata_columns or ()]
    if pack:
        document = F.coalesce(document, F.lit("")) if o.document_column else document
        meta = [packed({c: types[c] for c in o.metadata_columns}).alias("metadata")] if meta else []
    return _sized(raw.select(number.alias("id"), vector.alias("embedding"), document.alias("document"), *meta), o.dimension)


def record_id(c: Column, kind: str) -> Column:
    """A whole number of 64 bits, or its digits; booleans, fractions and other texts fail."""
    if kind in ("boolean", "float", "double") or kind.startswith(("decimal", "array", "struct", "map")):
        raise ValueError("ids must be whole numbers")
    text = F.trim(c.cast("string"))
    good = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(good, F.raise_error(F.concat(F.lit("not a 64-bit id: "), F.coalesce(text, F.lit("NULL")))).cast("bigint"))


def _number(c: Column, name: str) -> Column:
    return F.coalesce(c.try_cast("float"), F.raise_error(F.lit(f"column {name} is not numeric")).cast("float"))


def embedding_of(c: Column, kind: str) -> Column:
    """An array, a JSON array in a string, or numbers separated by commas or blanks."""
    if kind.startswith("array"):
        return c.cast("array<float>")
    if kind != "string":
        raise ValueError("embeddings are arrays or texts")
    text = F.trim(c)
    parts = F.split(F.regexp_replace(text, r"^\[\s*|\s*\]$", ""), r"\s*,\s*|\s+")
    sound = (text.startswith("[") == text.endswith("]")) & ~F.exists(parts, lambda p: p.try_cast("float").isNull())
    return F.when(sound, F.transform(parts, lambda p: p.try_cast("float"))).otherwise(
        F.raise_error(F.concat(F.lit("not an embedding: "), F.coalesce(text, F.lit("NULL")))).cast("array<float>")
    )


def _sized(rows: DataFrame, dimension: int | None) -> DataFrame:
    """Fail on a row of another dimension; without a stated one the first row's holds."""
    if dimension is None:
        first = rows.select(F.size("embedding")).first()
        dimension = first[0] if first else 1
    if not 1 <= dimension <= MAX_DIMENSION:
        raise ValueError(f"dimension must lie in 1..{MAX_DIMENSION}")
    bad = F.raise_error(F.concat(F.lit(f"expected {dimension} components, found "), F.size("embedding").cast("string"))).cast("array<float>")
    return rows.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(bad))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _vecs(spark: SparkSession, path: str, id_start: int, dtype: str, kind: str, most: int) -> DataFrame:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [int(np.frombuffer(h.as_py(), "<i4")[0]) if len(h.as_py()) == 4 else 0 for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n // (4 * (d + 1)) if d > 0 else 0 for n, d in zip(b.column(1).to_pylist(), heads)], pa.int64())], names=["path", "n"])

    # files follow each other in the order of their names
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 4).alias("head"))
    offsets, at = {}, id_start
    for r in sorted(files.mapInArrow(sizes, "path string, n bigint").collect()):
        offsets[r.path] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not content:
                    continue
                first = offsets[name]
                d = int(np.frombuffer(content, "<i4", 1)[0])
                if not 1 <= d <= MAX_DIMENSION or len(content) % (4 * (d + 1)):
                    raise ValueError(f"{name}: bad dimension or partial record")
                m = np.frombuffer(content, "<i4").reshape(-1, d + 1)
                if (m[:, 0] != d).any():
                    raise ValueError(f"{name}: dimensions differ")
                x = m[: max(0, most + id_start - first), 1:].copy().view(dtype)
                for s in range(0, len(x), 8192):
                    part = x[s : s + 8192]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * d), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(part)) + first), lists], names=["id", "embedding"])

    return _binary(spark, path).mapInArrow(run, f"id bigint, embedding array<{kind}>")


def read_fvecs(spark: SparkSession, path: str, id_start: int = 0, max_rows: int = 100_000_000) -> DataFrame:
    """(id, embedding) of little-endian records [int32 d][float32 x d]; ids follow the order of the file."""
    return _vecs(spark, path, id_start, "<f4", "float", max_rows)


def read_ivecs(spark: SparkSession, path: str, id_start: int = 0, max_rows: int = 100_000_000) -> DataFrame:
    """As ``read_fvecs`` with int32 components."""
    return _vecs(spark, path, id_start, "<i4", "int", max_rows)


def read_npy(spark: SparkSession, path: str, id_start: int = 0, max_rows: int = 100_000_000) -> DataFrame:
    """A two-dimensional C-ordered float32 array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 2 or x.dtype != np.dtype("<f4") or not x.flags.c_contiguous:
                    raise ValueError(f"{name}: a two-dimensional C-ordered float32 array is needed")
                x = x[:max_rows]
                for s in range(0, len(x), 8192):
                    yield pa.RecordBatch.from_pydict({"id": pa.array(np.arange(s, min(s + 8192, len(x))) + id_start), "embedding": pa.array(list(x[s : s + 8192]), pa.list_(pa.float32()))})

    return _binary(spark, path).mapInArrow(run, "id bigint, embedding array<float>")


def _npz_kinds(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, str]:
    """Spark types of the named arrays of the first file; a task reads the headers, the driver sees only the types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1).to_pylist():
                z = np.load(io.BytesIO(content), allow_pickle=False)
                kinds = {"i": "bigint", "u": "bigint", "f": "double", "b": "boolean"}
                yield pa.RecordBatch.from_pydict({"name": [n for n in names if n in z], "kind": [kinds.get(z[n].dtype.kind, "string") for n in names if n in z]})

    got = {r.name: r.kind for r in _binary(spark, path).limit(1).mapInArrow(run, "name string, kind string").collect()}
    return {n: got.get(n, "string") for n in names}


def _npz(spark: SparkSession, path: str, o: ImportOptions, pack: bool = False) -> DataFrame:
    """Archives of named arrays. Metadata arrays keep their kind; it is that of the first file."""
    names = tuple(o.metadata_columns or ())
    kinds = _npz_kinds(spark, path, names)
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    # numbers keep metadata columns apart from the record's own
    schema = "id bigint, embedding array<float>, document string" + "".join(f", m{k} {kinds[n]}" for k, n in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                lost = [k for k in (o.embeddings_key, *names) if k not in z]
                if lost:
                    raise ValueError(f"{name}: missing arrays {', '.join(lost)}")
                x = np.asarray(z[o.embeddings_key], np.float32)
                if x.ndim == 1 and o.dimension:
                    x = x.reshape(-1, o.dimension)
                ids = z[o.ids_key] if o.ids_key in z else np.arange(len(x)) + o.id_start
                if not np.issubdtype(ids.dtype, np.integer):
                    raise ValueError(f"{name}: ids must be whole numbers")
                docs = [str(d) for d in z[o.documents_key]] if o.documents_key in z else [None] * len(x)
                docs = docs if pack else [d or None for d in docs]
                meta = [pa.array(z[k].tolist(), arrow[kinds[k]]) for k in names]
                if any(len(c) != len(x) for c in (ids, docs, *meta)):
                    raise ValueError(f"{name}: arrays differ in length")
                most = o.max_rows or len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int64)), pa.array(list(x), pa.list_(pa.float32())), pa.array(docs, pa.string()), *meta],
                    names=["id", "embedding", "document", *[f"m{k}" for k in range(len(names))]],
                ).slice(0, most)

    rows = _sized(_binary(spark, path).mapInArrow(run, schema), o.dimension)
    if not pack:
        return rows.toDF("id", "embedding", "document", *names)
    if not names:
        return rows
    pairs = [F.struct(F.lit(n).alias("key"), tagged_value(F.col(f"m{k}"), kinds[n]).alias("value")) for k, n in enumerate(names)]
    return rows.select("id", "embedding", "document", F.map_from_entries(F.array(*pairs)).cast(METADATA).alias("metadata"))


def _arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams; the schema is that of the first file."""

    def opened(content: bytes):
        try:
            return pa.ipc.open_file(pa.BufferReader(content)).read_all()
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.BufferReader(content)).read_all()

    first = _binary(spark, path).select("content").first()
    if first is None:
        raise ValueError(f"no file at {path}")
    schema = spark.createDataFrame(opened(bytes(first.content)).slice(0, 0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1).to_pylist():
                yield from opened(content).to_batches(max_chunksize=8192)

    return _binary(spark, path).mapInArrow(run, schema)


#: Largest text file of numbers that is accepted.
MAX_FILE_BYTES = 1 << 40


def read_numbers(
    spark: SparkSession, path: str, dimension: int, sep: str = ",", has_header: bool = True, id_start: int = 0, max_rows: int = 100_000_000,
) -> DataFrame:
    """(id, embedding) of a purely numeric text file: no quoting, blank lines skipped, a wrong field count fails, and so do
    more than ``max_rows`` rows or a file above MAX_FILE_BYTES."""
    between("max_rows", max_rows, 1, 100_000_000)
    if spark.read.format("binaryFile").load(path).where(F.col("length") > MAX_FILE_BYTES).select("path").limit(1).count():
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    lines = numbered(spark.read.text(path), [], "n")
    lines = lines.where(F.trim("value") != "") if not has_header else lines.where((F.trim("value") != "") & (F.col("n") > 0))
    parts = F.split(F.regexp_replace("value", "\r$", ""), F.lit("\t" if sep == "\t" else sep))
    values = F.transform(parts, lambda p: F.coalesce(F.trim(p).try_cast("float"), F.raise_error(F.lit("not a number")).cast("float")))
    rows = numbered(lines.select(values.alias("embedding"), "n"), ["n"], "id", id_start).select("id", "embedding")
    over = F.raise_error(F.lit(f"more than {max_rows} rows")).cast("bigint")
    return _sized(rows.withColumn("id", F.when(F.col("id") < id_start + max_rows, F.col("id")).otherwise(over)), dimension)


def from_mappings(spark: SparkSession, rows: Iterable[dict], options: ImportOptions | None = None, batch_size: int = 8192, packed: bool = False, **how) -> Iterator[DataFrame]:
    """Any iterable of dicts, a streamed dataset split for one, as record DataFrames of up to ``batch_size`` rows."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    o = options or ImportOptions(**how)
    it, start = iter(rows if o.max_rows is None else islice(rows, o.max_rows)), o.id_start
    while part := list(islice(it, batch_size)):
        keys = dict.fromkeys(k for r in part for k in r)  # a key may be missing in the first rows
        raw = spark.createDataFrame(_table(part, list(keys)))
        yield mapped(raw, ImportOptions(**{**o.__dict__, "id_start": start, "max_rows": None}), packed)
        start += len(part)


def _table(part: list[dict], keys: list[str]) -> pa.Table:
    columns = {}
    for k in keys:
        got = pa.array([r.get(k) for r in part])
        columns[k] = got.cast(pa.string()) if pa.types.is_null(got.type) else got
    return pa.table(columns)


def opened_dataset(dataset, split: str = "train", config: str | None = None, streaming: bool = True, load_kwargs: dict | None = None) -> Iterable[dict]:
    """The rows of a dataset's split: by name through the installed ``datasets`` package, or of an iterable or a mapping of
    splits that is already open."""
    if isinstance(dataset, str):
        try:
            from datasets import load_dataset
        except ImportError as e:
            raise ImportError("the package datasets is needed to open a dataset by name") from e
        return load_dataset(dataset, config, split=split, streaming=streaming, **(load_kwargs or {}))
    if isinstance(dataset, dict):
        if split not in dataset:
            raise ValueError(f"no split {split}")
        return dataset[split]
    return dataset


class DatasetReader:
    """A one-shot reader of one source; its rows go to a collection once."""

    def __init__(self, how: str, source, options: dict):
        self.how, self.source, self.options, self.used = how, source, options, False

    def _go(self, collection, operation: str) -> int:
        if self.used:
            raise ValueError("the reader is used up")
        dimension = self.options.get("dimension")
        if dimension is not None and dimension != collection.dimension:
            raise ValueError(f"the reader has {dimension} components, the collection {collection.dimension}")
        self.used = True
        options = {k: v for k, v in self.options.items() if k != "dimension"}
        if self.how == "huggingface":
            return getattr(collection, f"{operation}_huggingface")(self.source, **options)
        return getattr(collection, f"{operation}_from")(self.source, file_format=self.how, **options)

    def add_to(self, collection) -> int:
        return self._go(collection, "add")

    def upsert_to(self, collection) -> int:
        return self._go(collection, "upsert")


def _reader(how: str):
    def make(source, **options) -> DatasetReader:
        return DatasetReader(how, source, options)

    make.__name__, make.__doc__ = f"read_{how}", f"A one-shot reader of {how} with the options of ``ImportOptions``."
    return make


read_json, read_jsonl, read_parquet, read_arrow, read_npz, read_huggingface = map(_reader, ("json", "jsonl", "parquet", "arrow", "npz", "huggingface"))


def from_arrays(spark: SparkSession, ids: np.ndarray, embeddings: np.ndarray) -> DataFrame:
    """int64 ids and a float32 matrix, without a copy per value."""
    if ids.dtype != np.int64 or embeddings.dtype != np.float32 or embeddings.ndim != 2 or len(ids) != len(embeddings):
        raise ValueError("int64 ids and a float32 matrix of as many rows are needed")
    if not all(map(math.isfinite, (embeddings.sum(),))) and not np.isfinite(embeddings).all():
        raise ValueError("vectors must be finite")
    flat = pa.array(np.ascontiguousarray(embeddings).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * embeddings.shape[1]), flat)
    return spark.createDataFrame(pa.table({"id": pa.array(ids), "embedding": lists}))


def write_fvecs(rows: DataFrame, path: str, vector: str = "embedding", key: str = "id") -> None:
    """A folder of fvecs files, one for each partition, that hold all rows in the order of ``key``. Tasks write the files, so
    that the folder must be one that all executors share."""
    root = Path(path)
    root.mkdir(parents=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        draft, n = root / f".{part}-{uuid.uuid4().hex}", 0
        with open(draft, "wb") as f:
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1)
                    width = np.full((len(x), 1), x.shape[1], "<i4").view("<f4")
                    f.write(np.concatenate([width, x], 1).tobytes())
                    n += len(x)
        os.replace(draft, root / f"part-{part:08d}.fvecs")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.select(key, vector).repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
