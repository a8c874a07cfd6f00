"""Scalar and product quantisation as column expressions and small NumPy kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sq8_bounds(records: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (lo, hi, scale, sym): global bounds of all components, the affine scale (hi - lo) / 255 and the symmetric
    scale max(|lo|, |hi|) / 127, 1 where the bounds coincide (are 0)."""
    b = records.agg(F.min(F.array_min(vector)).cast("double").alias("lo"), F.max(F.array_max(vector)).cast("double").alias("hi"))
    top = F.greatest(F.abs("lo"), F.abs("hi"))
    return b.select(
        "lo", "hi", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255.0).otherwise(1.0).alias("scale"),
        F.when(top > 0, top / 127.0).otherwise(1.0).alias("sym"),
    )


def sq8_affine(v: Column, lo: Column, scale: Column) -> Column:
    """Codes 0..255; halves round to even."""
    return F.transform(v, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((x.cast("double") - lo) / scale))).cast("int"))


def sq8_symmetric(v: Column, scale: Column) -> Column:
    """Codes -127..127; halves round to even."""
    return F.transform(v, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x.cast("double") / scale))).cast("int"))


def code_l2(a: Column, b: Column) -> Column:
    """Sum of squared code differences, a whole number."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def code_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def dimension_bounds(records: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, vmin, vdiff): bounds of each dimension, from 0."""
    return (
        records.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim")
        .agg(F.min("x").cast("double").alias("vmin"), (F.max("x").cast("double") - F.min("x").cast("double")).alias("vdiff"))
    )


def as_arrays(bounds: DataFrame) -> DataFrame:
    """One row (vmins, vdiffs) in the order of the dimensions."""
    s = F.array_sort(F.collect_list(F.struct("dim", "vmin", "vdiff")))
    return bounds.agg(s.alias("s")).select(F.col("s.vmin").alias("vmins"), F.col("s.vdiff").alias("vdiffs"))


def sq_encode(v: Column, vmins: Column, vdiffs: Column) -> Column:
    """Per-dimension 8-bit codes floor(x * 255 + 0.5) of the clamped relative value; 0 where a dimension is constant."""

    def one(x: Column, i: Column) -> Column:
        d = F.get(vdiffs, i)
        rel = F.when(d > 0, (x.cast("double") - F.get(vmins, i)) / d).otherwise(0.0)
        return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rel)) * 255.0 + 0.5).cast("int")

    return F.transform(v, one)


def sq_decode(codes: Column, vmins: Column, vdiffs: Column) -> Column:
    return F.transform(codes, lambda c, i: c / 255.0 * F.get(vdiffs, i) + F.get(vmins, i))


def fp16_round_trip(records: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, half): each component as the nearest 16-bit float, widened again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "half": [np.asarray(v, np.float16).astype(np.float32) for v in b.v]})

    return records.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(run, "id bigint, half array<float>")


def pq_train(sample: DataFrame, m: int, ksub: int = 256, rounds: int = 15, vector: str = "v") -> list[np.ndarray]:
    """Codebooks of m parts (ksub x d/m each), one task per part. ``sample``: id and v, of bounded size."""
    from ..operators.kmeans import lloyd

    first = sample.select(F.size(vector)).first()
    if first is None:
        raise ValueError("no rows to train on")
    d = first[0]
    if not 1 <= ksub <= 256 or d % m:
        raise ValueError("ksub must lie in 1..256 and the parts must divide the dimension")
    sub = d // m
    parts = sample.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("m"), F.slice(vector, i * sub + 1, sub).alias("x")))).alias("p"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf.x.to_list()).astype(np.float64)
        return pd.DataFrame({"m": pdf.m.iloc[0], "c": list(lloyd(x, ksub, rounds).astype(np.float32))})

    got = parts.select("id", "p.m", "p.x").groupBy("m").applyInPandas(fit, "m int, c array<float>").collect()
    books: dict[int, list] = {}
    for r in got:
        books.setdefault(r.m, []).append(r.c)
    return [np.array(books[i], np.float64) for i in range(m)]


def pq_encode_matrix(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Codes (n x m) of the nearest codeword of each part, the first of equals."""
    sub = books[0].shape[1]
    out = np.empty((len(x), len(books)), np.int16)
    for i, book in enumerate(books):
        part = x[:, i * sub : (i + 1) * sub]
        out[:, i] = ((part[:, None] - book[None]) ** 2).sum(2).argmin(1) if len(part) * len(book) < 4_000_000 else _argmin(part, book)
    return out


def _argmin(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.concatenate([((part[s : s + 1024, None] - book[None]) ** 2).sum(2).argmin(1) for s in range(0, len(part), 1024)])


def pq_decode_matrix(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([book[codes[:, i]] for i, book in enumerate(books)], 1)


def adc_table(q: np.ndarray, books: list[np.ndarray], metric: str) -> np.ndarray:
    """(m, ksub): what each codeword adds to the distance of q (squared L2, or the negative inner product)."""
    sub = books[0].shape[1]
    width = max(len(b) for b in books)
    out = np.zeros((len(books), width))
    for i, book in enumerate(books):
        part = q[i * sub : (i + 1) * sub]
        out[i, : len(book)] = ((book - part) ** 2).sum(1) if metric == "l2" else -(book @ part)
    return out
