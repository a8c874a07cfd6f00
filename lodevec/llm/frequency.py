"""Frequency of every distinct term: a global integer dictionary and count arrays over blocks of records."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..util import settle, shuffle_parts

#: A block's dictionary is emitted and begun anew once it holds so many terms, which bounds a task's memory.
BLOCK_TERMS = 500_000


def one_per_key(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each ``key`` once; repeats of a key are taken to have the same ``columns``. Combines before the shuffle."""
    return records.groupBy(key).agg(*[F.first(c).alias(c) for c in columns])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary-encode the words of a block and accumulate two count arrays by local identifier."""
    local: dict[str, int] = {}
    occ, rec = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    nonempty = 0

    def flush():
        n = len(local)
        return pa.RecordBatch.from_pydict(
            {"term": pa.array([*local, None], pa.string()), "occ": pa.array([*occ[:n], 0], pa.int64()), "rec": pa.array([*rec[:n], nonempty], pa.int64())}
        )

    for b in batches:
        words = [T.python_words(t) for t in b.column(0).to_pylist()]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = pa.array(chain.from_iterable(words), pa.string(), size=int(lengths.sum())).dictionary_encode()
        names = flat.dictionary.to_pylist()
        for name in names:
            local.setdefault(name, len(local))
        while len(occ) <= len(local):
            occ, rec = np.concatenate([occ, np.zeros_like(occ)]), np.concatenate([rec, np.zeros_like(rec)])
        to = np.array([local[x] for x in names], np.int64)
        codes = flat.indices.to_numpy()
        rows = np.repeat(np.arange(len(lengths)), lengths)
        occ[to] += np.bincount(codes, minlength=len(names))
        pairs = np.unique(rows * np.int64(max(len(names), 1)) + codes)
        rec[to] += np.bincount(pairs % max(len(names), 1), minlength=len(names))
        nonempty += np.count_nonzero(lengths)
        if len(local) > BLOCK_TERMS:
            yield flush()
            local.clear()
            occ[:], rec[:], nonempty = 0, 0, 0
    if local or nonempty:
        yield flush()


def _by_range(span: int):
    """Encoded counts (term_id, occ, rec) to arrays by identifier range: (range, ids, occ, rec), each id once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            sums = [np.zeros(len(ids), np.int64) for _ in range(2)]
            for s, c in zip(sums, (1, 2)):
                np.add.at(s, at, b.column(c).to_numpy())
            ranges, start = np.unique(ids // span, return_index=True)
            offsets = pa.array(np.r_[start, len(ids)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ranges), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, *sums)]], names=["range", "ids", "occ", "rec"])

    return run


def _add(span: int):
    """The terms of a range and the arrays of all blocks for it to one row a term."""

    def run(key, terms, arrays):
        start = key[0].as_py() * span
        occ, rec = np.zeros(span, np.int64), np.zeros(span, np.int64)
        at = arrays.column("ids").combine_chunks().flatten().to_numpy() - start
        np.add.at(occ, at, arrays.column("occ").combine_chunks().flatten().to_numpy())
        np.add.at(rec, at, arrays.column("rec").combine_chunks().flatten().to_numpy())
        ids = terms.column("term_id").to_numpy()
        return pa.table({"term_id": ids, "term": terms.column("term"), "occurrences": occ[ids - start], "records": rec[ids - start]})

    return run


def term_frequencies(texts: DataFrame, column: str, most_span: int = 1_000_000) -> DataFrame:
    """(term_id, term, occurrences, records, total): every word of ``column`` with its counts over all rows.

    ``total`` is the number of rows with at least one word. ``term_id`` numbers the sorted terms densely from 0: the terms
    are range partitioned and sorted, and each partition starts at the sum of the sizes of those before it (one count per
    partition is all the driver sees). Blocks count into arrays by local identifier, are encoded against the dictionary, and
    send arrays of identifiers and counts by identifier range; a task adds all arrays of a range, which spans ``most_span``
    identifiers at most. A term that stands in every row costs one number per block.

    NULL, empty and wordless texts give no term; repeated rows count each; an empty table gives an empty result.
    """
    spark = texts.sparkSession
    blocks = settle(texts.select(F.col(column)).mapInArrow(_blocks, "term string, occ bigint, rec bigint"), "blocks")
    total = blocks.where(F.col("term").isNull()).agg(F.coalesce(F.sum("rec"), F.lit(0)).cast("bigint").alias("total"))
    blocks = blocks.where(F.col("term").isNotNull())
    dictionary = settle(
        blocks.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")
        .select("term", F.monotonically_increasing_id().alias("m")), "terms",
    )
    part = F.shiftright("m", 33)
    sizes = sorted((r[0], r[1]) for r in dictionary.groupBy(part).count().collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    starts = spark.createDataFrame(starts, "p bigint, start bigint")
    ids = dictionary.join(F.broadcast(starts), part == F.col("p")).select(
        "term", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("term_id")
    )
    span = max(1, min(most_span, -(-at // shuffle_parts(spark))))
    arrays = blocks.join(ids, "term").select("term_id", "occ", "rec").mapInArrow(_by_range(span), "range bigint, ids array<bigint>, occ array<bigint>, rec array<bigint>")
    terms = ids.withColumn("range", F.floor(F.col("term_id") / span))
    summed = terms.groupBy("range").cogroup(arrays.groupBy("range")).applyInArrow(_add(span), "term_id bigint, term string, occurrences bigint, records bigint")
    return summed.crossJoin(F.broadcast(total))


def with_verdict(freq: DataFrame, rare_records: int = 2, common_share: float = 0.4) -> DataFrame:
    """Add ``verdict``: rare (in at most ``rare_records`` rows), common (in more than ``common_share`` of the rows that have
    a word), else NULL. The share is compared in integers per million, so that no rounding decides."""
    millionths = round(common_share * 1_000_000)
    common = F.col("records").cast("decimal(38,0)") * 1_000_000 > F.col("total").cast("decimal(38,0)") * millionths
    return freq.withColumn("verdict", F.when(F.col("records") <= rare_records, "rare").when(common, "common"))
