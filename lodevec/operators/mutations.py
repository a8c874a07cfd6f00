"""The mutation algebra: a log of writes and deletes folded into the current records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import numbered


def positions(log: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """Add ``internal_id``: the dense place of each write row by (seq, pos), -1 for deletes."""
    writes = numbered(log.where("op <> 'delete'"), [seq, pos], "internal_id")
    deletes = log.where("op = 'delete'").withColumn("internal_id", F.lit(-1).cast("bigint"))
    return writes.unionByName(deletes)


def fold(log: DataFrame, payloads: list[str], seq: str = "seq", pos: str = "pos", latest: tuple[str, ...] = ()) -> DataFrame:
    """(id, internal_id, *latest, *payloads): the records that are active after the log.

    Rows of one id in order (seq, pos): a delete ends a life, and within a life a payload that a write leaves out (NULL) is
    inherited from the last write that had it; ``latest`` columns are those of the last write. What marks a removal (an
    empty document, an empty map) is up to the caller.

    One aggregate with a partial step before the shuffle, so that an id with very many rows is no single task: the last
    row, the last delete, and each payload's last value with its place; a value from before the last delete is void, and
    if the last value is void so are all before it.
    """
    at = F.struct(F.col(seq), F.col(pos))
    is_delete = F.col("op") == "delete"
    parts = [F.max_by(F.struct("op", "internal_id", *latest), at).alias("last"), F.max(F.when(is_delete, at)).alias("gone")]
    for p in payloads:
        had = F.when(~is_delete & F.col(p).isNotNull(), at)
        parts += [F.max_by(p, had).alias(f"v_{p}"), F.max(had).alias(f"at_{p}")]
    now = log.groupBy("id").agg(*parts).where("last.op <> 'delete'")
    kept = [F.when(F.col("gone").isNull() | (F.col(f"at_{p}") > F.col("gone")), F.col(f"v_{p}")).alias(p) for p in payloads]
    return now.select("id", F.col("last.internal_id").alias("internal_id"), *[F.col(f"last.{c}").alias(c) for c in latest], *kept)


def compacted(active: DataFrame) -> DataFrame:
    """Active rows renumbered densely in the order of ``internal_id``."""
    return numbered(active.withColumnRenamed("internal_id", "__old"), ["__old"], "internal_id").drop("__old").select(*active.columns)


def deduplicated(log: DataFrame) -> DataFrame:
    """A log with rows delivered twice once: rows are equal when all their columns are."""
    return log.dropDuplicates()
