"""Connected components of an edge table, without collecting edges or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import drop_settled, settle


def _state(edges: DataFrame) -> tuple:
    # read from the written table, so this is one short scan
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternating large-star and small-star rounds; each round is a hash aggregate and a join on the node, so a node with
    very many edges is split by AQE's skew join, and each round's edges are written to the shared folder. NULL ends and
    loops are ignored; an empty edge table gives an empty result.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = settle(one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    if not state[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        least = least.select("n", F.least("n", "m").alias("m"))
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        small_least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(small_least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(small_least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b")
        after = settle(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        new = _state(after)
        drop_settled(now)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.union(heads)
