"""Queries that go through managed collections: typed metadata from files, mutations, and recovery from snapshot and log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions import where as W
from ..operators import topk
from ..util import shared_dir, table
from .reference import _E, _L2_RANK, K, _ranked_sql, _records, _shown


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("pmod(id, 20) = 0").select(F.col("id").alias("query_id"), "embedding")


def _imported(where: dict):
    """A file with one whole-number field, searched under a filter on the tagged map."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        c = Collection(spark, "imported", 64)
        c.add_from(f"{d}/embeddings.parquet", id_column="vec_id", metadata_columns=("label",))
        return _shown(topk.nearest(c.records, _asked(spark, d), K, "l2", W.on_map(where)))

    return run


def _mutated(spark: SparkSession, d: str, c: Collection) -> None:
    """Even ids with documents and metadata, then newer records whose document is taken away, then ids divisible by 7 go."""
    once = table(spark, d, "import_records").groupBy("id").agg(*[F.first(x).alias(x) for x in ("embedding", "document", "meta_category", "meta_year", "meta_published")])
    c.apply("add", c.frame_batch("add", once.where("id % 2 = 0")))
    newer = once.where("meta_year > 2015").select("id", "embedding", F.lit("").alias("document"))
    c.apply("upsert", c.frame_batch("upsert", newer))
    c.apply("delete", c.frame_batch("delete", once.where("id % 7 = 0").select("id", F.lit(None).cast("array<float>").alias("embedding"))))


def _state(c: Collection) -> DataFrame:
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    return c.records.select(
        "id", "document", m("meta_category")["s"].alias("category"), F.coalesce(m("meta_year")["i"], F.lit(-1)).alias("year"), F.coalesce(m("meta_published")["b"].cast("bigint"), F.lit(-1)).alias("published"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
    )


def collection_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    c = Collection(spark, "lifecycle", 32)
    _mutated(spark, d, c)
    return _state(c)


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    c = Collection(spark, "counts", 32)
    _mutated(spark, d, c)
    s = c.stats()
    return spark.createDataFrame([(s["active"], s["deleted"], s["total"])], "active bigint, deleted bigint, total bigint")


def collection_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The same mutations, from an empty snapshot and the log."""
    root = f"{shared_dir(spark).removeprefix('file://')}/lodevec-recovered-{uuid.uuid4().hex}"
    c = Collection(spark, "recovered", 32)
    c.save(f"{root}/snapshot")
    c.enable_log(f"{root}/log")
    _mutated(spark, d, c)
    return _state(Collection.recover(spark, f"{root}/snapshot", f"{root}/log"))


_LIFE = """
with o as (select id, any_value(embedding) as embedding, any_value(document) as document, any_value(meta_category) as meta_category, any_value(meta_year) as meta_year,
  any_value(meta_published) as meta_published from import_records group by id),
s as (select *, id % 2 = 0 as added, coalesce(meta_year > 2015, false) as newer from o),
a as (select * from s where (added or newer) and id % 7 <> 0)
"""
_LIFE_ROWS = _LIFE + """select id, case when not newer then nullif(document, '') end as document, case when added then meta_category end as category,
  case when added then coalesce(meta_year, -1) else -1 end as year, case when added then coalesce(meta_published::bigint, -1) else -1 end as published, round(embedding[1]::double, 6) as first from a"""

QUERIES = {
    "import_where_int": _imported({"label": {"$in": [1, 3, 5]}}),
    "import_where_kinds": _imported({"$or": [{"label": 3.0}, {"label": {"$gt": 6.5}}, {"label": "4"}]}),
    "import_where_not": _imported({"$not": {"label": {"$lte": 4}}}),
    "collection_lifecycle": collection_lifecycle, "collection_counts": collection_counts, "collection_recovered": collection_recovered,
}
SQL = {
    **{f"import_where_{n}": _E + f"w as (select * from e where {c}), " + _ranked_sql("w", _L2_RANK) for n, c in (("int", "label in (1, 3, 5)"), ("kinds", "label > 6.5"), ("not", "not label <= 4"))},
    "collection_lifecycle": _LIFE_ROWS,
    "collection_counts": _LIFE + ", w as (select count(*) filter (added) + count(*) filter (newer) as total from s) select count(*) as active, max(total) - count(*) as deleted, max(total)::bigint as total from a, w",
    "collection_recovered": _LIFE_ROWS,
}
