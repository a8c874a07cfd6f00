import pytest

from lodevec.collection import tagged
from lodevec.functions import where as W
from lodevec.types import METADATA

ROWS = [
    (10, {"category": "docs", "year": 2022, "score": 0.5, "published": True}),
    (20, {"category": "docs", "year": 2024, "score": 0.8, "published": False}),
    (30, {"category": "code", "year": 2025, "score": 0.95, "published": True}),
    (40, {"category": "code", "year": 2026, "score": 1.0, "published": False}),
    (50, {"owner": "x"}),
]
CASES = [
    ({"category": "docs"}, {10, 20}),
    ({"category": {"$ne": "docs"}}, {30, 40}),
    ({"year": {"$gt": 2024}}, {30, 40}),
    ({"score": {"$gte": 0.8}}, {20, 30, 40}),
    ({"score": {"$lte": 0.95}}, {10, 20, 30}),
    ({"year": {"$in": [2022, 2026]}}, {10, 40}),
    ({"year": {"$gt": 2024.5}}, {30, 40}),
    ({"$not": {"category": "docs"}}, {30, 40, 50}),
    ({"year": 2024.0}, set()),
    ({"year": {"$ne": 2024.0}}, {10, 20, 30, 40}),
    ({"published": True}, {10, 30}),
    ({"year": {"$nin": [2022, 2024]}}, {30, 40}),
    ({"$and": [{"category": "docs"}, {"year": {"$lt": 2024}}]}, {10}),
    ({"$or": [{"owner": "x"}, {"score": {"$lt": 0.6}}]}, {10, 50}),
    ({"category": "docs", "published": False}, {20}),
    ({"category": {"$gt": 3}}, set()),
    ({"nothing": {"$ne": 1}}, set()),
]


@pytest.mark.parametrize(("tree", "want"), CASES)
def test_map_and_columns(spark, tree, want):
    data = spark.createDataFrame([(i, tagged(m)) for i, m in ROWS], f"id bigint, metadata {METADATA}")
    assert {r.id for r in data.where(W.on_map(tree)).collect()} == want
    keys = ["category", "year", "score", "published", "owner"]
    wide = spark.createDataFrame([(i, *[m.get(k) for k in keys]) for i, m in ROWS], "id bigint, category string, year bigint, score double, published boolean, owner string")
    assert {r.id for r in wide.where(W.on_columns(tree, dict(wide.dtypes))).collect()} == want


@pytest.mark.parametrize(
    ("tree", "error"),
    [
        ({}, ValueError), ({"a": {}}, ValueError), ({"a": {"$in": []}}, ValueError), ({"a": {"$in": [1, "x"]}}, TypeError), ({"a": {"$foo": 1}}, ValueError),
        ({"$foo": 1}, ValueError), ({"a": {"$gt": "x"}}, TypeError), ({"a": {"$gt": True}}, TypeError), ({"$and": []}, ValueError), ({"a": {"$in": 3}}, TypeError),
        ({"a": None}, TypeError), ({"$and": {"a": 1}}, TypeError),
    ],
)
def test_malformed(tree, error):
    with pytest.raises(error):
        W.parse(tree)


def test_nan(spark):
    data = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id bigint, x double")
    ids = lambda t: {r.id for r in data.where(W.on_columns(t, dict(data.dtypes))).collect()}
    assert ids({"x": float("nan")}) == set()
    assert ids({"x": {"$ne": 1.0}}) == {1}
    assert ids({"x": {"$gt": 0}}) == {2}


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as year").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = t.where(W.on_columns({"year": {"$in": [1, 2]}}, dict(t.dtypes)))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan
