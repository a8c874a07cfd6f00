import math

import numpy as np
import pytest

from lodevec.functions import quant
from lodevec.functions import text as T
from lodevec.operators import bm25, indexes, ivf, kmeans, topk
from lodevec.operators.components import connected_components


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "id bigint, embedding array<float>")


def asked(spark, vectors):
    return frame(spark, range(len(vectors)), vectors).withColumnRenamed("id", "query_id")


def listed(found, value="distance"):
    return [(r.id, round(r[value], 6)) for r in found.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize(("metric", "want"), [("l2", [0, 2, 4]), ("cosine", [0, 1, 2]), ("ip", [0, 1, 2])])
def test_metrics(spark, metric, want):
    r = frame(spark, [10, 20, 30], [(1, 0), (0, 1), (-1, 0)])
    assert listed(topk.nearest(r, asked(spark, [(1, 0)]), 3, metric)) == list(zip([10, 20, 30], want))


def test_ip_negative(spark):
    r = frame(spark, [10, 20, 30], [(1, 0), (0, 1), (2, 2)])
    assert listed(topk.nearest(r, asked(spark, [(1, 0)]), 3, "ip")) == [(30, -1), (10, 0), (20, 1)]


def test_ties_and_padding(spark):
    r = frame(spark, [5, 3, 4, -7], [(1, 1)] * 4).repartition(3)
    q = asked(spark, [(0, 0)])
    assert [i for i, _ in listed(topk.nearest(r, q, 3))] == [-7, 3, 4]
    got = listed(topk.padded(topk.nearest(r, q, 6), q, 6))
    assert got[4:] == [(-1, 0), (-1, 0)]
    assert topk.nearest(r.limit(0), q, 3).count() == 0
    assert topk.nearest(r, q.limit(0), 3).count() == 0


def test_bad_vectors(spark):
    r = frame(spark, [1], [(0, 0)])
    with pytest.raises(Exception, match="direction"):
        topk.nearest(r, asked(spark, [(1, 0)]), 1, "cosine").collect()
    with pytest.raises(ValueError):
        topk.nearest(r, asked(spark, [(math.nan, 0)]), 1)
    with pytest.raises(ValueError):
        topk.nearest(r, asked(spark, [(1, 0)]), 2049)
    with pytest.raises(ValueError):
        topk.nearest(r, asked(spark, [(1, 0)]), 1, "l3")


def test_analyzer(spark):
    text = "The SWIFT—ЛОВКИЙ, naïve_7 🚀 и don't o'clock's"
    df = spark.createDataFrame([(text,), (None,), ("'_' __x'",), ("",)], "t string")
    got = [r[0] for r in df.select(T.terms(df.t)).collect()]
    assert got == [["swift", "ловкий", "naïve_7", "o'clock's"], [], ["x"], []]
    for t in (text, "a '' _b_ ' c", None, "x　y"):
        one = spark.createDataFrame([(t,)], "t string")
        assert one.select(T.words(one.t)).first()[0] == T.python_words(t)


def docs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, document string")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id bigint, text string")


def test_bm25(spark):
    index = bm25.TextIndex(docs(spark, [(10, "Exact vector lookup lookup"), (20, "Vector table scan"), (30, "Garden notes"), (40, None), (50, "the")]))
    assert [i for i, _ in listed(index.search(texts(spark, "VECTOR, lookup!", "garden"), 2), "score")] == [10, 20, 30]
    tie = bm25.TextIndex(docs(spark, [(i, "shared") for i in (5, 4, 3, 2, 1)]))
    assert [i for i, _ in listed(tie.search(texts(spark, "shared"), 2), "score")] == [1, 2]
    russian = bm25.TextIndex(docs(spark, [(1, "«Точный» разбор — для Spark"), (2, "Ничего общего здесь")]))
    assert [i for i, _ in listed(russian.search(texts(spark, "РАЗБОР spark"), 2), "score")] == [1]
    assert russian.search(texts(spark, "the"), 2).count() == 0


def test_filter_keeps_statistics(spark):
    rows = [(1, "a1 b1"), (2, "a1"), (3, "c1 c1 c1")]
    index = bm25.TextIndex(docs(spark, rows))
    every = dict(listed(index.search(texts(spark, "a1"), 5), "score"))
    only = dict(listed(index.search(texts(spark, "a1"), 5, docs(spark, rows[:1]).select("id")), "score"))
    assert only == {1: every[1]}


def test_rrf(spark):
    lists = [spark.createDataFrame([(0, r + 1, i) for r, i in enumerate(ids)], "query_id bigint, rank bigint, id bigint") for ids in ([0, 1, 2], [1, 3, 0])]
    got = listed(bm25.fuse(lists, 5), "score")
    assert [i for i, _ in got] == [1, 0, 3, 2]
    assert got[0][1] == round(1 / 62 + 1 / 61, 6)
    with pytest.raises(ValueError):
        bm25.fuse(lists, 5, 0)


def test_hybrid(spark):
    r = spark.createDataFrame([(10, [0.0, 0.0], "public", "unrelated"), (20, [1.0, 0.0], "private", "target target target"), (30, [2.0, 0.0], "public", "target")], "id bigint, embedding array<float>, category string, document string")
    index = bm25.TextIndex(r)
    q, t = asked(spark, [(1, 0)]), texts(spark, "target")
    assert [i for i, _ in listed(bm25.hybrid(r, index, q, t, 3), "score")] == [20, 30, 10]
    assert [i for i, _ in listed(bm25.hybrid(r, index, q, t, 3, where=r.category == "public"), "score")] == [30, 10]


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    return rng.uniform(-1, 1, (2000, 16)).astype(np.float32), rng.uniform(-1, 1, (40, 16)).astype(np.float32)


def test_recall_floors(spark, clouds):
    x, q = clouds
    r, a = frame(spark, range(len(x)), x).cache(), asked(spark, q)
    exact = topk.nearest(r, a, 10).cache()
    brute = np.argsort(((q[:, None].astype(float) - x[None]) ** 2).sum(2), 1, kind="stable")[:, :10]
    assert [i for i, _ in listed(exact)] == brute.ravel().tolist()
    c = kmeans.fit(r, 16, 6)
    assert topk.recall(ivf.search_flat(r, a, c, 10, 6), exact).first()[0] >= 0.75
    index = ivf.IVFPQ(16, nlist=16, m=8, nprobe=8, ksub=64).train(r, rounds=6).add(r)
    assert topk.recall(index.query(a, 10), exact).first()[0] >= 0.5
    assert index.stats()["count"] == 2000
    with pytest.raises(ValueError):
        index.add(r)


def test_sq8(spark):
    r = frame(spark, [1, 2, 3], [(0, 1), (0.5, 0.25), (1, 0)])
    b = quant.sq8_bounds(r)
    assert tuple(b.first())[:2] == (0, 1)
    codes = r.crossJoin(b).select("id", quant.sq8_affine(r.embedding, b.lo, b.scale).alias("c")).orderBy("id").collect()
    assert [c.c for c in codes] == [[0, 255], [128, 64], [255, 0]]
    s = frame(spark, [1, 2], [(1, 0.25), (-4, 0)])
    assert quant.sq8_bounds(s).first().sym == 4 / 127
    same = frame(spark, [1], [(0, 0)])
    assert (quant.sq8_bounds(same).first().scale, quant.sq8_bounds(same).first().sym) == (1, 1)


def test_dimension_quantiser(spark):
    r = frame(spark, [1, 2, 3], [(0, -10, 50, 0), (50, 0, 100, 5), (100, 10, 150, 10)])
    b = quant.as_arrays(quant.dimension_bounds(r))
    assert tuple(map(list, b.first())) == ([0, -10, 50, 0], [100, 20, 100, 10])
    mid = r.crossJoin(b).where("id = 2").select(quant.sq_encode(r.embedding, b.vmins, b.vdiffs)).first()[0]
    assert all(abs(c - 128) <= 1 for c in mid)


def test_kmeans_repeats(clouds):
    x = clouds[0][:257].astype(float)
    assert np.allclose(kmeans.lloyd(x, 17, 5), kmeans.lloyd(x, 17, 5), atol=1e-6)
    assert np.isfinite(kmeans.lloyd(np.ones((100, 4)), 5, 5)).all()


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (7, 7), (None, 3), (20, 30), (30, 40), (40, 50), (50, 60), (60, 70)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, **{i: 20 for i in range(20, 80, 10)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_indexes(spark, clouds, tmp_path, metric):
    x, q = clouds
    r, a = frame(spark, range(600), x[:600]).cache(), asked(spark, q[:10])
    exact = topk.nearest(r, a, 10, metric).cache()
    made = [
        (indexes.IndexFlat(16, metric), 1), (indexes.IndexHNSW(16, metric, M=8), 1), (indexes.IndexFlatSQ8(16, metric), 0.95), (indexes.IndexFlatSQ8(16, metric, rerank=0), 0.85),
        (indexes.IndexScalarQuantizer(16, metric), 0.85), (indexes.IndexScalarQuantizer(16, metric, "fp16"), 0.95), (indexes.IndexIVFFlat(16, metric, 8, 6), 0.7),
    ]
    for n, (index, floor) in enumerate(made):
        if not index.is_trained:
            with pytest.raises(ValueError):
                index.add(r)
        index.train(r)
        index.add(r)
        got = index.search(a, 10)
        assert topk.recall(got, exact).first()[0] >= floor, index.kind
        index.save(str(tmp_path / str(n)))
        again = indexes.load(spark, str(tmp_path / str(n)))
        assert listed(again.search(a, 10)) == listed(got) and again.ntotal == 600
        assert {i for i, _ in listed(index.search(a, 10, r.where("id < 5").select("id")))} <= set(range(5))
    flat = listed(made[0][0].search(a, 10))
    want = [(i, round(1 - d, 6)) if metric == "ip" else (i, d) for i, d in listed(exact)]
    assert flat == want


def test_ivfpq_save(spark, clouds, tmp_path):
    r, a = frame(spark, range(300), clouds[0][:300]), asked(spark, clouds[1][:5])
    index = ivf.IVFPQ(16, nlist=4, m=4, ksub=16).add(r)
    index.save(str(tmp_path / "i"))
    again = ivf.IVFPQ.load(spark, str(tmp_path / "i"))
    assert listed(again.query(a, 5)) == listed(index.query(a, 5))
    assert again.stats() == index.stats()
    with pytest.raises(ValueError):
        ivf.IVFPQ.load(spark, str(tmp_path / "none"))


def test_assign_breaks_ties_as_by_differences():
    rng = np.random.default_rng(7)
    for x, c in ((rng.integers(0, 3, (400, 4)) / 2, rng.integers(0, 3, (9, 4)) / 2), (rng.normal(0, 1e3, (300, 8)), rng.normal(0, 1e3, (20, 8)))):
        want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        assert (kmeans.assign(x.astype(float), c.astype(float)) == want).all()


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_lists_in_slices_and_blocks(spark, clouds, monkeypatch, metric):
    """However lists and queries are cut, the lists that are probed give what comparing with all of their rows gives."""
    monkeypatch.setattr(ivf, "SLICE_ROWS", 40)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 7)
    monkeypatch.setattr(ivf, "PROBE_COMPONENTS", 0)  # the probes of later searches go to the rows
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    q = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    centroids = x[:5].astype(float)
    every = {(r.query_id, r.rank): r.id for r in topk.nearest(df, q, 6, metric).collect()}
    flat = {(r.query_id, r.rank): r.id for r in ivf.search_flat(df, q, centroids, 6, 5, metric).collect()}
    assert flat == every
    index = ivf.IVFPQ(8, metric, nlist=5, m=4, nprobe=2, ksub=32).train(df).add(df)
    got = {(r.query_id, r.rank): (r.id, round(r.distance, 9)) for r in index.query(q, 6).collect()}
    monkeypatch.setattr(ivf, "PROBE_COMPONENTS", 16_000_000)
    assert flat == {(r.query_id, r.rank): r.id for r in ivf.search_flat(df, q, centroids, 6, 5, metric).collect()}
    assert got == {(r.query_id, r.rank): (r.id, round(r.distance, 9)) for r in index.query(q, 6).collect()}
    codes = {r.id: (r.list_no, r.code) for r in index.codes.collect()}
    decoded = {i: index.centroids[n] + np.concatenate([b[k] for b, k in zip(index.books, code)]) for i, (n, code) in codes.items()}
    for (qid, rank), (i, dist) in got.items():
        a = x[qid].astype(float)
        a = (a / np.sqrt(a @ a)).astype(np.float32).astype(float) if metric == "cosine" else a
        want = ((decoded[i] - a) ** 2).sum() if metric == "l2" else 1 - decoded[i] @ a
        assert abs(want - dist) < 1e-6
    assert kmeans.fit(df, 3).shape == (3, 8)
    with pytest.raises(ValueError):
        ivf.IVFPQ(64, nlist=1_000_000)


def test_fvecs_of_several_files(spark, tmp_path):
    from lodevec.sources import readers

    x = np.random.default_rng(2).normal(0, 1, (300, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>").repartition(5)
    readers.write_fvecs(df, str(tmp_path / "all"))
    got = {r.id: r.embedding for r in readers.read_fvecs(spark, str(tmp_path / "all"), id_start=10).collect()}
    assert sorted(got) == list(range(10, 310)) and all(np.allclose(got[i + 10], x[i]) for i in range(300))
    assert readers.read_fvecs(spark, str(tmp_path / "all"), max_rows=120).count() == 120


def test_text_scores_in_tasks_as_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(400)], "id bigint, document string").repartition(3)
    queries = spark.createDataFrame([(k, " ".join(rng.choice(words + ["none"], 6))) for k in range(12)] + [(50, "none"), (51, None)], "query_id bigint, text string")
    index = bm25.TextIndex(docs)
    allowed = docs.where("id % 3 = 0").select("id")
    for ok in (None, allowed):
        want = [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in index.search(queries, 7, ok, most_terms=3).orderBy("query_id", "rank").collect()]
        for block in (30, 4_000_000):
            monkeypatch.setattr(bm25, "BLOCK_SCORES", block)
            assert want == [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in index.search(queries, 7, ok).orderBy("query_id", "rank").collect()]
    assert len(want) == 84


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_measured_lists(spark, metric):
    """Probes are as many as the recall needs, with clusters and without."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (40, 16))
    for x in (centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.4, (3000, 16)), rng.normal(0, 1, (3000, 16))):
        df = frame(spark, range(3000), x)
        q = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
        lists = ivf.MeasuredLists(df, metric, 0.97)
        exact = topk.nearest(df, q, 10, metric)
        assert topk.recall(lists.search(q, 10), exact).first()[0] >= 0.94
        if metric == "l2" and x is not None and np.abs(x).max() > 5:
            assert lists.nprobe < lists.nlist
    index = indexes.IndexHNSW(16, metric, recall=0.97)
    index.add(df)
    assert topk.recall(index.search(q, 10), exact).first()[0] >= 0.94
    few = df.where("id < 50").select("id")
    assert {r.id for r in lists.search(q, 5, few).collect()} <= set(range(50))
    assert ivf.MeasuredLists(df.limit(0), metric).search(q, 5).count() == 0
    with pytest.raises(ValueError):
        ivf.MeasuredLists(df, metric, 0.0)


def test_collection_with_a_recall(spark):
    from lodevec.collection import Collection

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (1500, 6)).astype(np.float32)
    c = Collection(spark, "r", 6)
    c.add_numpy(np.arange(1500, dtype=np.int64), x)
    exact = {(r.query_id, r.id) for r in c.query(x[:30].tolist(), n_results=5).collect()}
    assert len(exact & {(r.query_id, r.id) for r in c.query(x[:30].tolist(), n_results=5, recall=0.97).collect()}) >= 0.94 * len(exact)
    c.delete([0])
    assert 0 not in {r.id for r in c.query(x[:1].tolist(), n_results=5, recall=0.97).collect()}
