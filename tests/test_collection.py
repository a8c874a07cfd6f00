import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec.collection import Client, Collection, to_result_dict
from lodevec.operators import mutations
from lodevec.sources import readers as R
from lodevec.streaming.ingest import upsert_stream


def ids(found):
    return [r.id for r in found.orderBy("query_id", "rank").collect()]


def test_lifecycle(spark, tmp_path):
    c = Client(spark).create_collection("c", 2)
    c.add([1], [[0, 0]], [{"version": 1}], ["preserved"])
    c.upsert([1, 2], [[0, 1], [5, 5]], [{"version": 2}, {"version": 3}])
    assert (c.count(), c.count_deleted()) == (2, 1)
    assert (c.get_document(1), c.get_metadata(1)) == ("preserved", {"version": 2})
    with pytest.raises(ValueError):
        c.add([2], [[0, 0]])
    with pytest.raises(ValueError):
        c.update([9], [[0, 0]])
    with pytest.raises(ValueError):
        c.add([5, 5], [[0, 0], [1, 1]])
    with pytest.raises(ValueError):
        c.add([5], [[0, float("nan")]])
    c.upsert([1], [[0, 1]], documents=[""])
    with pytest.raises(KeyError):
        c.get_document(1)
    assert c.get_metadata(1) == {"version": 2}
    assert ids(c.query([[5, 5]], n_results=3, pad=True)) == [2, 1, -1]
    assert ids(c.query([[5, 5]], where={"version": 2}, n_results=3)) == [1]
    c.delete([2, 99])
    report = c.compact_if_needed(0.25)
    assert report["after"]["deleted"] == 0 and c.count() == 1
    assert c.compact_if_needed() is None
    c.delete([1])
    c.add([1], [[1, 1]])
    assert c.get_metadata(1) == {}


def test_durability(spark, tmp_path):
    snap, log = str(tmp_path / "snap"), str(tmp_path / "log")
    c = Collection(spark, "d", 2)
    c.add([1], [[1, 1]])
    c.save(snap)
    c.enable_log(log)
    c.add([10, 20], [[0, 0], [1, 0]], documents=["ten", "twenty"])
    c.upsert([10], [[9, 9]], [{"year": 2030}])
    c.delete([20])

    def torn(point):
        if point == "after-batch":
            raise OSError("power")

    with pytest.raises(OSError):
        c.apply("add", c._batch("add", [77], [[7, 7]]), torn)
    back = Collection.recover(spark, snap, log)
    assert sorted(r.id for r in back.records.collect()) == [1, 10]
    assert (back.get_document(10), back.get_metadata(10), back.sequence) == ("ten", {"year": 2030}, c.sequence)
    with pytest.raises(ValueError):
        Collection(spark, "other", 2).enable_log(log)
    before = c.snapshot(str(tmp_path / "point"))
    c.delete([1])
    assert before.count() == 2

    def crash(point):
        if point == "before-publish":
            raise OSError("power")

    with pytest.raises(OSError):
        c.save(snap, crash)
    assert Collection.load(spark, snap).count() == 1
    c.checkpoint(snap)
    assert Collection.recover(spark, snap, log).count() == c.count() == 1
    with pytest.raises(ValueError):
        Collection.load(spark, str(tmp_path / "nothing"))


def test_text_and_hybrid(spark):
    c = Collection(spark, "t", 2)
    c.add([10, 20, 30], [[0, 0], [1, 0], [2, 0]], [{"category": x} for x in ("public", "private", "public")], ["unrelated", "target target target", "target"])
    assert ids(c.query(["target"], n_results=2)) == [20, 30]
    assert ids(c.query_hybrid([[1, 0]], ["target"], 3)) == [20, 30, 10]
    assert ids(c.query_hybrid([[1, 0]], ["target"], 3, where={"category": "public"}, pad=True)) == [30, 10, -1]
    with pytest.raises(ValueError):
        c.query([[1, 0]], ["x"])


def test_fold_against_a_model(spark):
    rng = random.Random(5)
    log, state, n = [], {}, 0
    for seq in range(60):
        for pos in range(rng.randint(1, 3)):
            i, op = rng.randint(1, 9), rng.choice(["add", "upsert", "update", "delete"])
            doc = None if op == "delete" else rng.choice([None, "", "x", f"d{seq}"])
            log.append((seq, pos, op, i, doc))
            if op == "delete":
                state.pop(i, None)
            else:
                old = state.get(i, (None, None))[1]
                state[i] = (n, old if doc is None else doc)
                n += 1
    df = spark.createDataFrame(log, "seq bigint, pos int, op string, id bigint, document string")
    got = {r.id: (r.internal_id, r.document) for r in mutations.fold(mutations.positions(df), ["document"]).collect()}
    assert got == state
    assert [r.internal_id for r in mutations.compacted(mutations.fold(mutations.positions(df), ["document"])).orderBy("internal_id").collect()] == list(range(len(state)))
    assert mutations.fold(mutations.positions(df.limit(0)), ["document"]).count() == 0


def test_readers(spark, tmp_path):
    want = [(7, [1.0, 2.0], "a"), (8, [3.0, 4.0], "b")]
    how = {"id_column": "id", "document_column": "text", "metadata_columns": ("year",)}
    show = lambda df: [(r.id, list(r.embedding), r.document) for r in df.orderBy("id").collect()]
    (tmp_path / "a.csv").write_text('id,embedding,text,year\n7,"[1, 2]",a,1\n8,"3 4",b,2\n')
    (tmp_path / "a.jsonl").write_text('{"id":7,"embedding":[1,2],"text":"a","year":1}\n\n{"id":8,"embedding":[3,4],"text":"b","year":2}\n')
    (tmp_path / "a.json").write_text('{"data":[{"id":7,"embedding":[1,2],"text":"a","year":1},{"id":8,"embedding":[3,4],"text":"b","year":2}]}')
    t = pa.table({"id": [7, 8], "embedding": [[1.0, 2.0], [3.0, 4.0]], "text": ["a", "b"], "year": [1, 2]})
    import pyarrow.feather
    import pyarrow.parquet

    pa.parquet.write_table(t, tmp_path / "a.parquet")
    with pa.ipc.new_file(tmp_path / "a.arrow", t.schema) as f:
        f.write_table(t)
    with pa.ipc.new_stream(tmp_path / "b.ipc", t.schema) as f:
        f.write_table(t)
    for name in ("a.csv", "a.jsonl", "a.json", "a.parquet", "a.arrow", "b.ipc"):
        assert show(R.read_vectors(spark, str(tmp_path / name), **how)) == want, name
    (tmp_path / "c.tsv").write_text("x\ty\n1\t2\n3\t4\n")
    assert show(R.read_vectors(spark, str(tmp_path / "c.tsv"), embedding_columns=("x", "y"), id_start=5)) == [(5, [1.0, 2.0], None), (6, [3.0, 4.0], None)]
    (tmp_path / "n.csv").write_text("a,b\n1,2\n\n3,4\n")
    assert [(r.id, list(r.embedding)) for r in R.read_numbers(spark, str(tmp_path / "n.csv"), 2).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    x = np.array([[1, 2], [3, 4]], np.float32)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "a.npz", embeddings=x, ids=np.array([7, 8]), documents=np.array(["a", "b"]), year=np.array([1, 2]))
    assert show(R.read_vectors(spark, str(tmp_path / "a.npy"), id_start=7)) == [(i, v, None) for i, v, _ in want]
    assert show(R.read_vectors(spark, str(tmp_path / "a.npz"), metadata_columns=("year",))) == want
    R.write_fvecs(R.from_arrays(spark, np.array([0, 1]), x), str(tmp_path / "a.fvecs"))
    assert show(R.read_vectors(spark, str(tmp_path / "a.fvecs"))) == [(0, [1.0, 2.0], None), (1, [3.0, 4.0], None)]
    (tmp_path / "bad.fvecs").write_bytes(b"\x02\x00\x00\x00abcd")
    with pytest.raises(Exception, match="partial"):
        R.read_vectors(spark, str(tmp_path / "bad.fvecs"), dimension=2).collect()
    with pytest.raises(ValueError):
        R.read_vectors(spark, "x.doc")
    (tmp_path / "bad.csv").write_text('id,embedding\nx,"1,2"\n')
    with pytest.raises(Exception, match="64-bit"):
        R.read_vectors(spark, str(tmp_path / "bad.csv"), id_column="id", dimension=2).collect()
    parts = list(R.from_mappings(spark, ({"embedding": [float(i), 1.0]} for i in range(5)), batch_size=2))
    assert [r.id for p in parts for r in p.orderBy("id").collect()] == [0, 1, 2, 3, 4]
    c = Collection(spark, "r", 2)
    assert c.add_from(str(tmp_path / "a.parquet"), id_column="id", document_column="text") == 2
    assert c.get_document(8) == "b"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id bigint, embedding array<float>").write.parquet(str(tmp_path / "in"))
    c = Collection(spark, "s", 2)
    stream = spark.readStream.schema("id bigint, embedding array<float>").parquet(str(tmp_path / "in"))
    upsert_stream(stream, c, str(tmp_path / "ckpt")).awaitTermination(60)
    assert c.records.agg(F.sum("id")).first()[0] == 3


def test_arrays_and_quantised(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 4)).astype(np.float32)
    plain, small = Collection(spark, "p", 4), Collection(spark, "q", 4, quantized=True)
    for c in (plain, small):
        assert c.add_numpy(np.arange(200, dtype=np.int64), x) == 200
    want, got = plain.query_numpy(x[:3], 5), small.query_numpy(x[:3], 5)
    assert (want[0] == got[0]).all() and np.allclose(want[1], got[1])
    assert want[0][:, 0].tolist() == [0, 1, 2]
    nested = to_result_dict(plain.query(x[:2].tolist(), n_results=2), 2)
    assert [v[0] for v in nested["ids"]] == [0, 1] and nested["metadatas"][0] == [{}, {}]
