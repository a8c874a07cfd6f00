"""Metadata on every way into a collection, durable state, and what is checked on the way."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec import store
from lodevec.collection import Collection
from lodevec.sources import readers as R
from lodevec.streaming.ingest import upsert_stream

ROWS = [
    {"id": 7, "embedding": [1.0, 2.0], "text": "a", "year": 2024, "lang": "en", "score": 2024.0, "fine": True},
    {"id": 8, "embedding": [3.0, 4.0], "text": "", "year": None, "lang": "de", "score": 0.5, "fine": False},
]
HOW = {"id_column": "id", "document_column": "text", "metadata_columns": ("year", "lang", "score", "fine")}


def files(folder):
    import pyarrow.parquet

    folder.mkdir(exist_ok=True)
    t = pa.Table.from_pylist(ROWS)
    pa.parquet.write_table(t, folder / "a.parquet")
    with pa.ipc.new_file(folder / "a.arrow", t.schema) as f:
        f.write_table(t)
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    (folder / "a.json").write_text(json.dumps({"data": ROWS}))
    return [folder / n for n in ("a.parquet", "a.arrow", "a.jsonl", "a.json")]


def found(c, where):
    return sorted(r.id for r in c.query([[1.0, 2.0]], n_results=5, where=where).collect())


def test_kinds_survive_files(spark, tmp_path):
    for path in files(tmp_path / "in"):
        c = Collection(spark, "m", 2)
        assert c.add_from(str(path), **HOW) == 2
        assert c.get_metadata(7) == {"year": 2024, "lang": "en", "score": 2024.0, "fine": True}, path
        assert c.get_metadata(8) == {"lang": "de", "score": 0.5, "fine": False}
        assert found(c, {"year": 2024}) == [7] and found(c, {"year": 2024.0}) == [] and found(c, {"score": 2024.0}) == [7]
        assert found(c, {"year": {"$gte": 2023.5}}) == [7] and found(c, {"fine": False}) == [8]
    m = c.get_metadata(7)
    assert (m.get_int("year"), m.get_string("lang"), m.get_float("score"), m.get_bool("fine"), m.contains("x"), m.count()) == (2024, "en", 2024.0, True, False, 4)
    with pytest.raises(TypeError):
        m.get_int("score")
    with pytest.raises(KeyError):
        m.get_int("none")


def test_text_and_archives(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,embedding,text,year\n7,"[1, 2]",a,2024\n8,"3 4",b,\n')
    c = Collection(spark, "m", 2)
    c.add_from(str(tmp_path / "a.csv"), id_column="id", document_column="text", metadata_columns=("year",))
    assert found(c, {"year": "2024"}) == [7] and found(c, {"year": 2024}) == []
    x = np.array([[1, 2], [3, 4]], np.float32)
    np.savez(tmp_path / "a.npz", embeddings=x, ids=np.array([7, 8]), documents=np.array(["a", "b"]), year=np.array([2024, 2025]), lang=np.array(["en", "de"]), embedding=np.array([0.5, 1.5]))
    c = Collection(spark, "n", 2)
    c.add_from(str(tmp_path / "a.npz"), metadata_columns=("year", "lang", "embedding"))
    assert c.get_metadata(7) == {"year": 2024, "lang": "en", "embedding": 0.5} and found(c, {"year": {"$gt": 2024}}) == [8]
    np.savez(tmp_path / "flat.npz", embeddings=x.ravel())
    assert Collection(spark, "f", 2).add_from(str(tmp_path / "flat.npz")) == 2


def test_mappings_and_readers(spark, tmp_path):
    c = Collection(spark, "m", 2)
    assert c.add_huggingface({"train": ROWS, "test": ROWS[:1]}, split="test", batch_size=1, **HOW) == 1
    assert c.upsert_huggingface({"train": ROWS}, batch_size=1, **HOW) == 2 and found(c, {"lang": {"$ne": "en"}}) == [8]
    with pytest.raises(ValueError):
        c.add_huggingface({"train": ROWS}, split="none", **HOW)
    with pytest.raises(ImportError):
        c.add_huggingface("some/name", **HOW)
    path = files(tmp_path / "in")[2]
    reader = R.read_jsonl(str(path), dimension=2, **HOW)
    d = Collection(spark, "d", 2)
    assert reader.add_to(d) == 2 and d.get_metadata(8)["lang"] == "de"
    with pytest.raises(ValueError):
        reader.upsert_to(d)
    with pytest.raises(ValueError):
        R.read_jsonl(str(path), dimension=3, **HOW).add_to(d)
    assert R.read_huggingface(ROWS, **HOW).upsert_to(d) == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "embedding": [1, 2]}\n\n{"id": 2, "embedding\n')
    with pytest.raises(ValueError, match="line 3"):
        R.read_vectors(spark, str(tmp_path / "bad.jsonl"), id_column="id")
    (tmp_path / "n.csv").write_text("a,b\n1,2\n3,4\n")
    with pytest.raises(Exception, match="more than 1"):
        R.read_numbers(spark, str(tmp_path / "n.csv"), 2, max_rows=1).collect()


def test_upsert_from_inherits(spark, tmp_path):
    c = Collection(spark, "u", 2)
    c.add([7], [[0, 0]], [{"kept": 1}], ["old"])
    (tmp_path / "v.jsonl").write_text('{"id": 7, "embedding": [1, 2]}\n')
    c.upsert_from(str(tmp_path / "v.jsonl"), id_column="id")
    assert c.get_metadata(7) == {"kept": 1} and c.get_document(7) == "old"
    (tmp_path / "w.jsonl").write_text('{"id": 7, "embedding": [1, 2], "text": null, "year": 5}\n')
    c.upsert_from(str(tmp_path / "w.jsonl"), id_column="id", document_column="text", metadata_columns=("year",))
    assert c.get_metadata(7) == {"year": 5}
    with pytest.raises(KeyError):
        c.get_document(7)


def test_zero_vectors_are_refused(spark):
    c = Collection(spark, "z", 2, "cosine")
    with pytest.raises(ValueError, match="direction"):
        c.add_numpy(np.array([1, 2]), np.array([[0, 0], [1, 0]], np.float32))
    assert c.count() == 0 and c.sequence == 0


def test_many_batches(spark, monkeypatch):
    """The tail and its folding against a plain model."""
    import random

    from lodevec import collection

    monkeypatch.setattr(collection, "FOLD_BATCHES", 4)
    rng, c, state = random.Random(3), Collection(spark, "b", 1), {}
    writes = 0
    for n in range(11):
        ids = rng.sample(range(6), 2)
        if n % 3 == 2:
            c.delete(ids)
            [state.pop(i, None) for i in ids]
            continue
        doc = rng.choice([None, "", f"d{n}"])
        c.upsert(ids, [[float(n)]] * 2, documents=None if doc is None else [doc] * 2)
        for i in ids:
            state[i] = (float(n), (state.get(i, (0, None))[1] if doc is None else doc) or None, writes)
            writes += 1
    got = {r.id: (r.embedding[0], r.document, r.internal_id) for r in c.records.collect()}
    assert got == state and c.count_deleted() == writes - len(state)


def test_own_path_and_checksum(spark, tmp_path):
    path = tmp_path / "s"
    c = Collection(spark, "s", 2)
    c.add([1, 2], [[1, 0], [0, 1]], [{"a": 1}, {"a": 2}], ["one", "two"])
    c.save(str(path))
    d = Collection.load(spark, str(path))
    d.save(str(path))
    d.add([3], [[1, 1]])
    d.save(str(path))
    assert d.count() == 3 and Collection.load(spark, str(path)).get_document(2) == "two"
    manifest = store.read_manifest(str(path))
    gen = path / manifest["generation"]
    for change in (("document", F.lit("other")), ("embedding", F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float")))):
        rows = spark.read.parquet(str(gen)).withColumn(*change).collect()
        other = tmp_path / f"t-{change[0]}"
        spark.createDataFrame(rows, spark.read.parquet(str(gen)).schema).write.parquet(str(other / manifest["generation"]))
        (other / "manifest.json").write_text(json.dumps(manifest))
        with pytest.raises(ValueError, match="damaged"):
            Collection.load(spark, str(other))


def test_log_levels_and_epochs(spark, tmp_path):
    c = Collection(spark, "e", 2)
    c.save(str(tmp_path / "snap"))
    with pytest.raises(ValueError):
        c.enable_log(str(tmp_path / "log"), durability=3)
    c.enable_log(str(tmp_path / "log"), durability=store.ASYNC)
    assert c.log_enabled and "flat" in repr(c)
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id bigint, embedding array<float>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    upsert_stream(stream, c, str(tmp_path / "ckpt")).awaitTermination(60)
    c.flush_log()
    back = Collection.recover(spark, str(tmp_path / "snap"), str(tmp_path / "log"))
    assert back.count() == 2 and back.epochs == {str(tmp_path / "ckpt"): 0} and back.count_deleted() == 0
    back.checkpoint(str(tmp_path / "snap"))
    assert Collection.load(spark, str(tmp_path / "snap")).epochs == back.epochs
