import numpy as np
import pytest

from lodevec.plans import reference


@pytest.mark.parametrize("name", ["pq256_encode", "pq256_adc_topk", "ivfpq_topk"])
def test_all_codewords_as_in_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    x = np.random.default_rng(3).integers(-128, 128, (300, 64)) / 128
    rows = [(i, [float(c) for c in v], i % 7) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(reference.SQL[name]).fetchall())
    got = sorted(tuple(r) for r in reference.QUERIES[name](spark, str(tmp_path)).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    if name == "pq256_encode":
        assert len({g[2] for g in got}) > 64
    else:
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
