"""Batch search at the size of the published figures: 1,000,000 rows of 128 components, 10,000 queries, the 10 nearest.

Prints one JSON line: seconds and queries a second of the exact search and of inverted lists at a recall of 0.99, the recall they
reach, and the seconds it takes to build them. The rows are made here: 1,000 normal clusters of uneven size in 128 dimensions.
BENCH_ROWS, BENCH_CPUS and BENCH_MEMORY choose.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")

DIMENSION, QUERIES, K = 128, 10_000, 10


def main() -> None:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import SparkSession

    from lodevec.operators import ivf, topk
    from lodevec.util import settle

    n, cpus = int(os.environ.get("BENCH_ROWS", 1_000_000)), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def make(batches):
        centres = np.random.default_rng(0).normal(0, 1, (1000, DIMENSION))
        for b in batches:
            ids = b.column(0).to_numpy()
            rng = np.random.default_rng(int(ids[0]))
            x = centres[(1000 * rng.random(len(ids)) ** 2).astype(int)] + rng.normal(0, 0.5, (len(ids), DIMENSION))
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * DIMENSION), flat)], names=["id", "embedding"])

    rows = settle(spark.range(n, numPartitions=4 * int(cpus)).mapInArrow(make, "id bigint, embedding array<float>"), "rows")
    step = max(1, n // QUERIES)
    queries = settle(rows.where(f"id % {step} = 0").withColumnRenamed("id", "query_id"), "queries")
    took = {}

    def timed(name, run):
        began = time.time()
        out = run()
        took[name] = round(time.time() - began, 2)
        return out

    topk.nearest(rows.limit(1000), queries.limit(10), K).count()
    asked = queries.count()
    exact = timed("exact", lambda: settle(topk.nearest(rows, queries, K), "exact"))
    lists = timed("build", lambda: ivf.MeasuredLists(rows, "l2", 0.99))
    found = timed("lists", lambda: settle(lists.search(queries, K), "found"))
    recall = topk.recall(found, exact).first()[0]
    print(json.dumps({"rows": n, "queries": asked, "seconds": took, "qps_exact": round(asked / took["exact"]), "qps_lists": round(asked / took["lists"]), "recall_lists": round(recall, 4), "nlist": lists.nlist, "nprobe": lists.nprobe}))


if __name__ == "__main__":
    main()
