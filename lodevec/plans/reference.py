"""Queries for the retrieval operators, each with its SQL. Query sets are the rows whose id is divisible by 20, or all
evaluation items; they meet all rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quant, text as T, vectors as V
from ..functions import where as W
from ..operators import bm25, ivf, kmeans, mutations, topk
from ..sources import readers
from ..util import shared_dir, table

K = 10
NLIST, NPROBE, PARTS, KSUB = 16, 4, 8, 64
#: Codewords of a part as the survey has them, and the lists that ivfpq_topk probes.
FULL_KSUB, PQ_NPROBE = 256, 12
#: Lists probed where nine of ten of the nearest are to be found.
WIDE_NPROBE = 13


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


def _asked(records: DataFrame) -> DataFrame:
    return records.where("pmod(id, 20) = 0").select(F.col("id").alias("query_id"), "embedding")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    return docs.join(_records(spark, d), "id")


def _shown(found: DataFrame, value: str = "distance") -> DataFrame:
    # adding 0.0 turns a negative zero into zero
    return found.select("query_id", "rank", "id", (F.round(value, 6) + F.lit(0.0)).alias(value))


def _topk(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _records(spark, d)
        if metric != "l2":  # lengths that differ tell the inner product from the cosine
            r = r.withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("label") + 1).cast("float")))
        return _shown(topk.nearest(r, _asked(r), K, metric))

    return run


_WHERE = {
    "eq": {"lang": "en"},
    "ne_missing": {"lang": {"$ne": "en"}},
    "range": {"n_chars": {"$gt": 500, "$lte": 1000.5}},
    "in": {"label": {"$in": [1, 3, 5]}},
    "nin": {"lang": {"$nin": ["en", "de"]}},
    "not": {"$not": {"lang": "en"}},
    "and_or": {"$or": [{"lang": "fr"}, {"$and": [{"label": {"$gte": 5}}, {"n_chars": {"$lt": 800}}]}]},
    "other_kind": {"n_chars": {"$ne": 500.0}, "label": {"$gt": 0}},
}
_WHERE_SQL = {
    "eq": "coalesce(lang = 'en', false)",
    "ne_missing": "coalesce(lang <> 'en', false)",
    "range": "coalesce(n_chars::double > 500e0 and n_chars::double <= 1000.5e0, false)",
    "in": "coalesce(label in (1, 3, 5), false)",
    "nin": "coalesce(lang not in ('en', 'de'), false)",
    "not": "not coalesce(lang = 'en', false)",
    "and_or": "(coalesce(lang = 'fr', false) or (coalesce(label >= 5, false) and coalesce(n_chars < 800, false)))",
    "other_kind": "(n_chars is not null and coalesce(label > 0, false))",
}


def _where(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _hybrid(spark, d)
        return _shown(topk.nearest(r, _asked(_records(spark, d)), K, "l2", W.on_columns(_WHERE[name], dict(r.dtypes))))

    return run


def _norms(spark, d):
    r = _records(spark, d)
    return r.select("id", F.round(F.sqrt(V.norm2(F.col("embedding"))), 6).alias("norm"))


def _normalised(spark, d):
    r = _records(spark, d).withColumn("u", V.normalised(F.transform("embedding", lambda x: x * (F.col("label") + 1).cast("float"))))
    return r.select("id", F.round(V.norm2(F.col("u")), 5).alias("length"))


def _nonfinite(spark, d):
    return _records(spark, d).agg(F.count_if(~V.is_finite(F.col("embedding"))).alias("bad"), F.count("*").alias("n"))


def _token_stats(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_tokens"))


def _index(spark, d) -> bm25.TextIndex:
    return bm25.TextIndex(table(spark, d, "documents"), "doc_id", "text")


def _term_df(spark, d):
    return _index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def _lengths(spark, d):
    return _index(spark, d).lengths.select(F.col("id").alias("doc_id"), "dl")


def _text_stats(spark, d):
    return _index(spark, d).stats.select("n", "total", F.round(F.col("total").cast("double") / F.col("n"), 6).alias("avgdl"))


def _items(spark, d) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d):
    return _shown(_index(spark, d).search(_items(spark, d), K), "score")


def _bm25_where(spark, d):
    allowed = table(spark, d, "documents").where(F.coalesce(F.col("lang") == "en", F.lit(False))).select(F.col("doc_id").alias("id"))
    return _shown(_index(spark, d).search(_items(spark, d), K, allowed), "score")


def _bm25_stop(spark, d):
    q = spark.createDataFrame([(1, "the of and"), (2, "и в не")], "query_id bigint, text string")
    return _shown(_index(spark, d).search(q, K), "score")


def _pair_queries(spark, d):
    h = _hybrid(spark, d)
    return h, _asked(h), h.where("pmod(id, 20) = 0").select(F.col("id").alias("query_id"), "text")


def _rrf(spark, d):
    h, v, t = _pair_queries(spark, d)
    return _shown(bm25.fuse([topk.nearest(h, v, 20), bm25.TextIndex(h, "id", "text").search(t, 20)], K), "score")


def _hybrid_topk(where=None):
    def run(spark, d):
        h, v, t = _pair_queries(spark, d)
        cond = None if where is None else W.on_columns(where, dict(h.dtypes))
        return _shown(bm25.hybrid(h, bm25.TextIndex(h, "id", "text"), v, t, K, "l2", cond), "score")

    return run


def _coded(spark, d, symmetric: bool):
    r = _records(spark, d)
    b = F.broadcast(quant.sq8_bounds(r))
    code = quant.sq8_symmetric(F.col("embedding"), F.col("sym")) if symmetric else quant.sq8_affine(F.col("embedding"), F.col("lo"), F.col("scale"))
    return r.crossJoin(b).select("id", code.alias("embedding"), "embedding", "scale", "sym").toDF("id", "code", "embedding", "scale", "sym")


def _sq8_bounds(spark, d):
    return quant.sq8_bounds(_records(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("lo", "hi", "scale", "sym")])


def _sq8_codes(spark, d):
    c = _coded(spark, d, False)
    at = F.aggregate(F.transform("code", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return c.select("id", at.alias("weighted"), F.element_at("code", 1).cast("bigint").alias("first_code"))


def _sq8_search(spark, d, metric: str, k: int) -> DataFrame:
    """Scans of whole-number codes; ip: the negative product of codes, in units of the scale squared."""
    c = _coded(spark, d, metric == "ip").select("id", F.col("code").alias("embedding"), (F.col("sym") if metric == "ip" else F.col("scale")).alias("unit"))
    found = topk.nearest(c, _asked(c), k, metric)
    unit = c.select("unit").limit(1)
    return found.crossJoin(F.broadcast(unit))


def _sq8_l2(spark, d):
    return _sq8_search(spark, d, "l2", K).select("query_id", "rank", "id", F.round(F.col("distance") * F.col("unit") * F.col("unit"), 6).alias("distance"))


def _sq8_ip(spark, d):
    return _sq8_search(spark, d, "ip", K).select("query_id", "rank", "id", F.round((F.col("distance") - 1) * F.col("unit") * F.col("unit"), 6).alias("distance"))


def _sq8_reranked(spark, d) -> DataFrame:
    r = _records(spark, d)
    cand = _sq8_search(spark, d, "l2", 2 * K).select("query_id", "id")
    q = _asked(r).select(F.col("query_id").alias("q"), F.col("embedding").alias("qe"))
    both = cand.join(r.select("id", "embedding"), "id").join(q, F.col("query_id") == F.col("q"))
    scored = both.select("query_id", "id", V.squared_l2(F.col("embedding"), F.col("qe")).alias("distance"))
    return topk.ranked(scored, K, [F.col("distance"), F.col("id")])


def _sq_dims(spark, d):
    return quant.dimension_bounds(_records(spark, d)).select(F.col("dim").cast("bigint").alias("dim"), F.round("vmin", 6).alias("vmin"), F.round("vdiff", 6).alias("vdiff"))


def _sq_decoded(spark, d) -> DataFrame:
    r = _records(spark, d)
    b = F.broadcast(quant.as_arrays(quant.dimension_bounds(r)))
    codes = r.crossJoin(b).withColumn("codes", quant.sq_encode(F.col("embedding"), F.col("vmins"), F.col("vdiffs")))
    return codes.select("id", "embedding", quant.sq_decode(F.col("codes"), F.col("vmins"), F.col("vdiffs")).alias("decoded"))


def _sq_error(spark, d):
    return _sq_decoded(spark, d).select("id", F.round(V.squared_l2(F.col("embedding"), F.col("decoded")), 8).alias("error"))


def _sq_topk(spark, d):
    c = _sq_decoded(spark, d)
    return _shown(topk.nearest(c.select("id", F.col("decoded").alias("embedding")), _asked(c), K))


def _fp16(spark, d):
    r = _records(spark, d)
    return _shown(topk.nearest(quant.fp16_round_trip(r).withColumnRenamed("half", "embedding"), _asked(r), K))


def _fixed_centroids(spark, d) -> np.ndarray:
    rows = _records(spark, d).orderBy("id").limit(NLIST).collect()
    return np.array([r.embedding for r in rows], np.float64)


def _listed(spark, d):
    return ivf.with_list(_records(spark, d).select("id", F.col("embedding").alias("v")), _fixed_centroids(spark, d))


def _assign(spark, d):
    return _listed(spark, d).select("id", F.col("list_no").cast("bigint").alias("list_no"))


def _one_iteration(spark, d):
    means, counts = kmeans.one_iteration(_records(spark, d).select(F.col("embedding").alias("v")), _fixed_centroids(spark, d))
    rows = [(i, int(n), round(float(m.sum()), 6)) for i, (m, n) in enumerate(zip(means, counts))]
    return spark.createDataFrame(rows, "list_no bigint, n bigint, total double")


def _list_sizes(spark, d):
    return _listed(spark, d).groupBy(F.col("list_no").cast("bigint").alias("list_no")).agg(F.count("*").alias("n"))


def _ivf_flat(spark, d, nprobe: int = NPROBE):
    r = _records(spark, d)
    return _shown(ivf.search_flat(r, _asked(r), _fixed_centroids(spark, d), K, nprobe))


def _first_rows(spark, d, n: int) -> np.ndarray:
    return np.array([r.embedding for r in _records(spark, d).orderBy("id").limit(n).collect()], np.float64)


def _pq_codes(spark, d, ksub: int = KSUB) -> DataFrame:
    books = spark.sparkContext.broadcast(np.split(_first_rows(spark, d, ksub), PARTS, axis=1))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            codes = quant.pq_encode_matrix(x, books.value)
            back = quant.pq_decode_matrix(codes, books.value)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "code": pa.array(list(codes), pa.list_(pa.int16())), "decoded": pa.array(list(back), pa.list_(pa.float64()))})

    return _records(spark, d).select("id", "embedding").mapInArrow(run, "id bigint, code array<smallint>, decoded array<double>")


def _pq_encode(spark, d, ksub: int = KSUB):
    return _pq_codes(spark, d, ksub).select("id", F.posexplode("code").alias("part", "code")).select("id", F.col("part").cast("bigint").alias("part"), F.col("code").cast("bigint").alias("code"))


def _pq_topk(spark, d, ksub: int = KSUB):
    """Asymmetric distances by table look-ups, in one list about the origin, so that codes are those of the vectors."""
    first = _first_rows(spark, d, ksub)
    r = _records(spark, d)
    index = ivf.IVFPQ(first.shape[1], "l2", 1, PARTS, 1, len(first), np.zeros((1, first.shape[1])), np.split(first, PARTS, axis=1))
    return _shown(index.add(r).query(_asked(r), K))


def _ivfpq_topk(spark, d):
    """Fixed lists, and the residuals of the first rows as codewords; distances by the codes alone."""
    r, centroids = _records(spark, d), _fixed_centroids(spark, d)
    first = _first_rows(spark, d, FULL_KSUB)
    books = np.split(first - centroids[kmeans.assign(first, centroids)], PARTS, axis=1)
    index = ivf.IVFPQ(first.shape[1], "l2", len(centroids), PARTS, min(PQ_NPROBE, len(centroids)), len(first), centroids, books)
    return _shown(index.add(r).query(_asked(r), K))


def _ivfpq_recall(spark, d):
    r = _records(spark, d)
    n = r.count()
    index = ivf.IVFPQ(64, "l2", min(NLIST, n), PARTS, nprobe=8, ksub=min(256, n)).add(r)
    return topk.recall(index.query(_asked(r), K), topk.nearest(r, _asked(r), K))


def _fvecs(spark, d):
    path = f"{shared_dir(spark).removeprefix('file://')}/lodevec-fvecs-{uuid.uuid4().hex}"
    readers.write_fvecs(_records(spark, d), path)
    return readers.read_fvecs(spark, path).select("id", F.round(V.norm2(F.col("embedding")), 6).alias("length"))


def _log(spark, d) -> DataFrame:
    log = table(spark, d, "mutation_log").select(F.col("seq_no").alias("seq"), F.col("frame_pos").alias("pos"), F.col("mutation_op").alias("op"), "id", "collection_name", "document", "meta_year")
    return mutations.deduplicated(log)


def _fold(spark, d) -> DataFrame:
    now = mutations.fold(mutations.positions(_log(spark, d)), ["document", "meta_year"], latest=("collection_name",))
    return now.withColumn("document", F.nullif("document", F.lit("")))


def _mutation_fold(spark, d):
    return _fold(spark, d).select("id", F.col("internal_id").cast("bigint").alias("internal_id"), "collection_name", "document", F.coalesce("meta_year", F.lit(-1)).alias("meta_year"))


def _collection_stats(spark, d):
    writes = _log(spark, d).agg(F.count_if(F.col("op") != "delete").alias("total"))
    active = _fold(spark, d).agg(F.count("*").alias("active"))
    both = active.crossJoin(F.broadcast(writes))
    return both.select("active", (F.col("total") - F.col("active")).alias("deleted"), "total", F.round((F.col("total") - F.col("active")) / F.col("total"), 6).alias("deleted_ratio"))


def _compact(spark, d):
    return mutations.compacted(_fold(spark, d).select("id", "internal_id")).select("id", F.col("internal_id").cast("bigint").alias("internal_id"))


def _upsert_merge(spark, d):
    """Imported records with their documents replaced by what the log leaves, and those the log adds."""
    old = table(spark, d, "import_records").groupBy("id").agg(F.min("document").alias("document"))
    new = _fold(spark, d).select(F.col("id").alias("nid"), F.col("document").alias("new_document"))
    both = old.join(new, F.col("id") == F.col("nid"), "full")
    return both.select(F.coalesce("nid", "id").alias("id"), F.coalesce("new_document", F.nullif("document", F.lit(""))).alias("document"))


def _delete(spark, d):
    gone = _log(spark, d).where("op = 'delete'").select("id")
    return table(spark, d, "import_records").select("id").distinct().join(gone, "id", "left_anti")


def _recall(found):
    def run(spark, d):
        r = _records(spark, d)
        return topk.recall(found(spark, d), topk.nearest(r, _asked(r), K)).select(F.round("recall", 6).alias("recall"))

    return run


def _padded(spark, d):
    r = _hybrid(spark, d)
    asked = _asked(_records(spark, d))
    got = topk.nearest(r, asked, K, "l2", W.on_columns({"lang": "de", "label": {"$lt": 2}}, dict(r.dtypes)))
    return _shown(topk.padded(got, asked, K))


# SQL

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
_E = "with e as (select vec_id as id, embedding, label from embeddings), "
_H = "h as (select doc_id as id, text, lang, source, n_chars, embedding, label from documents join embeddings on doc_id = vec_id), "
_UNIT = "list_transform({v}, lambda x: (x::double / sqrt({n}))::float)"


def _ranked_sql(source: str, dist: str, k: int = K, asked: str = "select id as query_id, embedding as q from e where id % 20 = 0") -> str:
    return (
        f"q as ({asked}), s as (select query_id, r.id, {dist} as distance from {source} r, q), "
        f"t as (select query_id, id, distance, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s) "
        f"select query_id, rank, id, round(distance, 6) + 0e0 as distance from t where rank <= {k}"
    )


_L2_RANK = _L2.format(a="r.embedding", b="q.q")
_SCALED = "with e0 as (select vec_id as id, list_transform(embedding, lambda x: x * (label + 1)::float) as embedding from embeddings), "
_COSINE = _SCALED + f"e as (select id, {_UNIT.format(v='embedding', n=_DOT.format(a='embedding', b='embedding'))} as embedding from e0), "
_BM25 = """
t as (select id, unnest(w) as term from (select id, list_filter({words}, lambda w: w not in {stop}) as w from {docs})),
tf as (select id, term, count(*) as tf from t group by id, term),
dl as (select id, sum(tf) as dl from tf group by id),
st as (select count(*) as n, sum(dl) * 1.0e0 / count(*) as avgdl from dl),
df as (select term, count(*) as df from tf group by term),
qt as (select distinct query_id, term from (select query_id, unnest(list_filter({qwords}, lambda w: w not in {stop})) as term from {queries})),
sc as (select query_id, id, sum(ln(1.0e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) as score
  from qt join tf using (term) join df using (term) join dl using (id), st {cond} group by query_id, id),
"""


def _bm25_sql(docs: str, queries: str, k: int, cond: str = "", name: str = "bt") -> str:
    body = _BM25.format(docs=docs, queries=queries, words=T.sql_words("text"), qwords=T.sql_words("text"), stop=T.sql_stop_list(), cond=cond)
    return body + f"{name} as (select * from (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from sc) where rank <= {k})"


_DOCS = "(select doc_id as id, text, lang from documents)"
_ITEMS = "(select item_id as query_id, text from eval_items)"
_SCORE = " select query_id, rank, id, round(score, 6) as score from bt"


def _fused_sql(k_candidates: int, cond: str = "true") -> str:
    asked = "(select id as query_id, text from h where id % 20 = 0)"
    return (
        "with " + _H + f"q as (select id as query_id, embedding as q from h where id % 20 = 0), s as (select query_id, r.id, {_L2_RANK} as distance from h r, q where {cond}), "
        f"vt as (select * from (select query_id, id, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s) where rank <= {k_candidates}), "
        + _bm25_sql("(select id, text from h)", asked, k_candidates, f"where id in (select id from h where {cond})")
        + f", u as (select query_id, rank, id from vt union all select query_id, rank, id from bt), "
        f"f as (select query_id, id, sum(1.0e0 / (60 + rank)) as score from u group by query_id, id), "
        f"g as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from f) "
        f"select query_id, rank, id, round(score, 6) as score from g where rank <= {K}"
    )


_BOUNDS = "b as (select min(list_min(embedding))::double as lo, max(list_max(embedding))::double as hi from e), bb as (select lo, hi, case when hi > lo then (hi - lo) / 255e0 else 1e0 end as scale, greatest(abs(lo), abs(hi)) / 127e0 as sym from b), "
_CODES = _E + _BOUNDS + "c as (select id, embedding as full_, list_transform(embedding, lambda x: least(255e0, greatest(0e0, round_even((x::double - lo) / scale, 0)))::bigint) as embedding, scale from e, bb), "
_CODES_IP = _E + _BOUNDS + "c as (select id, list_transform(embedding, lambda x: least(127e0, greatest(-127e0, round_even(x::double / sym, 0)))::bigint) as embedding, sym from e, bb), "
_ASK_C = "select id as query_id, embedding as q from c where id % 20 = 0"
_CODE_L2 = "list_sum(list_transform(list_zip(r.embedding, q.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_CODE_DOT = "list_sum(list_transform(list_zip(r.embedding, q.q), lambda p: p[1] * p[2]))"
_SQ8_TOP = _CODES + "q as (" + _ASK_C + f"), s as (select query_id, r.id, {_CODE_L2} as code_distance, scale from c r, q), t as (select *, row_number() over (partition by query_id order by code_distance, id) as rank from s)"
_SQ8_RERANK = (
    _SQ8_TOP + f", k as (select query_id, t.id, {_L2.format(a='c.full_', b='d.full_')} as distance from t join c on c.id = t.id join c d on d.id = t.query_id where rank <= {2 * K}), "
    f"r2 as (select query_id, id, distance, row_number() over (partition by query_id order by round(distance, 12), id) as rank from k) "
)
_EXACT = f"x as (select * from (select query_id, id, row_number() over (partition by query_id order by round(distance, 12), id) as rank from (select q.id as query_id, r.id, {_L2.format(a='r.embedding', b='q.embedding')} as distance from e r, e q where q.id % 20 = 0)) where rank <= {K})"
_DIMS = "x1 as (select id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as dim from e), db as (select dim, min(x)::double as vmin, max(x)::double - min(x)::double as vdiff from x1 group by dim), "
_DEC = _E + _DIMS + "dx as (select id, x1.dim, x::double as x, floor(least(1e0, greatest(0e0, case when vdiff > 0 then (x::double - vmin) / vdiff else 0e0 end)) * 255e0 + 0.5e0) / 255e0 * vdiff + vmin as y from x1 join db using (dim)), "
# sixteen bits: eleven significant ones down to 2^-14, and steps of 2^-24 below
_STEP = "pow(2e0, greatest(floor(log2(abs(x::double))), -14e0) - 10e0)"
_HALF = f"hf as (select id, list_transform(embedding, lambda x: case when x = 0 then 0e0 else round_even(x::double / {_STEP}, 0) * {_STEP} end) as embedding from e), "
_CENT = f"ce as (select row_number() over (order by id) - 1 as list_no, embedding as c from (select id, embedding from e order by id limit {NLIST})), "
_LISTS = _E + _CENT + f"al as (select id, list_no, {_L2.format(a='embedding', b='c')} as dist from e, ce), li as (select id, list_no from (select id, list_no, row_number() over (partition by id order by dist, list_no) as r from al) where r = 1)"
_BOOKS = _E + f"""bk as (select row_number() over (order by id) - 1 as code, embedding as c from (select id, embedding from e order by id limit {KSUB})),
p as (select unnest(range({PARTS})) as part),
pc as (select id, part, code, list_sum(list_transform(list_zip(embedding[part * 8 + 1 : part * 8 + 8], c[part * 8 + 1 : part * 8 + 8]), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as dist from e, bk, p),
co as (select id, part, code from (select id, part, code, row_number() over (partition by id, part order by dist, code) as r from pc) where r = 1)"""
_FULL_BOOKS = _BOOKS.replace(f"limit {KSUB})", f"limit {FULL_KSUB})")
_PQ_TOP = f", ta as (select e.id as query_id, part, code, dist from pc e where id % 20 = 0), s as (select query_id, co.id, sum(dist) as distance from ta join co using (part, code) group by query_id, co.id), t as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s) select query_id, rank, id, round(distance, 6) as distance from t where rank <= {K}"
_RESIDUAL = "list_transform(list_zip(embedding, c), lambda z: z[1]::double - z[2]::double)"
_PART_L2 = "list_sum(list_transform(list_zip(r[part * 8 + 1 : part * 8 + 8], w[part * 8 + 1 : part * 8 + 8]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_IVFPQ = _LISTS + f""", re as (select id, list_no, {_RESIDUAL} as r from li join e using (id) join ce using (list_no)),
bk as (select row_number() over (order by id) - 1 as code, r as w from (select id, r from re order by id limit {FULL_KSUB})),
p as (select unnest(range({PARTS})) as part),
pc as (select id, list_no, part, code, {_PART_L2} as dist from re, bk, p),
co as (select id, list_no, part, code from (select *, row_number() over (partition by id, part order by dist, code) as n from pc) where n = 1),
pr as (select id as query_id, list_no from (select id, list_no, row_number() over (partition by id order by dist, list_no) as n from al where id % 20 = 0) where n <= {PQ_NPROBE}),
rq as (select query_id, list_no, {_RESIDUAL} as r from pr join e on e.id = query_id join ce using (list_no)),
ta as (select query_id, list_no, part, code, {_PART_L2} as dist from rq, bk, p),
s as (select query_id, co.id, sum(dist) as distance from ta join co using (list_no, part, code) group by query_id, co.id),
t as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s)
select query_id, rank, id, round(distance, 6) as distance from t where rank <= {K}"""
_LOG = """l as (select distinct seq_no as seq, frame_pos as pos, mutation_op as op, id, collection_name, document, meta_year from mutation_log),
a as (select *, sum(case when op = 'delete' then 1 else 0 end) over (partition by id order by seq, pos rows between unbounded preceding and current row) as seg,
  sum(case when op <> 'delete' then 1 else 0 end) over (order by seq, pos rows between unbounded preceding and current row) - 1 as internal_id from l),
b as (select id, op, internal_id, collection_name, last_value(document ignore nulls) over w as doc, last_value(meta_year ignore nulls) over w as meta_year,
  row_number() over (partition by id order by seq desc, pos desc) as rn from a window w as (partition by id, seg order by seq, pos rows between unbounded preceding and current row)),
n as (select id, internal_id::bigint as internal_id, collection_name, nullif(doc, '') as document, meta_year from b where rn = 1 and op <> 'delete')"""

QUERIES = {
    "vector_topk_l2": _topk("l2"), "vector_topk_cosine": _topk("cosine"), "vector_topk_ip": _topk("ip"),
    **{f"vector_topk_where_{n}": _where(n) for n in _WHERE},
    "vector_norms": _norms, "cosine_normalize_check": _normalised, "nonfinite_count": _nonfinite,
    "tokenize_stats": _token_stats, "term_df": _term_df, "doc_lengths": _lengths, "bm25_corpus_stats": _text_stats,
    "bm25_topk": _bm25, "bm25_topk_where": _bm25_where, "bm25_stopword_only": _bm25_stop,
    "rrf_fuse": _rrf, "hybrid_topk": _hybrid_topk(), "hybrid_topk_where": _hybrid_topk({"lang": "en"}),
    "sq8_bounds": _sq8_bounds, "sq8_codes_l2": _sq8_codes, "sq8_topk_l2": _sq8_l2, "sq8_topk_ip": _sq8_ip,
    "sq8_rerank": lambda s, d: _shown(_sq8_reranked(s, d)),
    "sq_dim_bounds": _sq_dims, "sq_roundtrip_error": _sq_error, "sq_topk": _sq_topk, "fp16_topk": _fp16,
    "kmeans_assign": _assign, "kmeans_one_iter": _one_iteration, "ivf_list_sizes": _list_sizes, "ivf_flat_topk": _ivf_flat,
    "pq256_encode": lambda s, d: _pq_encode(s, d, FULL_KSUB), "pq256_adc_topk": lambda s, d: _pq_topk(s, d, FULL_KSUB), "ivfpq_topk": _ivfpq_topk,
    "pq_encode": _pq_encode, "pq_adc_topk": _pq_topk, "ivfpq_trained_recall": _ivfpq_recall, "fvecs_roundtrip": _fvecs,
    "mutation_fold": _mutation_fold, "collection_stats": _collection_stats, "compact_renumber": _compact, "upsert_merge": _upsert_merge, "delete_antijoin": _delete,
    "recall_at_10_sq8": _recall(_sq8_reranked),
    "recall_at_10_ivf": _recall(lambda s, d: ivf.search_flat(_records(s, d), _asked(_records(s, d)), _fixed_centroids(s, d), K, NPROBE)),
    "ivf_flat_wide_topk": lambda s, d: _ivf_flat(s, d, WIDE_NPROBE),
    "recall_at_10_ivf_wide": _recall(lambda s, d: ivf.search_flat(_records(s, d), _asked(_records(s, d)), _fixed_centroids(s, d), K, WIDE_NPROBE)),
    "padded_topk": _padded,
}

SQL = {
    "vector_topk_l2": _E + _ranked_sql("e", _L2_RANK),
    "vector_topk_cosine": _COSINE + _ranked_sql("e", "1e0 - " + _DOT.format(a="r.embedding", b="q.q")),
    "vector_topk_ip": _SCALED.replace("e0 as", "e as") + _ranked_sql("e", "1e0 - " + _DOT.format(a="r.embedding", b="q.q")),
    **{f"vector_topk_where_{n}": _E + _H + f"hw as (select * from h where {c}), " + _ranked_sql("hw", _L2_RANK) for n, c in _WHERE_SQL.items()},
    "vector_norms": f"select vec_id as id, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 6) as norm from embeddings",
    "cosine_normalize_check": _COSINE.rstrip(", ") + f" select id, round({_DOT.format(a='embedding', b='embedding')}, 5) as length from e",
    "nonfinite_count": "select count(*) filter (len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0) as bad, count(*) as n from embeddings",
    "tokenize_stats": f"select doc_id, len(w) as tokens, len(list_distinct(w)) as distinct_tokens from (select doc_id, {T.sql_words('text')} as w from documents)",
    "term_df": f"select term, count(distinct id) as df, count(*) as occurrences from (select doc_id as id, unnest({T.sql_words('text')}) as term from documents) where term not in {T.sql_stop_list()} group by term",
    "doc_lengths": f"select id as doc_id, count(*) as dl from (select doc_id as id, unnest({T.sql_words('text')}) as term from documents) where term not in {T.sql_stop_list()} group by id",
    "bm25_corpus_stats": f"select count(*) as n, sum(dl)::bigint as total, round(sum(dl) * 1.0e0 / count(*), 6) as avgdl from (select id, count(*) as dl from (select doc_id as id, unnest({T.sql_words('text')}) as term from documents) where term not in {T.sql_stop_list()} group by id)",
    "bm25_topk": "with " + _bm25_sql(_DOCS, _ITEMS, K) + _SCORE,
    "bm25_topk_where": "with " + _bm25_sql(_DOCS, _ITEMS, K, "where id in (select doc_id from documents where lang = 'en')") + _SCORE,
    "bm25_stopword_only": "with " + _bm25_sql(_DOCS, "(select 1 as query_id, 'the of and' as text union all select 2, 'и в не')", K) + _SCORE,
    "rrf_fuse": _fused_sql(20),
    "hybrid_topk": _fused_sql(40),
    "hybrid_topk_where": _fused_sql(40, "coalesce(lang = 'en', false)"),
    "sq8_bounds": _E + _BOUNDS.rstrip(", ") + " select round(lo, 9) as lo, round(hi, 9) as hi, round(scale, 9) as scale, round(sym, 9) as sym from bb",
    "sq8_codes_l2": _CODES.rstrip(", ") + " select id, list_sum(list_transform(embedding, lambda x, i: x * i))::bigint as weighted, embedding[1] as first_code from c",
    "sq8_topk_l2": _SQ8_TOP + f" select query_id, rank, id, round(code_distance * scale * scale, 6) as distance from t where rank <= {K}",
    "sq8_topk_ip": _CODES_IP + "q as (" + _ASK_C + f"), s as (select query_id, r.id, {_CODE_DOT} as dot, sym from c r, q), t as (select *, row_number() over (partition by query_id order by dot desc, id) as rank from s) select query_id, rank, id, round(-dot * sym * sym, 6) as distance from t where rank <= {K}",
    "sq8_rerank": _SQ8_RERANK + f"select query_id, rank, id, round(distance, 6) as distance from r2 where rank <= {K}",
    "sq_dim_bounds": _E + _DIMS.rstrip(", ") + " select dim::bigint as dim, round(vmin, 6) as vmin, round(vdiff, 6) as vdiff from db",
    "sq_roundtrip_error": _DEC.rstrip(", ") + " select id, round(sum((x - y) * (x - y)), 8) as error from dx group by id",
    "sq_topk": _DEC + "de as (select id, list(y order by dim) as embedding from dx group by id), " + _ranked_sql("de", _L2_RANK),
    "fp16_topk": _E + _HALF + _ranked_sql("hf", _L2_RANK),
    "kmeans_assign": _LISTS + " select id, list_no from li",
    "kmeans_one_iter": _LISTS + ", ux as (select list_no, id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from li join e using (id)), mm as (select list_no, dim, sum(x) / count(*) as m, count(*) as n from ux group by list_no, dim) select list_no, max(n) as n, round(sum(m), 6) as total from mm group by list_no",
    "ivf_list_sizes": _LISTS + " select list_no, count(*) as n from li group by list_no",
    "ivf_flat_topk": _LISTS + f", pr as (select id as query_id, list_no from (select id, list_no, row_number() over (partition by id order by dist, list_no) as r from al where id % 20 = 0) where r <= {NPROBE}), s as (select query_id, r.id, {_L2.format(a='r.embedding', b='o.embedding')} as distance from pr join li using (list_no) join e r on r.id = li.id join e o on o.id = pr.query_id), t as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s) select query_id, rank, id, round(distance, 6) as distance from t where rank <= {K}",
    "pq_encode": _BOOKS + " select id, part, code from co",
    "pq_adc_topk": _BOOKS + f", ta as (select e.id as query_id, part, code, dist from pc e where id % 20 = 0), s as (select query_id, co.id, sum(dist) as distance from ta join co using (part, code) group by query_id, co.id), t as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s) select query_id, rank, id, round(distance, 6) as distance from t where rank <= {K}",
    "pq256_encode": _FULL_BOOKS + " select id, part, code from co",
    "pq256_adc_topk": _FULL_BOOKS + _PQ_TOP,
    "ivfpq_topk": _IVFPQ,
    "fvecs_roundtrip": f"select row_number() over (order by vec_id) - 1 as id, round({_DOT.format(a='embedding', b='embedding')}, 6) as length from embeddings",
    "mutation_fold": "with " + _LOG + " select id, internal_id, collection_name, document, coalesce(meta_year, -1) as meta_year from n",
    "collection_stats": "with " + _LOG + ", w as (select count(*) filter (op <> 'delete') as total from l), ac as (select count(*) as active from n) select active, total - active as deleted, total, round((total - active) / total::double, 6) as deleted_ratio from ac, w",
    "compact_renumber": "with " + _LOG + " select id, row_number() over (order by internal_id) - 1 as internal_id from n",
    "upsert_merge": "with " + _LOG + ", o as (select id as oid, min(document) as od from import_records group by id) select coalesce(id, oid) as id, coalesce(document, nullif(od, '')) as document from o full join n on oid = id",
    "delete_antijoin": "select distinct id from import_records where id not in (select id from mutation_log where mutation_op = 'delete')",
    "recall_at_10_sq8": _SQ8_RERANK + f", {_EXACT.replace('e r, e q', 'e r, e q')} select round(count(r2.id) / count(*)::double, 6) as recall from x left join r2 on r2.query_id = x.query_id and r2.id = x.id and r2.rank <= {K}",
    "padded_topk": _E + _H + f"q as (select id as query_id, embedding as q from e where id % 20 = 0), hw as (select * from h where lang = 'de' and label < 2), s as (select query_id, r.id, {_L2_RANK} as distance from hw r, q), t as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from s), g as (select query_id, unnest(range(1, {K + 1})) as rank from q) select g.query_id, g.rank, coalesce(t.id, -1) as id, round(coalesce(distance, 0e0), 6) as distance from g left join t on t.query_id = g.query_id and t.rank = g.rank",
}
SQL["recall_at_10_ivf"] = (
    SQL["ivf_flat_topk"].replace(f" select query_id, rank, id, round(distance, 6) as distance from t where rank <= {K}", "")
    + f", {_EXACT} select round(count(t.id) / count(*)::double, 6) as recall from x left join t on t.query_id = x.query_id and t.id = x.id and t.rank <= {K}"
)
for _narrow, _wide in (("ivf_flat_topk", "ivf_flat_wide_topk"), ("recall_at_10_ivf", "recall_at_10_ivf_wide")):
    SQL[_wide] = SQL[_narrow].replace(f"id % 20 = 0) where r <= {NPROBE})", f"id % 20 = 0) where r <= {WIDE_NPROBE})")
