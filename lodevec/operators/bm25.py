"""Full-text ranking by BM25, reciprocal rank fusion, and hybrid search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..types import between, check_results
from ..util import settle
from .topk import best_of, nearest, ranked

# Fixed values of the ranking formula.
K1, B = 1.2, 0.75


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, dl, term, tf): a row for each term of a document, and one without a term for its length."""
    for b in batches:
        ids, lengths, terms, counts = [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tf = Counter(w for w in T.python_words(text) if w not in T.STOP_SET)
            if tf:
                n = tf.total()
                ids += [i] * (len(tf) + 1)
                lengths += [n] * (len(tf) + 1)
                terms += [*tf, None]
                counts += [*tf.values(), n]
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "dl": pa.array(lengths, pa.int64()), "term": pa.array(terms, pa.string()), "tf": pa.array(counts, pa.int64())})


#: Scores of queries x documents that a task holds at once.
BLOCK_SCORES = 4_000_000


def _best_documents(shipped, n: int):
    """Postings, those of a document one after the other, to each query's best n documents of the partition."""

    def scored(ids, dl, term, tf):
        code, starts, number, names, idf, average = shipped.value
        known = term >= 0
        ids, dl, term, tf = ids[known], dl[known], term[known], tf[known].astype(np.float64)
        docs, doc = np.unique(ids, return_inverse=True)
        part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1.0 - B + B * dl / average))
        step = max(1, BLOCK_SCORES // len(names))
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(0, len(docs) + step, step))
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
            mine = order[s:e]
            if not len(mine):
                continue
            width = min(step, len(docs) - k * step)
            many = (starts[1:] - starts[:-1])[term[mine]]
            place = np.repeat(starts[term[mine]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cell = number[place] * width + np.repeat(doc[mine] - k * step, many)
            score = np.bincount(cell, weights=np.repeat(part[mine], many), minlength=len(names) * width).reshape(len(names), width)
            rough = score.round(9)
            edge = np.partition(rough, width - n, axis=1)[:, width - n] if width > n else np.zeros(len(names))
            i, j = np.nonzero((rough >= edge[:, None]) & (score > 0))
            keep = best_of(i, docs[k * step + j], -rough[i, j], n)
            yield i[keep], docs[k * step + j[keep]], score[i[keep], j[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names = shipped.value[0], shipped.value[3]
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        rest = None

        def take(cols):
            nonlocal best
            parts = [tuple(best), *scored(*cols)]
            best = [np.concatenate(c) for c in zip(*parts)]
            keep = best_of(best[0], best[1], -best[2].round(9), n)
            best = [c[keep] for c in best]

        for b in batches:
            if not b.num_rows:
                continue
            terms = b.column(2).dictionary_encode()
            of = np.array([code.get(w, -1) for w in terms.dictionary.to_pylist()], np.int64)
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), of[terms.indices.to_numpy()], b.column(3).to_numpy()]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            ids = cols[0]
            last = len(ids) - int(np.argmax(ids[::-1] != ids[-1])) if (ids != ids[-1]).any() else 0
            rest = [c[last:] for c in cols]
            if last:
                take([c[:last] for c in cols])
        if rest is not None:
            take(rest)
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    return run


class TextIndex:
    """Postings, lengths and document frequencies of the active documents, written once and shared by searches.

    ``key`` is unique: a document's terms and length come from its row alone, so that the index needs no shuffle.
    """

    def __init__(self, docs: DataFrame, key: str = "id", text: str = "document"):
        rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        self.held = settle(rows.mapInArrow(_counted, "id bigint, dl bigint, term string, tf bigint"), "postings")
        #: one row per (document, term) with its count and the document's length
        self.postings = self.held.where("term is not null")
        self.lengths = self.held.where("term is null").select("id", "dl")
        self._counts: tuple[int, int] | None = None
        self.stats = self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))

    def counts(self) -> tuple[int, int]:
        """Documents with a term, and their lengths together."""
        if self._counts is None:
            r = self.stats.first()
            self._counts = r.n, r.total
        return self._counts

    def search(self, queries: DataFrame, n: int, allowed: DataFrame | None = None, text: str = "text", most_terms: int = 1_000_000) -> DataFrame:
        """(query_id, rank, id, score) for ``queries`` (query_id, text).

        Corpus statistics are those of all documents; ``allowed`` (id) limits only what may be returned. Only postings of
        query terms are scored. Up to ``most_terms`` terms of all queries go to the tasks, which add up the scores of the
        documents they hold and keep each query's best; more terms meet the postings in a join by term.
        """
        check_results(n)
        asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col(text).alias("text"))
        terms = T.exploded_terms(asked, "query_id", "text", "q").distinct()
        few = terms.limit(most_terms + 1).collect()
        if len(few) > most_terms:
            return self._joined(terms, n, allowed)
        spark = self.held.sparkSession
        words = spark.createDataFrame([(w,) for w in {r.q for r in few}], "term string")
        df = {r.term: r["count"] for r in self.postings.join(F.broadcast(words), "term", "left_semi").groupBy("term").count().collect()}
        docs, total = self.counts()
        code = {w: k for k, w in enumerate(sorted(df))}
        pairs = sorted((code[r.q], r.query_id) for r in few if r.q in code)
        if not pairs:
            return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank bigint")
        at, qid = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        names, number = np.unique(qid, return_inverse=True)
        starts = np.searchsorted(at, np.arange(len(code) + 1))
        idf = np.array([math.log(1.0 + (docs - df[w] + 0.5) / (df[w] + 0.5)) for w in sorted(df)])
        shipped = spark.sparkContext.broadcast((code, starts, number, names, idf, total / docs))
        rows = self.held
        if allowed is not None:  # a document's rows stay together
            rows = rows.join(allowed.select(F.col("id").alias("ok")), F.col("id") == F.col("ok"), "left_semi").sortWithinPartitions("id")
        found = rows.where("term is not null").select("id", "dl", "term", "tf").mapInArrow(_best_documents(shipped, n), "query_id bigint, id bigint, score double")
        return ranked(found, n, [F.desc(F.round("score", 9)), F.col("id")])

    def _joined(self, terms: DataFrame, n: int, allowed: DataFrame | None) -> DataFrame:
        wanted = terms.select(F.col("q").alias("term")).distinct()
        hits = self.postings.join(wanted, "term", "left_semi")
        df = hits.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
        scored = hits.join(df, F.col("term") == F.col("t")).join(terms, F.col("term") == F.col("q")).crossJoin(F.broadcast(self.stats))
        if allowed is not None:
            scored = scored.join(allowed.select(F.col("id").alias("ok")), F.col("id") == F.col("ok"), "left_semi")
        idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf, average = F.col("tf").cast("double"), F.col("total").cast("double") / F.col("n")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1.0 - B + B * F.col("dl") / average))
        total = scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
        return ranked(total, n, [F.desc(F.round("score", 9)), F.col("id")])


def fuse(lists: list[DataFrame], n: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, rank, id): the sum of 1 / (k + rank); negative ids are no results,
    but their places count."""
    check_results(n)
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    every = lists[0].select("query_id", "rank", "id")
    for x in lists[1:]:
        every = every.union(x.select("query_id", "rank", "id"))
    total = every.where("id >= 0").groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"))
    return ranked(total, n, [F.desc(F.round("score", 12)), F.col("id")])


def hybrid(
    records: DataFrame, index: TextIndex, vectors: DataFrame, texts: DataFrame, n: int = 10, metric: str = "l2", where: Column | None = None,
    rrf_k: int = 60, candidate_multiplier: int = 4,
) -> DataFrame:
    """Vector and text candidates of the same queries, fused by rank; ``where`` filters both sides."""
    count = min(check_results(n) * between("candidate_multiplier", candidate_multiplier, 1, 2048), 2048)
    allowed = None if where is None else records.where(where).select("id")
    return fuse([nearest(records, vectors, count, metric, where), index.search(texts, count, allowed)], n, rrf_k)
