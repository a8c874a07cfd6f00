"""Evaluation texts in training text: latent semantic retrieval of passages that cannot miss, then exact checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..util import settle
from .lookalike import folded_form

#: Characters of evaluation items that are searched for at once: they and their vectors go to every executor. More are
#: searched for in several passes over the documents.
ITEM_CHARS = 20_000_000


def plain_words(text: str) -> list[str]:
    """The analyzer's words of ``text`` with one letter for all that look alike. Letters are folded as they stand, before the
    analyzer lower-cases them."""
    return T.python_words(folded_form(text))


def windows(n: int, run: int) -> list[tuple[int, int]]:
    """Places of passages of 2 * run words, a run apart: each run of ``run`` words lies wholly within one."""
    return [(s, min(n, s + 2 * run)) for s in range(0, n - run + 1, run)]


def _encoded(vocabulary, run: int, whole: bool = False):
    """Texts to stretches of at least ``run`` words that items have too, and per partition in how many texts each occurs.

    With ``whole`` a text is one stretch, in which -1 stands for the words that no item has.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary.value
        found, texts, kind = np.zeros(len(code), np.int64), 0, None
        for b in batches:
            kind = b.column(0).type
            at, codes = [], []
            keys = b.column(0)
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text:
                    continue
                texts += 1
                got = np.array([code.get(w, -1) for w in plain_words(text)], np.int64)
                known = got >= 0
                found[np.unique(got[known])] += 1
                if whole:
                    if known.any():
                        at.append(i)
                        codes.append(got.astype(np.int32))
                    continue
                edge = np.flatnonzero(np.diff(np.r_[0, known.astype(np.int8), 0]))
                for s, e in zip(edge[::2], edge[1::2]):
                    if e - s >= run:
                        at.append(i)
                        codes.append(got[s:e].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(codes, pa.list_(pa.int32())), pa.array([None] * len(at), pa.list_(pa.int64()))],
                names=["key", "codes", "df"],
            )
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], kind), pa.array([[texts]], pa.list_(pa.int32())), pa.array([found.tolist()], pa.list_(pa.int64()))],
                names=["key", "codes", "df"],
            )

    return go


def _idf(counts: DataFrame, n: int) -> np.ndarray:
    df = np.zeros(n)
    for r in counts.select(F.posexplode("df").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n")).collect():
        df[r.w] = r.n
    total = counts.agg(F.coalesce(F.sum(F.element_at("codes", 1)), F.lit(0))).first()[0]
    return np.log((total + 1) / (df + 1)) + 0.1


def _presence(rows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of distinct words weighted by idf: (row, word, weight)."""
    unique = [np.unique(r) for r in rows]
    unique = [u[1:] if len(u) and u[0] < 0 else u for u in unique]  # -1 stands for words that no item has
    row = np.repeat(np.arange(len(unique)), [len(u) for u in unique])
    word = np.concatenate(unique) if unique else np.zeros(0, np.int64)
    return row, word, idf[word]


def _times(rows: list[np.ndarray], idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    row, word, weight = _presence(rows, idf)
    if not len(row):
        return np.zeros((len(rows), right.shape[1]))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    out = np.zeros((len(rows), right.shape[1]))
    out[row[starts]] = np.add.reduceat(right[word] * weight[:, None], starts, 0)
    return out


def _chopped(batches, run):
    for b in batches:
        keys, rows = [], []
        for i, c in enumerate(b.column(1).to_pylist()):
            c = np.array(c, np.int64)
            for s, e in windows(len(c), run):
                keys.append(i)
                rows.append(c[s:e])
        for s in range(0, len(rows), 2048):
            yield b.column(0).take(pa.array(keys[s : s + 2048], pa.int64())), rows[s : s + 2048]


def latent_basis(passages: DataFrame, item_rows: list[np.ndarray], idf: np.ndarray, rank: int, run: int, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of all passages, by randomised subspace iteration.

    Each round multiplies the current words x (rank + 16) block by the passages' Gram matrix: tasks hold their passages'
    part of the product, parts are summed by blocks of words, and the driver holds only the sum.
    """
    spark = passages.sparkSession
    width = min(rank + 16, len(idf))
    block = 512
    y = np.random.default_rng(11).standard_normal((len(idf), width))
    for _ in range(rounds):
        q = spark.sparkContext.broadcast(np.linalg.qr(y)[0])
        weights = idf

        def product(batches, q=q, weights=weights):
            total = np.zeros_like(q.value)
            seen = False
            for _, rows in _chopped(batches, run):
                seen = True
                row, word, weight = _presence(rows, weights)
                left = _times(rows, weights, q.value)
                order = np.argsort(word, kind="stable")
                row, word, weight = row[order], word[order], weight[order]
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                total[word[starts]] += np.add.reduceat(left[row] * weight[:, None], starts, 0)
            if seen:
                for s in range(0, len(total), block):
                    part = total[s : s + block]
                    if part.any():
                        yield pa.RecordBatch.from_pydict({"at": pa.array([s]), "part": pa.array([part.tobytes()], pa.binary())})

        def add(key, t):
            total = sum(np.frombuffer(x, np.float64) for x in t.column("part").to_pylist())
            return pa.table({"at": pa.array([key[0].as_py()]), "part": pa.array([total.tobytes()], pa.binary())})

        parts = passages.mapInArrow(product, "at bigint, part binary").groupBy("at", ).applyInArrow(add, "at bigint, part binary").collect()
        y = np.zeros((len(idf), width))
        for r in parts:
            y[r.at : r.at + block] = np.frombuffer(r.part, np.float64).reshape(-1, width)
        row, word, weight = _presence(item_rows, idf)
        left = _times(item_rows, idf, q.value)
        np.add.at(y, word, left[row] * weight[:, None])
        q.unpersist()
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    return u[:, : min(rank, width)]


def _in_parts(items: DataFrame, item_key: str, item_text: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over the items, or over parts of them of a bounded size in turn."""
    chars = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-chars // ITEM_CHARS))
    part = F.pmod(F.xxhash64(item_key), F.lit(parts))
    found = [search(items if parts == 1 else items.where(part == k)) for k in range(parts)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, rank: int = 192,
) -> DataFrame:
    """(doc, item, words): documents that have ``run`` words in a row in common with an item; ``words``: the longest run.

    Passages of 2 * run words, a run apart, are TF-IDF vectors x over the items' words, and a randomised SVD of all of them
    gives a latent space P. An item passage a that shares a run with x has x.a >= t(a), the least idf mass of a run of a.
    Latent vectors give x.a up to the parts outside P: x.a <= Px.Pa + |x - Px| |a - Pa|. So every pair whose bound reaches
    t(a) is a candidate, none that shares a run can be missed at any rank (rank only sets how many others come along), and
    candidates are compared word by word. Passages are cut only from stretches of words that items have.

    NULL and empty texts have no words and match nothing; texts shorter than a run neither; repeated documents each come
    out; NULL keys come out as NULL; other columns are ignored; empty tables give an empty result.
    """
    return _in_parts(items, item_key, item_text, lambda some: _leaks(docs, key, text, some, item_key, item_text, run, rank))


def _leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int, rank: int) -> DataFrame:
    spark, kind, item_kind = docs.sparkSession, dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    out = f"doc {kind}, item {item_kind}, words int"
    rows = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("t is not null").collect()
    texts = [(r.k, plain_words(r.t)) for r in rows]
    texts = [(k, w) for k, w in texts if len(w) >= run]
    code = {w: i for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    if not code:
        return spark.createDataFrame([], out)
    encoded = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _encoded(spark.sparkContext.broadcast(code), run), f"key {kind}, codes array<int>, df array<bigint>"
    )
    encoded = settle(encoded, "stretches")
    idf = _idf(encoded.where("df is not null"), len(code))
    passages = encoded.where("df is null").select("key", "codes")

    item_codes = [(k, np.array([code[w] for w in ws], np.int64)) for k, ws in texts]
    item_at, item_rows, least = [], [], []
    for i, (_, c) in enumerate(item_codes):
        for s, e in windows(len(c), run):
            item_at.append(i)
            item_rows.append(c[s:e])
            mass = [(idf[np.unique(c[p : p + run])] ** 2).sum() for p in range(s, min(s + run, e - run + 1))]
            least.append(min(mass))
    basis = latent_basis(passages, item_rows, idf, rank, run)
    inside = _times(item_rows, idf, basis)
    norm2 = np.bincount(np.repeat(np.arange(len(item_rows)), [len(np.unique(r)) for r in item_rows]), weights=_presence(item_rows, idf)[2] ** 2)
    outside = np.sqrt(np.maximum(norm2 - (inside**2).sum(1), 0))
    shipped = spark.sparkContext.broadcast((basis, inside, outside, np.array(least), np.array(item_at), item_rows, idf, item_codes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, inside, outside, least, item_at, item_rows, idf, item_codes = shipped.value
        keys_of_items = [k for k, _ in item_codes]
        item_runs = [run_keys(r, run) for r in item_rows]
        for b in batches:
            docs_, items_, lengths = [], [], []
            keys = b.column(0)
            stretches = [np.array(c, np.int64) for c in b.column(1).to_pylist()]
            at, rows = [], []
            for i, c in enumerate(stretches):
                for s, e in windows(len(c), run):
                    at.append(i)
                    rows.append(c[s:e])
            hits: set[tuple[int, int]] = set()
            for s in range(0, len(rows), 1024):
                part = rows[s : s + 1024]
                z = _times(part, idf, basis)
                row, _, weight = _presence(part, idf)
                full = np.bincount(row, weights=weight**2, minlength=len(part))
                rest = np.sqrt(np.maximum(full - (z * z).sum(1), 0))
                bound = z @ inside.T + rest[:, None] * outside[None]
                near = bound >= least[None] * (1 - 1e-9) - 1e-9
                for x in np.flatnonzero(near.any(1)):
                    mine = run_keys(part[x], run)
                    for a in np.flatnonzero(near[x]):
                        if not mine.isdisjoint(item_runs[a]):
                            hits.add((at[s + x], int(item_at[a])))
            for i, a in sorted(hits):
                docs_.append(i)
                items_.append(keys_of_items[a])
                lengths.append(longest_run(stretches[i], item_codes[a][1]))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(docs_, pa.int64())), pa.array(items_), pa.array(lengths, pa.int32())] if docs_ else
                [keys.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int32())],
                names=["doc", "item", "words"],
            )

    found = passages.mapInArrow(search, f"doc {kind}, item {item_kind}, words int")
    return found.groupBy("doc", "item").agg(F.max("words").alias("words"))


def paraphrases(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, rank: int = 192, cosine: float = 0.6,
    in_order: float = 0.6, answers: int = 4, answered: float = 0.75,
) -> DataFrame:
    """(doc, item, cosine, in_order, answered): documents with a passage that says what an item says in other words.

    Passages of 2 * ``run`` words, ``run`` apart, of whole texts are TF-IDF vectors; words that no item has count in their
    length only. Their randomised SVD gives the latent space, in which each passage is compared with those of the items. A
    candidate has the cosine ``cosine`` there. Of a candidate, the longest common subsequence must hold ``in_order`` of the
    item passage's words, and ``answered`` of its answer must stand in the passage: the ``answers`` words of the item passage
    that fewest documents have, numbers and names as a rule. The best passage of a pair comes out.

    Passages whose item words can't reach the cosine whatever they are drop out before the product, which is exact. Items
    are a bounded set for the executors, documents only pass by. Other cases are as for ``leaks``; texts that share
    ``run`` words in a row come out as well where they pass the same checks.
    """
    return _in_parts(items, item_key, item_text, lambda some: _paraphrases(docs, key, text, some, item_key, item_text, run, rank, cosine, in_order, answers, answered))


def _paraphrases(docs, key, text, items, item_key, item_text, run, rank, cosine, in_order, answers, answered) -> DataFrame:
    spark, kind, item_kind = docs.sparkSession, dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    out = f"doc {kind}, item {item_kind}, cosine double, in_order double, answered double"
    rows = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("t is not null").collect()
    texts = [(r.k, w) for r in rows if len(w := plain_words(r.t)) >= run]
    code = {w: i for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    if not code:
        return spark.createDataFrame([], out)
    encoded = settle(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(_encoded(spark.sparkContext.broadcast(code), run, whole=True), f"key {kind}, codes array<int>, df array<bigint>"), "texts",
    )
    idf = _idf(encoded.where("df is not null"), len(code))
    foreign = float(np.mean(idf**2))
    passages = encoded.where("df is null").select("key", "codes")
    item_at, item_rows, wanted = [], [], []
    for i, (_, ws) in enumerate(texts):
        c = np.array([code[w] for w in ws], np.int64)
        for s, e in windows(len(c), run):
            item_at.append(i)
            item_rows.append(c[s:e])
            u = np.unique(c[s:e])
            wanted.append(u[np.lexsort((u, -idf[u]))][:answers])
    basis = latent_basis(passages, item_rows, idf, rank, run)
    inside = _times(item_rows, idf, basis)
    inside /= np.maximum(np.sqrt((inside**2).sum(1, keepdims=True)), 1e-12)
    shipped = spark.sparkContext.broadcast((basis, inside, item_at, item_rows, wanted, idf, [k for k, _ in texts]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, inside, item_at, item_rows, wanted, idf, names = shipped.value
        weight2 = np.append(idf**2, foreign)
        for b in batches:
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            at, rows = [], []
            for i, c in enumerate(b.column(1).to_pylist()):
                c = np.array(c, np.int64)
                mass = weight2[c]  # -1 is the last
                for s, e in windows(len(c), run) or [(0, len(c))]:
                    known = c[s:e] >= 0
                    # a passage of which words of items hold too small a part can't reach the cosine
                    if mass[s:e][known].sum() >= cosine**2 * mass[s:e].sum():
                        at.append(i)
                        rows.append(c[s:e])
            for s in range(0, len(rows), 1024):
                part = rows[s : s + 1024]
                z = _times(part, idf, basis)
                row, _, weight = _presence(part, idf)
                full = np.bincount(row, weights=weight**2, minlength=len(part)) + foreign * np.array([np.count_nonzero(r < 0) for r in part])
                near = (z @ inside.T) / np.sqrt(np.maximum(full, 1e-12))[:, None]
                for x, a in zip(*np.nonzero(near >= cosine)):
                    got = np.isin(wanted[a], part[x]).mean()
                    if got < answered:
                        continue
                    order = common_subsequence(part[x], item_rows[a]) / len(item_rows[a])
                    if order >= in_order:
                        pair, value = (at[s + x], int(item_at[a])), (float(near[x, a]), float(order), float(got))
                        best[pair] = max(best.get(pair, value), value)
            found = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for (i, _), _ in found], pa.int64())), pa.array([names[a] for (_, a), _ in found] or [], None if found else pa.int64()),
                 *[pa.array([v[j] for _, v in found], pa.float64()) for j in range(3)]],
                names=["doc", "item", "cosine", "in_order", "answered"],
            )

    found = passages.mapInArrow(search, out)
    best = F.max(F.struct("cosine", "in_order", "answered")).alias("b")
    return found.groupBy("doc", "item").agg(best).select("doc", "item", "b.*")


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, one row of the table for each word of ``a``; -1 matches nothing."""
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        if w >= 0:
            longer = np.where(b == w, row[:-1] + 1, 0)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], longer))
    return int(row[-1])


def run_keys(words: np.ndarray, run: int) -> frozenset[bytes]:
    """Every run of ``run`` word numbers as bytes: two passages share a run just when these sets meet."""
    words = np.ascontiguousarray(words, np.int32)
    return frozenset(words[s : s + run].tobytes() for s in range(len(words) - run + 1))


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The longest run of equal words, by one row of run lengths for each word of ``a``."""
    best, row = 0, np.zeros(len(b) + 1, np.int32)
    for w in a:
        row[1:] = np.where(b == w, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best
