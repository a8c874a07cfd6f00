"""The k most similar vectors for every vector: anisotropic four-bit codes, table scans, exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import settle

#: Rows of a collection that one task searches; larger collections are split at coarse centroids.
BLOCK_ROWS = 32_768
#: Rows from which coarse centroids and codebooks are fitted, and queries by which the depth of a search is measured.
FIT_ROWS = 20_000
SAMPLE_QUERIES = 128
BORDER_QUERIES = 256
#: Components of coarse centroids that are sent to the executors (32 MB); beyond them blocks are larger.
CENTROID_COMPONENTS = 8_000_000
#: Centroids that a row is compared with; where there are more, those around the nearest of a coarser level.
NEAR_CENTROIDS = 512
#: Most repeated vectors that are broadcast, by their hashes.
MOST_HEAVY = 100_000
#: A block of so few rows is compared in full.
EXACT_ROWS = 512
#: Rows that every query scans at least, as far as its block has them.
LEAST_SCANNED = 4_500
#: A vector repeated more often than this share of a block within one collection leaves the search: see ``knn``.
HEAVY_SHARE = 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations from k distinct rows; an empty cell keeps its centroid."""
    k = min(k, len(x))
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(x.dtype)
    return c


def nearest(x: np.ndarray, c: np.ndarray, chunk: int = 8192) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[s : s + chunk] @ c.T).argmin(1) for s in range(0, max(len(x), 1), chunk)])


class AnisotropicCodes:
    """Four-bit product codes of residuals whose loss weighs the error along the vector ``eta`` times that across it."""

    def __init__(self, x: np.ndarray, residual: np.ndarray, threshold: float = 0.2, rounds: int = 3):
        n, d = x.shape
        self.sub = 1  # coordinates in a part: four bits for each
        self.m = -(-d // self.sub)
        self.m += self.m % 2  # two codes share a byte
        self.width = self.m * self.sub
        pad = lambda v: np.pad(v, ((0, 0), (0, self.width - d))).reshape(len(v), self.m, self.sub)
        r = pad(residual).astype(np.float32)
        norm = np.sqrt((x * x).sum(1))
        u = pad(x / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        step = max(1, -(-n // FIT_ROWS))
        fit_r, fit_u = r[::step], u[::step]
        self.books = np.zeros((self.m, 16, self.sub), np.float32)
        for j in range(self.m):
            book = kmeans(fit_r[:, j], 16, 6)
            self.books[j, : len(book)] = book
            self.books[j, len(book) :] = book[0]
        for _ in range(rounds):
            codes, error = self._assign(fit_r, fit_u, 1)
            self._refit(fit_r, fit_u, codes, error)
        self.codes, _ = self._assign(r, u, 1)
        pairs = self.codes.reshape(n, self.m // 2, 2)
        self.packed = np.ascontiguousarray(((pairs[:, :, 0] << 4) | pairs[:, :, 1]).T)  # a row of bytes for each pair of parts

    def _assign(self, r: np.ndarray, u: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(r)
        codes, part = np.zeros((n, self.m), np.uint8), np.zeros((n, self.m), np.float32)
        along = np.zeros(n, np.float32)
        for sweep in range(passes + 1):
            for j in range(self.m):
                left = r[:, j, None, :] - self.books[j][None]
                across = (left * left).sum(2)
                toward = np.einsum("ncs,ns->nc", left, u[:, j])
                rest = along - part[:, j]
                loss = across if sweep == 0 else across + (self.eta - 1) * (rest[:, None] + toward) ** 2
                best = loss.argmin(1)
                codes[:, j] = best
                new = toward[np.arange(n), best]
                along, part[:, j] = rest + new, new
        return codes, along

    def _refit(self, r: np.ndarray, u: np.ndarray, codes: np.ndarray, along: np.ndarray) -> None:
        """Each codeword's least squares under the same loss, part by part."""
        n, w = len(r), self.eta - 1
        for j in range(self.m):
            c, uj, rj = codes[:, j], u[:, j], r[:, j]
            toward = (uj * (rj - self.books[j][c])).sum(1)
            aim = along - toward + (uj * rj).sum(1)
            count = np.bincount(c, minlength=16)
            a = np.zeros((16, self.sub, self.sub))
            b = np.zeros((16, self.sub))
            for s in range(self.sub):
                b[:, s] = np.bincount(c, weights=rj[:, s] + w * uj[:, s] * aim, minlength=16)
                for t in range(self.sub):
                    a[:, s, t] = np.bincount(c, weights=w * uj[:, s] * uj[:, t], minlength=16) + (s == t) * count
            ok = count > 0
            new = self.books[j].copy()
            new[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
            along += (uj * (self.books[j][c] - new[c])).sum(1).astype(np.float32)
            self.books[j] = new

    def byte_tables(self) -> np.ndarray:
        """For each byte of a code, the coordinates that its 256 values stand for: (bytes, 256, 2 parts)."""
        low = np.broadcast_to(self.books[1::2, None], (self.m // 2, 16, 16, self.sub))
        high = np.broadcast_to(self.books[0::2, :, None], (self.m // 2, 16, 16, self.sub))
        return np.ascontiguousarray(np.concatenate([high, low], 3).reshape(self.m // 2, 256, 2 * self.sub))

    def scan(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The rows as their codes have them: one table look-up for each byte."""
        out = np.empty((len(rows), self.m // 2, 2 * self.sub), np.float32)
        for j in range(self.m // 2):
            out[:, j] = tables[j][self.packed[j, rows]]
        return out.reshape(len(rows), -1)


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, aim: float = 0.99, rerank: int = 128):
    """(query row, found row, squared distance) arrays: up to k rows for each query, without the query's own id.

    Equal vectors are one entry of the index and equal queries one search, so that copies neither crowd out other rows nor
    each other. The nearest k + 1 entries hold the nearest k rows of other ids, whatever id the query has itself.
    """
    n = len(x)
    if n <= EXACT_ROWS or not len(q):
        return _exact(ids, x, qids, q, k)
    by_id = np.argsort(ids, kind="stable")
    ids = ids[by_id]
    entry, copies = distinct(x[by_id])
    first = np.searchsorted(entry[copies], np.arange(entry.max() + 2))  # ``copies``: rows by entry, smaller ids first
    asked, same = distinct(q)
    of = np.searchsorted(asked[same], np.arange(asked.max() + 1))
    at, dist = _search_entries(x[by_id][copies[first[:-1]]], ids[copies[first[:-1]]], q[same[of]], k + 1, aim, rerank)
    # each entry found stands for the k + 1 smallest ids of its vector; each query takes its own id out of them
    place = first[at][:, :, None] + np.arange(k + 1)
    there = (place < first[at + 1][:, :, None]) & np.isfinite(dist)[:, :, None]
    rows = ids[copies[np.minimum(place, n - 1)]].reshape(len(at), -1)
    far = np.where(there, dist[:, :, None], np.inf).reshape(len(at), -1)
    take = np.lexsort((rows, far), axis=1)[:, : k + 1]
    rows, far = np.take_along_axis(rows, take, 1)[asked], np.take_along_axis(far, take, 1)[asked]
    ok = np.isfinite(far) & (rows != qids[:, None])
    ok &= ok.cumsum(1) <= k
    return np.nonzero(ok)[0], rows[ok], far[ok]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's vector, rows sorted by that number): equal vectors have one number, 0.0 and -0.0 are equal."""
    raw = np.ascontiguousarray(x + x.dtype.type(0))
    _, number = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)
    return number, np.argsort(number, kind="stable")


def _search_entries(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, aim: float, rerank: int):
    """(row of x, squared distance), queries x up to k: the nearest of distinct vectors, ties by smaller id.

    Cells of about sqrt(n) rows; the queries of one cell scan the codes of the nearest cells, and the best by approximate
    distance are ranked by the exact one. How many rows are scanned and how many ranked is measured: of some queries the
    nearest are found by brute force, and both numbers are such that the share ``aim`` of these comes out. Where vectors
    form no clusters that may be all rows. If so many are equally far that the last of the k is no nearer than the farthest
    one ranked, the query is compared with every row.
    """
    n, d = x.shape
    k = min(k, n)
    got, far = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf)
    if n <= EXACT_ROWS:
        for s in range(0, len(q), 512):
            got[s : s + 512], far[s : s + 512] = _every(x, ids, q[s : s + 512], k)
        return got, far
    centre = x.mean(0)
    xs, qs = (x - centre).astype(np.float32), (q - centre).astype(np.float32)
    nlist = max(1, int(np.sqrt(n)))
    fit = xs[:: max(1, -(-n // FIT_ROWS))]
    cells = kmeans(fit, nlist, 5)
    nlist = len(cells)
    at = nearest(xs, cells)
    order = np.argsort(at, kind="stable")
    ids, x, xs, at = ids[order], x[order], xs[order], at[order]
    starts = np.searchsorted(at, np.arange(nlist + 1))
    code = AnisotropicCodes(xs, xs - cells[at])
    bias = (xs * xs).sum(1) / 2  # kept exact beside the codes
    tables = code.byte_tables()
    near = squared(cells, cells).argsort(1)
    counts = np.diff(starts)
    home = nearest(qs, cells)
    enough, rerank = _depth(x, xs, q, qs, home, near, counts, at, bias, code.scan(np.arange(n), tables)[:, :d] + cells[at], k, aim, rerank)
    q_order = np.argsort(home, kind="stable")
    q_starts = np.searchsorted(home[q_order], np.arange(nlist + 1))
    for g in range(nlist):
        mine = q_order[q_starts[g] : q_starts[g + 1]]
        if not len(mine):
            continue
        reach = np.searchsorted(np.cumsum(counts[near[g]]), enough) + 1
        probed = near[g][:reach]
        rows = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in probed])
        # a table look-up for each byte of the codes, shared by all queries of the cell
        coded = code.scan(rows, tables)[:, :d] + cells[np.repeat(probed, counts[probed])]
        for s in range(0, len(mine), 256):
            part = mine[s : s + 256]
            score = bias[rows][None] - qs[part] @ coded.T
            r = min(max(rerank, k) + 1, len(rows))
            top = rows[np.argpartition(score, r - 1, axis=1)[:, :r]]
            gap = x[top].astype(np.float64)
            gap -= q[part][:, None, :]
            dist = np.einsum("qrd,qrd->qr", gap, gap)
            take = np.lexsort((ids[top], dist), axis=1)[:, :k]
            best = np.take_along_axis(dist, take, 1)
            found = np.take_along_axis(top, take, 1)
            tied = best[:, -1] >= dist.max(1)
            if r < n and tied.any():
                found[tied], best[tied] = _every(x, ids, q[part[tied]], k)
            got[part, : found.shape[1]], far[part, : found.shape[1]] = order[found], best
    return got, far


def _depth(x, xs, q, qs, home, near, counts, at, bias, coded, k, aim, rerank) -> tuple[int, int]:
    """(rows to scan, rows to rank): what finds the share ``aim`` of the nearest of a sample of the queries."""
    n = len(x)
    sample = np.unique(np.linspace(0, len(q) - 1, min(len(q), max(16, min(SAMPLE_QUERIES, n // 32)))).astype(int))
    dist = squared(q[sample].astype(np.float64), x.astype(np.float64))
    true = np.argpartition(dist, k - 1, axis=1)[:, :k]
    order = near[home[sample]]  # cells from the query's own outwards
    place = np.argsort(order, axis=1)
    reached = np.take_along_axis(np.cumsum(counts[order], axis=1), np.take_along_axis(place, at[true], 1), 1)
    score = bias[None] - qs[sample] @ coded.T
    own = np.take_along_axis(score, true, 1)
    better = np.stack([(score < own[:, j : j + 1]).sum(1) for j in range(k)], 1)
    each = 1 - (1 - aim) / 2
    return max(k, LEAST_SCANNED, int(np.quantile(reached, each, method="higher"))), max(rerank, k, int(np.quantile(better, each, method="higher")) + 1)


def _every(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int):
    """As ``_search_entries``, from the exact distances to all rows."""
    x64 = x.astype(np.float64)
    got, far = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
    for i, v in enumerate(q.astype(np.float64)):
        row = ((x64 - v) ** 2).sum(1)
        close = np.nonzero(row <= np.partition(row, k - 1)[k - 1])[0]
        got[i] = close[np.lexsort((ids[close], row[close]))[:k]]
        far[i] = row[got[i]]
    return got, far


def _exact(ids, x, qids, q, k):
    out_q, out_x, out_d = [], [], []
    x64 = x.astype(np.float64)
    for s in range(0, len(q), 512):
        part = np.arange(s, min(s + 512, len(q)))
        dist = np.maximum(squared(q[part].astype(np.float64), x64), 0)
        gap_own = ids[None] == qids[part][:, None]
        dist[gap_own] = np.inf
        r = min(len(ids), k + 8)
        top = np.argpartition(dist, r - 1, axis=1)[:, :r]
        bound = np.take_along_axis(dist, top, 1).max(1)
        # rows that tie with the last candidate might be cut off by the partition: such queries are sorted in full
        tied = (dist <= bound[:, None]).sum(1) > r
        gap = x64[top] - q[part][:, None, :]
        exact = np.einsum("qrd,qrd->qr", gap, gap)
        exact[ids[top] == qids[part][:, None]] = np.inf
        take = np.lexsort((ids[top], exact), axis=1)[:, :k]
        got, best = np.take_along_axis(top, take, 1), np.take_along_axis(exact, take, 1)
        for i in np.nonzero(tied)[0]:
            row = ((x64 - q[part[i]]) ** 2).sum(1)
            row[gap_own[i]] = np.inf
            full = np.lexsort((ids, row))[: got.shape[1]]
            got[i], best[i] = full, row[full]
        ok = np.isfinite(best)
        out_q.append(np.repeat(part, best.shape[1])[ok.ravel()])
        out_x.append(ids[got[ok]])
        out_d.append(best[ok])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


class Coarse:
    """Coarse centroids of one large collection; a row meets those around the nearest of a coarser level."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        c = len(centroids)
        self.tops = kmeans(centroids, int(np.sqrt(c)), 6) if c > NEAR_CENTROIDS else centroids.mean(0, keepdims=True)
        self.lists = np.argsort(squared(self.tops, centroids), axis=1)[:, :NEAR_CENTROIDS]

    def around(self, x: np.ndarray):
        """(rows, centroids, squared distances) for groups of rows, in pieces of bounded size."""
        top = nearest(x, self.tops)
        for t in np.unique(top):
            rows, cells = np.flatnonzero(top == t), self.lists[t]
            for s in range(0, len(rows), 8192):
                part = rows[s : s + 8192]
                yield part, cells, squared(x[part], self.centroids[cells])

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for rows, cells, dist in self.around(x):
            out[rows] = cells[dist.argmin(1)]
        return out

    def borders(self, x: np.ndarray):
        """(rows, blocks, ratios): for groups of rows and each block around, the distance to the plane between that block's
        centroid and the nearest one, over the distance to the nearest; 0 for the own block."""
        for rows, cells, dist in self.around(x):
            first = dist.argmin(1)
            own = np.maximum(np.take_along_axis(dist, first[:, None], 1), 1e-12)
            c = self.centroids[cells]
            between = np.sqrt(np.maximum(squared(c, c), 1e-12))[first]
            ratio = (dist - own) / (2 * between * np.sqrt(own))
            ratio[np.arange(len(rows)), first] = 0
            yield rows, cells, ratio


def _fit_by(rows: DataFrame, by: list[str], wanted) -> DataFrame:
    """(*by, c): centroids of each group's rows, ``wanted(key)`` of them."""

    def fit(key, t):
        key = tuple(k.as_py() for k in key)
        x = matrix(t.column("v"), key[1])
        x = x[np.argsort(t.column("id").to_numpy(), kind="stable")]
        c = kmeans(x[np.isfinite(x).all(1)], wanted(key), 8)
        cols = [pa.array([k] * len(c), kind) for k, kind in zip(key, (pa.string(), pa.int32(), pa.int64()))]
        return pa.Table.from_arrays([*cols, pa.array(list(c), pa.list_(pa.float32()))], names=[*by, "c"])

    kinds = ("g string", "dim int", "top bigint")[: len(by)]
    return rows.groupBy(*by).applyInArrow(fit, ", ".join([*kinds, "c array<float>"]))


def _centroids(in_big: DataFrame, blocks: dict[tuple, int]) -> dict[tuple, Coarse]:
    """Coarse centroids of each large collection, fitted on samples: ``in_big`` has n, the collection's rows.

    Up to NEAR_CENTROIDS are fitted at once. More are fitted around the centroids of a coarser level, each group of rows by a
    task of its own, from 16 rows of the sample for each.
    """
    picked = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = in_big.where(picked < F.lit(float(FIT_ROWS)) / F.col("n"))
    many = {b: c for b, c in blocks.items() if c > NEAR_CENTROIDS}
    found: dict[tuple, list] = {}
    for r in _fit_by(sample, ["g", "dim"], lambda key: int(np.sqrt(blocks[key])) if key in many else blocks[key]).collect():
        found.setdefault((r.g, r.dim), []).append(r.c)
    flat = {k: np.array(v, np.float32) for k, v in found.items()}
    if many:
        tops = in_big.sparkSession.sparkContext.broadcast({k: flat[k] for k in many if k in flat})

        def assign(batches):
            for b in batches:
                g, dim, v = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(3)
                offsets, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
                names, top = np.array(g, object), np.full(b.num_rows, -1)
                for (name, d), c in tops.value.items():
                    rows = np.flatnonzero((names == name) & (dim == d))
                    if len(rows):
                        top[rows] = nearest(values[offsets[rows][:, None] + np.arange(d)], c)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(top)], names=["g", "dim", "id", "v", "top"])

        each = {(g, dim): 16.0 * c for (g, dim), c in many.items()}
        sizes = in_big.sparkSession.createDataFrame([(g, dim, x) for (g, dim), x in each.items()], "sg string, sdim int, rows double")
        more = in_big.join(F.broadcast(sizes), (F.col("g") == F.col("sg")) & (F.col("dim") == F.col("sdim"))).where(picked < F.col("rows") / F.col("n"))
        placed = more.select("g", "dim", "id", "v").mapInArrow(assign, "g string, dim int, id bigint, v array<float>, top bigint").where("top >= 0")
        again: dict[tuple, list] = {}
        for r in _fit_by(placed, ["g", "dim", "top"], lambda key: max(1, int(np.sqrt(many[key[:2]])))).collect():
            again.setdefault((r.g, r.dim), []).append(r.c)
        flat |= {k: np.array(v, np.float32) for k, v in again.items()}
    return {k: Coarse(v) for k, v in flat.items()}


def _of_group(names: np.ndarray, dims: np.ndarray, v, name: str, d: int):
    """(rows, vectors) of a batch that belong to a collection and have finite components."""
    rows = np.flatnonzero((names == name) & (dims == d))
    x = v.values.to_numpy(zero_copy_only=False)[v.offsets.to_numpy()[rows][:, None] + np.arange(d)]
    fine = np.isfinite(x).all(1)
    return rows[fine], x[fine]


def _reach(in_big: DataFrame, coarse, k: int, aim: float) -> float:
    """The border ratio up to which a row must be searched in other blocks: measured on BORDER_QUERIES rows, whose nearest
    are found by brute force over all rows."""
    spark = in_big.sparkSession
    total = in_big.count()
    picked = in_big.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(min(1.0, BORDER_QUERIES / max(total, 1)) * (1 << 30)))
    asked: dict[tuple, list] = {}
    for r in picked.select("g", "dim", "id", "v").limit(2 * BORDER_QUERIES).collect():
        asked.setdefault((r.g, r.dim), []).append((r.id, r.v))
    queries = {}
    for (g, dim), rows in asked.items():
        x = np.array([v for _, v in rows], np.float32)
        fine = np.isfinite(x).all(1)
        if fine.any():
            queries[g, dim] = np.array([i for i, _ in rows])[fine], x[fine]
    shipped = spark.sparkContext.broadcast(queries)

    def meet(batches):
        for b in batches:
            g, dim, ids, v = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            names = np.array(g.to_pylist(), object)
            for (name, d), (qids, q) in shipped.value.items():
                rows, x = _of_group(names, dim, v, name, d)
                if not len(rows):
                    continue
                dist = np.maximum(squared(q.astype(np.float64), x.astype(np.float64)), 0)
                dist[qids[:, None] == ids[rows][None]] = np.inf
                top = np.argpartition(dist, min(k, len(rows)) - 1, axis=1)[:, :k]
                block = coarse.value[name, d].home(x)
                n, m = top.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (n * m)), pa.array(np.full(n * m, d, np.int32)), pa.array(np.repeat(qids, m)), pa.array(np.take_along_axis(dist, top, 1).ravel()), pa.array(block[top].ravel()), pa.array(ids[rows][top].ravel())],
                    names=["g", "dim", "q", "distance", "block", "id"],
                )

    met = in_big.select("g", "dim", "id", "v").mapInArrow(meet, "g string, dim int, q bigint, distance double, block bigint, id bigint")
    w = Window.partitionBy("g", "dim", "q").orderBy("distance", "id")
    best = met.where("distance < double('inf')").dropDuplicates(["g", "dim", "q", "id"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    needs = []
    near: dict[tuple, list] = {}
    for r in best.select("g", "dim", "q", "block").collect():
        near.setdefault((r.g, r.dim), []).append((r.q, r.block))
    for key, pairs in near.items():
        qids, q = queries[key]
        ratio = np.full((len(qids), len(coarse.value[key].centroids)), np.inf)
        for rows, cells, part in coarse.value[key].borders(q):
            ratio[rows[:, None], cells[None]] = part
        at = {i: j for j, i in enumerate(qids.tolist())}
        needs += [ratio[at[i], b] for i, b in pairs]
    return float(np.quantile(needs, aim, method="higher")) if needs else 0.0


def knn(
    records: DataFrame, key: str, vector: str, group: str, k: int = 5, aim: float = 0.99, rerank: int = 128,
    block_rows: int = BLOCK_ROWS, queries=None, every_block: bool = False,
) -> DataFrame:
    """(id, neighbour, distance, shared): for each key its k nearest rows of the same ``group`` by squared L2.

    A group of up to ``block_rows`` rows is one task. A larger one is split at coarse centroids (fitted on a bounded
    sample, every row is indexed): each row is searched in its own block and in all others whose border is as close as the
    share ``aim`` of the nearest rows of a sample of queries asks for, and its best k overall come out (``shared`` marks such
    rows). How deep a block is searched is measured in it, with the same aim. A vector that one large group repeats
    very often needs no search: any k others of its copies are at distance 0, so its rows get the smallest ids among them
    and only k + 1 of them stay in the index. ``queries``: a condition on ``id`` for the rows to search for, default all.
    ``every_block``: each row is compared with every row of its group, whatever its block: the yardstick of the index.

    Rows whose group, key or vector is NULL or whose vector has a component that isn't finite take no part; repeats of a
    key count once; vectors of another length form a group of their own; ties go to the smaller key; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = records.sparkSession
    rows = records.select(
        F.col(group).cast("string").alias("g"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")
    ).where("g is not null and id is not null and v is not null and size(v) > 0")
    rows = rows.select("g", "id", F.size("v").alias("dim"), "v")
    big = {(r.g, r.dim): r.n for r in rows.groupBy("g", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).collect()}
    heavy_pairs = None
    coarse: dict[tuple, Coarse] = {}
    if big:
        size = max(block_rows, -(-sum(n * dim for (_, dim), n in big.items()) // CENTROID_COMPONENTS))
        names = spark.createDataFrame([(g, dim, n) for (g, dim), n in big.items()], "bg string, bdim int, n bigint")
        in_big = rows.join(F.broadcast(names), (F.col("g") == F.col("bg")) & (F.col("dim") == F.col("bdim"))).select("g", "dim", "id", "v", "n")
        least = max(k + 2, block_rows // HEAVY_SHARE)
        heavy = in_big.groupBy("g", F.xxhash64("v").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > least)
        heavy_n = heavy.limit(MOST_HEAVY + 1).count()
        if heavy_n:
            side = heavy.select(F.col("g").alias("hg"), "h")
            side = F.broadcast(side) if heavy_n <= MOST_HEAVY else side
            same = (F.col("g") == F.col("hg")) & (F.xxhash64("v") == F.col("h"))
            copies = rows.join(side, same, "left_semi")
            tagged = copies.join(_smallest(copies, k + 1), ["g", "v"])
            near = F.slice(F.filter("firsts", lambda i: i != F.col("id")), 1, k)
            tagged_asked = tagged if queries is None else tagged.where(queries(F.col("id")))
            heavy_pairs = tagged_asked.select("id", F.explode(near).alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(True).alias("shared"))
            kept = tagged.where(F.array_contains("firsts", F.col("id"))).select("g", "id", "dim", "v")
            rows = rows.join(side, same, "left_anti").union(kept)
        coarse = _centroids(in_big, {b: -(-n // size) for b, n in big.items()})
    shipped = spark.sparkContext.broadcast(coarse)
    reach = _reach(in_big, shipped, k, aim) if big and not every_block else float("inf")
    rows = rows.withColumn("ask", F.lit(True) if queries is None else queries(F.col("id")))

    def place(batches):
        for b in batches:
            g, ids, dim, v, asked = (b.column(i) for i in range(5))
            asks = np.array(asked.to_pylist(), bool)
            block = np.zeros(b.num_rows, np.int64)
            more_rows, more_blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if shipped.value:
                names, dims = np.array(g.to_pylist(), object), dim.to_numpy()
                for (name, d), c in shipped.value.items():
                    rows_of, x = _of_group(names, dims, v, name, d)
                    if not len(rows_of) or len(c.centroids) < 2:
                        continue
                    if every_block:
                        home = c.home(x)
                        block[rows_of] = home
                        i, other = np.nonzero(np.arange(len(c.centroids))[None] != home[:, None])
                        take = asks[rows_of[i]]
                        more_rows.append(rows_of[i[take]])
                        more_blocks.append(other[take])
                        continue
                    for part, cells, ratio in c.borders(x):
                        first = ratio.argmin(1)
                        block[rows_of[part]] = cells[first]
                        close = (ratio <= reach) & asks[rows_of[part]][:, None]
                        close[np.arange(len(part)), first] = False
                        i, other = np.nonzero(close)
                        more_rows.append(rows_of[part[i]])
                        more_blocks.append(cells[other])
            take, others = np.concatenate(more_rows), np.concatenate(more_blocks)
            shared = np.zeros(b.num_rows, bool)
            shared[take] = True
            yield pa.RecordBatch.from_arrays(
                [g, ids, dim, v, pa.array(block), pa.array(np.zeros(b.num_rows, bool)), pa.array(shared), pa.array(asks)],
                names=["g", "id", "dim", "v", "block", "guest", "shared", "ask"],
            )
            for s in range(0, len(take), 8192):
                at = pa.array(take[s : s + 8192])
                yes = pa.array(np.ones(len(at), bool))
                yield pa.RecordBatch.from_arrays(
                    [g.take(at), ids.take(at), dim.take(at), v.take(at), pa.array(others[s : s + 8192]), yes, yes, yes], names=["g", "id", "dim", "v", "block", "guest", "shared", "ask"]
                )

    placed = rows.select("g", "id", "dim", "v", "ask").mapInArrow(place, "g string, id bigint, dim int, v array<float>, block bigint, guest boolean, shared boolean, ask boolean")

    def search(key, t):
        dim = key[1].as_py()
        ids, guest, shared, ask = (t.column(c).to_numpy() for c in ("id", "guest", "shared", "ask"))
        x = matrix(t.column("v"), dim)
        order = np.lexsort((guest, ids))
        order = order[np.isfinite(x[order]).all(1)]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (guest[order][1:] != guest[order][:-1])
        order = order[fresh]
        ids, guest, shared, ask, x = ids[order], guest[order], shared[order], ask[order], x[order]
        own = ~guest
        if not own.any() or not ask.any():
            return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "shared": pa.array([], pa.bool_())})
        qids, q, qshared = ids[ask], x[ask], shared[ask]
        if every_block:
            at, found, dist = _exact(ids[own], x[own], qids, q, k)
        else:
            at, found, dist = search_block(ids[own], x[own], qids, q, k, aim, rerank)
        return pa.table({"id": qids[at], "neighbour": found, "distance": dist, "shared": qshared[at]})

    got = placed.groupBy("g", "dim", "block").applyInArrow(search, "id bigint, neighbour bigint, distance double, shared boolean")
    if not big:
        return got
    got = settle(got, "nearest")  # read twice below; the search must not run twice
    return _best(got, k) if heavy_pairs is None else _best(got, k, heavy_pairs)


def _smallest(copies: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each repeated vector; the group limit of the window works before the shuffle."""
    w = Window.partitionBy("g", "v").orderBy("id")
    top = copies.select("g", "v", "id").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("g", "v").agg(F.array_sort(F.collect_list("id")).alias("firsts"))


def _best(got: DataFrame, k: int, more: DataFrame | None = None) -> DataFrame:
    alone, several = got.where("not shared"), got.where("shared")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    merged = several.dropDuplicates(["id", "neighbour"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    out = alone.union(merged)
    return out if more is None else out.join(more.select(F.col("id").alias("hid")).distinct(), F.col("id") == F.col("hid"), "left_anti").union(more)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once each."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
