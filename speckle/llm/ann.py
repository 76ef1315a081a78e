"""Nearest neighbours by inverted lists, product-quantised residuals, asymmetric tables and exact reranking.

What the index misses is added by an exact check of the rows that a bound on their inner product leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speckle.llm import _common as c

#: Vectors that the index is fitted on, at most: those of the least hash of their id. Every vector is indexed.
SAMPLE_ROWS, SUBSPACES, CODES, ROUNDS, SEED = 16384, 16, 256, 8, 11
#: Sample vectors that a cell is fitted on, at least; queries tried on the sample, and the share of their neighbours in
#: it that the cells probed, and the rows reranked, must hold.
CELL_ROWS, TRIALS, TARGET = 32, 256, 0.97
#: Rows of a block that are reranked exactly for a query, at least.
K, SHORTLIST = 20, 300
#: Vectors and queries that one task compares at once, on average.
BLOCK_ROWS, BLOCK_QUERIES, BATCH_QUERIES = 16384, 8192, 64
#: Inner products that a task of the exact check holds at once, and pairs whose products it sums exactly at once; rows
#: of queries that are sent to blocks at once.
PRODUCTS, RERANKED, SENT_ROWS = 1 << 20, 8192, 4096


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow or underflow of squares; infinite where a row is not finite."""
    top = np.abs(x).max(1)
    out = top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))
    return np.where(np.isnan(out), np.inf, out)


def rounding(dim: int) -> float:
    """What rounding may add to an inner product of this many terms, as a share of the product of lengths."""
    return 8 * (dim + 8) * float(np.finfo(float).eps)


class Index:
    """Coarse centroids and, for each subspace of the residuals, a codebook."""

    def __init__(self, sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centres = kmeans(sample, cells, rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = [p for p in np.array_split(np.arange(self.dim), min(subspaces, self.dim)) if len(p)]
        self.books = [kmeans(rest[:, p], codes, rng) for p in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([nearest(rest[:, p], b) for p, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells from the largest inner product with each query on."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def fit(self, q: np.ndarray, q_id: np.ndarray, sample: np.ndarray, x_id: np.ndarray, k: int, target: float = TARGET) -> tuple[int, int]:
        """The least number of cells, and of best rows by asymmetric tables, that hold `target` of the queries' k nearest in the sample."""
        own = q_id[:, None] == x_id[None]
        k = min(k, len(sample) - 1)
        if k < 1 or not len(q):
            return len(self.centres), 1
        near = np.argpartition(np.where(own, np.inf, -(q @ sample.T)), k - 1, axis=1)[:, :k]
        cell, codes = self.encode(sample)
        approx = (q @ self.centres.T).astype("f4")[:, cell]
        for m, (p, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            approx += (q[:, p] @ book.T).astype("f4")[:, codes[:, m]]
        approx[own] = -np.inf
        at = np.arange(len(q))[:, None]
        asked = np.argsort(self.order(q), axis=1)[at, cell[near]], np.argsort(np.argsort(-approx, axis=1, kind="stable"), axis=1)[at, near]
        need = [np.sort(a.ravel()) for a in asked]
        return tuple(int(n[min(len(n) - 1, int(np.ceil(target * len(n))) - 1)]) + 1 for n in need)

    def search(self, q: np.ndarray, q_id: np.ndarray, asks: np.ndarray, cells: np.ndarray, cuts: np.ndarray, codes: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, shortlist: int):
        """(query index, rows, exact scores) of each query's best rows of a block's cells.

        Rows from cuts[i] to cuts[i + 1] are of cells[i], which the queries of asks[:, i] want. The `shortlist` best by
        asymmetric tables are reranked; ties go to the first rows.
        """
        tables = [(q[:, p] @ book.T).astype("f4") for p, book in zip(self.cuts, self.books, strict=True)]
        approx = np.full((len(q), len(x)), -np.inf, "f4")
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            mine = np.nonzero(asks[:, i])[0]
            if len(mine):
                a = np.repeat((q[mine] @ self.centres[cells[i]]).astype("f4")[:, None], hi - lo, 1)
                for m, t in enumerate(tables):
                    a += np.take(t[mine], codes[lo:hi, m], axis=1)
                approx[mine, lo:hi] = a
        approx[q_id[:, None] == x_id[None]] = -np.inf
        for i, a in enumerate(approx):
            top = np.nonzero(np.isfinite(a))[0]
            if len(top) > shortlist:
                b = a[top]
                least = np.partition(b, len(b) - shortlist)[len(b) - shortlist]
                above = np.nonzero(b > least)[0]
                top = top[np.concatenate([above, np.nonzero(b == least)[0][: shortlist - len(above)]])]
            exact = (x[top] * q[i]).sum(1)
            best = np.lexsort([x_id[top], -exact])[:k]
            yield i, top[best], exact[best]


def missed(index: Index, q: np.ndarray, q_id: np.ndarray, least: np.ndarray, had: tuple[np.ndarray, np.ndarray], asks: np.ndarray, cells: np.ndarray, cuts: np.ndarray, far: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, k: int):
    """(query indices, rows, exact scores): the queries' k best rows of a block that score `least` or more and are new.

    Rows of a cell lie from cuts[i] to cuts[i + 1], the farthest from the centre first. q.x is at most q.c + |q||x - c|,
    so the nearer ones are left out where this is below `least`. had: query indices, and keys of rows found before.
    """
    size, off = norms(q), rounding(index.dim)
    by_key = np.argsort(x_row)
    at = by_key[np.minimum(np.searchsorted(x_row, had[1], sorter=by_key), len(x) - 1)]
    here = x_row[at] == had[1]
    old = np.sort(np.append(had[0][here] * len(x) + at[here], -1))
    got, n_got = [], 0

    def best():
        one, rows, exact = (np.concatenate(g) for g in zip(*got))
        order = np.lexsort([x_id[rows], -exact, one])
        start = np.searchsorted(one[order], one[order])
        order = order[np.arange(len(order)) - start < k]
        return one[order], rows[order], exact[order]

    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        mine = np.nonzero(asks[:, i])[0]
        centre = index.centres[cells[i]]
        slack = off * (norms(centre[None])[0] + far[lo])
        need = (least[mine] - q[mine] @ centre) / size[mine] - slack
        n = np.searchsorted(-far[lo:hi], -np.where(np.isfinite(need), need, -np.inf), "right")
        mine, n = mine[np.argsort(-n, kind="stable")], -np.sort(-n)
        done = 0
        while done < len(mine) and n[done]:
            end = lo + n[done]
            some = mine[done : done + max(1, PRODUCTS // n[done])]
            done += len(some)
            j, rows = np.nonzero(~(q[some] @ x[lo:end].T < (least[some] - size[some] * slack)[:, None]))
            one, rows = some[j], lo + rows
            pair = one * len(x) + rows
            new = (q_id[one] != x_id[rows]) & (old[np.searchsorted(old, pair, "right") - 1] != pair)
            one, rows = one[new], rows[new]
            for a in range(0, len(one), RERANKED):
                o, r = one[a : a + RERANKED], rows[a : a + RERANKED]
                exact = (x[r] * q[o]).sum(1)
                good = exact >= least[o]
                got.append((o[good], r[good], exact[good]))
                n_got += int(good.sum())
            if n_got > PRODUCTS + k * len(q):
                got = [best()]
                n_got = len(got[0][0])
    return best() if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows with an id and a vector that is neither null, empty nor zero and is finite throughout."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(good)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _blocks(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share a block, large ones are dealt to several."""
    first, parts, block, full = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows)), 0, 0
    for i, n in enumerate(sizes):
        if full and full + n > rows:
            block, full = block + 1, 0
        first[i], full = block, full + n
        if parts[i] > 1:
            block, full = block + parts[i], 0
    return first, parts


def _asks(near: list, first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(query index, block, cells) of every block that holds some of the cells that a query wants."""
    rows, blocks, wanted = [], [], []
    for i, cells in enumerate(near):
        cell = np.repeat(cells, parts[cells])
        block = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
        for one in np.unique(block):
            rows.append(i)
            blocks.append(one)
            wanted.append(np.sort(cell[block == one]).astype(np.int32))
    return np.array(rows, np.int64), np.array(blocks, np.int64), wanted


def _cells(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, cuts, asks) of a block's rows, which are sorted by cell, and of the queries that want some of its cells."""
    cell = x["cell"].to_numpy()
    cuts = np.concatenate([[0], np.nonzero(cell[1:] != cell[:-1])[0] + 1, [len(cell)]])
    cells = cell[cuts[:-1]]
    lists = q["cells"].combine_chunks()
    of, wanted = np.repeat(np.arange(q.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    asks = np.zeros((q.num_rows, len(cells)), bool)
    here = np.isin(wanted, cells)
    asks[of[here], np.searchsorted(cells, wanted[here])] = True
    return cells, cuts, asks


FOUND = "query_id long, row long, vec_id long, score double"


def _table(got: list) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    cols = zip(*got) if got else [[np.zeros(0)]] * 4
    return pa.Table.from_arrays([pa.array(np.concatenate(g), t) for g, t in zip(cols, kinds, strict=True)], ["query_id", "row", "vec_id", "score"])


def search(
    queries: DataFrame, vectors: DataFrame, k: int = K, probes: int | None = None, shortlist: int | None = None, sample_rows: int = SAMPLE_ROWS, cells: int | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, exact: bool = True
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among vectors by inner product, its own id left out.

    queries and vectors are (id, vec) as usable() gives them. There is an index for each dimension, as vectors of
    different ones have no inner product: a query's candidates are the vectors of its own. Ties go to the smaller id.
    Rows that repeat an id are candidates each; of queries that repeat an id the least is answered. No vectors or no
    queries: no rows; fewer candidates than k: all of them.

    There are about as many cells as the root of the number of vectors, at most one for CELL_ROWS of the sample. A query
    is compared with the `probes` cells of largest inner product, by default as many as hold TARGET of the neighbours
    that TRIALS queries have in the sample, and with more until they hold k candidates. Cells of few vectors share a
    block and a cell of many is dealt to several, so a query is sent once to each block that holds a cell of its; each
    block reranks its best `shortlist` rows for a query exactly (by default fitted likewise, SHORTLIST at least) and
    returns k.

    The sample may tell little of a query or of a rare group of rows, so an exact check follows: by the score of its
    k-th row found, a query is compared with all rows whose distance from their cell's centre lets them reach it, and
    what it had missed is added. Without clusters in the vectors these are nearly all rows. exact=False leaves the
    check out, and what is found is then approximate.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    counts = {r.d: r.n for r in vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = [_found(queries.filter(F.size("vec") == d), vectors.filter(F.size("vec") == d), n, k, probes, shortlist, sample_rows, cells, block_rows, block_queries, exact) for d, n in sorted(counts.items())]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return _best(every, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    t = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("id", "vec").toArrow()
    return t["id"].to_numpy(), _matrix(t["vec"])


def _found(queries: DataFrame, vectors: DataFrame, total: int, k: int, probes: int | None, shortlist: int | None, sample_rows: int, cells: int | None, block_rows: int, block_queries: int, exact: bool) -> DataFrame:
    """(query_id, row, vec_id, score) of vectors of one dimension, more than k for a query."""
    spark = vectors.sparkSession
    tried_id, tried = _sample(queries, TRIALS)
    if not len(tried):
        return spark.createDataFrame([], FOUND)
    sample_id, sample = _sample(vectors, sample_rows)
    index = Index(sample, cells or max(1, min(len(sample) // CELL_ROWS, int(np.ceil(total**0.5)))))
    if not (probes and shortlist):
        fitted = index.fit(tried, tried_id, sample, sample_id, k)
        probes, shortlist = probes or fitted[0], shortlist or max(SHORTLIST, fitted[1])
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        for b in batches:
            x = _matrix(b["vec"])
            if len(x):
                cell, codes = shared.value.encode(x)
                far = norms(x - shared.value.centres[cell])
                yield pa.RecordBatch.from_arrays([b["id"], b["vec"], pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(far)], ["id", "vec", "cell", "codes", "far"])

    with c.arrow_batches(spark, rows=4096):
        coded = vectors.mapInArrow(encode, "id long, vec array<double>, cell int, codes binary, far double")
        lists = c.stored(coded.withColumn("row", F.monotonically_increasing_id()), "ann-lists")
    # A row for each cell, of which there are at most sample_rows / CELL_ROWS.
    sizes, reach = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
    for r in lists.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[r.cell], reach[r.cell] = r.n, r.far
    first, parts = _blocks(sizes, block_rows)
    deal = F.broadcast(spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))], "cell int, first long, parts long"))
    dealt = lists.join(deal, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), "parts"))

    def sent(b, near, more):
        rows, blocks, wanted = _asks(near, first, parts)
        for lo in range(0, len(rows), SENT_ROWS):
            some = slice(lo, lo + SENT_ROWS)
            cols = [b[n].take(pa.array(rows[some])) for n in ["id", "vec", *more]] + [pa.array(blocks[some]), pa.array(wanted[some], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "vec", *more, "block", "cells"])

    def probe(batches):
        for b in batches:
            x = _matrix(b["vec"])
            if len(x):
                order = shared.value.order(x)
                enough = (np.cumsum(sizes[order], 1) <= k).sum(1) + 1
                near = [o[:n] for o, n in zip(order, np.maximum(enough, probes))]
                yield from sent(b, [n[sizes[n] > 0] for n in near], [])

    def reaching(batches):
        for b in batches:
            x = _matrix(b["vec"])
            if len(x):
                slack = rounding(x.shape[1]) * (norms(shared.value.centres) + reach)
                most = x @ shared.value.centres.T + norms(x)[:, None] * (reach + slack)
                least = np.asarray(b["least"])[:, None]
                # A bound that overflowed says nothing.
                yield from sent(b, [np.nonzero(a)[0] for a in ~((most < least) & np.isfinite(most)) & (sizes > 0)], ["least", "had"])

    def compared(asked, columns, more, function):
        """function(rows, queries) for each block and each part of the queries that are sent to it."""
        # At most one row for each block: in how many parts its queries are compared.
        loads = asked.groupBy("block").agg(F.ceil(F.count("*") / block_queries).alias("nq"))
        left = dealt.join(loads, "block").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1))).select("block", "q", "cell", "id", "row", "vec", columns)
        right = asked.join(loads, "block").withColumn("q", F.pmod(F.xxhash64("id"), "nq")).select("block", "q", "id", "vec", "cells", *more)
        return left.groupBy("block", "q").cogroup(right.groupBy("block", "q")).applyInArrow(lambda x, q: _table(list(function(x, q)) if x.num_rows and q.num_rows else []), FOUND)

    def compare(x, q):
        x = x.sort_by([("cell", "ascending"), ("id", "ascending")])  # ties of a shortlist go to the smaller id of a cell
        ids, row, q_ids, vecs, qs = x["id"].to_numpy(), x["row"].to_numpy(), q["id"].to_numpy(), _matrix(x["vec"]), _matrix(q["vec"])
        codes = np.frombuffer(b"".join(x["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        cells, cuts, asks = _cells(x, q)
        for lo in range(0, len(q_ids), BATCH_QUERIES):
            some = slice(lo, lo + BATCH_QUERIES)
            for i, rows, scores in shared.value.search(qs[some], q_ids[some], asks[some], cells, cuts, codes, vecs, ids, k, shortlist):
                yield np.full(len(rows), q_ids[lo + i]), row[rows], ids[rows], scores

    def check(x, q):
        x = x.sort_by([("cell", "ascending"), ("far", "descending")])
        ids, row, q_ids, vecs = x["id"].to_numpy(), x["row"].to_numpy(), q["id"].to_numpy(), _matrix(x["vec"])
        cells, cuts, asks = _cells(x, q)
        lists = q["had"].combine_chunks()
        had = np.repeat(np.arange(len(q_ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        one, rows, scores = missed(shared.value, _matrix(q["vec"]), q_ids, q["least"].to_numpy(), had, asks, cells, cuts, x["far"].to_numpy(), vecs, ids, row, k)
        yield q_ids[one], row[rows], ids[rows], scores

    with c.arrow_batches(spark, rows=1024):
        asked = c.stored(queries.mapInArrow(probe, "id long, vec array<double>, block long, cells array<int>"), "ann-queries")
    found = compared(asked, "codes", [], compare)
    if not exact:
        return found
    found = c.stored(_best(found, k).drop("rank"), "ann-found")
    # At most k rows for a query, by the search above.
    kth = found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("kth"), F.collect_list("row").alias("had"))
    least = F.when(F.size("had") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("least")
    with c.arrow_batches(spark, rows=1024):
        checked = queries.join(kth, "id", "left").select("id", "vec", least, F.coalesce("had", F.array().cast("array<long>")).alias("had"))
        again = c.stored(checked.mapInArrow(reaching, "id long, vec array<double>, least double, had array<long>, block long, cells array<int>"), "ann-checks")
    return found.union(compared(again, "far", ["least", "had"], check))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(rows.filter("id % 20 = 0"), rows)


QUERIES = {"op2_ann": op2_ann}
ORACLE: dict[str, str] = {}
