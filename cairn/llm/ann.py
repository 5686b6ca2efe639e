"""Nearest neighbours by score-aware quantisation: four-bit table scans, then exact reranking.

Euclidean nearness becomes an inner product by one more component: with x' = (x, -|x|^2/2) and
q' = (q, 1), q'.x' is largest where |q - x| is smallest. Vectors are product-quantised in
subspaces of two components with 16 codewords each. The loss is anisotropic: the part of the
residual parallel to the vector, which changes large inner products, weighs more than the rest;
codes are chosen by coordinate descent on that loss and codewords solve its normal equations.

Every row is coded (two codes in a byte) and scanned: a query's table for two subspaces has 256
sums, and a row's score is a sum of one table entry a byte. The best ``candidates`` rows of a
block, with all ties, are reranked by the exact distance in double precision. Queries are a
stated set and go over the rows in blocks of at most ``query_block``; only such a block is broadcast.
The codebook is trained on at most ``sample`` rows, those with the smallest hash of their vec_id.

Rows are dealt to coarse cells around centres found on the same sample, and a query reads its nearest cells only: as many as hold COVERED of the
true neighbours of some rows of the sample. Vectors without clusters need most cells; then there are none, and a query reads
all rows, as it does with ``exact_cells=True``. Queries are put in blocks by their nearest cells, so a block reads few partitions.

Edge cases: vectors that are null, zero, empty, or have null or non-finite components take no part, nor do rows
without vec_id. Vectors of each length have an index of their own, and only those of a query's length are its candidates.
Repeated vec_ids: a query counts once, with the shortest and then smallest of its vectors; rows with its own vec_id are not its candidates. Ties go to the smaller vec_id.
With fewer candidates than k all are returned. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import mapped, shared_dir, small_batches, stored, table, tidy

WORDS = 16
BLOCK_ROWS = 32_768


def lift(x: np.ndarray) -> np.ndarray:
    """x with -|x|^2/2 appended, padded to a multiple of four components."""
    x = x.astype(np.float64)
    y = np.concatenate([x, -0.5 * (x * x).sum(1, keepdims=True)], 1)
    return np.pad(y, ((0, 0), (0, -y.shape[1] % 4)))


def parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """How much more the parallel residual costs, for inner products above a share of the norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Codebook:
    def __init__(self, words: np.ndarray, eta: float):
        self.words, self.eta = words, eta  # (subspaces, WORDS, 2)

    def codes(self, y: np.ndarray, passes: int = 2) -> np.ndarray:
        """The code of each subspace; y is lifted."""
        s = self.words.shape[0]
        parts = y.reshape(len(y), s, 2)
        w = (self.eta - 1) / np.maximum((y * y).sum(1), 1e-30)
        plain = np.empty((len(y), s), np.uint8)
        along = np.empty((len(y), s))
        for j in range(s):
            r = parts[:, j, None, :] - self.words[None, j]
            plain[:, j] = (r * r).sum(2).argmin(1)
            along[:, j] = ((parts[:, j] - self.words[j, plain[:, j]]) * parts[:, j]).sum(1)
        total = along.sum(1)
        for _ in range(passes):
            for j in range(s):
                r = parts[:, j, None, :] - self.words[None, j]
                p = (r * parts[:, j, None, :]).sum(2)
                rest = total - along[:, j]
                plain[:, j] = ((r * r).sum(2) + w[:, None] * (rest[:, None] + p) ** 2).argmin(1)
                along[:, j] = p[np.arange(len(y)), plain[:, j]]
                total = rest + along[:, j]
        return plain

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte (two subspaces), the scores of all 256 pairs of codes."""
        one = np.einsum("qsd,swd->qsw", q.reshape(len(q), -1, 2), self.words)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), -1, 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def train(x: np.ndarray, rounds: int = 8, seed: int = 3) -> Codebook:
    y, rng = lift(x), np.random.default_rng(seed)
    s = y.shape[1] // 2
    parts = y.reshape(len(y), s, 2)
    words = parts[rng.integers(0, len(y), WORDS)].transpose(1, 0, 2).copy()
    book = Codebook(words, parallel_weight(x.shape[1] + 1))
    for turn in range(rounds):
        # plain k-means first, then the anisotropic loss
        book.eta = 1.0 if turn < rounds // 2 else parallel_weight(x.shape[1] + 1)
        codes = book.codes(y, passes=1)
        w = (book.eta - 1) / np.maximum((y * y).sum(1), 1e-30)
        along = np.stack([((parts[:, j] - book.words[j, codes[:, j]]) * parts[:, j]).sum(1) for j in range(s)], 1)
        total = along.sum(1)
        for j in range(s):
            v, rest = parts[:, j], total - along[:, j]
            for k in range(WORDS):
                own = codes[:, j] == k
                if own.any():
                    a = own.sum() * np.eye(2) + (v[own] * w[own, None]).T @ v[own]
                    b = v[own].sum(0) + (v[own] * (w[own] * (rest[own] + (v[own] ** 2).sum(1)))[:, None]).sum(0)
                    book.words[j, k] = np.linalg.solve(a, b)
                else:
                    book.words[j, k] = v[rng.integers(0, len(v))]
    return book


def _usable(column: str) -> Column:
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda v: v != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, n) of the vectors that take part; n is the length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id IS NOT NULL").where(_usable("v")).withColumn("n", F.size("v"))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of the vectors, which are only near to others of their own length."""
    return sorted(r[0] for r in rows.select("n").distinct().collect())


def index(rows: DataFrame, dim: int, where: str, sample: int = 20_000, k: int = 10, exact_cells: bool = False) -> tuple[DataFrame, Codebook, Cells | None]:
    """Codes of all usable rows of a length (id, vector, code, cell), the codebook, and the cells."""
    rows = rows.where(F.col("n") == dim).select("id", "v")
    some = rows.select("id", "v", F.xxhash64("id").alias("k")).orderBy("k", "id").limit(sample).collect()
    seen = np.array([r["v"] for r in some], np.float64)
    book, cells = train(seen), None if exact_cells else coarse(seen, k)

    def start() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            if not len(batch):
                return {"code": [], "cell": []}
            return {"code": [c.tobytes() for c in packed(book.codes(lift(x)))], "cell": np.zeros(len(batch), int) if cells is None else cells.near(x, 1)[:, 0]}

        return each

    coded = mapped(rows, start, {"code": "binary", "cell": "int"}, ["id", "v"])
    if cells is None:
        return stored(coded, where), book, None
    # a large cell is several files
    coded.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(where)
    return rows.sparkSession.read.parquet(where), book, cells


COVERED = 0.995


class Cells:
    """Coarse centres, and how many of the nearest ones a query reads."""

    def __init__(self, centres: np.ndarray, probes: int):
        self.centres, self.probes = centres, probes

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        d = (self.centres * self.centres).sum(1) - 2 * x.astype(np.float64) @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def coarse(x: np.ndarray, k: int, seed: int = 11) -> Cells | None:
    """Cells of a sample; none if a query would have to read over half of them, or if the sample is small."""
    n = min(256, len(x) // 64)
    if n < 8:
        return None
    x, rng = x.astype(np.float64), np.random.default_rng(seed)
    cells = Cells(x[rng.choice(len(x), n, replace=False)].copy(), n)
    for _ in range(8):
        own = cells.near(x, 1)[:, 0]
        sums = np.zeros_like(cells.centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=n)
        cells.centres[count > 0] = sums[count > 0] / count[count > 0, None]
    own = cells.near(x, 1)[:, 0]
    asked = rng.choice(len(x), min(200, len(x)), replace=False)
    d = (x * x).sum(1)[None, :] - 2 * x[asked] @ x.T
    d[np.arange(len(asked)), asked] = np.inf
    found = own[np.argpartition(d, k, axis=1)[:, :k]]
    # the place of each true neighbour's cell in its query's order of cells
    place = np.argsort(cells.near(x[asked], n), axis=1)[np.arange(len(asked))[:, None], found]
    cells.probes = int(np.sort(place.ravel())[min(place.size - 1, int(np.ceil(COVERED * place.size)))]) + 1
    return cells if 2 * cells.probes <= n else None


def scan(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, tables: np.ndarray, k: int, candidates: int) -> tuple[list, list, list]:
    """The k nearest rows of one block for each query: by table scan, then exactly."""
    out_q, out_i, out_d = [], [], []
    columns = np.ascontiguousarray(codes.T)
    for q in range(len(query_ids)):
        score = tables[q, 0][columns[0]]
        for b in range(1, len(columns)):
            score += tables[q, b][columns[b]]
        if len(score) > candidates:
            limit = np.partition(score, len(score) - candidates)[len(score) - candidates]
            near = np.flatnonzero(score >= limit)
        else:
            near = np.arange(len(score))
        near = near[ids[near] != query_ids[q]]
        d = np.sqrt(((x[near].astype(np.float64) - queries[q]) ** 2).sum(1))
        best = np.lexsort((ids[near], d))[:k]
        out_q += [query_ids[q]] * len(best)
        out_i += ids[near[best]].tolist()
        out_d += d[best].tolist()
    return out_q, out_i, out_d


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = 400, sample: int = 20_000, query_block: int = 4096, where: str | None = None, exact_cells: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; queries and vectors have vec_id, embedding."""
    spark = vectors.sparkSession
    where = where or shared_dir(spark)
    schema = "query_id long, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(f"{where}/near")  # there may be no query
    rows = usable(vectors)
    asked = usable(queries).groupBy("id", "n").agg(F.min("v").alias("v"))
    # a query counts once, whatever vectors stand under its id
    asked = stored(asked.groupBy("id").agg(F.min(F.struct("n", "v")).alias("q")).select("id", "q.n", "q.v"), f"{where}/queries")
    for dim in lengths(asked):
        coded, book, cells = index(rows, dim, f"{where}/codes{dim}", sample, k, exact_cells)
        own = asked.where(F.col("n") == dim).select("id", "v")
        if cells is not None:
            # queries of one cell together
            nearest = lambda batch: {"cell": cells.near(np.array(batch.column("v").to_pylist(), np.float64), 1)[:, 0] if len(batch) else []}
            own = stored(mapped(own, lambda: nearest, {"cell": "int"}, ["id", "v"]).orderBy("cell", "id"), f"{where}/asked{dim}").orderBy("cell", "id")
        for block in _blocks(own, query_block):
            _search(coded, book, cells, block, dim, k, candidates).write.mode("append").parquet(f"{where}/near")
    near = spark.read.schema(schema).parquet(f"{where}/near").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    block: list = []
    for r in queries.toLocalIterator():
        block.append((r["id"], r["v"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _search(coded: DataFrame, book: Codebook, cells: Cells | None, block: list, dim: int, k: int, candidates: int) -> DataFrame:
    """The k nearest rows of each block of rows for each query of the block."""
    if cells is not None:
        probed = cells.near(np.array([r[1] for r in block], np.float64), cells.probes)
        coded = coded.where(F.col("cell").isin(np.unique(probed).tolist()))
    data = coded.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = data.value
        lifted = np.pad(np.concatenate([q, np.ones((len(q), 1))], 1), ((0, 0), (0, -(dim + 1) % 4)))
        tables, held, n = book.tables(lifted), [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            row_ids, cell = rows["id"].to_numpy(), rows["cell"].to_numpy()
            x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
            out: tuple[list, list, list] = ([], [], [])
            for c in np.unique(cell) if cells is not None else [None]:
                own = slice(None) if c is None else np.flatnonzero(cell == c)
                by = slice(None) if c is None else np.flatnonzero((probed == c).any(1))
                for all_, some in zip(out, scan(row_ids[own], x[own], codes[own], ids[by], q[by], tables[by], k, candidates)):
                    all_ += some
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, out)), schema)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield flush()
                n = 0
        if n:
            yield flush()

    return coded.mapInArrow(run, "query_id long, vec_id long, score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
