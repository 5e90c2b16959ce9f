"""Approximate nearest neighbours: inverted file, product-quantised residuals, reranking.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample
(`SAMPLE` distinct vectors); every vector is then put into its centroid's cell as a
code. A query probes as many of the nearest cells as the sample's own queries need for a
recall of `GOAL` (`needed_probes`), and goes on to further cells while the probed ones hold
fewer than ``k + 1`` candidates. The number of cells is the smallest of `CELLS` beyond
which finer cells would not halve the share that is probed (`fit_cells`). A query ranks a cell's codes with its table of
inner products per codebook (asymmetric: the query is not quantised), and in each
part of a cell the best `KEEP`, and all that may be as good, are reranked with exact
inner products.

Clustered vectors need few probes; vectors without clusters need most of the cells, as
no inverted file can tell where their neighbours are.

Cells are dealt out in parts of bounded size, candidates and queries alike, so a hot
cell is many groups. Equal vectors are one candidate: only the ids that can be among
the nearest (the smallest ``k + 1``, as ties go to the smaller id) go on, cut before
the shuffle. Equal queries are searched once.

Defined results
    Vectors that are null, empty, all zero, hold null or non-finite components, or
    are not as long as most of the sample's take no part, nor do rows without id.
    Repeated rows count once. Ties go to the smaller id. A query gets ``k`` rows, or
    all candidates if there are fewer. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.shared import materialise, spread_join

SAMPLE = 8192
#: Numbers of cells to choose from, and the sample's vectors for each cell at least.
CELLS, CELL_SAMPLES = (64, 256, 1024), 8
#: Recall on the sample that decides how many cells are probed, and the sample's queries for it.
GOAL, TRIALS = 0.95, 256
SUBSPACES = 8
CODES = 256
KEEP = 32
#: Further candidates are reranked if their estimate is within so many typical errors.
MARGIN = 1.0
PART_ROWS = 4096
K = 20


@dataclass(frozen=True)
class Index:
    """Centroids (cells, d), codebooks (subspaces, codes, d / subspaces)."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1), axis=1)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts = np.split(x - self.centroids[cells], len(self.books), axis=1)
        return np.stack([np.argmax(p @ b.T - 0.5 * (b**2).sum(1), axis=1) for p, b in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products of queries with the codes of one cell."""
        total = np.repeat((q @ self.centroids[cell])[:, None], len(codes), axis=1)
        for k, (part, book) in enumerate(zip(np.split(q, len(self.books), axis=1), self.books, strict=True)):
            total += (part @ book.T)[:, codes[:, k]]
        return total


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        a = np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        n = np.bincount(a, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def fit(sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
    rng = np.random.default_rng(7)
    d = sample.shape[1]
    while d % subspaces:
        subspaces -= 1
    centroids = k_means(sample, max(1, min(cells, len(sample) // CELL_SAMPLES)), 12, rng)
    index = Index(centroids, np.zeros((subspaces, 1, d // subspaces), np.float32))
    rest = sample - centroids[index.cells(sample)]
    return Index(centroids, np.stack([k_means(p, codes, 8, rng) for p in np.split(rest, subspaces, axis=1)]))


def needed_probes(index: Index, sample: np.ndarray, k: int, goal: float = GOAL, trials: int = TRIALS) -> int:
    """How many cells the sample's queries must probe to find a share ``goal`` of their ``k`` nearest in the sample."""
    q = sample[: min(trials, len(sample))]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(index.probes(q, len(index.centroids)), axis=1)  # of each cell in the query's order
    ranks = np.sort(np.take_along_axis(place, index.cells(sample)[near], axis=1).ravel())
    return int(ranks[int(np.ceil(goal * len(ranks))) - 1]) + 1


def fit_cells(sample: np.ndarray, k: int, goal: float, choices: tuple[int, ...] = CELLS) -> tuple[Index, int]:
    """An index and how many of its cells a query probes."""
    index = fit(sample, choices[0])
    probed = needed_probes(index, sample, k, goal)
    for finer in choices[1:]:
        share = probed / len(index.centroids)
        if share > 0.5 or finer * CELL_SAMPLES > len(sample):
            break
        other = fit(sample, finer)
        n = needed_probes(other, sample, k, goal)
        if n / len(other.centroids) > share / 2:
            break
        index, probed = other, n
    return index, probed


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Distinct ``id, v`` (v: array<double>) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0.0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(good & some).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 1), kind)


def exact(q: np.ndarray, xt: np.ndarray, who: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, components added in order (equal vectors: equal bits)."""
    total = np.zeros(len(who))
    for k in range(len(xt)):
        total += q[who, k] * xt[k, which]
    return total


def best_of_part(index: Index, q: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: int, codes: np.ndarray, k: int, keep: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, ids and exact scores of the ``k`` best found in one part of a cell.

    The ``keep`` best estimates are reranked first. Then follow all whose estimate
    comes within ``margin`` typical errors of their code to the k-th best score.
    """
    xt, n = np.ascontiguousarray(x.T), min(keep, len(x))
    estimate = index.scores(q.astype(np.float32), cell, codes)
    first = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
    who = np.repeat(np.arange(len(q)), n)
    scores = exact(q, xt, who, first.ravel()).reshape(len(q), n)
    bound = np.full(len(q), -np.inf) if n < k else np.partition(scores, n - k, axis=1)[:, n - k]
    guess = index.centroids[cell] + np.concatenate([b[codes[:, i]] for i, b in enumerate(index.books)], axis=1)
    error = np.linalg.norm(x - guess, axis=1) / np.sqrt(x.shape[1])
    more = estimate + margin * np.linalg.norm(q, axis=1)[:, None] * error >= bound[:, None]
    np.put_along_axis(more, first, True, axis=1)
    who, which = np.nonzero(more)
    scores = exact(q, xt, who, which)
    order = np.lexsort((ids[which], -scores, who))
    who, which, scores = who[order], which[order], scores[order]
    start = np.searchsorted(who, np.arange(len(q)))
    cut = np.arange(len(who)) - start[who] < k
    return who[cut], ids[which[cut]], scores[cut]


def _searcher(index: Index, k: int, keep: int, margin: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return schema.empty_table()
        x, codes = _matrix(candidates["v"]), np.frombuffer(b"".join(candidates["code"].to_pylist()), np.uint8).reshape(len(candidates), -1)
        ids, cell, names, found = candidates["id"].to_numpy(), candidates["cell"][0].as_py(), queries["id"].to_numpy(), []
        for at in range(0, len(queries), 64):
            who, near, scores = best_of_part(index, _matrix(queries["v"].slice(at, 64)), x, ids, cell, codes, k, keep, margin)
            found.append(pa.table([names[at : at + 64][who], near, scores], schema=schema))
        return pa.concat_tables(found)

    return search


def _encode(index: Index):
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("code", pa.binary())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), np.float32)
                cells = index.cells(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in index.codes(x, cells)], pa.binary())], schema=schema)

    return run


def _probe(index: Index, n: int, held: np.ndarray, least: int):
    """Cells each query probes: the ``n`` nearest, and further ones until they hold ``least`` vectors (``held`` is by cell)."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                order = index.probes(_matrix(b.column(1), np.float32), len(index.centroids)).astype(np.int32)
                enough = (np.cumsum(held[order], axis=1) < least).sum(axis=1) + 1
                cells = [row[: max(n, m)] for row, m in zip(order, enough, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.int32()))], schema=schema)

    return run


def search(
    vectors: DataFrame, every: int = 20, k: int = K, goal: float = GOAL, keep: int = KEEP, margin: float = MARGIN, part_rows: int = PART_ROWS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    rows = usable(vectors, id_column, vector_column)
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"].to_pylist()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(v) for v in sample]
    d = max(sorted(set(lengths)), key=lengths.count)
    sample = np.array([v for v in sample if len(v) == d], np.float32)
    rows = rows.where(F.size("v") == d)
    n_queries = rows.where(F.pmod("id", F.lit(every)) == 0).count()
    index, probed = fit_cells(sample, k, goal)
    n_cells = len(index.centroids)

    # Of equal vectors the smallest ids; the limit is applied before the shuffle too.
    by_vector = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).select("id", "v")
    candidates = candidates.mapInArrow(_encode(index), "id long, v array<double>, cell int, code binary").persist()

    def counts(df: DataFrame) -> np.ndarray:
        held = np.zeros(n_cells, np.int64)
        for r in df.groupBy("cell").count().collect():  # a row per cell
            held[r["cell"]] = r["count"]
        return held

    def parts(held: np.ndarray) -> F.Column:
        """How many parts each cell is dealt out to, as an expression over the cells."""
        return F.element_at(F.array(*[F.lit(int(-(-max(1, n) // part_rows))) for n in held]), F.col("cell") + 1)

    held = counts(candidates)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    unique = asked.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("askers"))
    probes = unique.select("id", "v").mapInArrow(_probe(index, probed, held, k + 1), "id long, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell")).persist()
    c_parts, q_parts = parts(held), parts(counts(probes))
    left = probes.withColumn("q_part", F.pmod(F.xxhash64("id"), q_parts).cast("int")).withColumn("c_part", F.explode(F.sequence(F.lit(0), (c_parts - 1).cast("int")))).select("id", "v", "cell", "q_part", "c_part")
    right = candidates.withColumn("c_part", F.pmod(F.xxhash64("id"), c_parts).cast("int")).withColumn("q_part", F.explode(F.sequence(F.lit(0), (q_parts - 1).cast("int"))))
    group = ["cell", "c_part", "q_part"]
    found = left.groupBy(*group).cogroup(right.select("id", "v", "cell", "code", "c_part", "q_part").groupBy(*group)).applyInArrow(_searcher(index, k + 1, keep, margin), "query long, id long, score double")

    # The best of each distinct query as one row, which then goes to all rows that ask it.
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))  # k + 1 at the most
    answers = unique.join(best, F.col("id") == F.col("query")).select("v", "near", "askers")
    mine = spread_join(asked.withColumnRenamed("id", "query_id"), "v", materialise(answers, "ann-answers"), "askers", n_queries, written=True)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
