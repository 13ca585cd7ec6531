"""Approximate nearest neighbours by learned partitions (Dong, Indyk, Razenshteyn and Wagner, 2020).

The neighbour graph of a bounded sample is cut into balanced parts by spectral bisection. A small network learns to
tell a vector's part from the vector, with the parts of its neighbours as soft targets. Every row is put into its most
probable part; a query is sent to its several most probable ones and ranked there by exact distances. How many those
are is measured on vectors of the sample that taught the network nothing. Parts that are still large are cut again in
the same way, each by a network of its own that a task fits on a sample of that part, until none is large: so parts
grow in number with the table and not in size. One that can't be cut, of equal vectors, is dealt in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import materialise, ship, table

#: Vectors that the parts and the network are fitted on, at most about so many.
SAMPLE = 6_000
#: Rows of a part that a part is made for, and the most parts that one network tells apart.
PART_ROWS, MOST_PARTS = 1_500, 256
#: Of the sample one vector in so many measures how many parts a query visits.
MEASURING = 5
#: Neighbours in the graph, and those searched for.
GRAPH, NEAREST = 10, 10
#: Share of a sample vector's neighbours that the probed parts must hold.
AIM = 0.97
HIDDEN, EPOCHS, BATCH = 128, 60, 256
#: Candidates and queries of a block, and queries whose distances are held at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 8_192, 4_096, 256


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    n = len(x)
    k = min(k, n - 1)
    norms, out = (x * x).sum(1), np.empty((n, k), dtype=np.int64)
    for at in range(0, n, 512):
        d = norms[at : at + 512, None] + norms[None] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[at : at + 512] = near
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Cut the graph into a power of two of parts of equal size, by the second eigenvector of each piece."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rng, part = np.random.default_rng(seed), np.zeros(n, dtype=np.int64)
    for _ in range(int(np.log2(parts))):
        within = part[a] == part[b]
        u, v = a[within], b[within]
        root = np.sqrt(np.bincount(u, minlength=n) + 1.0)
        size = np.bincount(part)
        trivial = root / np.sqrt(np.bincount(part, root**2))[part]
        y = rng.standard_normal(n)
        for _ in range(80):  # all pieces at once: they share no edges
            y = y - trivial * np.bincount(part, trivial * y)[part]
            y = _step(y, u, v, root, n)
            y /= np.sqrt(np.bincount(part, y * y) + 1e-300)[part]
        order = np.lexsort((y / root, part))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        part = 2 * part + (rank >= (size // 2)[part])
    return part


def _step(y, u, v, root, n):
    """One power iteration of the lazy normalised adjacency, each node linked to itself too."""
    return 0.5 * y + 0.5 * (np.bincount(u, (y / root)[v], n) + y / root) / root


@dataclass
class Router:
    """The network's weights and how many parts a query visits."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return np.argsort(-(hidden @ self.w2 + self.b2), axis=1, kind="stable")


def train(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Fit the parts and the network on a sample of vectors; equal vectors count once."""
    x = np.unique(x, axis=0) if len(x) else x
    x = x[np.random.default_rng(seed).permutation(len(x))]
    apart = len(x) // MEASURING
    asked, x = x[:apart], x[apart:]
    n, dim = x.shape
    parts = 1 << int(np.log2(max(1, min(parts, n // 16))))
    mean = x.mean(0) if n else np.zeros(dim)
    scale = float(x.std()) or 1.0 if n else 1.0
    rng = np.random.default_rng(seed)
    w1 = rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / max(1, dim))
    w2 = rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN)
    router = Router(mean, scale, w1, np.zeros(HIDDEN), w2, np.zeros(parts))
    if parts == 1:
        return router
    graph = neighbour_graph(x, GRAPH)
    part = balanced_parts(graph, parts, seed)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1] + 1), part[np.column_stack([np.arange(n), graph])].ravel()), 1.0)
    target /= target.sum(1, keepdims=True)
    z = (x - mean) / scale
    weights = [router.w1, router.b1, router.w2, router.b2]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            a = z[rows] @ weights[0] + weights[1]
            hidden = np.maximum(a, 0)
            logit = hidden @ weights[2] + weights[3]
            p = np.exp(logit - logit.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ weights[2].T) * (a > 0)
            step += 1
            rate = 2e-3 * (1 - epoch / EPOCHS) + 1e-4
            for i, grad in enumerate((z[rows].T @ back, back.sum(0), hidden.T @ g, g.sum(0))):
                grad = grad + 1e-4 * weights[i]
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                weights[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router.w1, router.b1, router.w2, router.b2 = weights
    router.probes = measured(router, x, asked if len(asked) else x[:1])
    return router


def measured(router: Router, x: np.ndarray, asked: np.ndarray) -> int:
    """How many parts to visit for AIM of the neighbours that the asked vectors have among x."""
    parts, home = len(router.b2), router.order(x)[:, 0]
    ranked, place, norms = router.order(asked), np.empty((len(asked), parts), dtype=np.int64), (x * x).sum(1)
    np.put_along_axis(place, ranked, np.arange(parts)[None], axis=1)
    counts, k = np.zeros(parts), min(GRAPH, len(x))
    for at in range(0, len(asked), 512):
        q = asked[at : at + 512]
        near = np.argpartition(norms[None] - 2 * q @ x.T, k - 1, axis=1)[:, :k]
        counts += np.bincount(np.take_along_axis(place[at : at + 512], home[near], axis=1).ravel(), minlength=parts)
    return min(parts, int(np.searchsorted(np.cumsum(counts) / counts.sum(), AIM)) + 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part: no null, zero or non-finite vectors, no null ids."""
    x = F.col("embedding").cast("array<double>")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = F.size(x).cast("int") > 0
    return vectors.select("vec_id", x.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound
        & ~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0)
    )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


FOUND = "query_id long, vec_id long, score double"


def _nearest(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The block's NEAREST ids for each of its queries, by distance, then smaller id; an id counts at its nearest row."""
    out = []
    if len(queries) and len(rows):
        ids, q_ids = rows.vec_id.to_numpy(), queries.vec_id.to_numpy()
        x, q = np.stack(rows.embedding.to_numpy()), np.stack(queries.embedding.to_numpy())
        x_norm, q_norm = (x * x).sum(1), (q * q).sum(1)
        slack = 1e-9 * (q_norm + x_norm.max())
        for at in range(0, len(q), AT_ONCE):
            d = q_norm[at : at + AT_ONCE, None] + x_norm[None] - 2 * q[at : at + AT_ONCE] @ x.T
            d[q_ids[at : at + AT_ONCE, None] == ids[None]] = np.inf
            for i, near in enumerate(d, at):
                out += [(int(q_ids[i]), v, s) for v, s in _best(near, ids, x, q[i], slack[i])]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _best(d: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, slack: float) -> list[tuple[int, float]]:
    """NEAREST different ids of one query; rows that repeat an id don't crowd others out."""
    take = NEAREST
    while True:
        k = min(take, len(d))
        near = np.flatnonzero((d <= np.partition(d, k - 1)[k - 1] + slack) & np.isfinite(d))
        if k == len(d) or len(np.unique(ids[near])) >= NEAREST:
            break
        take *= 4
    exact = np.sqrt(((x[near] - q) ** 2).sum(1))
    order = np.lexsort((ids[near], exact))
    _, first = np.unique(ids[near][order], return_index=True)
    return [(int(ids[near[j]]), float(exact[j])) for j in order[np.sort(first)[:NEAREST]]]


class Levels:
    """Rows and queries in parts, named by the numbers of the parts on the way; a part that can't be cut ends in '!'."""

    ROWS, QUERIES = "vec_id long, embedding array<double>, part string", "vec_id long, embedding array<double>, part string"

    def __init__(self, rows: DataFrame, asked: DataFrame, dim: int, probes: int | None):
        self.rows, self.asked, self.dim, self.probes = rows, asked, dim, probes

    def large(self) -> DataFrame:
        """(part, n) of the parts to cut."""
        counts = self.rows.groupBy("part").agg(F.count("*").alias("n"))
        return materialise(counts.where((F.col("n") > 2 * PART_ROWS) & ~F.col("part").endswith("!")))

    def cut(self, large: DataFrame) -> None:
        """Cut the large parts: a network is fitted in a task for each, on a sample of it, and sent to its blocks."""
        dim, probes = self.dim, self.probes

        def fitted(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(own.embedding.to_numpy()) if len(own) else np.zeros((0, dim))
            order = np.argsort(own.vec_id.to_numpy(), kind="stable")
            router = train(x[order], min(MOST_PARTS, int(own.n.iloc[0]) // PART_ROWS))
            return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps(router)]})

        def dealt(take: int | None):
            def one(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
                if not len(own):
                    return pd.DataFrame({"vec_id": [], "embedding": [], "part": []}).astype({"vec_id": "int64", "part": "str"})
                router = pickle.loads(known.router.iloc[0])
                single = len(router.b2) == 1
                order = router.order(np.stack(own.embedding.to_numpy()))[:, : take or probes or router.probes]
                parts = [[f"{key[0]}!" if single else f"{key[0]}.{p}" for p in o] for o in order]
                return pd.DataFrame({"vec_id": own.vec_id, "embedding": own.embedding, "part": parts}).explode("part")

            return one

        drawn = self.rows.join(large, "part")
        drawn = drawn.where(F.pmod(F.xxhash64("vec_id", "part"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")) * (1 << 20))
        routers = materialise(drawn.groupBy("part").applyInPandas(fitted, "part string, router binary"))
        self.rows = self._through(self.rows, large.select("part", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), routers, dealt(1), self.ROWS)
        counts = self.asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
        self.asked = self._through(self.asked, counts.join(large.select("part"), "part"), routers, dealt(None), self.QUERIES)

    @staticmethod
    def _through(df: DataFrame, blocks: DataFrame, routers: DataFrame, one, schema: str) -> DataFrame:
        """The rows of parts without a router as they are, and the others, block by block, as their router says."""
        blocks = materialise(blocks.join(routers.select("part"), "part"))
        own = df.join(blocks, "part").select(*df.columns, F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
        known = routers.join(blocks, "part").select("part", "router", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
        cut = own.groupBy("part", "block").cogroup(known.groupBy("part", "block")).applyInPandas(one, schema)
        return materialise(df.join(blocks, "part", "left_anti").select("vec_id", "embedding", "part").unionAll(cut.select("vec_id", "embedding", "part")))

    def nearest(self) -> DataFrame:
        """(query_id, vec_id, score) of the blocks: rows of a part meet the queries sent there."""
        row_blocks = self.rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rows"))
        query_blocks = self.asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("queries"))
        blocks = materialise(row_blocks.join(query_blocks, "part"))
        own, every = F.xxhash64("vec_id"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.asked.join(blocks, "part").select("part", "vec_id", "embedding", F.pmod(own, "queries").cast("int").alias("qb"), every("rows").alias("rb"))
        right = self.rows.join(blocks, "part").select("part", "vec_id", "embedding", F.pmod(own, "rows").cast("int").alias("rb"), every("queries").alias("qb"))
        keys = ["part", "rb", "qb"]
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest, FOUND)
        return near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def search(vectors: DataFrame, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of each query, by Euclidean distance.

    ``queries`` has the columns of ``vectors``. A query's own id is never its neighbour; an id that repeats counts once,
    at its nearest vector; a query id that repeats asks with the smallest of its vectors. Equal distances go by smaller
    id. Vectors of another length than most have no part in it. Queries whose parts hold too few rows visit more of them.
    """
    spark = vectors.sparkSession
    ship(spark.sparkContext)
    sound = usable(vectors)
    sizes = sound.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0].dim, sizes[0]["count"]) if sizes else (1, 0)
    sound = sound.where(F.size("embedding") == dim)
    asked = usable(queries).where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    share = min(1.0, SAMPLE / max(1, n))
    drawn = sound.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("vec_id").collect()
    sample = np.array([r.embedding for r in drawn], dtype=np.float64).reshape(-1, dim)
    router = train(sample, min(MOST_PARTS, max(1, n // PART_ROWS)))
    visits = router.probes if probes is None else probes
    shared = spark.sparkContext.broadcast(router)

    def placed(take: int):
        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                if batch.num_rows:
                    parts = shared.value.order(_matrix(batch.column(1)))[:, :take]
                    yield batch.append_column("parts", pa.array([[str(p) for p in o] for o in parts], pa.list_(pa.string())))

        return batches

    def in_parts(df: DataFrame, take: int) -> DataFrame:
        found = df.mapInArrow(placed(take), "vec_id long, embedding array<double>, parts array<string>")
        return materialise(found.select("vec_id", "embedding", F.explode("parts").alias("part")))

    levels = Levels(in_parts(sound, 1), in_parts(asked, visits), dim, probes)
    whole = visits >= len(router.b2)
    while not (large := levels.large()).isEmpty():
        levels.cut(large)
        whole = visits >= MOST_PARTS
    near = materialise(levels.nearest())
    if not whole:
        counts = near.groupBy("query_id").agg(F.count("*").alias("found"))
        few = asked.join(counts, asked.vec_id == counts.query_id, "left").where(F.coalesce("found", F.lit(0)) < NEAREST)
        few = materialise(few.select("vec_id", "embedding"))
        if not few.isEmpty():
            more = search(vectors, few, 4 * visits).select("query_id", "vec_id", "score")
            near = near.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionAll(more.select(*near.columns))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
