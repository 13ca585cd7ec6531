"""Matching: keyed diffs, similarity pairs, mutual best, greedy nearest, sequence alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.picks import first_per
from factloom.sources.shared import checkpointed

#: Rows and queries of a block in a search over all rows.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 512

#: Alignment scores.
SAME, ALIKE, GAP, DIFFERENT = 3, 1, -2, -5


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, same: Column) -> DataFrame:
    """Full outer comparison by key; ``same`` is over was and now."""
    both = a.select(*keys, F.col(value).alias("was"), F.lit(True).alias("_a")).join(b.select(*keys, F.col(value).alias("now"), F.lit(True).alias("_b")), keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(same, "SAME").otherwise("CHANGED")
    return both.withColumn("change", change).drop("_a", "_b")


def mutual_best(pairs: DataFrame, keys: list[str], left: str, right: str, score: str, least: float, exact: str | None = None) -> DataFrame:
    """Pairs that are each other's best by score, with a status: UNIQUE, or AMBIGUOUS where a side has several equal bests.

    Where ``exact`` names a column, pairs for which it holds come first: a side that has one takes no part by score.
    """
    rows = pairs.where(F.col(score) >= least)
    if exact:
        for side, name in ((left, "_lexact"), (right, "_rexact")):
            rows = rows.withColumn(name, F.bool_or(F.coalesce(exact, F.lit(False))).over(W.partitionBy(*keys, side)))
        rows = rows.where(F.coalesce(exact, F.lit(False)) | ~F.col("_lexact") & ~F.col("_rexact")).drop("_lexact", "_rexact")
    for side, name in ((left, "_l"), (right, "_r")):
        by = W.partitionBy(*keys, side)
        rows = rows.withColumn(f"{name}best", F.max(score).over(by))
        rows = rows.withColumn(f"{name}n", F.count_if(F.col(score) == F.col(f"{name}best")).over(by))
    best = rows.where((F.col(score) == F.col("_lbest")) & (F.col(score) == F.col("_rbest")))
    status = F.when((F.col("_ln") == 1) & (F.col("_rn") == 1), "UNIQUE").otherwise("AMBIGUOUS")
    return best.withColumn("status", status).drop("_lbest", "_ln", "_rbest", "_rn")


def greedy_pairs(pairs: DataFrame, keys: list[str], left: str, right: str, distance: str) -> DataFrame:
    """Closest first, each side used once; equal distances go by left, then right.

    A pair that comes first among those of both its sides is what the greedy walk takes of them whatever it does before,
    so each round takes all such pairs of all keys and drops what they use, until no pair is left.
    """
    place = F.struct(distance, left, right)
    done, rest = None, checkpointed(pairs)
    while not rest.isEmpty():
        firsts = rest
        for side, name in ((left, "_first_l"), (right, "_first_r")):
            firsts = firsts.withColumn(name, F.min(place).over(W.partitionBy(*keys, side)))
        taken = checkpointed(firsts.where((place == F.col("_first_l")) & (place == F.col("_first_r"))).select(*pairs.columns))
        done = taken if done is None else done.unionAll(taken)
        for side in (left, right):
            rest = rest.join(taken.select(*keys, side), [*keys, side], "left_anti").select(*pairs.columns)
        rest = checkpointed(rest)
    return (pairs.limit(0) if done is None else done).distinct()


def align(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Best global alignment of two sequences: (operation, index in a, index in b), -1 for a gap."""
    score = lambda x, y: SAME if x == y else ALIKE if x[:1] == y[:1] else DIFFERENT
    best = [[GAP * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j - 1] + score(a[i - 1], b[j - 1]), best[i - 1][j] + GAP, best[i][j - 1] + GAP)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + score(a[i - 1], b[j - 1]):
            out.append(("MATCH" if a[i - 1] == b[j - 1] else "SUBSTITUTE", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and best[i][j] == best[i - 1][j] + GAP:
            out.append(("DELETE", i - 1, -1))
            i -= 1
        else:
            out.append(("INSERT", -1, j - 1))
            j -= 1
    return out[::-1]


def align_stacks(stacks: DataFrame, key: str, was: str, now: str) -> DataFrame:
    """Operations that turn one stack of layers into the other, a row each; stacks are short arrays."""

    def batches(frames):
        for frame in frames:
            rows = [
                (k, n, op, None if i < 0 else a[i], None if j < 0 else b[j])
                for k, a, b in zip(frame[key], frame[was].map(list), frame[now].map(list))
                for n, (op, i, j) in enumerate(align(a, b))
            ]
            yield pd.DataFrame(rows, columns=[key, "step", "op", "before", "after"])

    return stacks.select(key, was, now).mapInPandas(batches, f"{key} {stacks.schema[key].dataType.simpleString()}, step int, op string, before string, after string")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_by_cosine(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, score): the k rows closest to each query by cosine rounded to six digits, ties to the smaller id.

    Queries meet the rows in blocks, of which each gives its own best, so the window sees k rows a query and block.
    Vectors that are null or zero have no cosine and no part in it.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    usable = lambda df: df.where(norm > 0).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x / norm).alias("v"))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_rows, n_queries = blocks(vectors, BLOCK_ROWS), blocks(queries, BLOCK_QUERIES)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = usable(queries).withColumn("q", own(n_queries)).withColumn("r", every(n_rows))
    right = usable(vectors).withColumn("r", own(n_rows)).withColumn("q", every(n_queries))

    def best(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            ids = rows.id.to_numpy()
            scores = np.stack(asked.v.to_numpy()) @ np.stack(rows.v.to_numpy()).T
            scores[asked.id.to_numpy()[:, None] == ids[None]] = -np.inf
            for q, s in zip(asked.id, scores):
                least = np.partition(s, -min(k, len(s)))[-min(k, len(s))]
                out += [(q, i, x) for i, x in zip(ids[s >= least - 1e-5], s[s >= least - 1e-5]) if np.isfinite(x)]
        return pd.DataFrame(out, columns=["query_id", id_col, "score"]).astype({"query_id": "int64", id_col: "int64", "score": "float64"})

    met = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(best, f"query_id long, {id_col} long, score double")
    return first_per(met.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.asc(id_col)], k)
