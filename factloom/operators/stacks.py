"""Stacks of layers: runs of one material merged, stacks aligned, and the operations that turn one into the other.

A layer is struct(m, raw, t): the material's key or null for one that the catalogue doesn't know, how it is written, and
its thickness. Many pairs of stacks are aligned at once: the table of scores has a plane for each pair of a batch, and
its cells are filled for the whole batch in one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = "array<struct<m:string,raw:string,t:double>>"
#: What it is worth to put two layers on one place, and to leave one alone.
SAME, GROUP, UNKNOWN, OTHER, GAP = 3, 1, 0, -5, -2
#: Pairs aligned at once.
PLANES = 4096


def written_key(text: Column) -> Column:
    """Letters and digits of a name in lower case; empty for one without any."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), r"[^a-zа-я0-9]+", "")


def material(layer: Column) -> Column:
    """What tells whether two layers are of one material: its key, else how it is written; null tells nothing."""
    return F.coalesce(layer["m"], F.concat(F.lit("~"), F.nullif(written_key(layer["raw"]), F.lit(""))))


def merged_runs(layers: Column) -> Column:
    """Neighbouring layers of one material as one, as thick as they are together if all have a thickness.

    Of a material that only its writing tells, two layers are one: what is written for both is no longer what the third has.
    """

    def add(out: Column, layer: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        both = F.struct(last["m"].alias("m"), F.concat(last["raw"], F.lit(" + "), layer["raw"]).alias("raw"), (last["t"] + layer["t"]).alias("t"))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both)).cast(LAYERS)
        return F.when((F.size(out) > 0) & F.coalesce(material(last) == material(layer), F.lit(False)), joined).otherwise(F.concat(out, F.array(layer)))

    return F.aggregate(layers.cast(LAYERS), F.array().cast(LAYERS), add)


def steps(score: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Best global alignments of many pairs: places in both stacks, -1 for none.

    ``score`` is pairs x rows x columns, ``n`` and ``m`` are the pairs' lengths. Of equal alignments that one is taken
    which, read from the end, puts layers together before it leaves one of the second stack alone, and that before one
    of the first.
    """
    pairs, rows, columns = score.shape
    best = np.zeros((pairs, rows + 1, columns + 1), np.int32)
    best[:, :, 0], best[:, 0, :] = GAP * np.arange(rows + 1), GAP * np.arange(columns + 1)
    for i in range(1, rows + 1):
        for j in range(1, columns + 1):
            alone = np.maximum(best[:, i - 1, j], best[:, i, j - 1]) + GAP
            best[:, i, j] = np.maximum(best[:, i - 1, j - 1] + score[:, i - 1, j - 1], alone)
    every = np.arange(pairs)
    i, j, taken = n.copy(), m.copy(), []
    for _ in range(rows + columns):
        here = best[every, i, j]
        both = (i > 0) & (j > 0) & (here == best[every, i - 1, j - 1] + score[every, i - 1, j - 1] if score.size else False)
        second = ~both & (j > 0) & (here == best[every, i, j - 1] + GAP)
        first = ~both & ~second & (i > 0)
        taken.append((np.where(both | first, i - 1, -1), np.where(both | second, j - 1, -1)))
        i, j = i - (both | first), j - (both | second)
    for pair in range(pairs):
        yield [(int(a[pair]), int(b[pair])) for a, b in reversed(taken) if a[pair] >= 0 or b[pair] >= 0]


def scores(a: list[list[tuple]], b: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all places of pairs of coded stacks; a layer is (material, group), None where unknown."""
    codes: dict = {}

    def coded(stacks: list[list[tuple]]) -> np.ndarray:
        out = np.full((len(stacks), max(map(len, stacks), default=0), 3), -1, np.int64)
        for row, stack in enumerate(stacks):
            for at, (name, known, group) in enumerate(stack):
                out[row, at] = [codes.setdefault(name, len(codes)) if name is not None else -1, known, codes.setdefault(("g", group), len(codes)) if group is not None else -1]
        return out

    x, y = coded(a)[:, :, None], coded(b)[:, None]
    same = (x[..., 0] == y[..., 0]) & (x[..., 0] >= 0)
    either_unknown = (x[..., 1] != 1) | (y[..., 1] != 1)
    group = (x[..., 2] == y[..., 2]) & (x[..., 2] >= 0)
    out = np.where(same, SAME, np.where(either_unknown, UNKNOWN, np.where(group, GROUP, OTHER))).astype(np.int32)
    return out, np.array([len(s) for s in a]), np.array([len(s) for s in b])


def _moved(a: list[tuple], b: list[tuple], path: list[tuple[int, int]]) -> list[tuple[int, int | None, int | None, bool]]:
    """step, both places and whether it moves there, of a path without the steps that a layer moves to."""
    came: dict[str, list[int]] = {}
    for step, (i, j) in enumerate(path):
        if i < 0 and b[j][0] is not None:
            came.setdefault(b[j][0], []).append(step)
    out, used, taken = [], set(), dict.fromkeys(came, 0)
    for step, (i, j) in enumerate(path):
        if j < 0 and came and taken.get(name := a[i][0], 0) < len(came.get(name, ())):
            to = came[name][taken[name]]
            taken[name] += 1
            used.add(to)
            out.append((step, i, path[to][1], True))
        else:
            out.append((step, i if i >= 0 else None, j if j >= 0 else None, False))
    return [x for x in out if x[0] not in used] if used else out


PATH = "array<struct<step:int,before_at:int,after_at:int,moved:boolean>>"


def paths(pairs: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """The pairs with ``path``: the steps of their stacks ``before`` and ``after``, and places in both, null where a layer
    stands alone.

    A layer left alone on one side and found alone on the other in the same material is moved, the n-th of a material to
    the n-th, and has one step. ``groups`` tells materials of one group. Null stacks are empty. Stacks go along, so that
    nobody has to find them again.
    """
    coded = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(LAYERS)), lambda x: F.struct(material(x).alias("name"), F.when(x["m"].isNotNull(), 1).otherwise(0).alias("known"), x["m"].alias("m")))
    group_of = dict(groups or {})
    n = len(pairs.columns)

    def layers(column: pa.ListArray) -> list[list[tuple]]:
        flat = column.flatten()
        names, known, keys = (flat.field(k).to_pylist() for k in range(3))
        every, ends = list(zip(names, known, map(group_of.get, keys))), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)).tolist()
        return [every[i:j] for i, j in zip([0, *ends], ends)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for begin in range(0, batch.num_rows, PLANES):
                part = batch.slice(begin, PLANES)
                sides = [layers(part.column(c)) for c in (n, n + 1)]
                found = [_moved(a, b, path) for a, b, path in zip(*sides, steps(*scores(*sides)))]
                columns = [pa.array([p[k] for f in found for p in f], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
                at = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
                path = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, ["step", "before_at", "after_at", "moved"]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(n)), path], [*names, "path"])

    names = pairs.columns
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names]
    return pairs.select(*names, coded("before").alias("_a"), coded("after").alias("_b")).mapInArrow(batches, ", ".join([*kinds, f"path {PATH}"]))


def operations(pairs: DataFrame, keys: list[str], analogs: DataFrame, groups: dict[str, str] | None = None, every: bool = False) -> DataFrame:
    """keys, step, op, before_at, after_at, violation and uncertain of what turns stack ``before`` into ``after``.

    Stacks are merged runs; ``tolerance`` (of the pair) is how much thinner a layer may be. A substitute is as good as
    ``analogs`` (was, now, verdict) say; where the catalogue knows only one of the two, nobody can tell. With ``every``
    a pair without a layer has one row without an operation.
    """
    layer = lambda c, at: F.get(F.col(c), at)
    step = F.transform("path", lambda p: F.struct(p["step"].alias("step"), p["before_at"].alias("before_at"), p["after_at"].alias("after_at"), p["moved"].alias("moved"), layer("before", p["before_at"]).alias("was"), layer("after", p["after_at"]).alias("now")))
    explode = F.explode_outer if every else F.explode
    path = paths(pairs.select(*keys, "before", "after", "tolerance"), groups).select(*keys, "tolerance", explode(step).alias("_s")).select(*keys, "tolerance", "_s.*")
    known = F.broadcast(analogs.select(F.col("was").alias("_was"), F.col("now").alias("_now"), "verdict"))
    path = path.join(known, (F.col("was.m") == F.col("_was")) & (F.col("now.m") == F.col("_now")), "left")
    same = F.coalesce(material(F.col("was")) == material(F.col("now")), F.lit(False))
    unknown = F.col("was.m").isNull() | F.col("now.m").isNull()
    equivalent = F.coalesce(F.col("verdict") == "EQUIVALENT", F.lit(False))
    change = F.col("now.t") - F.col("was.t")
    thickness = F.when(change < -F.col("tolerance"), "thickness_down").when(change > F.col("tolerance"), "thickness_up")
    placed = (
        F.when(F.col("now").isNull(), "delete_layer").when(F.col("was").isNull(), "insert_layer").when(F.col("moved"), "reorder")
        .when(same, F.when(thickness.isNull(), "match")).otherwise("substitute_material")
    )
    both = F.col("was").isNotNull() & F.col("now").isNotNull() & (same | ~unknown & equivalent)
    rows = path.withColumn("ops", F.when(F.col("step").isNotNull(), F.array_compact(F.array(placed, F.when(both, thickness))))).withColumn("op", explode("ops"))
    substitute = F.col("op") == "substitute_material"
    violation = F.col("op").isin("delete_layer", "thickness_down", "reorder") | substitute & ~unknown & ~equivalent
    return rows.select(*keys, "step", "op", "before_at", "after_at", violation.alias("violation"), (substitute & unknown).alias("uncertain"))
