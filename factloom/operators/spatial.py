"""Spatial predicates between the shapes of a sheet, joined by grid cells.

A shape is an array of [x, y]: one point, the two ends of a line, or the corners of a polygon. Every shape goes to the
cells that its box, widened by the reach of the predicate, lies in, and shapes meet by sheet and cell; a pair that shares
several cells is kept in the one that has the lower left corner of what their boxes share. So what meets grows with what
is near, and not with the square of a sheet. Predicates are taken in blocks of cells: a shape is sent once to each block,
its cells are made and meet where the block is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.geometry import crossings, inside

SLACK = 1e-9
#: Sampled points to each direction of an area at most.
MOST_STEPS = 2000
#: Places computed at once, and cells of a block to each direction.
PLACES, SIDE = 1 << 18, 16


def centre(shape: Column) -> Column:
    """The mean of a shape's points, as [x, y]."""
    mean = lambda i: F.aggregate(shape, F.lit(0.0), lambda s, p: s + p[i]) / F.size(shape)
    return F.array(mean(0), mean(1))


def _boxed(df: DataFrame, shape: str, name: str, reach: float) -> DataFrame:
    """Columns name_x0 .. name_y1 of the box, widened by the reach."""
    low, high = (lambda i, f=f: f(F.transform(shape, lambda p: p[i])) for f in (F.array_min, F.array_max))
    return df.withColumns({f"{name}_x0": low(0) - reach, f"{name}_y0": low(1) - reach, f"{name}_x1": high(0) + reach, f"{name}_y1": high(1) + reach})


def _celled(df: DataFrame, name: str, cell: float) -> DataFrame:
    across = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{name}_{axis}0") / cell), F.floor(F.col(f"{name}_{axis}1") / cell)))
    return df.withColumn("_cx", across("x")).withColumn("_cy", across("y"))


def meeting(left: DataFrame, right: DataFrame, sheet: list[str], reach: float = 0.0, cell: float = 1.0, left_shape: str = "shape", right_shape: str = "other") -> DataFrame:
    """Rows of both whose boxes on one sheet are within the reach of each other, once for each pair."""
    a = _celled(_boxed(left.where(F.size(left_shape) > 0), left_shape, "_a", reach + SLACK), "_a", cell)
    b = _celled(_boxed(right.where(F.size(right_shape) > 0), right_shape, "_b", 0.0), "_b", cell)
    own = lambda axis: F.floor(F.greatest(f"_a_{axis}0", f"_b_{axis}0") / cell) == F.col(f"_c{axis}")
    shared = (F.col("_a_x0") <= F.col("_b_x1")) & (F.col("_b_x0") <= F.col("_a_x1")) & (F.col("_a_y0") <= F.col("_b_y1")) & (F.col("_b_y0") <= F.col("_a_y1"))
    met = a.join(b, [*sheet, "_cx", "_cy"]).where(shared & own("x") & own("y"))
    return met.drop("_cx", "_cy", *[f"_{s}_{axis}{n}" for s in "ab" for axis in "xy" for n in (0, 1)])


def _edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (points, np.roll(points, -1, axis=0)) if len(points) > 2 else (points[:1], points[-1:])


def _to_edges(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of points and edges."""
    along = b - a
    size = np.maximum((along**2).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a[None]) * along[None]).sum(-1) / size[None], 0, 1)
    return float(np.sqrt((((a[None] + t[..., None] * along[None]) - points[:, None]) ** 2).sum(-1)).min())


def _holds(polygon: np.ndarray, x: float, y: float) -> bool:
    a, b = _edges(polygon)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    return bool(len(polygon) > 2 and (x < a[over, 0] + (y - a[over, 1]) * (b[over, 0] - a[over, 0]) / (b[over, 1] - a[over, 1])).sum() % 2)


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    side = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
    a, b, c, d = a[:, None], b[:, None], c[None], d[None]
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any())


def gap(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two shapes; 0 where they touch, cross or one is within the other."""
    if _holds(p, *q[0]) or _holds(q, *p[0]) or _cross(*_edges(p), *_edges(q)):
        return 0.0
    return min(_to_edges(p, *_edges(q)), _to_edges(q, *_edges(p)))


def _edges_of(shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shapes, np.roll(shapes, -1, axis=1)) if shapes.shape[1] > 2 else (shapes[:, :1], shapes[:, -1:])


def _held(shapes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_holds`` of many shapes (pairs x corners x 2) and points of each (pairs x points x 2)."""
    if shapes.shape[1] < 3:
        return np.zeros(at.shape[:2], bool)
    low, high = (e[:, None] for e in _edges_of(shapes))
    x, y = at[:, :, None, 0], at[:, :, None, 1]
    over = (low[..., 1] > y) != (high[..., 1] > y)
    rise = np.where(over, high[..., 1] - low[..., 1], 1.0)
    return (over & (x < low[..., 0] + (y - low[..., 1]) * (high[..., 0] - low[..., 0]) / rise)).sum(2) % 2 == 1


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``gap`` of many pairs at once: pairs x points x 2, all shapes of a side of one size."""
    (a, b), (c, d) = _edges_of(p), _edges_of(q)

    def crossed() -> np.ndarray:
        side = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
        o, t, u, v = a[:, :, None], b[:, :, None], c[:, None], d[:, None]
        return ((side(o, t, u) * side(o, t, v) < 0) & (side(u, v, o) * side(u, v, t) < 0)).any((1, 2))

    def to_edges(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        along = (high - low)[:, None]
        t = np.clip(((points[:, :, None] - low[:, None]) * along).sum(-1) / np.maximum((along**2).sum(-1), 1e-300), 0, 1)
        return np.sqrt((((low[:, None] + t[..., None] * along) - points[:, :, None]) ** 2).sum(-1)).min((1, 2))

    none = _held(p, q[:, :1])[:, 0] | _held(q, p[:, :1])[:, 0] | crossed()
    return np.where(none, 0.0, np.minimum(to_edges(p, c, d), to_edges(q, a, b)))


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    sizes, out = np.array([a.map(len), b.map(len)]).reshape(2, -1) // 2, np.zeros(len(a))
    flat = [np.concatenate([np.zeros(0), *s]).reshape(-1, 2) for s in (a, b)]
    begin = np.cumsum(sizes, axis=1) - sizes
    for m, n in np.unique(sizes, axis=1).T:
        rows = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
        step = max(PLACES // int(m * n), 1)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            p, q = (flat[k][begin[k][part][:, None] + np.arange(size)] for k, size in enumerate((m, n)))
            out[part] = _gaps(p, q)
    return pd.Series(out)


def distance(a: str, b: str) -> Column:
    """Distance of two shapes."""
    return _distance(F.flatten(a), F.flatten(b))


def within(left: DataFrame, right: DataFrame, sheet: list[str], limit: float, cell: float) -> DataFrame:
    """Pairs of a ``shape`` and an ``other`` that are no further apart than the limit."""
    return meeting(left, right, sheet, limit, cell).where(distance("shape", "other") <= limit + SLACK)


def holds(kind: str, subjects: DataFrame, others: DataFrame, sheet: list[str], subject: str, limit: float = 0.0, cell: float = 1.0) -> DataFrame:
    """sheet, subject, holds: whether each subject lies inside, meets, or is within the limit of one of the others.

    Subjects and others have a ``shape``; ``inside`` wants all points of the subject in one polygon. Sheets without any
    of the others tell nothing and have no rows.
    """
    asked = Asked(inside=kind) if kind == "inside" else Asked(within={kind: {"intersects": 0.0, "distance": limit}[kind]})
    return judged(subjects, others, sheet, subject, asked, cell).select(*sheet, subject, "holds")


def spaced(subjects: DataFrame, sheet: list[str], subject: str, limit: float, cell: float) -> DataFrame:
    """sheet, subject, holds: whether another subject's centre is within the limit; a sheet's only one has none to miss."""
    return judged(subjects, None, sheet, subject, Asked(spaced=("spaced", limit)), cell).select(*sheet, subject, "holds")


def covered(areas: DataFrame, subjects: DataFrame, sheet: list[str], area: str, radius: float, step: float, cell: float) -> DataFrame:
    """sheet, area, holds: whether each corner, and each point of a grid within, has a subject's centre in the radius."""
    unnamed = subjects.select(*sheet, "shape").withColumn(area, F.lit(None).cast(areas.schema[area].dataType))
    return judged(unnamed, areas, sheet, area, Asked(covered=("covered", radius, step)), cell).select(*sheet, area, "holds")


@dataclass(frozen=True)
class Asked:
    """Predicates by the names they get: inside; within, with limits; spaced, with a limit; covered, with radius and step."""

    inside: str | None = None
    within: dict[str, float] = field(default_factory=dict)
    spaced: tuple[str, float] | None = None
    covered: tuple[str, float, float] | None = None

    @property
    def reach(self) -> float:
        """How far a subject is from anything that it is held against, at most."""
        return max([0.0, *self.within.values(), *(x[1] for x in (self.spaced, self.covered) if x)])

    @property
    def names(self) -> list[str]:
        return [*filter(None, [self.inside]), *self.within, *(x[0] for x in (self.spaced, self.covered) if x)]


def judged(subjects: DataFrame, others: DataFrame | None, sheet: list[str], item: str, asked: Asked, cell: float) -> DataFrame:
    """predicate, sheet, item, holds: all predicates asked for, of the subjects and (covered) of the others, at once.

    Every shape goes once to each block of its sheet that its box, a subject's widened by the reach, lies in; all that is
    near meets there by grid cells, in the task that has the block. What a block tells is a few flags of each shape, and
    the flags of an item, and the numbers of its sheet, are put together where the sheet is.
    """
    low, high = (lambda i, f=f: f(F.transform("shape", lambda p: p[i])) for f in (F.array_min, F.array_max))

    def blocks(df: DataFrame, side: int) -> DataFrame:
        reach = asked.reach + SLACK if side == 0 else 0.0
        at = lambda x: F.coalesce(F.floor(F.floor(x / cell) / SIDE), F.lit(0).cast("long"))
        real = F.forall("shape", lambda p: F.forall(F.slice(p, 1, 2), lambda v: F.abs(v) < F.lit(float("inf"))))
        spans = [F.when(real, F.sequence(at(low(i) - reach), at(high(i) + reach))).otherwise(F.array(F.lit(0).cast("long"))) for i in (0, 1)]
        rows = df.select(*sheet, F.col(item).alias("_item"), F.lit(side).cast("byte").alias("_side"), F.flatten("shape").alias("_shape"), *[F.coalesce(c, F.array(F.lit(0).cast("long"))).alias(f"_{n}s") for n, c in zip("xy", spans)])
        return rows.withColumn("_bx", F.explode("_xs")).withColumn("_by", F.explode("_ys")).select(
            *sheet, "_item", "_side", "_bx", "_by", "_shape", ((F.col("_bx") == F.col("_xs")[0]) & (F.col("_by") == F.col("_ys")[0])).alias("_own")
        )

    rows = blocks(subjects.where(F.size("shape") > 0).dropna(subset=sheet), 0)
    if others is not None:
        rows = rows.unionByName(blocks(others, 1))
    place = [*sheet, "_bx", "_by"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*sheet, "_item"])
    told = ", ".join(f"_f{n} boolean" for n in range(len(asked.names)))
    met = rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(_judge(len(sheet), asked, cell), f"{kinds}, _side byte, _own boolean, {told}")
    every = [name == (asked.covered or [None])[0] for name in asked.names]
    flags = [(F.bool_and if e else F.bool_or)(f"_f{n}").alias(f"_f{n}") for n, e in enumerate(every)]
    whole = W.partitionBy(*sheet)
    found = met.repartition(*sheet).groupBy(*sheet, "_item", "_side").agg(F.count_if("_own").alias("_n"), *flags)
    found = found.withColumns({"_against": F.max("_side").over(whole), "_alone": F.sum(F.when(F.col("_side") == 0, F.col("_n"))).over(whole) == 1})
    verdicts = []
    for n, (name, e) in enumerate(zip(asked.names, every)):
        flag, known = F.col(f"_f{n}"), (F.col("_side") == 0) & (F.col("_against") == 1)
        if asked.spaced and name == asked.spaced[0]:
            flag, known = flag | F.col("_alone"), F.col("_side") == 0
        elif e:
            known = flag.isNotNull()
        verdicts.append(F.when(known, F.struct(F.lit(name).alias("predicate"), flag.alias("holds"))))
    return found.select(*sheet, F.col("_item").alias(item), F.explode(F.array_compact(F.array(*verdicts))).alias("_v")).select("_v.predicate", *sheet, item, "_v.holds")


def _points_apart(a: str, b: str) -> Column:
    x, y = (F.col(a)[0][i] - F.col(b)[0][i] for i in (0, 1))
    return F.sqrt(x * x + y * y)


def _spans(low: np.ndarray, high: np.ndarray, group: np.ndarray, block: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the cells of its block that each box lies in."""
    first, last = (np.floor(v / cell) - block * SIDE for v in (low, high))
    rows = np.flatnonzero(((last >= 0) & (first < SIDE)).all(1))
    first, last = (np.clip(v[rows], 0, SIDE - 1).astype(np.int64) for v in (first, last))
    across = last - first + 1
    n = across.prod(1)
    at = np.repeat(np.arange(len(rows)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    x, y = first[at, 0] + k // across[at, 1], first[at, 1] + k % across[at, 1]
    return rows[at], (group[rows[at]] * SIDE + x) * SIDE + y


def _counted(n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, each as often as n says, with 0, 1, 2 and so on; no more at once than the most."""
    for first, size in _parts(n, most):
        k = n[first : first + size]
        for begin in range(0, max(int(k.sum()), 1), most) if size == 1 else (0,):
            own = np.minimum(k - begin, most) if size == 1 else k
            yield np.repeat(np.arange(first, first + size), own), begin + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)


def _parts(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows that follow each other and are the most together, or one row."""
    ends, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")), begin + 1)
        yield begin, end - begin
        begin = end


def _met(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal keys, no more than PLACES at once."""
    order = np.argsort(right, kind="stable")
    keys = right[order]
    first = np.searchsorted(keys, left, "left")
    for row, k in _counted(np.searchsorted(keys, left, "right") - first, PLACES):
        yield row, order[first[row] + k]


class _Shapes:
    """Shapes of a batch: flat points, and of each its first point, number of points, box and centre."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = values.reshape(-1, 2), sizes
        self.begin = np.cumsum(sizes) - sizes
        self.low, self.high, self.centre = (np.full((len(sizes), 2), np.nan) for _ in range(3))
        for n in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == n)
            at = self.of(rows, n)
            self.low[rows], self.high[rows] = at.min(1), at.max(1)
            self.centre[rows] = sum((at[:, i] for i in range(n)), np.zeros((len(rows), 2))) / n
        self.real = np.isfinite(self.low).all(1) & np.isfinite(self.high).all(1)

    def of(self, rows: np.ndarray, n: int) -> np.ndarray:
        return self.points[self.begin[rows][:, None] + np.arange(n)]

    def by_sizes(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of shapes: their places in a and b, and the points of both, all of one size."""
        code = self.sizes[a] * (int(self.sizes.max(initial=0)) + 1) + self.sizes[b]
        for c in np.unique(code):
            at = np.flatnonzero(code == c)
            m, n = int(self.sizes[a[at[0]]]), int(self.sizes[b[at[0]]])
            step = max(PLACES // (m * n), 1)
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                yield part, self.of(a[part], m), self.of(b[part], n)


def _near(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    x, y = a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]
    return np.sqrt(x * x + y * y) <= limit + SLACK


def _samples(shapes: _Shapes, areas: np.ndarray, block: np.ndarray, step: float, cell: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Areas and points, in the areas' blocks, of their corners and of the points of a grid that lie in them."""

    def owned(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (np.floor(np.floor(at / cell) / SIDE) == block[rows]).all(1)
        return rows[own], at[own]

    if (((shapes.high - shapes.low)[areas] / step) > MOST_STEPS).any():
        raise ValueError("the step is too small for an area")
    for n in np.unique(shapes.sizes[areas]):
        rows = areas[shapes.sizes[areas] == n]
        for part in np.array_split(rows, max(len(rows) * int(n) // PLACES, 1)):
            yield owned(np.repeat(part, n), shapes.of(part, n).reshape(-1, 2))
        last = ((shapes.high[rows] - shapes.low[rows]) / step + 1e-9).astype(np.int64)
        begin, end = (np.clip(np.floor(((block[rows] + k) * SIDE * cell - shapes.low[rows]) / step) + more, 0, last).astype(np.int64) for k, more in ((0, -1), (1, 1)))
        size = (end - begin + 1).prod(1)
        for row, k in _counted(size, PLACES // int(n)):
            down = end[row, 1] - begin[row, 1] + 1
            at = np.stack([k // down, k % down], axis=1) + begin[row]
            row, at = owned(rows[row], shapes.low[rows[row]] + step * at)
            held = _held(shapes.of(row, n), at[:, None])[:, 0]
            yield row[held], at[held]


def _judge(keys: int, asked: Asked, cell: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The flags of the rows of whole blocks; rows come sorted by sheet (the first columns) and block."""

    def told(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        column = lambda c: rows.column(rows.schema.get_field_index(c))
        side, listed = column("_side").to_numpy(), column("_shape")
        group, block = np.cumsum(new), np.stack([column(c).to_numpy().astype(float) for c in ("_bx", "_by")], axis=1)
        sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        shapes = _Shapes(np.asarray(listed.flatten().to_numpy(zero_copy_only=False), float), sizes)
        subject = np.flatnonzero((side == 0) & shapes.real)
        other = np.flatnonzero((side == 1) & shapes.real)
        item = column("_item").dictionary_encode().indices.fill_null(-1).to_numpy()
        cells = lambda at, low, high: _spans(low, high, group[at], block[at], cell)
        found = {name: np.zeros(len(side), bool) for name in asked.names}
        if asked.inside or asked.within:
            reach = max([0.0, *asked.within.values()]) + SLACK
            low, high = shapes.low[subject] - reach, shapes.high[subject] + reach
            (a, a_key), (b, b_key) = cells(subject, low, high), cells(other, shapes.low[other], shapes.high[other])
            for i, j in _met(a_key, b_key):
                s, o = a[i], b[j]
                corner = np.maximum(low[s], shapes.low[other[o]])
                at = np.stack([a_key[i] // SIDE % SIDE, a_key[i] % SIDE], axis=1) + block[subject[s]] * SIDE
                meets = (low[s] <= shapes.high[other[o]]).all(1) & (shapes.low[other[o]] <= high[s]).all(1) & (np.floor(corner / cell) == at).all(1)
                s, o = subject[s[meets]], other[o[meets]]
                for pairs, p, q in shapes.by_sizes(s, o):
                    if asked.inside and q.shape[1] > 2:
                        found[asked.inside][s[pairs[_held(q, p).all(1)]]] = True
                    if asked.within:
                        gaps = _gaps(p, q)
                        for name, limit in asked.within.items():
                            found[name][s[pairs[gaps <= limit + SLACK]]] = True
        centre = shapes.centre
        points, point_key = cells(subject, centre[subject], centre[subject])
        if asked.spaced:
            name, limit = asked.spaced
            a, a_key = cells(subject, centre[subject] - limit - SLACK, centre[subject] + limit + SLACK)
            for i, j in _met(a_key, point_key):
                s, o = subject[a[i]], subject[points[j]]
                near = (item[s] != item[o]) & (item[s] >= 0) & (item[o] >= 0) & _near(centre[s], centre[o], limit)
                found[name][s[near]] = True
        if asked.covered:
            name, radius, step = asked.covered
            a, a_key = cells(subject, centre[subject] - radius - SLACK, centre[subject] + radius + SLACK)
            areas = other[shapes.sizes[other] > 2]
            found[name][side == 1] = True
            for row, at in _samples(shapes, areas, block, step, cell):
                reached = np.zeros(len(row), bool)
                inner = np.floor(at / cell).astype(np.int64) - (block[row] * SIDE).astype(np.int64)
                for i, j in _met((group[row] * SIDE + inner[:, 0]) * SIDE + inner[:, 1], a_key):
                    reached[i[_near(at[i], centre[subject[a[j]]], radius)]] = True
                found[name][row[~reached]] = False
            known = (side == 1) & (sizes > 2)
        columns = [pa.array(found[n], mask=~known) if asked.covered and n == asked.covered[0] else pa.array(found[n]) for n in asked.names]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(keys)), *map(column, ("_item", "_side", "_own")), *columns], names=[*rows.schema.names[:keys], "_item", "_side", "_own", *(f"_f{n}" for n in range(len(columns)))])

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        new = np.ones(rows.num_rows, bool)
        new[1:] = False
        for name in (*rows.schema.names[:keys], "_bx", "_by"):
            c = rows.column(rows.schema.get_field_index(name))
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
        return new

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block that goes on in the next batch waits for it."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = int(np.flatnonzero(starts(batch))[-1])
            if waiting and not begin and not starts(pa.concat_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)]))[1]:
                waiting.append(batch)
                continue
            rows = pa.concat_batches([*waiting, batch.slice(0, begin)])
            waiting = [batch.slice(begin)]
            if rows.num_rows:
                yield told(rows, starts(rows))
        if waiting:
            rows = pa.concat_batches(waiting)
            yield told(rows, starts(rows))

    return judge


def guarded_crossings(lines: DataFrame, barriers: DataFrame, devices: DataFrame, sheet: list[str], line: str, radius: float, cell: float) -> DataFrame:
    """sheet, line, crossings and bare: where each line crosses a barrier's edges, and how often without a device near."""
    closed = F.when(F.size("shape") > 2, F.concat("shape", F.slice("shape", 1, 1))).otherwise(F.col("shape"))
    edge = F.explode(F.transform(F.sequence(F.lit(1), F.size("_ring") - 1), lambda i: F.array(F.col("_ring")[i - 1], F.col("_ring")[i])))
    edges = barriers.where(F.size("shape") > 1).select(*sheet, closed.alias("_ring")).select(*sheet, edge.alias("other"))
    met = meeting(lines.select(*sheet, line, "shape"), edges, sheet, 0.0, cell)
    at = met.select(*sheet, line, F.explode(crossings(F.col("shape"), F.col("other"))).alias("at")).distinct().select(*sheet, line, F.array("at").alias("shape"))
    centres = devices.where(F.size("shape") > 0).select(*sheet, F.array(centre(F.col("shape"))).alias("other"))
    near = meeting(at, centres, sheet, radius, cell).where(_points_apart("shape", "other") <= radius + SLACK).select(*sheet, line, F.to_json("shape").alias("_at")).distinct()
    found = at.select(*sheet, line, F.to_json("shape").alias("_at")).join(near.withColumn("_near", F.lit(True)), [*sheet, line, "_at"], "left")
    return found.groupBy(*sheet, line).agg(F.count("*").alias("crossings"), F.count_if(F.col("_near").isNull()).alias("bare"))
