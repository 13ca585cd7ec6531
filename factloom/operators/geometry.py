"""Planar geometry over polygons as arrays of points; predicates of pairs run on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def area(polygon: Column) -> Column:
    """Shoelace area of an array of [x, y] points, in built-in expressions."""
    n = F.size(polygon)
    turn = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: polygon[i][0] * polygon[(i + 1) % n][1] - polygon[(i + 1) % n][0] * polygon[i][1],
    )
    return F.when(n >= 3, F.abs(F.aggregate(turn, F.lit(0.0), lambda a, b: a + b)) / 2).otherwise(0.0)


def inside(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a polygon: edges crossed by a ray, odd or even."""
    n = F.size(polygon)

    def crosses(i):
        a, b = polygon[i], polygon[(i + 1) % n]
        between = (a[1] > y) != (b[1] > y)
        return (between & (x < F.try_divide((b[0] - a[0]) * (y - a[1]), b[1] - a[1]) + a[0])).cast("int")

    count = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, c: s + c)
    return F.when(n >= 3, count % 2 == 1).otherwise(False)


def apply_frame(x: Column, y: Column, frame: list[float]) -> tuple[Column, Column]:
    """Affine frame a, b, c, d, e, f: x' = ax + by + c, y' = dx + ey + f."""
    a, b, c, d, e, f = frame
    return a * x + b * y + c, d * x + e * y + f


#: The larger side of two contours is this many steps of the points along their edges; numbers held at once (a processor's cache).
STEPS = 200
AT_ONCE = 1 << 15


def _contours(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All corners of a batch, where each row's begin, and how many it has; -1 for null."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    corners = column.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    return corners, np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), sizes


def _alike(a: pa.Array, b: pa.Array, least: int, numbers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows whose contours have as many corners each, least or more, with the corners; about AT_ONCE ``numbers`` in all."""
    (p, p_at, p_size), (q, q_at, q_size) = _contours(a), _contours(b)
    rows = np.flatnonzero((p_size >= least) & (q_size >= least))
    rows = rows[np.lexsort((q_size[rows], p_size[rows]))]
    for group in np.split(rows, np.flatnonzero((np.diff(p_size[rows]) != 0) | (np.diff(q_size[rows]) != 0)) + 1):
        if len(group):
            n, m = int(p_size[group[0]]), int(q_size[group[0]])
            most = max(AT_ONCE // numbers(n, m), 1)
            for part in (group[i : i + most] for i in range(0, len(group), most)):
                yield part, p[p_at[part, None] + np.arange(n)], q[q_at[part, None] + np.arange(m)]


def _doubles(found: np.ndarray) -> pa.Array:
    return pa.array(found, pa.float64(), mask=np.isnan(found))


def _squared(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """Squared distances of points to an edge each, from a corner on."""
    t = ((x - ax) * ex + (y - ay) * ey) / np.maximum(ex * ex + ey * ey, 1e-300)
    np.clip(t, 0, 1, out=t)
    dx, dy = ax + t * ex - x, ay + t * ey - y
    return dx * dx + dy * dy


def _furthest(p: np.ndarray, q: np.ndarray, step: np.ndarray) -> np.ndarray:
    """How far the furthest point of each row's first contour, taken every step along its edges, is from the other's edges."""
    edge = np.roll(p, -1, axis=1) - p
    n = np.maximum(np.ceil(np.sqrt(edge[..., 0] ** 2 + edge[..., 1] ** 2) / step[:, None]).astype(int), 1).ravel()
    first = np.cumsum(n) - n
    part = (np.arange(n.sum()) - np.repeat(first, n)) / np.repeat(n, n)
    corner, along = p.reshape(-1, 2), edge.reshape(-1, 2)
    x, y = (np.repeat(corner[:, i], n) + part * np.repeat(along[:, i], n) for i in (0, 1))
    points = n.reshape(len(p), -1).sum(1)
    sides, nearest = np.roll(q, -1, axis=1) - q, np.full(len(x), np.inf)
    for i in range(q.shape[1]):
        np.minimum(nearest, _squared(x, y, *(np.repeat(of[:, i, axis], points) for of in (q, sides) for axis in (0, 1))), out=nearest)
    return np.sqrt(np.maximum.reduceat(nearest, np.cumsum(points) - points))


def _hausdorffs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    both = np.concatenate([p, q], axis=1)
    step = np.maximum((both.max(1) - both.min(1)).max(1) / STEPS, 1e-9)
    return np.maximum(_furthest(p, q, step), _furthest(q, p, step))


def _hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    return float(_hausdorffs(a[None], b[None])[0])


@F.arrow_udf(T.DoubleType())
def hausdorff(a: pa.Array, b: pa.Array) -> pa.Array:
    """Largest distance from a point of either contour's edges to the nearest of the other, to half a step."""
    found = np.full(len(a), np.nan)
    for rows, p, q in _alike(a, b, 1, lambda n, m: (n + m) * STEPS):
        found[rows] = _hausdorffs(p, q)
    return _doubles(found)


@F.arrow_udf(T.DoubleType())
def distance_to_contour(x: pa.Array, y: pa.Array, polygon: pa.Array) -> pa.Array:
    """Distance of a point to the nearest edge."""
    px, py, found = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), np.full(len(x), np.nan)
    for rows, p, _ in _alike(polygon, polygon, 1, lambda n, m: n):
        sides = np.roll(p, -1, axis=1) - p
        found[rows] = np.sqrt(np.min([_squared(px[rows], py[rows], p[:, i, 0], p[:, i, 1], sides[:, i, 0], sides[:, i, 1]) for i in range(p.shape[1])], axis=0))
    return _doubles(found)


def crossings(a: Column, b: Column) -> Column:
    """Points where two polylines, arrays of [x, y], cross or touch; parallel stretches that overlap are no crossing."""
    steps = lambda line: F.when(F.size(line) > 1, F.sequence(F.lit(1), F.size(line) - 1)).otherwise(F.array().cast("array<int>"))

    def meet(i, j):
        p, q, u, v = a[i - 1], a[i], b[j - 1], b[j]
        rx, ry, sx, sy = q[0] - p[0], q[1] - p[1], v[0] - u[0], v[1] - u[1]
        turn = rx * sy - ry * sx
        t = F.try_divide((u[0] - p[0]) * sy - (u[1] - p[1]) * sx, turn)
        w = F.try_divide((u[0] - p[0]) * ry - (u[1] - p[1]) * rx, turn)
        hit = (F.abs(turn) > 1e-9) & t.between(-1e-9, 1 + 1e-9) & w.between(-1e-9, 1 + 1e-9)
        return F.when(hit, F.array(F.round(p[0] + t * rx, 6), F.round(p[1] + t * ry, 6)))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(steps(a), lambda i: F.transform(steps(b), lambda j: meet(i, j))))))


def _slabs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) between neighbouring heights of each row's corners and of the points where edges of the two cross."""
    r, s = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    turn = r[:, :, None, 0] * s[:, None, :, 1] - r[:, :, None, 1] * s[:, None, :, 0]
    gap = q[:, None] - p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * s[:, None, :, 1] - gap[..., 1] * s[:, None, :, 0]) / turn
        u = (gap[..., 0] * r[:, :, None, 1] - gap[..., 1] * r[:, :, None, 0]) / turn
        hit = (np.abs(turn) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        crossed = (p[:, :, None, 1] + t * r[:, :, None, 1])[hit]
    every = np.arange(len(p))
    row = np.concatenate([np.repeat(every, p.shape[1]), np.repeat(every, q.shape[1]), np.nonzero(hit)[0]])
    y = np.concatenate([p[..., 1].ravel(), q[..., 1].ravel(), crossed])
    order = np.lexsort((y, row))
    row, y = row[order], y[order]
    apart = (row[1:] == row[:-1]) & (y[1:] > y[:-1])
    return row[:-1][apart], y[:-1][apart], y[1:][apart]


def _cover(polygons: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the stretches of a level that are in a polygon, for each polygon and level; nan past the last."""
    a, b, level = polygons, np.roll(polygons, -1, axis=1), y[:, None]
    over = (a[..., 1] > level) != (b[..., 1] > level)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(over, a[..., 0] + (level - a[..., 1]) * (b[..., 0] - a[..., 0]) / (b[..., 1] - a[..., 1]), np.nan)
    most = int(over.sum(1).max(initial=0))
    x = np.sort(x, axis=1)[:, :most]
    return x[:, ::2], x[:, 1::2]


def _shared_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between two neighbouring levels every edge is straight, so the middle's width times the height is exact."""
    row, low, high = _slabs(p, q)
    most, total = max(AT_ONCE // (p.shape[1] + q.shape[1]), 1), np.zeros(len(p))
    for at in range(0, len(row), most):
        part = slice(at, at + most)
        y = (low[part] + high[part]) / 2
        (a, b), (c, d) = _cover(p[row[part]], y), _cover(q[row[part]], y)
        width = np.zeros(len(y))
        for i in range(a.shape[1]):
            for j in range(c.shape[1]):
                width += np.fmax(0.0, np.minimum(b[:, i], d[:, j]) - np.maximum(a[:, i], c[:, j]))
        np.add.at(total, row[part], (high[part] - low[part]) * width)
    return total


def _sizes(z: np.ndarray) -> np.ndarray:
    x, y = z[..., 0], z[..., 1]
    return np.abs(np.sum(x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y, axis=1)) / 2


@F.arrow_udf(T.DoubleType())
def polygon_iou(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shared area of two polygons whose edges don't cross themselves, over the area of both; null for fewer than three corners."""
    found = np.full(len(a), np.nan)
    for rows, p, q in _alike(a, b, 3, lambda n, m: n * m):
        shared = _shared_areas(p, q)
        both = _sizes(p) + _sizes(q) - shared
        found[rows] = np.divide(shared, both, out=np.full(len(rows), np.nan), where=both > 0)
    return _doubles(found)


def related(subjects: DataFrame, others: DataFrame, sheet: list[str], subject: str, kind: str, limit: float = 0.0) -> DataFrame:
    """(sheet, subject, holds): whether each subject's box is inside, meets or is within ``limit`` of one of the others.

    Boxes are arrays x0, y0, x1, y1 in a column ``box``; only those of one sheet can meet. A sheet without others has
    nothing to hold against and no rows.
    """
    a, b = F.col("box"), F.col("_other")
    across, along = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2]), F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    gap = F.sqrt(across * across + along * along)
    holds = {
        "inside": (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3]),
        "intersects": gap <= 1e-9,
        "distance": gap <= limit + 1e-9,
    }[kind]
    met = subjects.select(*sheet, subject, "box").join(others.select(*sheet, F.col("box").alias("_other")), sheet)
    return met.groupBy(*sheet, subject).agg(F.bool_or(holds).alias("holds"))
