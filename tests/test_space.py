import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import graphs, spatial

NODES, EDGES = "system int, side string, id int, kind string, mark string", "system int, side string, u int, v int"


def plain_graph(nodes, edges):
    """marks with kinds, and pairs of marks, with everything between them walked node by node."""
    def projected(side, keep):
        kept = {n[0]: n for n in nodes[side] if keep(n)}
        near = {n[0]: set() for n in nodes[side]}
        for u, v in edges[side]:
            near[u].add(v)
            near[v].add(u)
        pairs = set()
        for start in kept:
            seen, todo = {start}, list(near[start])
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at in kept:
                    if kept[at][2] != kept[start][2]:
                        pairs.add(tuple(sorted((kept[at][2], kept[start][2]))))
                else:
                    todo += near[at]
        return {n[2]: n[1] for n in kept.values()}, pairs

    marked = [projected(s, lambda n: n[2])[0] for s in (0, 1)]
    if not all(marked):
        return None
    level = set(marked[0 if len(marked[0]) <= len(marked[1]) else 1].values())
    (old, before), (new, after) = (projected(s, lambda n: n[2] and n[1] in level) for s in (0, 1))
    around = lambda pairs, k: tuple(sorted(b if a == k else a for a, b in pairs if k in (a, b)))
    gone, came, names = sorted(set(old) - set(new)), sorted(set(new) - set(old)), {}
    for k in list(gone):
        for x in came:
            if around(before, k) and old[k] == new[x] and around(before, k) == around(after, x):
                names[k] = x
                gone.remove(k)
                came.remove(x)
                break
    before = {tuple(sorted((names.get(a, a), names.get(b, b)))) for a, b in before}
    return gone, came, sorted(f"{a}>{b}" for a, b in names.items()), sorted("-".join(p) for p in before - after), sorted("-".join(p) for p in after - before)


def random_graph(rng):
    kind = {f"m{i}": f"k{i % 2}" for i in range(9)}
    nodes, edges = [], []
    for _ in range(2):
        marks = rng.sample(sorted(kind), rng.randrange(1, 7)) + [None] * rng.randrange(3)
        rng.shuffle(marks)
        nodes.append([(i, kind.get(m, "k0"), m) for i, m in enumerate(marks[:7])])
        edges.append([p for p in itertools.combinations(range(len(nodes[-1])), 2) if rng.random() < 0.4])
    return nodes, edges


def test_graphs_equal_a_walk_node_by_node(spark):
    rng = random.Random(6)
    made = {g: random_graph(rng) for g in range(120)}
    for g in range(0, 60):  # half of them: the same graph with one mark changed
        nodes, edges = made[g]
        renamed = [(i, k, "m9" if n == 0 and m else m) for n, (i, k, m) in enumerate(nodes[0])]
        made[g] = ([nodes[0], renamed], [edges[0], edges[0]])
    rows = [(g, s, i, k, m and m.upper()) for g, (nodes, _) in made.items() for s, side in zip(graphs.SIDES, nodes) for i, k, m in side]
    links = [(g, s, u, v) for g, (_, edges) in made.items() for s, side in zip(graphs.SIDES, edges) for u, v in side]
    found = graphs.compared(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES), ["system"]).collect()
    got = {r.system: (r.removed_nodes, r.added_nodes, r.renamed, r.removed_edges, r.added_edges) for r in found}
    assert got == {g: w for g, graph in made.items() if (w := plain_graph(*graph)) is not None}
    assert sum(bool(w[2]) for w in got.values()) > 20
    r = found[0]
    assert r.cost == 3 * len(r.removed_nodes) + len(r.added_nodes) + len(r.renamed) + 2 * len(r.removed_edges) + len(r.added_edges)


def test_chains_of_renamed_nodes_need_rounds(spark):
    rows = [(0, s, i, "k", m) for s, marks in zip(graphs.SIDES, ("abc", "axy")) for i, m in enumerate(marks)] + [(0, s, 3, "q", "z") for s in graphs.SIDES]
    links = [(0, s, u, v) for s in graphs.SIDES for u, v in ((0, 1), (1, 2), (2, 3), (1, 3))]
    run = lambda rounds: graphs.compared(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES), ["system"], rounds).collect()[0]
    assert run(1).renamed == [] and run(1).removed_nodes == ["b", "c"]
    one = [(0, s, i, "k", m) for s, marks in zip(graphs.SIDES, ("abc", "abd")) for i, m in enumerate(marks)]
    found = graphs.compared(spark.createDataFrame(one, NODES), spark.createDataFrame([x for x in links if x[3] != 3], EDGES), ["system"], 5).collect()[0]
    assert found.renamed == ["c>d"] and (found.removed_nodes, found.removed_edges, found.cost, found.changed) == ([], [], 1, True)


def sampled_gap(p, q):
    """Distance by many points along the edges and by holding."""
    def along(s):
        ends = [(s[i], s[(i + 1) % len(s)]) for i in range(len(s))] if len(s) > 2 else [(s[0], s[-1])]
        return [(a[0] + (b[0] - a[0]) * t / 60, a[1] + (b[1] - a[1]) * t / 60) for a, b in ends for t in range(61)]
    return min(math.dist(a, b) for a in along(p) for b in along(q))


def shapes(rng, n):
    out = []
    for i in range(n):
        x, y, kind = rng.uniform(-40, 40), rng.uniform(-40, 40), rng.randrange(3)
        if kind == 0:
            points = [[x, y]]
        elif kind == 1:
            points = [[x, y], [x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)]]
        else:
            turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 7)))
            points = [[x + rng.uniform(2, 9) * math.cos(t), y + rng.uniform(2, 9) * math.sin(t)] for t in turns]
        out.append((i % 3, i, points))
    return out


def test_relations_equal_all_pairs(spark):
    rng = random.Random(9)
    a, b = shapes(rng, 90), shapes(rng, 60)
    schema = "sheet int, item int, shape array<array<double>>"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    arrays = lambda rows: [(s, i, np.array(p)) for s, i, p in rows]
    gaps = {(i, j): spatial.gap(p, q) for s, i, p in arrays(a) for t, j, q in arrays(b) if s == t}
    for limit, cell in ((4.0, 3.0), (0.0, 50.0), (11.0, 7.5)):
        got = [(r.item, r.other_item) for r in spatial.within(left, right.select("sheet", F.col("item").alias("other_item"), F.col("shape").alias("other")), ["sheet"], limit, cell).collect()]
        assert sorted(got) == sorted(k for k, d in gaps.items() if d <= limit + 1e-9)
    for (i, j), d in list(gaps.items())[:150]:
        p, q = a[i][2], b[j][2]
        assert d <= sampled_gap(p, q) + 1e-9 and (d == 0 or sampled_gap(p, q) - d < 0.35)
    got = {r.item: r.holds for r in spatial.holds("distance", left, right, ["sheet"], "item", 4.0, 5.0).collect()}
    assert got == {i: any(d <= 4 + 1e-9 for (x, _), d in gaps.items() if x == i) for _, i, _ in a}
    centres = {i: (s, np.mean(p, axis=0)) for s, i, p in a}
    got = {r.item: r.holds for r in spatial.spaced(left, ["sheet"], "item", 6.0, 4.0).collect()}
    assert got == {i: any(j != i and t == s and math.dist(c, e) <= 6 for j, (t, e) in centres.items()) for i, (s, c) in centres.items()}


def test_points_inside_and_areas_covered(spark):
    schema = "sheet int, item int, shape array<array<double>>"
    notched = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [5.0, 3.0], [0.0, 10.0]]
    areas = spark.createDataFrame([(1, 7, notched), (2, 8, [[0.0, 0.0], [1.0, 0.0]])], schema)
    subjects = spark.createDataFrame([(1, 1, [[1.0, 1.0], [9.0, 1.0]]), (1, 2, [[5.0, 8.0]]), (3, 3, [[1.0, 1.0]]), (2, 4, [[0.5, 0.0]])], schema)
    assert {r.item: r.holds for r in spatial.holds("inside", subjects, areas, ["sheet"], "item").collect()} == {1: True, 2: False, 4: False}
    assert {r.item: r.holds for r in spatial.holds("intersects", subjects, areas, ["sheet"], "item").collect()} == {1: True, 2: False, 4: True}
    reach = lambda r: {x.item: x.holds for x in spatial.covered(areas, subjects, ["sheet"], "item", r, 1.0, 4.0).collect()}
    assert reach(12.0) == {7: True} and reach(5.4) == {7: False}


def test_crossings_without_a_device(spark):
    schema = "sheet int, item int, shape array<array<double>>"
    lines = spark.createDataFrame([(1, 1, [[-1.0, 1.0], [5.0, 1.0]]), (1, 2, [[-5.0, 9.0], [5.0, 9.0]])], schema)
    walls = spark.createDataFrame([(1, 1, [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])], schema)
    devices = spark.createDataFrame([(1, 1, [[0.3, 1.0]])], schema)
    got = [tuple(r) for r in spatial.guarded_crossings(lines, walls, devices, ["sheet"], "item", 0.5, 2.0).collect()]
    assert got == [(1, 1, 2, 1)]


def test_distances_of_many_pairs_are_those_of_each(spark):
    rng = random.Random(4)
    shape = lambda: [[float(rng.randrange(8)), rng.uniform(0, 8)] for _ in range(rng.choice((1, 2, 3, 4, 5)))]
    pairs = [(i, shape(), shape()) for i in range(400)]
    want = {i: spatial.gap(np.array(p), np.array(q)) for i, p, q in pairs}
    df = spark.createDataFrame(pairs, "i int, p array<array<double>>, q array<array<double>>")
    assert {r.i: r.d for r in df.select("i", spatial.distance("p", "q").alias("d")).collect()} == want
    squares = np.array([[[x, 0.0], [x + 1.0, 0.0], [x + 1.0, 1.0]] for x in range(50)])
    assert spatial._gaps(squares, squares + [5.0, 0.0]).tolist() == [spatial.gap(p, p + [5.0, 0.0]) for p in squares]


def test_an_area_of_several_shapes_is_covered_if_all_are(spark):
    box = lambda x: [[x, 0.0], [x + 2.0, 0.0], [x + 2.0, 2.0], [x, 2.0]]
    areas = spark.createDataFrame([(1, 1, box(0.0)), (1, 1, box(20.0)), (1, 2, box(0.0)), (2, 3, box(0.0))], "sheet int, area int, shape array<array<double>>")
    subjects = spark.createDataFrame([(1, 7, [[1.0, 1.0]])], "sheet int, item int, shape array<array<double>>")
    assert {(r.sheet, r.area): r.holds for r in spatial.covered(areas, subjects, ["sheet"], "area", 2.0, 0.5, 4.0).collect()} == {(1, 1): False, (1, 2): True, (2, 3): False}
