"""Graphs of systems compared by the marks of their nodes: contraction of what has none, renamed nodes, cost of the edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.components import components
from factloom.operators.stacks import written_key
from factloom.sources.shared import checkpointed

SIDES = ("PD", "RD")
#: What each edit costs.
COST = {"removed_nodes": 3, "added_nodes": 1, "renamed": 1, "removed_edges": 2, "added_edges": 1}


def contracted(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b (marks, a before b): kept nodes that an edge or a path through nodes not kept connects.

    Nodes have keys, id, mark and kept; nodes that are left out and touch each other are one place, and all marks around
    a place are connected, as many pairs as there are.
    """
    end = lambda name: nodes.select(*keys, F.col("id").alias(name), F.col("mark").alias(f"{name}_mark"), F.col("kept").alias(f"{name}_kept"))
    both = checkpointed(edges.select(*keys, "u", "v").join(end("u"), [*keys, "u"]).join(end("v"), [*keys, "v"]))
    direct = both.where("u_kept and v_kept").select(*keys, F.col("u_mark").alias("x"), F.col("v_mark").alias("y"))
    node = lambda name: F.struct(*keys, F.col(name).alias("id"))
    roots = components(both.where("not u_kept and not v_kept").select(node("u").alias("a"), node("v").alias("b")))
    crossing = both.where("u_kept and not v_kept").select(*keys, F.col("u_mark").alias("mark"), node("v").alias("node"))
    crossing = crossing.unionAll(both.where("v_kept and not u_kept").select(*keys, F.col("v_mark").alias("mark"), node("u").alias("node")))
    around = crossing.join(roots, "node", "left").select(*keys, "mark", F.coalesce("root", "node").alias("place")).distinct()
    through = around.withColumnRenamed("mark", "x").join(around.withColumnRenamed("mark", "y"), [*keys, "place"]).where("x < y").select(*keys, "x", "y")
    pairs = direct.unionAll(through).where("x <> y")
    return pairs.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _neighbours(links: DataFrame, keys: list[str]) -> DataFrame:
    ends = links.select(*keys, F.col("a").alias("mark"), F.col("b").alias("other")).unionAll(links.select(*keys, F.col("b").alias("mark"), F.col("a").alias("other")))
    return ends.groupBy(*keys, "mark").agg(F.array_sort(F.collect_set("other")).alias("around"))


def _renamed(links: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Links with the marks that ``names`` (was, now) gives their ends."""
    for end in ("a", "b"):
        links = links.join(names.select(*keys, F.col("was").alias(end), F.col("now").alias("_new")), [*keys, end], "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compared(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int = 1) -> DataFrame:
    """A row for each graph that both sides have: lists of removed, added and renamed nodes and edges, cost and changed.

    Nodes have keys, side (PD or RD), id, kind and mark, edges keys, side, u and v. The side with fewer marks tells
    which kinds of nodes count. A node that went and one that came are one renamed if they are of one kind and have the
    same neighbours, of several the first by mark with the first; each further round sees what the last one renamed, so
    chains of renamed nodes need as many. A graph that has changed has lost a node or an edge or has a renamed node: what
    came is detail.
    """
    both = [*keys, "side"]
    nodes = nodes.withColumn("mark", F.nullif(written_key(F.col("mark")), F.lit("")))
    marked = checkpointed(nodes.where("mark is not null").groupBy(*both, "mark").agg(F.max("kind").alias("kind")))
    n = lambda side: F.count_if(F.col("side") == side)
    sizes = marked.groupBy(*keys).agg(n(SIDES[0]).alias("n_a"), n(SIDES[1]).alias("n_b")).where("n_a > 0 and n_b > 0")
    less = sizes.select(*keys, F.when(F.col("n_a") <= F.col("n_b"), SIDES[0]).otherwise(SIDES[1]).alias("side"))
    level = marked.join(less, both).select(*keys, "kind").distinct().withColumn("_counts", F.lit(True))
    flagged = nodes.join(less.select(*keys), keys, "left_semi").join(level, [*keys, "kind"], "left")
    flagged = checkpointed(flagged.withColumn("kept", F.col("mark").isNotNull() & F.coalesce("_counts", F.lit(False))).drop("_counts"))
    links = checkpointed(contracted(flagged, edges.join(less.select(*keys), keys, "left_semi"), both))
    held = flagged.where("kept").groupBy(*both, "mark").agg(F.max("kind").alias("kind"))
    side = lambda df, s: df.where(F.col("side") == s).drop("side")
    old, new = side(held, SIDES[0]), side(held, SIDES[1])
    old_links, new_links = side(links, SIDES[0]), side(links, SIDES[1])
    gone, came = checkpointed(old.join(new, [*keys, "mark"], "left_anti")), checkpointed(new.join(old, [*keys, "mark"], "left_anti"))
    names = None
    for _ in range(rounds):
        known = old_links if names is None else _renamed(old_links, names, keys)
        like = lambda df, ends, name: df.join(_neighbours(ends, keys), [*keys, "mark"]).select(
            *keys, "kind", "around", F.col("mark").alias(name), F.row_number().over(W.partitionBy(*keys, "kind", "around").orderBy("mark")).alias("no")
        )
        found = checkpointed(like(gone, known, "was").join(like(came, new_links, "now"), [*keys, "kind", "around", "no"]).select(*keys, "was", "now"))
        names = found if names is None else checkpointed(names.unionAll(found))
        if rounds > 1:
            if found.isEmpty():
                break
            gone = gone.join(found.withColumnRenamed("was", "mark"), [*keys, "mark"], "left_anti")
            came = came.join(found.withColumnRenamed("now", "mark"), [*keys, "mark"], "left_anti")
    if rounds == 1:
        gone = gone.join(names.withColumnRenamed("was", "mark"), [*keys, "mark"], "left_anti")
        came = came.join(names.withColumnRenamed("now", "mark"), [*keys, "mark"], "left_anti")
    known = _renamed(old_links, names, keys)
    parts = {
        "removed_nodes": gone.select(*keys, F.col("mark").alias("x")), "added_nodes": came.select(*keys, F.col("mark").alias("x")),
        "renamed": names.select(*keys, F.concat_ws(">", "was", "now").alias("x")),
        "removed_edges": known.join(new_links, [*keys, "a", "b"], "left_anti").select(*keys, F.concat_ws("-", "a", "b").alias("x")),
        "added_edges": new_links.join(known, [*keys, "a", "b"], "left_anti").select(*keys, F.concat_ws("-", "a", "b").alias("x")),
    }
    edits = None
    for name, rows in parts.items():
        rows = rows.withColumn("edit", F.lit(name))
        edits = rows if edits is None else edits.unionByName(rows)
    listed = lambda name: F.array_sort(F.collect_list(F.when(F.col("edit") == name, F.col("x")))).alias(name)
    rows = less.select(*keys).join(edits.groupBy(*keys).agg(*map(listed, parts)), keys, "left")
    rows = rows.select(*keys, *[F.coalesce(name, F.array().cast("array<string>")).alias(name) for name in parts])
    size: dict[str, Column] = {name: F.size(name) for name in parts}
    cost = sum((size[name] * c for name, c in COST.items()), F.lit(0))
    changed = (size["removed_nodes"] > 0) | (size["removed_edges"] > 0) | (size["renamed"] > 0)
    return rows.withColumn("cost", cost).withColumn("changed", changed)
