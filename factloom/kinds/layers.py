"""The kind of layered constructions: stacks of materials, paired between stages and compared layer by layer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, applied, disputed, of, subjects, true
from factloom.operators.compare import ladder
from factloom.operators.stacks import LAYERS, material, merged_runs, operations, written_key
from factloom.sources.shared import checkpointed

#: Roles of revisions from the best on, what a violation is called by first, and the least likeness of
#: stacks without a common mark.
ROLES, WORST, ALIKE = ("CURRENT", "CONFLICT", "UNRESOLVED"), ("delete_layer", "substitute_material", "thickness_down", "reorder"), 0.5
PAIR = [*KEYS, "stage", "before_no", "after_no"]


def _ranked(mentions: DataFrame, params: DataFrame) -> DataFrame:
    """Mentions with what ``usable`` tells of them, and fit: whether they count; all rows of KEYS are in one task."""
    fit = F.col("stage").isin(*STAGES) & (F.size("layers") > 0) & ~true(F.col("role") == "SUPERSEDED")
    if "excluded" in mentions.columns:
        fit = fit & F.col("excluded").isNull()
    rank = F.col("source_rank") if "source_rank" in mentions.columns else F.lit(0)
    order = [rank, F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.desc_nulls_last("confidence"), F.asc("file_id"), F.asc("page"), F.asc_nulls_first("item"), F.col("layers").cast("string")]
    at = F.row_number().over(W.partitionBy(*KEYS).orderBy("_unfit", "stage", *order))
    rows = of(mentions, params).withColumn("fit", true(fit)).withColumn("_unfit", ~F.col("fit")).withColumn("_at", at)
    no = F.col("_at") - F.min("_at").over(W.partitionBy(*KEYS, "_unfit", "stage")) + 1
    names = F.array_distinct(F.transform("layers", lambda x: F.coalesce(material(x), F.lit("~"))))
    return rows.select(*KEYS, "stage", no.alias("no"), F.nullif(written_key(F.col("item")), F.lit("")).alias("mark"), "file_id", "role", names.alias("names"), merged_runs(F.col("layers")).alias("layers"), "fit")


def usable(mentions: DataFrame, params: DataFrame) -> DataFrame:
    """Mentions that count, by priority: keys, stage, no (from 1 within the stage), mark (null without), file_id, role, names (the
    materials) and layers.

    Mentions have item, layers, and optionally excluded (why one doesn't count) and source_rank; past revisions and
    mentions without a layer don't count. Runs of one material are merged.
    """
    return _ranked(mentions, params).where("fit").drop("fit")


def _firsts(rows: DataFrame) -> DataFrame:
    """The first stack of each mark of a stage, and every one without a mark."""
    first = F.min("no").over(W.partitionBy(*KEYS, "stage", "mark"))
    return rows.withColumn("_first", first).where("mark is null or no = _first").drop("_first")


def _alike(left: list[int], right: list[int], names: list[list[str]]) -> Iterator[tuple[float, int, int]]:
    """Likeness of stacks that share a material: shared materials among all of both."""
    having: dict[str, list[int]] = {}
    for i in left:
        for name in names[i]:
            having.setdefault(name, []).append(i)
    for j in right:
        for i, n in Counter(i for name in names[j] for i in having.get(name, ())).items():
            yield n / (len(names[i]) + len(names[j]) - n), i, j


def _matched(rows: list[int], stage: list[str], no: list[int], mark: list[str | None], names: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Pairs of one object and param, as places in the lists."""
    seen, before, after = set(), [], {}
    for i in sorted(rows, key=lambda i: (stage[i], no[i])):
        if mark[i] is None or (stage[i], mark[i]) not in seen:
            seen.add((stage[i], mark[i]))
            (before if stage[i] == "PD" else after.setdefault(stage[i], [])).append(i)
    own = {mark[i]: i for i in before if mark[i] is not None}
    for later in after.values():
        met = [(own[mark[j]], j) for j in later if mark[j] in own]
        yield from met
        taken = {i for i, _ in met}
        left, right = [i for i in before if i not in taken], [j for j in later if mark[j] not in own]
        if len(left) == 1 == len(right) and (mark[left[0]] is None or mark[right[0]] is None or any(n >= ALIKE for n, *_ in _alike(left, right, names))):
            yield left[0], right[0]
            continue
        loose = [j for j in right if mark[j] is None]
        used = set()
        for *_, i, j in sorted((-n, mark[i] or f"~{no[i]:09}", no[j], i, j) for n, i, j in _alike(left, loose, names) if n >= ALIKE):
            if i not in used and j not in used:
                used |= {i, j}
                yield i, j


def _paired(rows: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """PAIR, before and after (the layers) and pairs (how many the key has), with aggregates of the key.

    A key without a pair has one row with nulls. Rows have fit, and those of a key are taken at once.
    """
    more = more or {}
    stack = F.when(F.col("fit"), F.struct("stage", "no", "mark", "names", "layers"))
    grouped = rows.groupBy(*KEYS).agg(*[c.alias(n) for n, c in more.items()], F.collect_list(stack).alias("_stacks"))
    n = len(KEYS) + len(more)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            stacks = frame.column(n)
            flat = stacks.flatten()
            stage, no, mark, names = (flat.field(k).to_pylist() for k in range(4))
            key, before, after, counts, begin = [], [], [], [], 0
            for at, size in enumerate(pc.list_value_length(stacks).to_pylist()):
                met = list(_matched(list(range(begin, begin + size)), stage, no, mark, names))
                begin += size
                for i, j in met or [(None, None)]:
                    key.append(at)
                    before.append(i)
                    after.append(j)
                counts += [len(met)] * max(len(met), 1)
            key, first, second = pa.array(key, pa.int64()), pa.array(before, pa.int64()), pa.array(after, pa.int64())
            columns = [flat.field(0).take(second), flat.field(1).take(first), flat.field(1).take(second), flat.field(4).take(first), flat.field(4).take(second), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(frame.column(c).take(key) for c in range(n)), *columns], [*names_of, "stage", "before_no", "after_no", "before", "after", "pairs"])

    names_of = grouped.columns[:n]
    kinds = ", ".join(f"{c} {grouped.schema[c].dataType.simpleString()}" for c in names_of)
    return grouped.mapInArrow(batches, f"{kinds}, stage string, before_no int, after_no int, before {LAYERS}, after {LAYERS}, pairs long")


def paired(rows: DataFrame) -> DataFrame:
    """PAIR of the design's stacks (before_no) and those of each later stage (after_no).

    Stacks of one mark are a pair. Then, where each side has one left, these two are if one has no mark or they are alike;
    elsewhere those of the later stage without a mark find the most alike that nobody has taken.
    """
    return _paired(rows.withColumn("fit", F.lit(True))).where("pairs > 0").select(*PAIR)


def _tolerated(pairs: DataFrame, params: DataFrame) -> DataFrame:
    return pairs.join(F.broadcast(params.select("param_code", "tolerance")), "param_code")


def _analogs(analogs: DataFrame | None, mentions: DataFrame) -> DataFrame:
    return analogs if analogs is not None else mentions.sparkSession.createDataFrame([], "was string, now string, verdict string")


def layer_operations(mentions: DataFrame, params: DataFrame, analogs: DataFrame | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """PAIR, step, op, before_at, after_at, violation and uncertain of every pair of stacks of two stages."""
    pairs = _paired(_ranked(mentions, params)).where("pairs > 0")
    return operations(_tolerated(pairs, params), PAIR, _analogs(analogs, mentions), groups)


def layer_conflicts(mentions: DataFrame, params: DataFrame, analogs: DataFrame | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """object_id, param_code, stage, mark and documents: marks whose stack a stage's documents give differently."""
    rows = checkpointed(usable(mentions, params).where("mark is not null"))
    first = _firsts(rows).select(*KEYS, "stage", "mark", F.col("no").alias("before_no"), F.col("file_id").alias("first_file"), F.col("layers").alias("before"))
    others = rows.join(first, [*KEYS, "stage", "mark"]).where("file_id <> first_file").withColumnRenamed("no", "after_no").withColumnRenamed("layers", "after")
    pairs = others.join(F.broadcast(params.select("param_code", "tolerance")), "param_code").select(*PAIR, "mark", "file_id", "before", "after", "tolerance")
    keys = [*PAIR, "mark", "file_id"]
    differing = operations(pairs, keys, _analogs(analogs, mentions), groups).where("op <> 'match'")
    return differing.groupBy(*KEYS, "stage", "mark").agg((F.countDistinct("file_id") + 1).alias("documents"))


@kind("layers")
def layers(
    mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None, analogs: DataFrame | None = None, groups: dict[str, str] | None = None
) -> DataFrame:
    """Findings for stacks of layers, with worst (the first operation that breaks the rule) and the numbers of operations.

    ``params`` have tolerance, how much thinner a layer may be; ``groups`` tell which group a material is of.
    """
    stage = lambda condition: true(F.bool_or(F.col("fit") & condition))
    seen = {"design": stage(F.col("stage") == "PD"), "later": stage(F.col("stage") != "PD"), "any_disputed": stage(disputed())}
    pairs = _tolerated(_paired(_ranked(mentions, params), seen), params)
    ops = operations(pairs, [*KEYS, "pairs", *seen], _analogs(analogs, mentions), groups, every=True)
    order = lambda: F.array_position(F.array(*map(F.lit, WORST)), F.col("op"))
    found = ops.groupBy(*KEYS).agg(
        F.count("op").alias("operations"), F.count_if("violation").alias("violations"), F.count_if("uncertain").alias("uncertain"), F.min(F.when(F.col("violation"), order())).alias("worst"),
        F.max("pairs").alias("pairs"), *[F.bool_or(c).alias(c) for c in seen],
    )
    values = applied(found, params, profiles) if asked is None else subjects(mentions, params, profiles, asked).join(found, KEYS, "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    status: Column = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (~(true(F.col("design")) & true(F.col("later"))), ME),
        (n("pairs") == 0, NC),
        (n("violations") > 0, CA),
        (n("uncertain") > 0, NC),
        otherwise=NV,
    )
    worst = F.element_at(F.array(*map(F.lit, WORST)), F.col("worst").cast("int"))
    return values.select(*KEYS, status.alias("status"), n("pairs").alias("pairs"), n("operations").alias("operations"), n("violations").alias("violations"), F.when(status == CA, worst).alias("worst"))
