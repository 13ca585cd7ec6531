"""Packing of token sequences: shortest pack first over the histogram of lengths (Krell and others, 2021).

Texts are encoded once and cut into pieces of the sequence length and a rest. Only the histogram of piece lengths (one
row per length, so no more rows than a sequence has tokens) comes to the driver. There lengths are placed longest
first, each into the packs that are shortest so far and have room, as counts of packing patterns. Pieces find their
place by rank: the r-th piece of a length takes the r-th slot of that length among the patterns' copies.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.common import clean_text, materialise, table, text_batches

SEQUENCE = 2048
END_ID = 1
#: Pieces of one length numbered by one task's window; a length has as many such runs as it needs.
RUN = 256


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """A compiled encoder for the vocabulary file, one per worker; ids as little-endian unsigned 32-bit integers.

    Its pattern matcher gives up on some million-character runs of white space; those texts go to the automaton.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = bpe.byte_letters()
    ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    compiled = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> bytes:
        try:
            return np.array(compiled.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        except ValueError:
            return bpe.load(path, pattern).encode(text)

    return encode


def pieces(
    docs: DataFrame, path: str, pattern: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Encode each whole text (null: empty), end it with an id, and cut it every ``sequence`` ids.

    Rows: doc_id, start, length, ids_crc32, doc_tokens and, on demand, token_ids. Repeated rows give their own pieces.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        end = np.uint32(end_id).tobytes()
        for batch in rows:
            ids = [encode(t) + end for t in batch.column(1).to_pylist()]
            whole = [len(x) // 4 for x in ids]
            cuts = [(row, at) for row, n in enumerate(whole) for at in range(0, n, sequence)]
            parts = [ids[row][4 * at : 4 * (at + sequence)] for row, at in cuts]
            columns = {
                "doc_id": batch.column(0).take(pa.array([row for row, _ in cuts], pa.int64())),
                "start": pa.array([at for _, at in cuts], pa.int64()),
                "length": pa.array([len(p) // 4 for p in parts], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                "doc_tokens": pa.array([whole[row] for row, _ in cuts], pa.int64()),
            }
            if with_ids:
                columns["token_ids"] = pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", token_ids array<int>" * with_ids
    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(batches, schema)


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (copies, lengths in order) of every packing pattern.

    A group of equal packs that takes a length whole moves on as one group; only the last group a length meets is
    split, so there are at most two groups for each length.
    """
    room: list[list[tuple[int, tuple]]] = [[] for _ in range(sequence + 1)]
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, space = histogram[length], sequence
        while left:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                room[sequence - length].append((left, (length, None)))
                break
            copies, slots = room[space].pop()
            taken = min(copies, left)
            if copies > taken:
                room[space].append((copies - taken, slots))
            room[space - length].append((taken, (length, slots)))
            left -= taken
    out = []
    for groups in room:
        for copies, slots in groups:
            lengths = []
            while slots is not None:
                lengths.append(slots[0])
                slots = slots[1]
            out.append((copies, lengths[::-1]))
    return out


def slot_table(found: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of ranks: from rank ``rank`` on, pieces of ``length`` fill ``many`` slots of each copy of a pattern."""
    rows, ranks, sequence = [], {}, 0
    for copies, lengths in found:
        offset, seen = 0, {}
        for length in lengths:
            seen.setdefault(length, offset)
            offset += length
        for length, first in seen.items():
            many = lengths.count(length)
            rows.append((length, ranks.get(length, 0), many, sequence, first))
            ranks[length] = ranks.get(length, 0) + many * copies
        sequence += copies
    rows.sort()
    return {k: np.array(v, dtype=np.int64) for k, v in zip(("length", "rank", "many", "sequence", "offset"), zip(*rows))}


def ranked(cut: DataFrame, lengths: DataFrame) -> DataFrame:
    """The pieces with their columns and their number in their length from 0, last, under a name of its own.

    The pieces of a length aren't brought together.

    A piece falls in one of the length's runs by hash; runs are numbered inside and shifted by the runs before.
    """
    mark = "_"
    while any(c.startswith(mark) for c in cut.columns):
        mark += "_"
    runs, run, at, shift = (f"{mark}{name}" for name in ("runs", "run", "at", "shift"))
    known = F.broadcast(lengths.select("length", F.ceil(F.col("n") / RUN).alias(runs)))
    placed = cut.join(known, "length").withColumn(run, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), runs))
    before = W.partitionBy("length").orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    shifts = placed.groupBy("length", run).agg(F.count("*").alias(at))
    shifts = shifts.select("length", run, F.coalesce(F.sum(at).over(before), F.lit(0)).alias(shift))
    inside = W.partitionBy("length", run).orderBy("doc_id", "start", "ids_crc32")
    numbered = placed.withColumn(at, F.row_number().over(inside) - 1).join(shifts, ["length", run])
    return numbered.select(*cut.columns, (F.col(shift) + F.col(at)).alias(f"{mark}rank"))


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Give every piece a sequence_id and an offset there; all other columns stay. ``cut`` should be materialised.

    Needs the columns doc_id, start, length (1 to ``sequence``) and ids_crc32.
    """
    spark = cut.sparkSession
    lengths = materialise(cut.groupBy("length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in lengths.collect()}  # at most `sequence` rows
    rows = ranked(cut, lengths)
    numbered = rows.columns[-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    shared = spark.sparkContext.broadcast(slot_table(patterns(histogram, sequence))) if histogram else None

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value if shared else None
        for batch in parts:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", numbered))
            order = (slots["length"] << 44) + slots["rank"]
            run = np.searchsorted(order, (length << 44) + rank, side="right") - 1
            copy, slot = np.divmod(rank - slots["rank"][run], slots["many"][run])
            kept = batch.drop_columns([numbered])
            kept = kept.append_column("sequence_id", pa.array(slots["sequence"][run] + copy, pa.int64()))
            yield kept.append_column("offset", pa.array(slots["offset"][run] + slot * length, pa.int64()))

    return rows.mapInArrow(batches, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from packed pieces with token_ids: sequence_id, token_ids, n_tokens.

    Padded to ``sequence``, except those whose length is a power of two.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "token_ids")))
    joined = packed.groupBy("sequence_id").agg(F.flatten(parts.token_ids).alias("ids"))
    n = F.size("ids")
    padding = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(sequence - n)
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), padding))
    return joined.select("sequence_id", padded.alias("token_ids"), n.cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    cut = materialise(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
