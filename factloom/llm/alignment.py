"""Cross-tokenizer alignment with dense count matrices striped by id.

Two tokenizers cut the same bytes; offsets where tokens of both end cut a text into groups, and all tokens of a group
that come from different sides are linked. How many documents hold a pair of ids linked is counted in matrices: ids of
the first side are dealt to stripes (id modulo their number), a stripe's block has a row for each of its ids and a
column for each id of the other side, and ``np.add.at`` puts what blocks of documents have counted into it. The links of
a stripe are sent to where its block is, so a link is scored by looking its pair up, and the largest of a row tells
which pairs are the best of their id. A block's size depends on the vocabularies and not on the corpus; links pass by
in batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.common import clean_text, materialise, table, text_batches

#: Stripes of ids: a block of the public vocabularies has 393 x 32,000 counts, 100 MB.
STRIPES = 128
#: Documents counted together, and the characters at which they are no more.
BLOCK_DOCUMENTS, BLOCK_CHARACTERS = 1024, 3_000_000
#: Links of a group beyond which its tokens are first counted by id.
LARGE_GROUP = 1 << 16
#: Cells of a matrix to a row when it is sent, and segments remembered with their ids by a worker.
CELLS, CACHED_SEGMENTS = 1 << 17, 300_000
SPACE = "▁"

LINKS = "block long, stripe int, cells array<int>, holders array<int>, places array<smallint>, repeated array<int>, times array<long>"
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class ByteSide:
    """Byte-level vocabulary file; special tokens' strings are plain text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters, vocabulary = bpe.byte_letters(), spec["model"]["vocab"]
        self.labels = {i: bytes(letters[c] for c in s) for s, i in vocabulary.items() if s not in special}
        self.size = max(vocabulary.values()) + 1
        self.path, self.pattern = path, pattern
        ranks = {label: i for i, label in self.labels.items()}
        self.compiled = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Its pattern matcher gives up on some very long runs of white space; those texts go to the automaton."""
        try:
            return np.array(self.compiled.encode_ordinary(text), dtype=np.int32)
        except ValueError:
            automaton = bpe.load(self.path, self.pattern)
            return np.frombuffer(b"".join(map(automaton.words.__getitem__, automaton.split(text))), "<i4")


class PieceSide:
    """Piece vocabulary; it puts a space before a text by itself.

    If no piece goes on after a space that follows other letters, merges don't cross the start of a run of spaces and
    a text's segments from one such start to the next can be encoded apart, which is remembered.
    """

    class _Segments(dict):
        def __init__(self, side):
            self.side = side

        def __missing__(self, segment: str) -> bytes:
            if len(self) >= CACHED_SEGMENTS:
                self.clear()
            ids = self.side.checked(segment).tobytes()
            if len(segment) <= 64:
                self[segment] = ids
            return ids

    def __init__(self, path: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.pieces.vocab_size()
        spelled = [self.pieces.id_to_piece(i) for i in range(self.size)]
        self.labels = {
            i: bytes([int(s[3:5], 16)]) if self.pieces.is_byte(i) else s.replace(SPACE, " ").encode() for i, s in enumerate(spelled)
        }
        self.apart = not any(SPACE in s.lstrip(SPACE) for s in spelled)
        self.lone = self.pieces.piece_to_id(SPACE)
        self.segments = self._Segments(self)

    def checked(self, spaced: str) -> np.ndarray:
        """Ids of a text with the space before it; ValueError if they don't stand for its bytes."""
        ids = self.pieces.encode(spaced[1:]) if spaced != " " else [self.lone]
        if b"".join(self.labels[i] for i in ids) != spaced.encode():
            raise ValueError("pieces differ from the text")
        return np.array(ids, dtype="<i4")

    def encode(self, spaced: str) -> np.ndarray | None:
        try:
            if not self.apart:
                return self.checked(spaced)
            return np.frombuffer(b"".join(map(self.segments.__getitem__, re.findall(" +[^ ]*", spaced))), "<i4")
        except ValueError:
            return None


def _sizes(labels: dict[int, bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[list(labels)] = [len(b) for b in labels.values()]
    return out


def _spelled(n: int, *ends: str) -> np.ndarray:
    """Each id in decimal with each of the ends: entry id + n * (number of the end)."""
    return np.array([f"{i}{end}".encode() for end in ends for i in range(n)], dtype=object)


class Sides:
    """Both tokenizers in a worker, and what their ids look like."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.a, self.b = ByteSide(a_path, pattern), PieceSide(b_path)
        self.sizes = _sizes(self.a.labels, self.a.size), _sizes(self.b.labels, self.b.size)
        self.spelled = _spelled(self.a.size, ",", "|"), _spelled(self.b.size, ",", ";")
        self.rows = -(-self.a.size // STRIPES)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none if either's don't stand for the text's bytes."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        spaced = " " + text
        b = self.b.encode(spaced)
        a = self.a.encode(spaced) if b is not None else none
        n = len(spaced.encode())
        if b is None or self.sizes[0][a].sum() != n or self.sizes[1][b].sum() != n:
            return none, none
        return a, b

    def block(self, texts: list[str]) -> tuple[dict, dict]:
        """Columns of each document, and those of each stripe's links in all of them."""
        found = [self.tokens(t) for t in texts]
        a, b = (np.concatenate([f[side] for f in found]).astype(np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(f[side]) for f in found]) for side in (0, 1))
        place = np.repeat(np.arange(len(texts)), n_a)
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # documents end on both sides, so groups of one long text are those of its documents
        last_a, last_b = np.isin(a_ends, b_ends), np.isin(b_ends, a_ends)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        of_group = place[last_a]
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, of_group, in_a * in_b)

        parts = np.empty(len(a) + len(b), dtype=object)
        parts[np.arange(len(a)) + start_b[group_a]] = self.spelled[0][a + self.a.size * last_a]
        parts[np.arange(len(b)) + (start_a + in_a)[group_b]] = self.spelled[1][b + self.b.size * last_b]
        to = np.cumsum(n_a + n_b)
        digests = [
            hashlib.sha256(b"".join(parts[end - n : end].tolist())[:-1]).hexdigest() if n else ""
            for end, n in zip(to.tolist(), (n_a + n_b).tolist())
        ]
        documents = {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(of_group, minlength=len(texts)), "n_links": links, "groups_sha256": digests,
        }

        large = in_a * in_b > LARGE_GROUP
        reach = np.where(large[group_a], 0, in_b[group_a])
        first = np.cumsum(reach) - reach
        other = np.arange(reach.sum()) - np.repeat(first - start_b[group_a], reach)
        keys, times = [self._key(np.repeat(a, reach), b[other], np.repeat(place, reach))], []
        for g in np.flatnonzero(large).tolist():
            ids_a, of_a = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            ids_b, of_b = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            keys.append(self._key(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)), of_group[g]))
            times.append(np.multiply.outer(of_a, of_b).ravel())
        if times:
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(unique), np.int64)
            np.add.at(count, inverse, np.concatenate([np.ones(len(keys[0]), np.int64), *times]))
        else:
            unique, count = np.unique(keys[0], return_counts=True)
        return documents, self._striped(unique, count)

    def _key(self, a: np.ndarray, b: np.ndarray, place) -> np.ndarray:
        """A number for pair and document that sorts by stripe, cell of its block, and document."""
        return (((a % STRIPES) * self.rows + a // STRIPES) * self.b.size + b) * BLOCK_DOCUMENTS + place

    def _striped(self, unique: np.ndarray, count: np.ndarray) -> dict:
        block = self.rows * self.b.size
        cells, places = np.divmod(unique, BLOCK_DOCUMENTS)
        begins = np.flatnonzero(np.diff(cells, prepend=-1))  # of each pair
        many = np.flatnonzero(count > 1)
        cut = np.searchsorted(cells, np.arange(STRIPES + 1) * block)
        cut_pairs, cut_many = np.searchsorted(begins, cut), np.searchsorted(many, cut)
        listed = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
        return {
            "stripe": pa.array(np.arange(STRIPES), pa.int32()),
            "cells": listed(cut_pairs, cells[begins] % block, pa.int32()),
            "holders": listed(cut_pairs, np.diff(begins, append=len(cells)), pa.int32()),
            "places": listed(cut, places, pa.int16()),
            "repeated": listed(cut_many, many - np.repeat(cut[:-1], np.diff(cut_many)), pa.int32()),
            "times": listed(cut_many, count[many], pa.int64()),
        }


@lru_cache(maxsize=1)
def load(a_path: str, pattern: str, b_path: str) -> Sides:
    """One pair of tokenizers per worker process."""
    return Sides(a_path, pattern, b_path)


def linked(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """Rows of documents (block, place, doc_id and ``COUNTS``) and of links (``LINKS``, a row for a block's stripe)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"{LINKS}, place int, doc_id {kind}, {COUNTS}"

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = load(a_path, pattern, b_path), TaskContext.get().partitionId() << 32
        ids, texts, size, id_type = [], [], 0, None
        for batch in rows:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if len(texts) == BLOCK_DOCUMENTS or size >= BLOCK_CHARACTERS:
                    yield from written(sides, number, pa.array(ids, id_type), texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if texts:
            yield from written(sides, number, pa.array(ids, id_type), texts)

    def written(sides: Sides, number: int, ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        documents, links = sides.block(texts)
        documents |= {"place": np.arange(len(texts), dtype=np.int32), "doc_id": ids}
        for columns in (documents, links):
            n = len(next(iter(columns.values())))
            columns = {"block": np.full(n, number, np.int64), **columns}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(blocks, schema)


def _values(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def _dealt(rows: DataFrame, shares: int, *order: str) -> DataFrame:
    """Each stripe's share to a task, which has its rows together."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.col("stripe") * shares + F.col("share"), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("stripe", "share", *order)


def summed(rows: DataFrame, shares: int, cells: int) -> DataFrame:
    """stripe, cells and holders of the sums of all rows of a stripe's share, a dense block at a time."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(batch.column(i)[row].as_py() for i in (0, 1))
                if key != at:
                    if at is not None:
                        yield from emptied(block, at[0])
                    block, at = np.zeros(cells, np.int64), key
                np.add.at(block, _values(batch.column(2)[row]), _values(batch.column(3)[row]))
        if at is not None:
            yield from emptied(block, at[0])

    def emptied(block: np.ndarray, stripe: int) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(block)
        for begin in range(0, len(found), CELLS):
            part = found[begin : begin + CELLS]
            at = pa.array([0, len(part)], pa.int32())
            yield pa.RecordBatch.from_pydict({
                "stripe": pa.array([stripe], pa.int32()),
                "cells": pa.ListArray.from_arrays(at, pa.array(part, pa.int32())),
                "holders": pa.ListArray.from_arrays(at, pa.array(block[part], pa.int64())),
            })

    dealt = _dealt(rows.select("stripe", "share", "cells", F.col("holders").cast("array<long>").alias("holders")), shares)
    return dealt.mapInArrow(sums, "stripe int, cells array<int>, holders array<long>")


def scored(links: DataFrame, counts: DataFrame, shares: int, cells: int, columns: int) -> DataFrame:
    """block, and for each of its documents n_best and count_sum over the links of one stripe."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, most, at = None, None, None
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                stripe, share, number, pairs, holders, places, repeated, times = (c[row] for c in batch.columns)
                key = (stripe.as_py(), share.as_py())
                if key != at:
                    block, most, at = np.zeros(cells, np.int64), None, key
                if not number.is_valid:
                    block[_values(pairs)] = _values(holders)
                    continue
                if most is None:
                    most = block.reshape(-1, columns).max(axis=1)
                pairs, places = _values(pairs), _values(places)
                if not len(pairs):
                    continue
                n, held = np.ones(len(places), np.int64), _values(holders)
                n[_values(repeated)] = _values(times)
                count = block[pairs]
                best, total = np.zeros((2, int(places.max()) + 1), np.int64)
                np.add.at(best, places, n * np.repeat(count == most[pairs // columns], held))
                np.add.at(total, places, n * np.repeat(count, held))
                out.append((number.as_py(), best, total))
            if out:
                numbers, bests, totals = zip(*out)
                lists = [pa.array(v, pa.list_(pa.int64())) for v in (bests, totals)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *lists], ["block", "n_best", "count_sum"])

    copies = counts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(
        "stripe", "share", F.lit(None).cast("long").alias("block"), "cells", "holders",
        F.lit(None).cast("array<smallint>").alias("places"), F.lit(None).cast("array<int>").alias("repeated"), F.lit(None).cast("array<long>").alias("times"),
    )
    both = copies.unionByName(links.select("stripe", "share", "block", "cells", F.col("holders").cast("array<long>").alias("holders"), "places", "repeated", "times"))
    return _dealt(both, shares, "block").mapInArrow(scores, "block long, n_best array<long>, count_sum array<long>")


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that either tokenizer doesn't give back byte for byte, have zeros and an empty
    digest. Texts may be of any length; repeated rows each count as a document and stay; other columns are left out.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sides = load(a_path, pattern, b_path)
    cells, columns = sides.rows * sides.b.size, sides.b.size
    shares = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // STRIPES)
    found = materialise(linked(docs, a_path, pattern, b_path))
    links = found.where("stripe is not null").withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    counts = summed(links, shares, cells)
    if shares > 1:
        counts = summed(counts.withColumn("share", F.lit(0)), 1, cells)
    parts = scored(links, counts, shares, cells, columns)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finished(documents: pa.Table, sums: pa.Table) -> pa.Table:
        n = documents.num_rows
        totals = {c: np.zeros(n, np.int64) for c in ("n_best", "count_sum")}
        for c, out in totals.items():
            for row in sums.column(c):
                out[: len(row)] += _values(row)
        place = documents.column("place").to_numpy()
        added = {c: pa.array(out[place], pa.int64()) for c, out in totals.items()}
        return pa.table({c: added.get(c, documents.column(c) if c not in added else None) for c in names})

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"
    documents = found.where("stripe is null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(finished, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path
    return align(docs, path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))
