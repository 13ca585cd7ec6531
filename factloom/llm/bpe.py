"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts with one state that every byte loops on. Each merge (u, v) -> w in turn puts a gadget in: the
arcs labelled u get a target of their own that has lost its arc v, and wherever u could be followed by v an arc w
leads to where v led. After all merges the paths of the automaton are exactly the token sequences that BPE produces
(Berglund, Martens and van der Merwe, 2024), so whether a token may follow another is a look-up of an arc. A word is
encoded by walking its bytes: exactly one token ends at each position on a path of the automaton, and arcs are looked
up in a table filled on first use. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm.common import clean_text, table, text_batches

#: Words remembered with their ids by a worker, and arcs kept in its table; both are emptied when full.
CACHED_WORDS = 400_000
CACHED_ARCS = 2_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabulary files write bytes with: printable Latin-1, then from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """States are numbered; ``target[t]`` is where all arcs labelled with token t lead.

    A state is kept as what it lost: ``cuts[s]`` has the arcs cut and the merge that cut them, on top of what its
    ``parent`` had lost before the merge that split the two.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = max(labels) + 1
        self.labels = labels
        self.rank, self.first = [-1] * size, [-1] * size
        self.parent, self.born, self.cuts, self.sharers = [-1], [NEVER], [{}], [0]
        self.target = [-1] * size
        made = {w for _, _, w in merges}
        for t, label in labels.items():
            if t not in made and len(label) == 1:
                self.target[t] = 0
                self.sharers[0] += 1
        self.reachable = {t for t, s in enumerate(self.target) if s >= 0}
        for k, (u, v, w) in enumerate(merges):
            self._gadget(k, u, v, w)
        self.arcs: dict[int, bool] = {}
        self.size = size
        self.endings: dict[bytes, int] = {}
        for t in self.reachable:
            label = labels[t]
            for i in range(len(label)):
                self.endings.setdefault(label[i:], -1)
            self.endings[label] = t

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if self.target[w] >= 0:
            raise ValueError("two merges make one token")
        if u in self.reachable and v in self.reachable and self._open(self.target[u], v, k):
            self.reachable.add(w)
        after = self.target[v]
        state = self.target[u]
        if self.sharers[state] > 1 or u == v:
            self.sharers[state] -= 1
            self.parent.append(state)
            self.born.append(k)
            self.cuts.append({})
            self.sharers.append(1)
            state = self.target[u] = len(self.parent) - 1
        self.cuts[state].setdefault(v, k)  # an arc that is gone stays gone since its first cut
        self.target[w] = after
        self.sharers[after] += 1
        self.rank[w], self.first[w] = k, u

    def _open(self, state: int, token: int, before: int = NEVER) -> bool:
        """Whether the state has an arc for the token, as it stood before a merge."""
        while True:
            s, limit = state, before
            while s >= 0:
                if self.cuts[s].get(token, NEVER) < limit:
                    return False
                limit = min(limit, self.born[s])
                s = self.parent[s]
            if self.rank[token] < 0:
                return True
            # an arc w was put where u had an arc; of equal letters the left pair merges first
            before, token = self.rank[token] + 1, self.first[token]

    def follows(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._open(self.target[left], right)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        whole = self.endings.get(word, -1)
        if whole >= 0:
            return [whole]
        endings, follows, arcs, size = self.endings.get, self.follows, self.arcs.get, self.size
        last, begin = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            start = end - 1
            while start >= 0:
                token = endings(word[start:end])
                if token is None:
                    break
                if token >= 0:
                    before = last[start]
                    if start == 0:
                        last[end] = token
                        break
                    known = arcs(before * size + token)
                    if known or known is None and follows(before, token):
                        last[end], begin[end] = token, start
                        break
                start -= 1
            if last[end] < 0:
                raise ValueError("a byte has no token in this vocabulary")
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end = begin[end]
        return ids[::-1]

    def decode(self, ids) -> bytes:
        labels = self.labels
        return b"".join([labels[i] for i in ids])


class ByteBpe:
    """A tokenizers file of byte-level BPE: splits texts into words and encodes each by the automaton."""

    class _Words(dict):
        def __init__(self, encode):
            self.encode = encode

        def __missing__(self, word: str) -> bytes:
            if len(self) >= CACHED_WORDS:
                self.clear()
            ids = np.array(self.encode(word.encode("utf-8")), dtype="<u4").tobytes()
            if len(word) <= 64:
                self[word] = ids
            return ids

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.automaton.labels = labels | {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(pattern).findall
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = self._Words(self.automaton.encode)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.words.__getitem__
        if self.marks is None or not (found := list(self.marks.finditer(text))):
            return b"".join(map(get, self.split(text)))
        parts, at = [], 0
        for m in found:
            parts += [*map(get, self.split(text[at : m.start()])), np.uint32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*parts, *map(get, self.split(text[at:]))])

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def load(path: str, pattern: str) -> ByteBpe:
    """One automaton per worker process and vocabulary."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text (null: empty).

    Returns the id, n_tokens, token_ids (array of int, unless ``with_ids`` is false), ids_sha256 and
    decoded_sha256; a row for each row, repeated ones too. Other columns are left out.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in rows:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            columns = {id_col: batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if with_ids:
                columns["token_ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
            texts = [hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids]
            columns["decoded_sha256"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long" + ", token_ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, clean_text().alias("text")).mapInArrow(batches, schema)


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)
