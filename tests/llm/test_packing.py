import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import packing
from factloom.llm.common import materialise

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_patterns_use_each_length_as_often_as_it_occurs():
    rng = random.Random(4)
    for _ in range(50):
        size = rng.choice([8, 64, 2048])
        histogram = Counter(rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 3000)))
        found = packing.patterns(histogram, size)
        used = Counter()
        for copies, lengths in found:
            assert copies > 0 and sum(lengths) <= size
            for n in lengths:
                used[n] += copies
        assert used == histogram
        assert len(found) <= 2 * len(histogram)


def test_little_padding():
    rng = np.random.default_rng(1)
    histogram = Counter(np.minimum(2048, rng.gamma(1.5, 400, 200_000).astype(int) + 1).tolist())
    found = packing.patterns(histogram)
    total = sum(c for c, _ in found) * 2048
    assert sum(n * c for n, c in histogram.items()) / total > 0.99


def check(docs_rows, packed):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in docs_rows}
    spans, places = defaultdict(list), defaultdict(list)
    for r in packed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        spans[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    times = Counter(i for i, *_ in docs_rows)
    for i, n in times.items():
        assert sum(length for _, length in spans[i]) == n * len(ids[i])
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return places


def test_documents_are_packed_whole(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "thing", "é", "xy"], k=rng.randrange(900)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 9000), (1003, "same text"), (1003, "same text"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int")
    check(rows, packing.pack_documents(docs).collect())
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_ranks_are_gapless_for_a_hot_length(spark):
    cut = spark.range(5000).selectExpr("id as doc_id", "0L as start", "if(id % 3 = 0, 7L, id % 100 + 1) as length", "id as ids_crc32")
    lengths = cut.groupBy("length").count().withColumnRenamed("count", "n")
    by = defaultdict(list)
    for r in packing.ranked(cut, lengths).collect():
        by[r.length].append(r[-1])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_columns_of_the_pieces_stay_whatever_their_names(spark):
    cut = spark.range(300).selectExpr("id as doc_id", "0L as start", "id % 90 + 1 as length", "id as ids_crc32", "id + 1 as runs", "id + 2 as run", "id + 3 as at", "id + 4 as shift", "id + 5 as rank", "id + 6 as _runs")
    packed = packing.pack(cut)
    assert packed.columns == [*cut.columns, "sequence_id", "offset"]
    got = packed.collect()
    assert len(got) == 300 and all([r[c] - r.doc_id for c in ("runs", "run", "at", "shift", "rank", "_runs")] == [1, 2, 3, 4, 5, 6] for r in got)


def test_sequences_hold_the_pieces(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 40)) for i in range(60)], "doc_id long, text string")
    cut = materialise(packing.pieces(docs, PATH, public_tokenizers.PATTERN, with_ids=True))
    packed = packing.pack(cut)
    total = cut.selectExpr("sum(length)").first()[0]
    found = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in found) == total
    for r in found:
        assert len(r.token_ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048)
