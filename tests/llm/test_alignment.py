import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment

SCHEMA = "doc_id long, text string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def plain(libraries, rows):
    """The libraries on whole texts, and every link in plain Python."""
    a, b = libraries
    letters = alignment.bpe.byte_letters()
    counts, linked = Counter(), []
    for doc_id, text in rows:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]]
            pieces = [b.id_to_piece(i) for i in ids[1]]
            cut = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces)]
            if b"".join(raw) == b"".join(cut) == (" " + text).encode():
                ends = []
                for side in (raw, cut):
                    at, out = 0, []
                    for t in side:
                        at += len(t)
                        out.append(at)
                    ends.append(out)
                both = sorted(set(ends[0]) & set(ends[1]))
                held = defaultdict(lambda: ([], []))
                for side in (0, 1):
                    g = 0
                    for i, end in zip(ids[side], ends[side]):
                        held[g][side].append(i)
                        g += end == both[g]
                groups = [held[g] for g in range(len(both))]
        links = Counter()
        for xs, ys in groups:
            for x, n in Counter(xs).items():
                for y, m in Counter(ys).items():
                    links[x, y] += n * m
        counts.update(links.keys())
        linked.append((doc_id, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups, links in linked:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def texts():
    rng = random.Random(3)
    bits = ["the", " the", "  ", " ", "\n", "\t", "é", "École", "▁", "<|endoftext|>", "<0x41>", "<s>", "　", "\xa0", "\U0001f600", "ﬁ", "a" * 40, "1234567", "'ll", "\x00", "=====", "日本語", "́", "word ", "Zürich "]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(25)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " "), (303, "a "), (304, " a"), (305, "▁"), (306, "x" * 4000), (307, " " * 3000 + "y"), (308, "ab" * 9000 + " " + "é" * 700)]
    rows += [(309, "the cat sat on the mat " * 4000), (309, "the cat sat on the mat " * 4000), (None, "the cat"), (310, "\r\n" * 50)]
    return rows


def test_alignment_equals_the_libraries_and_plain_links(spark, libraries):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, block int").repartition(3)
    got = alignment.align(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, rows)


def test_query_equals_plain_links_with_many_tasks(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "140")  # stripes in two shares
    try:
        assert sorted(map(tuple, alignment.op11_alignment(spark, sf).collect()), key=str) == plain(libraries, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_large_groups_are_counted_by_id_first(libraries, monkeypatch):
    rows = [r for r in texts() if r[1]]
    sides = alignment.load(*PATHS)
    documents, links = sides.block([t for _, t in rows])
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    again, same = sides.block([t for _, t in rows])
    assert all(list(documents[c]) == list(again[c]) for c in documents)
    assert all(links[c].to_pylist() == same[c].to_pylist() for c in links)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
