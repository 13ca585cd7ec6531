import random
import re
from collections import Counter, defaultdict

import pytest

from factloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
SMALL = {"shard_words": 300, "range_pairs": 150, "merged_nodes": 50}


def plain(rows, least, top):
    """Every occurrence counted in plain Python."""
    count, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        found = {p for p, a in f.items() if len(p) > 1 and a >= least}
        held = set()
        for longer in found:
            for n in range(2, len(longer)):
                for i in range(len(longer) - n + 1):
                    if 100 * f[longer] >= 80 * f[longer[i : i + n]]:
                        held.add(longer[i : i + n])
        scored = []
        for p in found - held:
            cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def corpus(rng, n):
    words = ["The", "the", "of", "École", "é", "a\x01", "a", "\U0001f600", "x\x00", "zz", "É", "new", "york", "city", "times", "\x07b"]
    sets = [["new york city times", "of the", "é a\x01 zz"], ["The of", "x\x00 a"]]
    def text():
        out = []
        for _ in range(rng.randrange(60)):
            out.append(rng.choice(rng.choice(sets)) if rng.random() < 0.5 else rng.choice(words))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", " ", "\x1c"]))
        return "".join(out)
    rows = [(i, text(), rng.choice(["en", "de", None, "", "und", "en"])) for i in range(n)]
    return rows + [(n, None, "en"), (n, "", None), (n, " .\t, ", "fr"), (n, rows[3][1], rows[3][2]), (n, rows[3][1], rows[3][2]), (None, "new york city " * 900 + "w" * 5000, "en")]


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_mined_phrases_equal_plain_counting(spark, sizes):
    rows = corpus(random.Random(2), 150)
    docs = spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, phrase int").repartition(3)
    for least, top in ((30, 2000), (4, 40), (1, 2000)):
        got = phrases.mine(docs, least, top, **sizes)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_query_on_a_table_of_the_smallest_size(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert sorted(map(tuple, phrases.op12_phrases(spark, sf).collect())) == plain(rows, phrases.LEAST, phrases.TOP)


def test_one_first_word_fills_several_ranges(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"hot w{rng.randrange(400)}" for _ in range(40)), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = docs.selectExpr("lang", "cast(text as binary) text")
    assert len(phrases.ranges(texts, 500)["en"][1]) > 10
    assert sorted(map(tuple, phrases.mine(docs, 5, 300, range_pairs=500, shard_words=1000).collect())) == plain(rows, 5, 300)


def test_quantiles_leave_the_first_ones(spark):
    rows = [("en", f"p{i:05}", 30 + i % 7, i % 900) for i in range(9000)] + [("de", f"q{i}", 30, 5) for i in range(3000)] + [("fr", "z", 30, 1)]
    got = phrases.best(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 100)
    want = []
    for lang in ("en", "de", "fr"):
        first = sorted((-s, -a, p) for x, p, a, s in rows if x == lang)[:100]
        want += [(lang, p, -a, -s, i) for i, (s, a, p) in enumerate(first, 1)]
    assert sorted(map(tuple, got.select("lang", "phrase", "a", "score", "rank").collect())) == sorted(want)


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0
