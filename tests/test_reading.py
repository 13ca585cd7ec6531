import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import classes
from factloom.operators import anchors, search, stats
from factloom.sources.cache import HASH, ResultCache

DIMS = [("n", "number", None, None), ("step", "ladder", ["LS", "FRLS"], None), ("marks", "flags", ["E", "I", "W"], {"W": ["E"]})]


def test_spellings_of_a_class_have_one_key(spark):
    cases = {"В 22,5": "B22.5", "А500С": "A500C", "ЕІ – 60": "EI60", "EI-60": "EI60", "КМО": "KM0", "СО": "C0", "B3O": "B30", "EI 6O": "EI60", "С355-1": "C355-1", "КМЗ": "KM3", "B3З": "B33",
             "ЗO5": "305", "ПОЛ": "ПOЛ", "Ⅲ": "III", "OOOO": "OOO0", "OOOOO": "OOOOO", "A--5": "A--5", "": "", "I (особая)": "I(OCOБAЯ)", "ＫＭ０": "KM0"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.k for r in df.select("c", classes.fold_class(classes.nfkc(F.col("c"))).alias("k")).collect()} == cases


def test_classes_of_several_dimensions(spark):
    cases = [("EI 60 LS", "EI 60 LS", "EQUAL"), ("EI 60 LS", "EI 45 LS", "WORSE"), ("EI 60 LS", "EIW 60 FRLS", "BETTER"), ("EI 60 LS", "E 90 LS", "CROSSING"), ("EI LS", "EI 60 LS", None), ("I 5 LS", "IW 5 LS", "BETTER"),
             ("E 5 LS", "W 5 LS", "BETTER"), ("E 5", "E 5 LS", None)]
    dims = spark.createDataFrame([(DIMS,)], f"dims {classes.DIMENSIONS}")
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").crossJoin(dims)
    got = df.select("i", classes.relation(classes.vector(F.col("dims"), F.col("a")), classes.vector(F.col("dims"), F.col("b"))).alias("r")).collect()
    assert [r.r for r in sorted(got)] == [want for *_, want in cases]


def plain_share(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return 200.0 * rows[-1][-1] / (len(a) + len(b))


def plain_score(anchor, line):
    if not anchor or not line:
        return 0.0
    if len(line) < len(anchor):
        return plain_share(anchor, line)
    n = len(anchor)
    return max(plain_share(anchor, line[max(0, i) : i + n]) for i in range(1 - n, len(line)) if line[max(0, i) : i + n])


def test_scores_equal_a_table_of_distances():
    rng = random.Random(3)
    text = lambda k: "".join(rng.choices("abcd ", k=k))
    for _ in range(600):
        a, b = text(rng.randrange(9)), text(rng.randrange(16))
        want = plain_score(a, b)
        assert anchors.score(a, b) == pytest.approx(want, abs=1e-9)
        assert anchors.score(a, b, 60.0) == pytest.approx(want if want >= 60 else 0.0, abs=1e-9)


def test_best_lines_with_rivals(spark):
    names = [("P", "building volume"), ("U", "building volume underground"), ("H", "height"), ("N", None)]
    lines = [(1, 0, "Height: 12"), (1, 1, "Building volume (underground) 30"), (1, 2, "Bui1ding volume 100"), (2, 0, "building volume underground"), (2, 1, None), (3, 0, "heigth"), (3, 1, "hei ght")]
    got = anchors.best_lines(spark.createDataFrame(lines, "doc int, no int, text string"), spark.createDataFrame(names, "param string, anchor string"), ["doc"], 80.0).collect()
    found = {(r.doc, r.param): r.no for r in got}
    assert found == {(1, "H"): 0, (1, "U"): 1, (1, "P"): 2, (2, "U"): 0, (3, "H"): 0}
    rng = random.Random(1)
    rows = [(d, n, "".join(rng.choices("abc ", k=rng.randrange(12)))) for d in range(20) for n in range(4)]
    many = [(f"p{i}", "".join(rng.choices("abc", k=5))) for i in range(6)]
    claims = anchors.anchor_claims(spark.createDataFrame(rows, "doc int, no int, text string"), spark.createDataFrame(many, "param string, anchor string"), ["doc"], 70.0).collect()
    squeeze = lambda t: " ".join(t.split())
    assert {(r.doc, r.no, r.param): round(r.score, 6) for r in claims} == {(d, n, p): round(s, 6) for d, n, t in rows for p, a in many if (s := plain_score(a, squeeze(t))) >= 70}


def test_claims_of_a_batch_are_those_of_each_line():
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("ab cdé\U0001d504", k=k))
    known = anchors.Anchors([(f"p{i % 5}", text(rng.choice((1, 2, 5, 9, 33, 64, 70)))) for i in range(14)])
    lines = ["", "a", *(text(rng.randrange(150)) for _ in range(120)), *(a[1:-1] + "a" for _, a in known.rows), *(f"x{a} " for _, a in known.rows)]
    for least in (40.0, 75.0, 100.0):
        at, which, scores = known.claims(lines, least)
        want = {(i, j): s for i, line in enumerate(lines) for j, (_, a) in enumerate(known.rows) if line and (s := anchors.score(a, line, least)) >= least}
        assert dict(zip(zip(at.tolist(), which.tolist()), scores.tolist())) == want


def test_cache_makes_only_what_is_new_and_survives_a_crash(spark, tmp_path):
    made = []

    def make(new):
        rows = new.collect()
        made.append(sorted(r.text for r in rows))
        return spark.createDataFrame([(r[HASH], len(r.text)) for r in rows], f"{HASH} string, n int")

    docs = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    cache = ResultCache(spark, str(tmp_path / "c"), "v1")
    cache.add(docs("a", "bb", "a", None), "text", "n int", make)
    cache.add(docs("bb", "ccc"), "text", "n int", make)
    assert made == [["a", "bb"], ["ccc"]]
    assert sorted((r.id, r.n) for r in cache.of(docs("ccc", "a", "new", None), "text", "n int").collect()) == [(0, 3), (1, 1), (2, None), (3, None)]
    cache.publish, published = lambda run: (_ for _ in ()).throw(OSError("lost")), cache.publish
    with pytest.raises(OSError):
        cache.add(docs("dddd"), "text", "n int", make)
    cache.publish = published
    assert [r.n for r in cache.of(docs("dddd"), "text", "n int").collect()] == [None] and len(cache.sweep()) == 1
    cache.add(docs("dddd", "a"), "text", "n int", make)
    assert made[2:] == [["dddd"], ["dddd"]] and cache.sweep() == []
    ResultCache(spark, str(tmp_path / "c"), "v2").add(docs("a"), "text", "n int", make)
    assert made[-1] == ["a"]
    runs = cache.runs()
    other = "0" * 32
    spark.createDataFrame([(r[HASH], "v1", 99) for r in cache.published("n int").collect()], f"{HASH} string, version string, n int").write.parquet(f"{tmp_path}/c/data/run={other}")
    cache.publish(other)
    assert {r.n for r in cache.of(docs("a"), "text", "n int").collect()} == {99} and len(cache.runs()) == len(runs) + 1


def test_index_reads_postings_alone(spark, tmp_path):
    texts = ["the cat sat", "The CAT, the cat!", "a dog", None, "", "dog and cat and cat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    search.write_index(docs, "id", "text", f"{tmp_path}/index")
    got = search.search_index(spark, f"{tmp_path}/index", "Cat, dog", 10)
    assert all("/index/postings/" in f for f in got.inputFiles())
    want = search.bm25(docs.where("text is not null"), "id", "text", "cat dog", 10).collect()
    assert [(r[0], pytest.approx(r[1])) for r in want] == [tuple(r) for r in got.collect()]
    other = spark.createDataFrame([(0, 1.0)], "id int, other double")
    assert search.search_index(spark, f"{tmp_path}/index", "cat", 1, other, 0.9).collect()[0].id == 0
    assert search.search_index(spark, f"{tmp_path}/index", "nothing", 5).count() == 0 and search.search_index(spark, f"{tmp_path}/index", "?", 5).count() == 0


def test_resampled_intervals_equal_a_plain_loop(spark):
    import hashlib

    rng = random.Random(2)
    objects = [(f"o{i:02}", rng.randrange(5), rng.randrange(5), rng.randrange(0, 6)) for i in range(17)]
    found = stats.bootstrap(spark.createDataFrame(objects, "key string, a long, b long, n long").repartition(3), "key", {"a": ("a", "n"), "b": ("b", "n")}, 200, "s", differences=[("a", "b")]).collect()
    draws = {"a": [], "b": [], "a - b": []}
    for b in range(200):
        picked = [objects[int(int(hashlib.md5(f"s:{b}:{i}".encode()).hexdigest()[:8], 16) / 2**32 * 17)] for i in range(17)]
        n = sum(o[3] for o in picked)
        if n:
            x, y = sum(o[1] for o in picked) / n, sum(o[2] for o in picked) / n
            for k, v in (("a", x), ("b", y), ("a - b", x - y)):
                draws[k].append(v)

    def percentile(values, q):
        values, at = sorted(values), (len(values) - 1) * q
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    assert {r.metric: (pytest.approx(r.low), pytest.approx(r.high), r.replicates) for r in found} == {k: (percentile(v, 0.025), percentile(v, 0.975), len(v)) for k, v in draws.items()}
