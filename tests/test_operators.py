import io
import itertools
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import geometry, match, picks, rules, stats
from factloom.operators.compare import compare, ladder, round_half_up, violates
from factloom.sources import files, sinks
from factloom.streaming import events as streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_comparator_and_rules(spark):
    lit = F.lit
    r = one(spark, compare(lit(2.0), lit(">"), lit(1.0)).alias("a"), compare(lit(2.0), lit("~"), lit(1.0)).alias("b"), compare(lit(None).cast("double"), lit("<"), lit(1.0)).alias("c"))
    assert (r.a, r.b, r.c) == (True, None, None)
    bad = lambda kind, expected, actual: violates(lit(kind), lit(expected), lit(actual), lit(10.0), lit(1.0), lit(9.0))
    r = one(spark, *[bad(*x).alias(f"c{i}") for i, x in enumerate([("equal", 1.0, 1.0), ("equal", 1.0, 2.0), ("delta_pct", 10.0, 11.0), ("delta_pct", 10.0, 11.1), ("delta_pct", 0.0, 1.0), ("min", 5.0, 1.0), ("max", 5.0, 9.5), ("other", 1.0, 2.0)])])
    assert tuple(r) == (False, True, False, True, None, False, True, None)


def test_ladder_takes_the_first(spark):
    assert one(spark, ladder((F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c"), otherwise="d")).asDict().popitem()[1] == "b"


def test_halves_round_up(spark):
    assert tuple(one(spark, *[round_half_up(F.lit(x)).alias(str(i)) for i, x in enumerate((-2.5, 2.5, 0.49))])) == (-2.0, 3.0, 0.0)


def test_wilson_and_undefined_ratios(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(8, 10), (0, 0), (0, 5)], "k int, n int").select(low, high, stats.ratio(F.col("k"), F.col("n")), stats.ratio(F.col("k"), F.col("n"), 0.0)).collect()
    assert math.isclose(rows[0][0], 0.4901565, abs_tol=1e-4) and math.isclose(rows[0][1], 0.9433178, abs_tol=1e-4)
    assert tuple(rows[1]) == (None, None, None, 0.0) and rows[2][0] == 0.0


def test_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [("g", rng.randrange(8) / 8, rng.randrange(2)) for _ in range(200)] + [("one", 0.5, 1)]
    got = {r.k: r.auc for r in stats.auc(spark.createDataFrame(rows, "k string, s double, y int"), "s", "y", ["k"]).collect()}
    pos, neg = ([s for k, s, y in rows if k == "g" and y == v] for v in (1, 0))
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(got["g"], want) and got["one"] is None


def test_ancestors_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child int, parent int")
    got = {(r.node, r.ancestor) for r in rules.ancestors(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 1), (4, 2), (4, 3)}


def test_bounded_key(spark):
    long = "ключ" * 200
    r = one(spark, rules.bounded_key(F.lit("short")).alias("a"), rules.bounded_key(F.lit(long)).alias("b"))
    assert r.a == "short" and len(r.b.encode()) <= 512 and r.b.startswith("ключ")


def test_alignment_is_the_best(spark):
    def cost(ops, a, b):
        return sum(match.GAP if i < 0 or j < 0 else match.SAME if a[i] == b[j] else match.ALIKE if a[i][0] == b[j][0] else match.DIFFERENT for _, i, j in ops)

    def brute(a, b):
        if not a or not b:
            return match.GAP * (len(a) + len(b))
        pair = match.SAME if a[0] == b[0] else match.ALIKE if a[0][0] == b[0][0] else match.DIFFERENT
        return max(pair + brute(a[1:], b[1:]), match.GAP + brute(a[1:], b), match.GAP + brute(a, b[1:]))

    rng = random.Random(2)
    for _ in range(60):
        a, b = (rng.choices(["x1", "x2", "y1", "z"], k=rng.randrange(5)) for _ in range(2))
        ops = match.align(a, b)
        assert cost(ops, a, b) == brute(a, b)
        assert [i for _, i, _ in ops if i >= 0] == list(range(len(a))) and [j for _, _, j in ops if j >= 0] == list(range(len(b)))


def test_greedy_pairs_use_each_side_once(spark):
    rows = [(1, "a", "x", 3.0), (1, "a", "y", 1.0), (1, "b", "y", 2.0), (1, "b", "x", 9.0), (2, "a", "x", 5.0)]
    got = {tuple(r) for r in match.greedy_pairs(spark.createDataFrame(rows, "k int, l string, r string, d double"), ["k"], "l", "r", "d").collect()}
    assert got == {(1, "a", "y", 1.0), (1, "b", "x", 9.0), (2, "a", "x", 5.0)}


def test_offsets_after_an_unknown_size(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 3, None), (1, 4, 2)], "k int, i int, n int")
    assert [r.o for r in picks.running_offset(df, ["k"], ["i"], "n", "o").orderBy("i").collect()] == [0, 3, 7, None]


def test_text_functions(spark):
    r = one(
        spark,
        text.fold(F.lit("  Ёлка—№5,  ДОМ ")).alias("fold"),
        text.to_latin_code(F.lit("ав 12-СК")).alias("code"),
        text.parse_number(F.lit("итого 12 345,5 кг")).alias("grouped"),
        text.parse_number(F.lit("none")).alias("none"),
        text.format_number(F.lit(1234.5)).alias("shown"),
        text.format_number(F.lit(7.0)).alias("whole"),
        text.unit_factor(F.lit(" MM.")).alias("mm"),
        text.unit_factor(F.lit("ell")).alias("ell"),
        text.iso_date(F.lit("от 05.03.2024 г.")).alias("date"),
        text.iso_date(F.lit("31.02.2024")).alias("no_date"),
        text.mask_mail(F.lit("to anna.b@mail.org now")).alias("mail"),
    )
    assert (r.fold, r.code, r.grouped, r.none) == ("елка 5 дом", "AB12-CK", 12345.5, None)
    assert (r.shown, r.whole, r.mm, r.ell) == ("1234,5", "7", 0.001, None)
    assert (r.date, r.no_date, r.mail) == ("2024-03-05", None, "to a***@mail.org now")


def test_geometry(spark):
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    r = one(spark, geometry.area(square).alias("area"), geometry.inside(square, F.lit(1.0), F.lit(3.0)).alias("yes"), geometry.inside(square, F.lit(5.0), F.lit(3.0)).alias("no"), geometry.distance_to_contour(F.lit(1.0), F.lit(2.0), square).alias("d"))
    assert (r.area, r.yes, r.no, r.d) == (16.0, True, False, 1.0)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_office_files_and_kinds(spark):
    w = 'xmlns:w="urn:w"'
    docx = zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:body></w:document>"})
    xlsx = zipped({
        "xl/workbook.xml": "<workbook/>",
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><t>Area</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>Hall</t></is></c><c><v>12.5</v></c></row></sheetData></worksheet>',
    })
    rows = [("a.docx", docx), ("b.xlsx", xlsx), ("c.docx", b"PK\x03\x04broken"), ("d.pdf", b"%PDF-1.7"), ("e.xml", b"<?xml version='1.0'?><a/>"), ("f.json", b' {"a": 1}'), ("g", b"\x89PNG\r\n")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert [r.k for r in df.select("path", files.file_kind(F.col("content")).alias("k")).orderBy("path").collect()] == ["zip", "zip", "zip", "pdf", "xml", "json", "png"]
    lines = {(r.path, r.kind, r.text) for r in files.document_lines(df.where("path < 'd'")).collect()}
    assert lines == {("a.docx", "docx", "Hello there"), ("a.docx", "docx", "Two"), ("b.xlsx", "xlsx", "Name\tArea"), ("b.xlsx", "xlsx", "Hall\t12.5"), ("c.docx", "broken", None)}


def test_xml_values(spark):
    xml = '<doc code="A-1"><value name="Area" unit="m2">1 234,5</value><value name="Floors" unit="n">x</value></doc>'
    got = {(r.name, r.unit, r.num) for r in files.xml_values(spark.createDataFrame([(xml,)], "text string")).collect()}
    assert got == {("Area", "m2", 1234.5), ("Floors", "n", None)}


def test_batches_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, f"{i:03d}", rng.randrange(1, 40)) for k in range(4) for i in range(rng.randrange(30))]
    got = {(r.k, r.path): r.batch for r in files.batches(spark.createDataFrame(rows, "k int, path string, bytes long"), ["k"], 60, 3).collect()}
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        batch = filled = n = 0
        for _, path, size in group:
            if n and (filled + size > 60 or n >= 3):
                batch, filled, n = batch + 1, 0, 0
            filled, n = filled + size, n + 1
            assert got[k, path] == batch


def test_parts_with_a_gap_are_incomplete(spark):
    parts = spark.createDataFrame([("a", 3, 4, "y"), ("a", 1, 2, "x"), ("b", 1, 2, "x"), ("b", 4, 4, "z"), ("c", 2, 3, "x"), ("d", 1, 9, "w")], "doc string, first int, last int, text string")
    got = {r.doc: (r.complete, r.text, r.pages) for r in files.assembled(parts).collect()}
    assert got == {"a": (True, "xy", 4), "b": (False, "xz", 4), "c": (False, "x", 3), "d": (True, "w", 9)}


def test_publishing_twice_is_publishing_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    a = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 3)], "file_id string, v int")
    sinks.publish(a, path, "file_id")
    b = spark.createDataFrame([("f1", 9)], "file_id string, v int")
    for _ in range(2):
        sinks.publish(b, path, "file_id")
    assert sorted((r.file_id, r.v) for r in spark.read.parquet(path).collect()) == [("f1", 9), ("f2", 3)]


def test_exports_and_validation(spark, tmp_path):
    df = spark.createDataFrame([("M-1", 2.5), ("M-2", None)], "code string, num double")
    sinks.export_json(df, str(tmp_path / "j"))
    sinks.export_xml(df, str(tmp_path / "x"))
    assert spark.read.schema("code string, num double").json(str(tmp_path / "j")).count() == 2
    assert spark.read.schema("code string, num double").option("rowTag", "check").format("xml").load(str(tmp_path / "x")).count() == 2
    texts = spark.createDataFrame([('{"code": "A", "num": 1.0}',), ('{"code": "A", "num": "x"}',), ("broken",)], "t string")
    assert [r.valid for r in sinks.validated(texts, "t", "code string, num double").collect()] == [True, False, False]


@pytest.fixture
def event_files(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", i % 3, ["view", "error"][i % 2], float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(4):
        df.where(f"event_id div 60 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df, tmp_path


def test_stream_status_and_affected_keys(spark, event_files):
    path, df, work = event_files
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r.user_id] = (r.at, r.status)

    stream = streams.current_status(streams.source(spark, path, df.schema))
    run = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(work / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = {u: max((r.ts, r.event_id, r.event_type) for r in df.where(f"user_id = {u}").collect())[2] for u in range(3)}
    assert {u: s for u, (_, s) in seen.items()} == want
    results = {}
    writer = streams.recompute_affected(
        streams.source(spark, path, df.schema).where("event_id < 5"), lambda: df, lambda f: f.groupBy("user_id").count(), "user_id", lambda out, n: results.update({r.user_id: r["count"] for r in out.collect()})
    )
    writer.option("checkpointLocation", str(work / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert results == {0: 80, 1: 80, 2: 80}


def test_components_against_a_search(spark):
    from factloom.operators.components import components

    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in near:
        seen, front = {node}, [node]
        while front:
            front = [y for x in front for y in near[x] if y not in seen and not seen.add(y)]
        want[node] = min(seen)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_pairs_are_those_of_a_walk(spark):
    rng = random.Random(4)
    rows = sorted({(k, rng.randrange(12), rng.randrange(12)) for k in range(6) for _ in range(60)})
    rows = [(k, a, b, float(rng.randrange(5))) for k, a, b in rows]
    want, used = set(), set()
    for k, a, b, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if (k, "l", a) not in used and (k, "r", b) not in used:
            used |= {(k, "l", a), (k, "r", b)}
            want.add((k, a, b, d))
    df = spark.createDataFrame(rows, "k int, l int, r int, d double")
    assert {tuple(r) for r in match.greedy_pairs(df, ["k"], "l", "r", "d").collect()} == want
    assert match.greedy_pairs(df.limit(0), ["k"], "l", "r", "d").count() == 0


def test_deletions_reach_all_texts_within_as_many_edits(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randrange(0, 6))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")
    forms = {r.w: set(r.f) for r in df.select("w", text.deletions(F.col("w"), 2).alias("f")).collect()}
    near = df.toDF("a").join(df.toDF("b"), F.levenshtein("a", "b") <= 2).collect()
    assert all(forms[r.a] & forms[r.b] for r in near)


def test_batches_stream_a_key_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), f"p{i:04d}", rng.randrange(1, 50)) for i in range(300)]
    got = {(r.k, r.path): r.batch for r in files.batches(spark.createDataFrame(rows, "k int, path string, bytes long"), ["k"], 60, 3).collect()}
    want = {}
    for key in range(3):
        no = filled = n = 0
        for k, path, size in sorted(rows):
            if k == key:
                if n and (filled + size > 60 or n >= 3):
                    no, filled, n = no + 1, 0, 0
                filled, n = filled + size, n + 1
                want[k, path] = no
    assert got == want


def test_masks(spark):
    addresses = {
        "10.20.30.40": "10.20.30.0", "::ffff:10.20.30.40": "::ffff:10.20.30.0", "2001:0db8:1:2:3:4:5:6": "2001:db8:1::/48", "fe80::1": "fe80:0:0::/48",
        "256.1.1.1": "***", "1:2:3": "***", "no": "***", "": "", "1::2::3": "***", "1.2.3": "***",
        "1:2:3:4:5:6:7::": "1:2:3::/48", "1:2:3:4:5:6:7:8:9": "***", "::": "0:0:0::/48", "12345::": "***", "A:B::C": "a:b:0::/48", "::FFFF:1.2.3.4": "::FFFF:1.2.3.0",
    }
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    assert {r.a: r.m for r in df.select("a", text.mask_ip(F.col("a")).alias("m")).collect()} == addresses
    fields = [("IP", "10.20.30.40", "10.20.30.0"), ("login", "anna", "***"), ("note", "anna@b.org, +7 (495) 123-45-67, 123-456-789 01", "a***@b.org, +7***-**-67, ***-***-*** 01"), ("note", None, None),
              ("note", "8 9161234567; 8-916-123-45-67 12345678901 a8 916 123 45 67", "+7***-**-67; +7***-**-67 12345678901 a8 916 123 45 67"), ("note", "a@b c@d.org@x.y <иван.п@почта.рф>", "a@b c***@d***@x.y <и***@почта.рф>"),
              ("note", "1-2 123-456-789-01 1123-456-789 01", "1-2 ***-***-*** 01 1123-456-789 01"), ("host", "::1", "0:0:0::/48")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(fields)], "i int, k string, v string")
    assert [r.m for r in df.select("i", text.mask_field(F.col("k"), F.col("v")).alias("m")).orderBy("i").collect()] == [m for *_, m in fields]


def test_composed_letters_and_word_distance(spark):
    r = one(spark, text.nfc(F.lit("cafe\u0301")).alias("a"), text.nfc(F.lit("plain")).alias("b"), text.nfc(F.lit(None).cast("string")).alias("c"))
    assert (r.a, r.b, r.c) == ("caf\u00e9", "plain", None)
    rng = random.Random(1)
    rows = [([rng.choice("abcd") * 3 for _ in range(rng.randrange(7))], [rng.choice("abcd") * 3 for _ in range(rng.randrange(7))]) for _ in range(60)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
        return d[-1]

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == distance(r.a, r.b) for r in got) and len(got) == len(rows)


def test_word_distance_of_long_texts(spark):
    many = [f"w{i}" for i in range(45_000)]
    rows = [(many[:40_000], many[40_000:]), (many[:300], many[300:600]), ([], many[:3]), (None, ["a"]), (["a", None, "b"], ["b"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [40_000, 300, 3, None, 1]


def test_crossings_and_overlaps(spark):
    line = lambda *p: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    r = one(
        spark,
        geometry.crossings(line((0, 0), (4, 4)), line((0, 4), (4, 0), (4, 1))).alias("two"),
        geometry.crossings(line((0, 0), (4, 0)), line((1, 0), (3, 0))).alias("along"),
        geometry.crossings(line((0, 0), (4, 0)), line((4, 0), (4, 5))).alias("touch"),
        geometry.polygon_iou(line((0, 0), (4, 0), (4, 4), (0, 4)), line((2, 2), (6, 2), (6, 6), (2, 6))).alias("squares"),
        geometry.polygon_iou(line((0, 0), (4, 0), (0, 4)), line((4, 4), (4, 0), (0, 4))).alias("apart"),
        geometry.polygon_iou(line((0, 0), (6, 0), (6, 6), (3, 1), (0, 6)), line((0, 0), (6, 0), (6, 6), (0, 6))).alias("hollow"),
        geometry.polygon_iou(line((0, 0), (1, 1)), line((0, 0), (4, 0), (4, 4))).alias("none"),
    )
    assert sorted(map(tuple, r.two)) == [(2.0, 2.0)]
    assert (r.along, [tuple(p) for p in r.touch]) == ([], [(4.0, 0.0)])
    assert math.isclose(r.squares, 4 / 28) and r.apart == 0 and math.isclose(r.hollow, 21 / 36) and r.none is None


def test_relations_on_a_sheet(spark):
    box = "sheet int, item string, box array<double>"
    subjects = spark.createDataFrame([(1, "in", [1.0, 1.0, 2.0, 2.0]), (1, "edge", [9.0, 9.0, 11.0, 11.0]), (1, "far", [20.0, 0.0, 21.0, 1.0]), (2, "alone", [0.0, 0.0, 1.0, 1.0])], box)
    others = spark.createDataFrame([(1, "room", [0.0, 0.0, 10.0, 10.0])], box)
    holds = lambda kind, limit=0.0: {r.item: r.holds for r in geometry.related(subjects, others, ["sheet"], "item", kind, limit).collect()}
    assert holds("inside") == {"in": True, "edge": False, "far": False}
    assert holds("intersects") == {"in": True, "edge": True, "far": False}
    assert holds("distance", 10.0) == {"in": True, "edge": True, "far": True} and not holds("distance", 9.9)["far"]


def test_mutual_bests_and_exact_keys(spark):
    rows = [("a", "x", 5.0, False), ("a", "y", 5.0, False), ("b", "y", 4.0, False), ("c", "z", 1.0, True), ("c", "w", 9.0, False), ("d", "w", 8.0, False), ("e", "v", 0.5, False)]
    df = spark.createDataFrame(rows, "l string, r string, s double, same boolean").withColumn("k", F.lit(1))
    plain = {(r.l, r.r, r.status) for r in match.mutual_best(df, ["k"], "l", "r", "s", 1.0).collect()}
    assert plain == {("a", "x", "AMBIGUOUS"), ("a", "y", "AMBIGUOUS"), ("c", "w", "UNIQUE")}
    keyed = {(r.l, r.r, r.status) for r in match.mutual_best(df, ["k"], "l", "r", "s", 1.0, "same").collect()}
    assert keyed == {("a", "x", "AMBIGUOUS"), ("a", "y", "AMBIGUOUS"), ("c", "z", "UNIQUE"), ("d", "w", "UNIQUE")}
