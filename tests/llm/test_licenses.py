import random

import duckdb
import pandas as pd

from factloom.llm import licenses


def by_duckdb(rows):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con.register("documents", frame)
    return sorted(con.sql(licenses.oracle()).fetchall(), key=str)


def test_scan_equals_sql_on_texts_of_every_kind(spark, tmp_path):
    rng = random.Random(4)
    bits = [*licenses.BASE, *licenses.NOTICES, "the", "license", "public", "mit", "École", "é", "License\x00MIT", "x"]
    rows = [(i, rng.choice([" ", "-", ". ", "\n"]).join(rng.choices(bits, k=rng.randrange(12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "MIT License"), (303, "mit mit license license"), (304, "mit"), (305, "MIT LİCENSE"), (None, "apache-license"), (302, "MIT License"), (302, "MIT License")]
    rows += [(306, "word " * 20_000 + "the MIT license")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = licenses.op8_licenses(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == by_duckdb(rows)


def test_base_places_are_those_of_a_plain_search(spark):
    rng = random.Random(7)
    words = ["mit", "license", "apache", "general", "public", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(300)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        split = text.split()
        places = [
            (at, label)
            for phrase, label in licenses.BASE.items()
            for at in range(len(split))
            if split[at : at + len(phrase.split())] == phrase.split()
        ]
        r = found[i]
        assert (r.n_words, r.n_base) == (len(split), len(places))
        assert r.first_word == min((p for p, _ in places), default=None)
        assert r.last_word == max((p for p, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))


def test_a_notice_with_a_word_put_in_is_one_span(spark):
    text = "It is licensed under the very Apache License, Version 2.0."
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert "apache-2.0" in r.labels.split(",") and r.base_labels == "apache" and r.score == 1.0


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_the_callers_own_are_found_whole(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)]
    license_text = " ".join(rng.choices(words, k=400))
    split = license_text.split()
    edited = split[:100] + ["extra"] + split[100:250] + split[251:]
    rows = [(1, "before " + license_text.upper() + " after"), (2, " ".join(edited)), (3, " ".join(split[:200])), (4, " ".join(rng.choices(words, k=400))), (5, "mit license")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {license_text: "own-1.0"}).collect()}
    assert got == {1: "own-1.0", 2: "own-1.0", 3: "", 4: "", 5: "mit"}
