import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "eit"], "cc": ["cion", "ado", "ez"]}


def text_in(lang, rng, n=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choices(list(SYLLABLES), [6, 3, 1])[0]
        declared = lang if rng.random() < 0.9 else rng.choice(list(SYLLABLES))
        rows.append((i, text_in(lang, rng), declared, f"h{rng.randrange(3)}.{lang}site.{lang}", lang))
    return rows


def test_fused_posterior_is_that_of_bayes_by_hand(spark):
    rows = corpus(200, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    found = language.document_evidence(docs)
    model = language.train(found)
    got = {r.doc_id: r for r in language.identify(found, ["doc_id"], model).collect()}
    names, kappa = [*model.languages, "und"], language.INHERITED
    scores = {r[0]: np.array(model.score(r[1])) for r in rows}
    start = np.append(np.zeros(len(names) - 1), np.log(language.OTHER))
    soft = {i: np.exp(s + start) / np.exp(s + start).sum() for i, s in scores.items()}
    for i, _, declared, host, truth in rows[:60]:
        n = lambda keep: sum((soft[r[0]] for r in rows if keep(r) and r[0] != i), np.zeros(len(names)))
        total = n(lambda r: True)
        flat = (total + 1) / (total.sum() + len(names))
        smooth = lambda c, p: (c + kappa * p) / (c.sum() + kappa)
        site = smooth(n(lambda r: r[3].split(".", 1)[1] == host.split(".", 1)[1]), flat)
        logs = scores[i] + np.log(smooth(n(lambda r: r[3] == host), site))
        for same in (lambda r: r[2] == declared, lambda r: r[3].rsplit(".", 1)[1] == host.rsplit(".", 1)[1]):
            c, share = n(same), sum(map(same, rows)) / len(rows)
            logs = logs + c.sum() / (c.sum() + kappa) * np.log((c + kappa * share) / (total + kappa))
        p = np.exp(logs - logs.max())
        p /= p.sum()
        assert got[i]._lang == names[int(p.argmax())] == truth
        assert math.isclose(got[i]._posterior, p.max(), rel_tol=1e-9)


def test_other_evidence_decides_short_texts(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in corpus(300, 2)] + [(1000, "", "bb", "h0.bbsite.bb"), (1001, None, None, "h0.ccsite.cc"), (1002, "1 2 3", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(language.document_evidence(docs), ["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert got[1000]._lang == "bb" and got[1001]._lang == "cc"
    assert got[1002]._lang == "aa"  # the commonest one of the corpus


def test_unknown_languages_go_and_columns_stay(spark):
    rows = [(*r[:4], "x", 1) for r in corpus(200, 3)]
    odd = [(2000, "Это совсем другой язык и другие буквы " * 3, "aa", "s", "x", 1), (2001, "短い", "aa", "s", "x", 1), (3, rows[3][1], "aa", "s", "x", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, _text string, _n int")
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([r[0] for r in rows] + [2001, 3])


def test_the_posterior_decides_what_stays(spark):
    """The same doubtful text stays at a host that writes known languages and goes at one that doesn't."""
    rng = random.Random(4)
    odd = lambda n: "".join(rng.choices("жщыюбдлкм", k=n))
    rows = [(*r[:3], "known.example", "") for r in corpus(300, 3)]
    rows += [(1000 + i, " ".join(odd(5) for _ in range(60)), None, "other.example", "") for i in range(80)]
    doubtful = f"{text_in('aa', random.Random(2), 3)} {odd(8)} {odd(9)}"
    rows += [(2000, doubtful, None, "known.example", ""), (2001, doubtful, None, "other.example", "")]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in language.keep_known(docs).collect()}
    assert 2000 in kept and 2001 not in kept and not kept & set(range(1000, 1080)) and set(range(300)) <= kept


def test_long_texts_ties_and_repeats(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in corpus(200, 6)]
    long = " ".join(text_in("bb", random.Random(i), 50) for i in range(4_000))
    rows += [(900, long, "bb", "h"), (900, long, "bb", "h"), (901, long[: language.LONGEST + 1], "bb", "h"), (902, "", None, None), (902, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(long) > 20 * language.LONGEST
    got = language.identify(language.document_evidence(docs), ["doc_id"]).collect()
    assert [r._lang for r in got if r.doc_id in (900, 901)] == ["bb"] * 3
    assert len(got) == len(rows) and len({r._lang for r in got if r.doc_id == 902}) == 1
    (part,) = docs.where("doc_id = 900").limit(1).select(language.stretches(F.col("text"))).first()
    step = language.LONGEST // language.STRETCHES
    assert part == " ".join(long[i * len(long) // language.STRETCHES :][:step] for i in range(language.STRETCHES))


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, None)], "doc_id long, text string, lang string, source string")
    (r,) = language.identify(language.document_evidence(docs), ["doc_id"]).collect()
    assert r._lang is None
    assert language.keep_known(docs.limit(0)).count() == 0


def test_pages_bring_markup_address_and_text(spark):
    pages = spark.createDataFrame(
        [(1, "http://u@www.Example.org:80/x", "<html LANG='de-AT'><nav>no</nav><p>Text</p></html>"), (2, None, None)], "page_id long, url string, html string"
    )
    rows = {r.page_id: r for r in language.page_evidence(pages).collect()}
    assert (rows[1]._text, rows[1]._declared, rows[1]._host, rows[1]._site, rows[1]._suffix) == ("Text", "de", "www.example.org", "example.org", "org")
    assert (rows[2]._text, rows[2]._declared, rows[2]._host, rows[2]._suffix) == ("", "", "", "")


def test_trigrams_in_blocks(monkeypatch):
    text = text_in("aa", random.Random(1), 400)
    whole = np.concatenate(list(language.trigrams(text)))
    monkeypatch.setattr(language, "BLOCK", 37)
    assert (np.concatenate(list(language.trigrams(text))) == whole).all()
    assert sum(map(len, language.trigrams(""))) == 0


def test_a_rare_declared_language_of_a_large_table_is_known(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 300)
    rng = random.Random(8)
    rows = [(i, text_in("aa", rng), "aa", "s") for i in range(4_000)]
    rows += [(4_000 + i, " ".join("".join(rng.choices("жщыюбд", k=4)) for _ in range(12)), "rr", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language.keep_known(docs).count() == len(rows)
    got = language.identify(language.document_evidence(docs), ["doc_id"]).where("doc_id >= 4000").collect()
    assert {r._lang for r in got} == {"rr"}
