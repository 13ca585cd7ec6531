import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(200)]
    rude = ["zorgle", "quuxify", "vextrous"]
    texts, labels = [], []
    for _ in range(n):
        sentences = [rng.choices(plain, k=rng.randrange(4, 15)) for _ in range(rng.randrange(1, 12))]
        label = rng.random() < 0.2
        if label:
            rng.choice(sentences).insert(0, rng.choice(rude) + rng.choice(["", "ed"]))
        texts.append(". ".join(" ".join(s) for s in sentences) + ".")
        labels.append(int(label))
    return texts, labels


def test_sentences_are_found_from_document_labels():
    scorer = toxicity.fit(*corpus(1200, 1))
    texts, labels = corpus(400, 2)
    scores = np.array([scorer.score(t) for t in texts])
    assert (((scores >= 0.5) == np.array(labels)).mean()) > 0.95
    for text, label, s in zip(texts, labels, scores):
        if label and s >= 0.5:
            best = max(scorer.offending(text), key=lambda x: x["p"])
            part = text[best["start"] : best["stop"]]
            assert any(w in part for w in ("zorgle", "quuxify", "vextrous"))


def test_noisy_or_of_sentences_by_hand():
    scorer = toxicity.Scorer({"bad": 3.0}, -2.0)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    want = 1 - (1 - sigmoid(1.0)) * (1 - sigmoid(-2.0)) * (1 - sigmoid(4.0))
    assert np.isclose(scorer.score("So BAD it is. Fine words! bad, bad"), want)
    assert np.isclose(scorer.score(""), sigmoid(-2.0)) and np.isclose(scorer.score("..."), sigmoid(-2.0))


def test_long_lists_are_cut_in_stretches():
    starts, stops = toxicity.stretches(np.array([False] * 95 + [True, False]))
    assert list(zip(starts, stops)) == [(0, 40), (40, 80), (80, 95), (96, 97)]


def test_one_sided_labels_give_a_constant():
    assert toxicity.fit(["a", "b"], [0, 0]).score("anything") < 0.5
    assert 0 <= toxicity.fit([], []).score("x") <= 1


def test_query_over_rows_with_nulls_and_clashes(spark):
    texts, labels = corpus(300, 5)
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(1000, None, "x", 1.0), (1001, "", None, None), (None, "zorgle", None, None), (0, texts[0], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    known = spark.createDataFrame([(i, y, 1) for i, y in enumerate(labels)] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    scorer = toxicity.train(docs, known)
    found = toxicity.score(docs, scorer).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = toxicity.keep_clean(docs, scorer)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in found if not r.predicted)
    assert toxicity.score(docs.limit(0), scorer).count() == 0
    again = toxicity.train(docs, known)
    assert again.weights == scorer.weights and again.bias == scorer.bias


def test_held_out_labels_are_not_read(spark):
    texts, labels = corpus(200, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    a = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    b = spark.createDataFrame([(i, flip(i, y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    assert toxicity.train(docs, a).weights == toxicity.train(docs, b).weights


def plain_score(weights, bias, text):
    """Noisy-or over the sentences, one word at a time."""
    sentences, words = [], []
    for m in re.finditer(r"[^\W\d_]+|[.!?;|\n。！？।]", text):
        if m[0].isalpha():
            words.append(m[0].lower())
        elif words:
            sentences, words = [*sentences, words], []
    sentences += [words] if words else []
    sentences = [s[i : i + toxicity.STRETCH] for s in sentences for i in range(0, len(s), toxicity.STRETCH)] or [[]]
    clean = 1.0
    for s in sentences:
        logit = bias + sum(weights.get(f, 0.0) for w in s for f in [w, *(w[:n] + "*" for n in toxicity.BEGINNINGS if len(w) >= n)])
        clean *= 1 / (1 + math.exp(logit))
    return 1 - clean


def test_the_whole_query_against_plain_loops(spark, tmp_path):
    texts, labels = corpus(400, 9)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "x. " * 70_000 + "zorgle was here"), (0, texts[0]), (1003, "İİİ zorgle")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = sorted((i, t or "") for i, t in rows if i < 400 and not held(i))
    scorer = toxicity.fit([t for _, t in known], [labels[i] for i, _ in known])
    got = sorted((r.doc_id, r.held_out, r.predicted, r.score) for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect())
    want = sorted((i, held(i), plain_score(scorer.weights, scorer.bias, t or "")) for i, t in rows)
    assert len(got) == len(want)
    for (i, h, predicted, score), (j, k, s) in zip(got, want):
        assert (i, h) == (j, k) and abs(score - s) < 1e-9 and predicted == int(s >= 0.5)


def test_training_ends_where_the_likelihood_is_flat(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 4000)
    texts, labels = corpus(300, 11)
    scorer = toxicity.fit(texts, labels)

    def loss(weights, bias):
        total = 0.0
        for t, y in zip(texts, labels):
            p = min(max(plain_score(weights, bias, t), 1e-12), 1 - 1e-12)
            total -= math.log(p if y else 1 - p)
        return total / len(texts) + toxicity.DECAY / 2 * sum(w * w for w in weights.values())

    base = loss(scorer.weights, scorer.bias)
    names = sorted(scorer.weights, key=lambda f: -abs(scorer.weights[f]))[:6]
    for name in names:
        for step in (0.2, -0.2):
            assert loss(scorer.weights | {name: scorer.weights[name] + step}, scorer.bias) > base - 1e-4
    assert loss({}, scorer.bias) > base


def test_offsets_are_those_of_the_text_itself():
    scorer = toxicity.Scorer({"bad": 9.0}, -4.0)
    (hit,) = scorer.offending("İİİİ. bad thing. fine")
    assert "İİİİ. bad thing. fine"[hit["start"] : hit["stop"]] == "bad thing"


def test_long_texts_teach_by_stretches_from_all_over(spark):
    text = "".join(f"{i:07d} " for i in range(60_000))
    (part,) = spark.createDataFrame([(text,)], "text string").select(toxicity.stretched(F.col("text"))).first()
    step = toxicity.LONGEST // toxicity.STRETCHES
    assert part == "\n".join(text[len(text) * i // toxicity.STRETCHES :][:step] for i in range(toxicity.STRETCHES))
