import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import language, pii, toxicity
from tests.llm.test_dedup import brute

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "ber"]}


def documents():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(260):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(30, 160))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = "zorgle"
            words[rng.randrange(len(words))] = "zorgle"
        if i % 7 == 0:
            words[3] = f"user{i % 4}@mail.example.com"
        text = " ".join(words)
        rows.append([i, text, lang, f"src{i % 3}", len(text)])
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(260, 290):
        rows.append([i, rows[i - 250][1], "aa", "src0", rows[i - 250][4]])
    rows.append([300, "Совсем другой язык с другими буквами " * 3, "aa", "src1", 111])
    rows.append([301, None, None, None, None])
    return rows, labels


def fused(rows, model):
    """The rows for which no class is more probable than that of unknown languages, by Bayes' rule in plain loops."""
    kappa, size = language.INHERITED, len(model.languages) + 1
    scores = [np.array(model.score(r[1] or "")) for r in rows]
    start = np.append(np.zeros(size - 1), np.log(language.OTHER))
    soft = [np.exp(s + start) / np.exp(s + start).sum() for s in scores]
    kept = []
    for i, r in enumerate(rows):
        n = lambda at: sum((p for k, p in enumerate(soft) if k != i and (rows[k][at] or "") == (r[at] or "")), np.zeros(size))  # noqa: E731, B023
        total = sum(p for k, p in enumerate(soft) if k != i)
        prior = (total + 1) / (total.sum() + size)
        for _ in ("site", "host"):  # both are the source here
            prior = (n(3) + kappa * prior) / (n(3).sum() + kappa)
        logs = scores[i] + np.log(prior)
        if r[2]:
            c, share = n(2), sum(q[2] == r[2] for q in rows) / len(rows)
            logs = logs + c.sum() / (c.sum() + kappa) * np.log((c + kappa * share) / (total + kappa))
        if logs.argmax() < size - 1:
            kept.append(r)
    return kept


def by_hand(rows, labels):
    """The stages as plain loops: what packing is given."""
    truth = {i: t for i, _, t in labels}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = sorted((r for r in rows if r[0] in truth and not held(r[0])), key=lambda r: r[0])
    scorer = toxicity.fit([r[1] for r in known], [truth[r[0]] for r in known])
    rows = [r for r in rows if scorer.score(r[1] or "") < 0.5]
    pairs = sorted({(r[1] or "", r[2]) for r in rows if r[2]})
    model = language.fit([t for t, _ in pairs], [x for _, x in pairs])
    rows = fused(rows, model)
    rows = list(brute(rows))
    real = {f[2:] for r in rows for f in pii.find(r[1] or "")}
    fresh = {f"{k}\x1f{c}": pii.surrogate(pii.TEST_KEY, k, c, r) for k, c, r in real}
    assert len(set(fresh.values())) == len(fresh) and not set(fresh.values()) & {c for _, c, _ in real}
    return [(r[0], pii.replace(r[1], pii.find(r[1]), fresh) if r[1] else r[1]) for r in rows]


def test_pipeline_against_plain_loops(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = by_hand(rows, labels)
    assert 150 < len(want) < len(rows) - 50
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in want}
    assert {r.doc_id for r in packed} == set(ids)
    spans = Counter()
    for r in packed:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        spans[r.doc_id] += r.length
    assert spans == Counter({i: len(x) for i, x in ids.items()})


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, labels = documents()
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
