import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def brute_merge(word, merges):
    rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
    made = {(a, b): w for a, b, w in merges}
    word = list(word)
    while True:
        pairs = [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]
        if not pairs:
            return word
        best = min(pairs)[0]
        out, i = [], 0
        while i < len(word):
            pair = tuple(word[i : i + 2])
            if rank.get(pair, -1) == best:
                out.append(made[pair])
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out


def test_automaton_equals_merging_on_random_vocabularies():
    rng = random.Random(11)
    for _ in range(60):
        labels = {i: bytes([97 + i]) for i in range(3)}
        merges = []
        for _ in range(rng.randrange(1, 14)):
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                labels[len(labels)] = labels[u] + labels[v]
                merges.append((u, v, len(labels) - 1))
        automaton = bpe.MergeAutomaton(labels, merges)
        for _ in range(60):
            word = bytes(rng.choices(b"abc", k=rng.randrange(1, 14)))
            ids = automaton.encode(word)
            assert ids == brute_merge([b - 97 for b in word], merges), (labels, merges, word)
            assert automaton.decode(ids) == word


def test_equals_the_library(library):
    rng = random.Random(2)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endof", "a" * 3000, " \n\t  x", "it's WE'LL 日本語 é́ \U0001f600\U0001f600"]
    texts += ["".join(rng.choices("the ing'lsé \n.,0129日", k=rng.randrange(80))) for _ in range(500)]
    own = bpe.load(PATH, public_tokenizers.PATTERN)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton({0: b"a", 1: b"aa", 2: b"aaa"}, [(0, 0, 1), (0, 1, 2), (1, 0, 2)])


def test_query_keeps_rows_and_handles_nulls(spark, library):
    rows = [(1, "Some words here.", 5), (2, None, 6), (3, "", 7), (1, "Some words here.", 5), (None, "x y", 8), (4, "w" * 50_000 + " end", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), ids, sha, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
