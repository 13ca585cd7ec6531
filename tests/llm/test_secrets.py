import hashlib
import math
import random
import re

import duckdb
import pandas as pd

from factloom.llm import secrets

SCHEMA = "doc_id long, text string"


def plain_fixed(text):
    """Spans of the fixed kinds by the stated patterns, with Python's own matcher."""
    key = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [("assign", *m.span()) for m in key.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def plain_hot(text, allowed=secrets.ALLOWED):
    """Windows counted one by one, with entropies in floating point."""
    out = []
    for kind, c in secrets.CLASSES.items():
        for m in re.finditer(f"[{c.pattern}]{{{c.window},}}", text):
            if any(re.search(p, m[0]) for p in allowed):
                continue
            x, spans = m[0].lower() if c.folded else m[0], []
            for at in range(len(x) - c.window + 1):
                part = x[at : at + c.window]
                bits = -sum(n / c.window * math.log2(n / c.window) for n in map(part.count, set(part)))
                if bits >= c.bits - 1e-9:
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = at + c.window
                    else:
                        spans.append([at, at + c.window])
            out += [(kind, m.start() + a, m.start() + b) for a, b in spans]
    return out


def listed(spans):
    order = [*secrets.BASE, *secrets.CLASSES]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))


def texts():
    rng = random.Random(5)
    word = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    base64 = secrets.CLASSES["entropy_base64"].characters
    bits = ["password", "Token", "API_KEY", "secret", "apikey", "pAsSwD", "=", ": ", '"', "'", " = '", "é", "ſecret", "\n", " ", "word", "AKIA", "a.b"]
    made = ["".join(rng.choice(bits) if rng.random() < 0.6 else word(rng.choice([base64, "0123456789abcdef", "ABCDEFGH", "0123456789", "ab"]), rng.choice([3, 6, 20, 24, 70])) for _ in range(rng.randrange(14))) for _ in range(250)]
    made += [None, "", "token=token:abcdef", "token:abc token:abcdef", "AKIA" + "Z" * 15, "AKIA" + "Z" * 16, "f" * 24, "x" + "f" * 23 + "g"]
    made += ["00000000-1234-4abc-9def-9f8e7d6c5b4a", "the/quick/brown/fox/jumps/over", "EXAMPLE" + word(base64, 30), "d41d8cd98f00b204e9800998ecf8427e".upper()]
    made += ["é" * 5 + " " + word("0123456789ABCDEF", 40) + "\U0001f600 token = " + word(base64, 40), " ".join(word(base64, 30) for _ in range(700)), word(base64, 5000) + "a" * 100 + word(base64, 50)]
    made += ["word " * 30_000 + "secret: hunter22 " + word("0123456789abcdef", 32)]
    return [*enumerate(made), (3, made[3]), (3, made[3]), (None, made[4])]


def test_scan_equals_plain_search_and_sql(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(*r, "clash") for r in rows], f"{SCHEMA}, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    found = secrets.op13_secrets(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
    got = sorted(map(tuple, found.collect()), key=str)
    want = []
    for i, text in rows:
        fixed, hot = plain_fixed(text or ""), plain_hot(text or "")
        n = [sum(k == kind for k, _, _ in fixed) for kind in secrets.BASE]
        want.append((i, *n, hashlib.sha256(listed(fixed).encode()).hexdigest(), listed(fixed + hot), len(hot)))
    assert got == sorted(want, key=str)
    assert sum(r[-1] for r in got) > 500
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert sorted(con.sql(secrets.oracle()).fetchall(), key=str) == got


def test_spans_keep_their_columns_and_the_callers_list(spark):
    key = "Kx9Qv2LmT7pRz4WbN8sYc1Hd"
    docs = spark.createDataFrame([(1, f"use {key} here", 7)], f"{SCHEMA}, secret_spans int")
    (row,) = secrets.scan(docs).collect()
    assert [(s.kind, s.start, s.stop) for s in row.secret_spans] == [("entropy_base64", 4, 28)]
    (row,) = secrets.scan(docs, allowed=("^Kx9",)).collect()
    assert row.secret_spans == []


def test_runs_in_one_stage_without_python(spark, tmp_path):
    spark.createDataFrame([(1, "x")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    plan = secrets.op13_secrets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0
