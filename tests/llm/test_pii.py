import random
from collections import defaultdict

import pytest

from factloom.llm import pii
from factloom.llm.common import materialise

TEXT = (
    "Write to Anna.Lee@Mail.example.org or ANNA.LEE@mail.example.org, call +1 (017) 555-7713 or +1-017-555-7713, from 96.153.118.61. "
    "Card 4111 1111 1111 1111, again 4111111111111111. token = \"908038b7daaf91e730d2f64001c52934d43d9336\"### "
    "Mrs Helen Carver met Mr. Tom Carver; Carver said HELEN was late. Г-жа Анна Павлова. 555-8001%%% Release 1.2, 127.0.0.1, 2024-01-02."
)


def spans(text):
    return [(text[a:b], k, c) for a, b, k, c, _ in pii.find(text)]


def test_kinds_and_canonical_forms():
    found = spans(TEXT)
    by = defaultdict(set)
    for _, kind, canonical in found:
        by[kind].add(canonical)
    assert by["email"] == {"anna.lee@mail.example.org"} and by["phone"] == {"+10175557713"}
    assert by["ip"] == {"96.153.118.61"} and by["account"] == {"4111111111111111"}
    assert by["hex"] == {"908038b7daaf91e730d2f64001c52934d43d9336"} and by["local"] == {"5558001"}
    roles = {(c, r) for _, _, k, c, r in pii.find(TEXT) if k == "name"}
    assert roles == {("helen", "given_f"), ("tom", "given_m"), ("carver", "family"), ("анна", "given_f"), ("павлова", "family")}
    assert [w for w, k, c in found if c == "carver"] == ["Carver"] * 3
    assert spans("An ordinary text about 12 things, 3.5 of them in 2024-01-02.") == []


def test_spelling_check_digit_and_country_stay():
    fresh = {f"{k}\x1f{c}": pii.surrogate(b"k", k, c, r) for _, _, k, c, r in pii.find(TEXT)}
    out = pii.replace(TEXT, pii.find(TEXT), fresh)
    for word, _, _ in spans(TEXT):
        assert word not in out
    assert "+1 (" in out and "+1-" in out and "Release 1.2, 127.0.0.1, 2024-01-02." in out and "###" in out
    card = fresh["account\x1f4111111111111111"]
    assert card[0] == "4" and pii.luhn_digit(card[:-1]) == card[-1] and card in out and " ".join(card[i : i + 4] for i in range(0, 16, 4)) in out
    assert [w for w, k, _ in spans(out) if k == "email"][1].split("@")[0].isupper()
    assert pii.CYRILLIC.search(fresh["name\x1fанна"]) and len(out.split()) == len(TEXT.split())
    assert pii.surrogate(b"k", "ip", "192.168.3.4").startswith("192.168.")
    assert pii.surrogate(b"k", "email", "a@b.org") != pii.surrogate(b"other", "email", "a@b.org")


def test_social_and_bank_numbers():
    text = "SSN 123-45-6789, account DE89 3704 0044 0532 0130 00 or DE89370400440532013000."
    found = spans(text)
    assert [(k, c) for _, k, c in found] == [("ssn", "123456789"), ("iban", "DE89370400440532013000"), ("iban", "DE89370400440532013000")]
    fresh = {f"{k}\x1f{c}": pii.surrogate(b"k", k, c) for _, k, c in found}
    out = pii.replace(text, pii.find(text), fresh)
    iban = fresh["iban\x1fDE89370400440532013000"]
    assert iban.startswith("DE") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out.count(iban) == 1 and " ".join(iban[i : i + 4] for i in range(0, 22, 4)) in out and "123-45-6789" not in out


def test_a_quick_look_misses_nothing():
    rng = random.Random(3)
    bits = [*(w for w in TEXT.split() if w != "127.0.0.1,"), "the", "of", "Mr", "MRS", "secret:", "abcdefgh", "Ordinary", "\n"]
    for _ in range(500):
        text = " ".join(rng.choices(bits, k=8))
        whole = {m.span() for m in pii.ENTITY.finditer(text) if "\n" not in m[0]}
        assert whole <= {m.span() for line in pii.lines_with_signs(text) for m in pii.ENTITY.finditer(text, *line)}


def drawn(spark, entities, key=b"k"):
    rows = [e if len(e) == 3 else (*e, "") for e in entities]
    return pii.surrogates(materialise(spark.createDataFrame(rows, "kind string, canonical string, role string")), key).collect()


def surrogates_by_hand(entities, key=b"k"):
    """Rounds as a plain loop."""
    real, left, done, attempt = {c for _, c, _ in entities}, sorted(entities), {}, 0
    while left:
        drew = {}
        for kind, c, role in left:
            drew.setdefault(pii.surrogate(key, kind, c, role, attempt), []).append((kind, c, role))
        for value, own in drew.items():
            if value not in real and value not in done.values():
                done[min(own)[:2]] = value
        left, attempt = [e for e in left if e[:2] not in done], attempt + 1
    return done


@pytest.mark.parametrize(
    "entities",
    [
        [("email", f"{a}@{b}.com", "") for a in "bcdfghjklmnprstvz" for b in "bcdfghjklmnprstvz"],  # all of that shape
        [("ip", f"192.168.{a}.{b}", "") for a in range(1, 9) for b in range(1, 255)],
        [("secret", f"a-------{c}", "") for c in "abcdefghijklmnopqrstuvwxyz"],
        [("name", n, r) for n, r in [("anna", "given_f"), ("carver", "family"), ("анна", "given_f"), ("tom", "given_m")]],
        [("local", f"555{i:04d}", "") for i in range(0, 10_000, 3)],
        [("born", f"{y}-{m:02d}-{d:02d}", "") for y in range(1990, 1993) for m in range(1, 13) for d in range(1, 29)],
        [("phone", "+4930123456", ""), ("phone", "84951234567", ""), ("passport", "AB1234567", ""), ("street", "12 oak hill street", ""), ("ip6", "2001:db8::1:2", ""), ("ssn", "123456789", "")],
    ],
)
def test_full_and_small_spaces_end_as_a_plain_loop_does(spark, entities):
    found = drawn(spark, entities)
    assert {(r.kind, r.canonical): r.surrogate for r in found} == surrogates_by_hand(entities)
    assert len({r.surrogate for r in found}) == len(entities) and not {r.surrogate for r in found} & {c for _, c, _ in entities}


def test_drawing_ends_with_an_error_that_names_the_kinds(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_DRAWS", 1)
    with pytest.raises(RuntimeError, match="local"):
        drawn(spark, [("local", f"555{i:04d}") for i in range(0, 10_000, 3)])


@pytest.mark.parametrize("text", ["password: --------", "token: ++++++++++", "_@-.com", "version 1.2.3.4", "Order 1234567890123", "token: International"])
def test_what_only_looks_like_an_entity(spark, text):
    assert pii.find(text) == []
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.protect(docs, b"k").first().text == text


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("John Smith wrote.", ["name", "name"]),
        ("8 (495) 123-45-67", ["phone"]),
        ("fe80::1:2 is up", ["ip6"]),
        ("born on 12.03.1981, passport AB1234567", ["born", "passport"]),
        ("at 12 Oak Hill Street, in der Hauptstraße 5, 7 rue de la Paix, Calle Mayor 3, ул. Ленина, д. 5", ["street"] * 5),
        ("account no. 1234567890123", ["account"]),
        ("DE89 3704 0044 0532 0130 00 holds, DE88 3704 0044 0532 0130 00 doesn't", ["iban"]),
    ],
)
def test_more_kinds(text, kinds):
    found = pii.find(text)
    assert [k for _, _, k, _, _ in found] == kinds
    fresh = {f"{k}\x1f{c}": pii.surrogate(b"k", k, c, r) for _, _, k, c, r in found}
    out = pii.replace(text, found, fresh)
    assert out != text and [k for _, _, k, _, _ in pii.find(out) if k != "name"] == [k for k in kinds if k != "name"]


def test_a_person_is_one_over_documents(spark):
    texts = ["Dr. Anna Carver came.", "Mrs. Anna Carver left.", "Mr Anna spoke.", "Mrs Anna again."]
    out = [r.text for r in pii.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").orderBy("doc_id").collect()]
    given = {t.split()[1] for t in (out[0], out[1])} | {out[2].split()[1], out[3].split()[1]}
    assert len(given) == 1 and "Anna" not in given
    assert given.pop().lower().endswith(tuple(pii.ENDINGS["f", "latin"]))


def test_corpus_is_coreferent_and_whole(spark):
    rng = random.Random(5)
    people = [f"user{i}@mail{i % 3}.example.com" for i in range(40)]
    rows = [(i, f"Text {i % 7} by {rng.choice(people)} and {people[0]}.", "en", i) for i in range(200)]
    rows += [(500, None, "en", 1), (501, "", "en", 1), (502, "nothing here", None, 1), (None, f"no id {people[1]}", "en", 1), (7, rows[7][1], "en", 7), (503, "x " * 30_000 + people[2], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _hash long")
    out = pii.protect(docs, b"k")
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.lang), r._hash) for r in got) == sorted((str(i), str(x), h) for i, _, x, h in rows)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    found = {(k, c, r) for _, t, *_ in rows if t for _, _, k, c, r in pii.find(t)}
    known = {c: v for (_, c), v in surrogates_by_hand(sorted(found)).items()}
    for r in got:
        (before,) = texts[r.doc_id]
        want = before
        for p in people:
            want = want and want.replace(p + ".", known.get(p, p) + ".").replace(p, known.get(p, p)) if p in known else want
        assert r.text == want
    assert pii.protect(docs.limit(0), b"k").count() == 0


def test_the_key_decides(spark):
    entities = [("email", f"a{i}@b.org") for i in range(9)] + [("phone", f"+1202555{i:04d}") for i in range(9)]
    a, b, c = (sorted(map(tuple, drawn(spark, entities, key))) for key in (b"k", b"k", b"other"))
    assert a == b != c
    assert pii.session_key(spark) == pii.TEST_KEY
