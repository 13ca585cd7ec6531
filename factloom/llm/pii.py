"""Surrogates for personal data: keyed, consistent in type, and distinct.

Texts are searched for personal data; each entity, in a canonical form shared by all its spellings, gets a surrogate
drawn from a keyed hash, so the same entity reads the same in every document and nobody without the key can tell which
it was. The surrogate keeps what readers and models rely on: kind, length, script, letter case, separators, country
code, check digit, and the gender of a name. Two entities never share a surrogate and none is a real entity of the
corpus, whatever their kinds: the table of all entities is checked by joins, and those that clash draw again. Later
draws may be longer, so there is always room.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed, materialise, table, text_batches

#: Where a session names its key, in hexadecimal, and what the registered queries take where it names none: a
#: published key hides nothing, it only makes test runs repeat.
KEY_SETTING, TEST_KEY = "factloom.surrogates.key", b"only for tests"
#: Draws of an entity before giving up; each after the third has ten times the room at least.
MOST_DRAWS = 60

#: Forms of address by the gender they tell.
TITLES = {
    "f": "Mrs Ms Miss Madam Madame Mme Mlle Frau Sra Srta Señora Señorita Signora госпожа г-жа".split(),
    "m": "Mr Mister Sir Monsieur Herr Señor Signor господин г-н".split(),
    "u": "Dr Prof Professor".split(),
}
#: Frequent given names by gender. They start a name that has no form of address.
GIVEN = {
    "f": (
        "Alice Amanda Amélie Angela Anna Antonia Barbara Camille Carmen Caroline Catherine Charlotte Chloé Christine Claudia "
        "Cristina Deborah Dorothy Elena Elizabeth Emily Emma Eva Francesca Gabriela Hannah Heidi Helen Helga Ingrid Isabel "
        "Jennifer Jessica Juana Julia Karen Katharina Laura Linda Lisa Louise Lucía Margaret María Marie Martha Mary Monika "
        "Nancy Natalie Nicole Olivia Patricia Petra Pilar Rachel Rebecca Renate Sabine Sandra Sarah Sofía Sophie Susan Teresa "
        "Ursula Victoria Анна Вера Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна"
    ).split(),
    "m": (
        "Alejandro Alexander Andrew Anthony Antonio Benjamin Brian Carlos Charles Christian Christopher Daniel David Diego "
        "Edward Fernando Francisco Friedrich George Günther Hans Heinrich Henry Jacques James Javier Jean John Jonathan "
        "Jorge Joseph José Juan Jürgen Kevin Klaus Laurent Louis Luis Manuel Mark Matthew Michael Miguel Nicolas Olivier "
        "Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Stefan Stephen Steven Thomas Timothy Tom Wolfgang "
        "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей"
    ).split(),
}
GENDER = {t.lower(): g for g, names in TITLES.items() for t in names}
KNOWN = {n.lower(): g for g, names in GIVEN.items() for n in names}
SPELLED = [w for t in GENDER for w in (t[:1].upper() + t[1:], t.upper())]
STARTS = [w for names in GIVEN.values() for n in names for w in (n, n.upper())]


def one_of(words: list[str]) -> str:
    """A pattern of any of the words, longest first."""
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_CAPITAL = r"\p{Lu}[\p{L}'’-]+"
_SPACE = r"[^\S\n]"
_FREE = r"(?<![\p{L}\p{N}])"
#: What a street is called, before, behind and at the end of its name.
_STREETS = (
    rf"\d{{1,5}} (?:{_CAPITAL} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?!\p{{L}})"
    rf"|\d{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:(?:de la|du|des|de) )?{_CAPITAL}"
    rf"|\p{{Lu}}\p{{Ll}}+(?:straße|strasse|gasse|platz|allee) \d{{1,4}}"
    rf"|(?:Calle|Avenida|Plaza|Paseo) (?:(?:de la|del|de) )?{_CAPITAL},? \d{{1,4}}"
    rf"|(?:ул\.|улица|проспект|пер\.) {_CAPITAL}, (?:д\. ?)?\d{{1,4}}"
)
STREET_WORDS = frozenset(
    "street st avenue ave road rd lane ln drive boulevard blvd court square rue place chemin de la du des calle avenida "
    "plaza paseo del ул. улица проспект пер. д.".split()
)
STREET_ENDS = ("straße", "strasse", "gasse", "platz", "allee")

ENTITY = regex.compile(
    r"(?P<email>(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+)"
    r"|(?i:(?P<cue>api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)[\"']?[^\S\n]*[:=][^\S\n]*[\"']?)(?P<secret>[A-Za-z0-9+/_-]{8,}={0,2})"
    r"|(?i:(?:born|birth|dob|geboren|geburtsdatum|née?|nacid[oa]|родил(?:ся|ась)|рождения)[^\d\n]{1,12})(?P<born>\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)"
    r"|(?i:(?:passport|reisepass|passeport|pasaporte|паспорт)[^\d\n]{0,12}?[^\p{L}\p{N}\n])(?P<passport>[A-Z]{0,2}\d{6,9}|\d{2} ?\d{2} \d{6})(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}])(?P<hex>(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128})(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?!\.?\d)(?!\p{L})"
    r"|(?<![\p{L}\p{N}:.])(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\p{L}\p{N}:])"
    r"|(?<![\p{L}\p{N}])(?P<phone>\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|8 ?\(\d{3}\) ?\d{3}-\d{2}-\d{2}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d(?:[ .]\d{2}){4})(?![\p{L}\p{N}]|\.\d)"
    r"|(?<![\p{L}\p{N}-])(?P<account>\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?![\p{L}\p{N}-])"
    r"|(?<![\p{L}\p{N}-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\p{L}\p{N}-])"
    r"|(?<![\p{L}\p{N}])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}-])(?P<local>\d{3}-\d{4})(?![\p{L}\p{N}-])"
    rf"|{_FREE}(?P<street>{_STREETS})(?!\p{{N}})"
    rf"|{_FREE}(?P<title>{one_of(SPELLED)})\.?{_SPACE}+(?P<name>{_CAPITAL}(?:{_SPACE}{_CAPITAL}){{0,2}})"
    rf"|{_FREE}(?P<person>(?:{one_of(STARTS)}){_SPACE}{_CAPITAL}(?:{_SPACE}{_CAPITAL})?)"
)
SECRETS = ("key", "token", "secret", "password", "passwd", "pwd")
NUMBER = re.compile(r"\d")
ADDRESSED = re.compile(rf"(?:{one_of(SPELLED + STARTS)})(?!\w)")
SIGN = re.compile(rf"[@\d]|{ADDRESSED.pattern}")
WORD = regex.compile(r"[\p{L}][\p{L}'’-]*")
DIGIT = regex.compile(r"\d")
CYRILLIC = regex.compile(r"\p{Cyrillic}")
#: What stands before a number that is an account whatever its check digit, or no address though it looks so.
ACCOUNT_CUE = regex.compile(r"(?i)(?:account|acct|card|konto|kontonummer|compte|cuenta|tarjeta|счет|счёт|карта)\W{0,3}(?:n[or°]?\W{0,2}|number\W{0,2})?$")
VERSION_CUE = regex.compile(r"(?i)(?:\bv|version|release|build|ver)\W{0,2}$")

Found = tuple[int, int, str, str, str]


def _script(text: str) -> str:
    return "cyrillic" if CYRILLIC.search(text) else "latin"


def lines_with_signs(text: str) -> Iterator[tuple[int, int]]:
    """Lines that have a digit, an @, a form of address, a given name or an assignment to a secret; no entity is without."""
    if "@" not in text and not NUMBER.search(text) and not ADDRESSED.search(text) and "=" not in text and ":" not in text:
        return
    at = 0
    for line in text.split("\n"):
        if SIGN.search(line) or (("=" in line or ":" in line) and any(w in line.lower() for w in SECRETS)):
            yield at, at + len(line)
        at += len(line) + 1


def iban_holds(number: str) -> bool:
    """Whether the check digits of an account number with country are right."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def canonical_of(m, text: str) -> tuple[str, str] | None:
    """Kind and canonical form of a match, or None for what only looks like an entity."""
    kind = next(k for k, v in m.groupdict().items() if v is not None and k not in ("title", "cue"))
    raw, before = m[kind], text[max(0, m.start() - 24) : m.start()]
    digits = "".join(DIGIT.findall(raw))
    if kind == "email":
        return (kind, raw.lower()) if any(c.isalnum() for c in raw.partition("@")[0]) else None
    if kind == "secret":
        known = digits or m["cue"].lower() in ("password", "passwd", "pwd")
        if not known or not any(c.isalnum() for c in raw):
            return None
    if kind in ("secret", "hex"):
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in raw)
        return ("hex", raw.lower()) if hexadecimal else ("secret", raw)
    if kind == "iban":
        number = raw.replace(" ", "")
        return (kind, number) if iban_holds(number) else None
    if kind == "ip":
        octets = [int(o) for o in raw.split(".")]
        real = max(octets) < 256 and octets not in ([0] * 4, [127, 0, 0, 1], [255] * 4) and not VERSION_CUE.search(before)
        return (kind, ".".join(map(str, octets))) if real else None
    if kind == "account":
        return (kind, digits) if luhn_digit(digits[:-1]) == digits[-1] or ACCOUNT_CUE.search(before) else None
    if kind == "born":
        a, b, c = (int(x) for x in re.split(r"[./-]", raw))
        year, month, day = (a, b, c) if a > 31 else (c, b, a)
        return (kind, f"{year:04d}-{month:02d}-{day:02d}") if 1 <= max(month, day) <= 31 and min(month, day) else None
    if kind == "passport":
        return kind, raw.replace(" ", "")
    if kind == "ip6":
        return (kind, raw.lower()) if digits or "::" not in raw else None
    if kind == "street":
        return kind, " ".join(raw.lower().split())
    if kind == "phone" and not 7 <= len(digits) <= 15:
        return None
    return kind, ("+" if raw[0] == "+" else "") + digits


def find(text: str) -> list[Found]:
    """(start, stop, kind, canonical form, role) of every entity, in order, not overlapping.

    The role of a name is "given_" and a gender, or "family"; other kinds have an empty one. Once an address or a given
    name has named a person, the names alone count too in the rest of the text.
    """
    out: list[Found] = []
    names: dict[str, str] = {}
    for m in chain.from_iterable(ENTITY.finditer(text, *line) for line in lines_with_signs(text)):
        group = "name" if m["name"] else "person" if m["person"] else ""
        if not group:
            if known := canonical_of(m, text):
                out.append((*m.span(next(k for k, v in m.groupdict().items() if v is not None and k not in ("title", "cue"))), *known, ""))
            continue
        told = GENDER[m["title"].lower()] if m["title"] else "u"
        parts = list(WORD.finditer(text, *m.span(group)))
        for i, part in enumerate(parts):
            name = part[0].lower()
            listed = KNOWN.get(name)
            given = i < len(parts) - 1 or len(parts) == 1 and listed
            gender = told if told != "u" else listed or KNOWN.get(parts[0][0].lower(), "u")
            names.setdefault(name, f"given_{gender}" if given else "family")
            out.append((*part.span(), "name", name, names[name]))
    if names:
        taken = {i for a, b, *_ in out for i in range(a, b)}
        for m in WORD.finditer(text):
            role = names.get(m[0].lower())
            if role and m[0][0].isupper() and m.start() not in taken and m.end() - 1 not in taken:
                out.append((*m.span(), "name", m[0].lower(), role))
        out.sort()
    return out


def gender_of(role: str) -> str:
    return role.removeprefix("given_")


class Draw:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.key, self.seed, self.counter, self.pool = key, f"{kind}\x1f{canonical}\x1f{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + self.counter.to_bytes(4, "big"), hashlib.sha256)
            self.counter += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32

    def pick(self, options):
        return options[self.below(len(options))]


LETTERS = {"latin": ("bcdfghjklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}
#: Openings of invented names, and endings by gender.
OPENINGS = {"latin": "Al Bel Cor Dan El Fer Gal Hel Jul Kar Lor Mar Nor Or Per Ros Sel Tam Val Wil".split(), "cyrillic": "Ал Бел Вар Дан Ел Зор Кар Лев Мар Ник Ол Пет Рос Сав Тим".split()}
ENDINGS = {
    ("f", "latin"): "ina ela issa etta ena iana".split(),
    ("m", "latin"): "ard eon ric in us ert".split(),
    ("u", "latin"): "is en y ian el".split(),
    ("family", "latin"): "son man ley field wood berg".split(),
    ("f", "cyrillic"): "ина ена ия ана".split(),
    ("m", "cyrillic"): "ислав ан ий ор".split(),
    ("u", "cyrillic"): "ей ин".split(),
    ("family", "cyrillic"): "енко ич ук ян".split(),
}


def _same_shape(draw: Draw, text: str) -> str:
    """Letters for letters of the script, digits for digits, the rest as it is."""
    out, vowel = [], False
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            out.append(draw.pick(LETTERS[_script(c)][vowel]))
            vowel = not vowel
        else:
            out.append(c)
    return "".join(out)


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it pass the Luhn check."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def longer(draw: Draw, attempt: int, signs: str) -> str:
    """More signs for the attempts after the third, one for each."""
    return "".join(draw.pick(signs) for _ in range(attempt - 3))


def invented(draw: Draw, role: str, script: str, attempt: int) -> str:
    """A name; a later attempt has a longer one."""
    middle = "".join(draw.pick(LETTERS[script][i % 2]) for i in range(2 * (attempt + 1)))
    return (draw.pick(OPENINGS[script]) + middle + draw.pick(ENDINGS[role, script])).lower()


def _street(draw: Draw, canonical: str, attempt: int) -> str:
    out = []
    for word in canonical.split(" "):
        bare = word.strip(",")
        end = next((e for e in STREET_ENDS if bare.endswith(e)), "")
        if bare in STREET_WORDS:
            fresh = bare
        elif number := DIGIT.findall(bare):
            fresh = bare.rstrip("0123456789") + str(1 + draw.below(9)) + "".join(str(draw.below(10)) for _ in number[1:])
        else:
            fresh = invented(draw, "family", _script(bare), attempt) + end
        out.append(fresh + word[len(bare) :])
    return " ".join(out)


def surrogate(key: bytes, kind: str, canonical: str, role: str = "", attempt: int = 0) -> str:
    """The attempt's surrogate of an entity, in canonical form. Every kind has ever more room from the fourth attempt on."""
    draw = Draw(key, kind, canonical, attempt)
    digits, small = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    number = lambda n: "".join(draw.pick(digits) for _ in range(n))
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        fresh = _same_shape(draw, local) + longer(draw, attempt, small)
        return f"{fresh}@{'.'.join(_same_shape(draw, x) for x in labels[:-1])}.{labels[-1]}"
    if kind == "hex":
        return "".join(draw.pick("0123456789abcdef") for _ in canonical) + longer(draw, attempt, "0123456789abcdef")
    if kind in ("secret", "passport"):
        fresh = [draw.pick(digits) if c.isdigit() else draw.pick(small) if c.islower() else draw.pick(small.upper()) if c.isupper() else c for c in canonical]
        return "".join(fresh) + longer(draw, attempt, digits if kind == "passport" else small)
    if kind == "ip":
        a, b, *_ = octets = canonical.split(".")
        kept = 1 if a == "10" else 2 if (a, b) == ("192", "168") or a == "172" and 16 <= int(b) < 32 else 0
        if attempt > 5:  # addresses of four bytes may all be taken
            return "2001:db8:" + ":".join(f"{draw.below(65535) + 1:x}" for _ in range(6))
        if attempt > 3 and kept:
            kept, octets = 1, ["10"]
        fresh = [str(draw.pick([n for n in range(1, 224) if n not in (10, 127, 172, 192)]))] if not kept else []
        return ".".join([*octets[:kept], *fresh, *(str(1 + draw.below(254)) for _ in range(4 - kept - len(fresh)))])
    if kind == "ip6":
        groups = [g if i < 1 or not g else f"{draw.below(65535) + 1:x}" for i, g in enumerate(canonical.split(":"))]
        return ":".join(groups) if attempt <= 3 else "2001:db8:" + ":".join(f"{draw.below(65535) + 1:x}" for _ in range(6))
    if kind == "born":
        year = 1930 + draw.below(80) if attempt < 3 else 1000 + draw.below(9000)
        return f"{year:04d}-{1 + draw.below(12):02d}-{1 + draw.below(28):02d}"
    if kind == "street":
        return _street(draw, canonical, attempt)
    if kind == "phone":
        plus, own = canonical[0] == "+", canonical.lstrip("+")
        country = (1 if own[0] in "17" else 2) if plus else 1 if own[0] in "08" else 0
        rest = own[country:]
        fresh = number(len(rest))
        if rest[3:6] == "555" and attempt < 3:  # numbers kept free for fiction
            fresh = fresh[:3] + "555" + fresh[6:]
        return "+" * plus + own[:country] + fresh + longer(draw, attempt, digits)
    if kind == "ssn":
        return number(9) + longer(draw, attempt, digits)
    if kind == "iban":
        letters = small.upper()
        body = "".join(draw.pick(digits) if c.isdigit() else draw.pick(letters) for c in canonical[4:]) + longer(draw, attempt, digits)
        value = int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00"))
        return f"{canonical[:2]}{98 - value % 97:02d}{body}"
    if kind == "local":
        return (canonical[:3] + number(4) if canonical[:3] == "555" and attempt < 3 else number(7)) + longer(draw, attempt, digits)
    if kind == "account":
        body = canonical[0] + number(len(canonical) - 2) + longer(draw, attempt, digits)
        return body + (luhn_digit(body) if luhn_digit(canonical[:-1]) == canonical[-1] else number(1))
    return invented(draw, gender_of(role or "family"), _script(canonical), attempt)


def dressed(raw: str, kind: str, fresh: str) -> str:
    """A canonical surrogate in the spelling of the original: its separators and letter case."""
    if kind in ("phone", "account", "local", "ssn", "passport"):
        signs = iter(fresh.lstrip("+"))
        spelled = "".join(next(signs) if c.isalnum() else c for c in raw)
        return spelled + "".join(signs)
    if kind == "born":
        year, month, day = fresh.split("-")
        sign = next(c for c in raw if not c.isdigit())
        return fresh if sign == "-" else sign.join((day, month, year))
    if kind == "iban":
        signs = iter(fresh)
        return "".join(c if c == " " else next(signs) for c in raw) + "".join(signs)
    if kind == "secret":
        return fresh
    if kind == "street":
        return " ".join(f.capitalize() if r[:1].isupper() else f for r, f in zip(raw.split(), fresh.split()))
    if raw.isupper():
        return fresh.upper()
    if kind in ("email", "hex", "ip6") and len(raw) == len(fresh):
        return "".join(f.upper() if r.isupper() else f for r, f in zip(raw, fresh))
    return fresh[:1].upper() + fresh[1:] if raw[:1].isupper() else fresh


def replace(text: str, found: list[Found], fresh: dict[str, str]) -> str:
    out, at = [], 0
    for start, stop, kind, canonical, _ in found:
        out += [text[at:start], dressed(text[start:stop], kind, fresh[f"{kind}\x1f{canonical}"])]
        at = stop
    return "".join([*out, text[at:]])


def entities(lists: DataFrame, column: str) -> DataFrame:
    """Distinct (kind, canonical, role) of rows that list theirs as kind, canonical form and role.

    Documents may disagree on what a name is: it is what most of them say, of unknown gender if as many say either.
    """
    parts = F.split(F.col("entity"), "\x1f", 3)
    told = lists.select(F.explode(column).alias("entity")).select(parts[0].alias("kind"), parts[1].alias("canonical"), parts[2].alias("role"))
    says = lambda *roles: F.count_if(F.col("role").isin(*roles))
    votes = told.groupBy("kind", "canonical").agg(
        says("family").alias("family"), says("given_f", "given_m", "given_u").alias("given"), says("given_f").alias("f"), says("given_m").alias("m")
    )
    gender = F.when(F.col("f") > F.col("m"), "given_f").when(F.col("m") > F.col("f"), "given_m").otherwise("given_u")
    role = F.when(F.col("kind") != "name", "").when(F.col("family") > F.col("given"), "family").otherwise(gender)
    return votes.select("kind", "canonical", role.alias("role"))


def surrogates(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, surrogate) of materialised entities (kind, canonical, role): one to one, away from all real ones.

    Each round the entities still open draw; of those that drew alike the smallest keeps its draw, unless it is taken
    or real. The rest draw again with the next attempt, until none is left. The room grows tenfold with each attempt
    after the third, so few rounds suffice for any corpus; should MOST_DRAWS not, that is an error which names the kinds.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            drawn = [surrogate(key, *r.values()) for r in batch.to_pylist()]
            yield batch.append_column("surrogate", pa.array(drawn, pa.string()))

    done, left = None, known
    real = known.select(F.col("canonical").alias("surrogate")).distinct()
    for attempt in range(MOST_DRAWS):
        drawn = checkpointed(
            left.select("kind", "canonical", "role", F.lit(attempt).alias("attempt"))
            .mapInArrow(batches, "kind string, canonical string, role string, attempt int, surrogate string")
            .drop("attempt")
        )
        free = drawn.join(real, "surrogate", "left_anti")
        if done is not None:
            free = free.join(done, "surrogate", "left_anti")
        won = free.groupBy("surrogate").agg(F.min(F.struct("kind", "canonical")).alias("entity"))
        won = checkpointed(won.select("entity.kind", "entity.canonical", "surrogate"))
        done = won if done is None else done.unionAll(won)
        left = checkpointed(drawn.join(won, ["kind", "canonical"], "left_anti").drop("surrogate"))
        if left.isEmpty():
            return materialise(done)
    open_kinds = {r["kind"]: r["count"] for r in left.groupBy("kind").count().collect()}
    raise RuntimeError(f"no free surrogate after {MOST_DRAWS} draws for so many entities: {open_kinds}")


def protect(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows with their own columns, every entity in ``text`` replaced under the caller's key.

    Null texts stay null, texts without entities as they are; repeated rows stay and read alike; a text may be of any
    length, and signs that only stand for a secret (``password: --------``) are none. Texts without entities aren't
    written or shuffled before the end. The others are written once, with what was found and where, and meet their own
    few surrogates by a join on the row, after those were joined to entities: no table of surrogates is gathered
    anywhere.
    """
    at, columns = docs.columns.index("text"), docs.columns
    mark = "_"
    while any(c.startswith(mark) for c in columns):
        mark += "_"
    found_as, fresh_as, keys = f"{mark}found", f"{mark}fresh", [f"{mark}id", f"{mark}hash"]
    key_of_row = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(keys[0]), F.xxhash64("text").alias(keys[1])]
    span = T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("stop", T.IntegerType()), ("entity", T.StringType()))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("entity", pa.string())]))

    def plain(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array([not (t and find(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [[{"start": a, "stop": b, "entity": "\x1f".join(e)} for a, b, *e in find(t)] if t else [] for t in batch.column(at).to_pylist()]
            batch = batch.append_column(found_as, pa.array(found, arrow))
            yield batch.filter(pa.array([bool(f) for f in found], pa.bool_()))

    def replaced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, spans, fresh = (batch.column(i).to_pylist() for i in (at, len(columns), len(columns) + 1))
            found = [[(s["start"], s["stop"], *s["entity"].split("\x1f")) for s in own] for own in spans]
            texts = [replace(t, f, dict(m)) for t, f, m in zip(texts, found, fresh)]
            batch = batch.drop_columns([found_as, fresh_as])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    text_batches(docs.sparkSession)
    marked = materialise(docs.mapInArrow(listed, T.StructType([*docs.schema.fields, T.StructField(found_as, T.ArrayType(span))])))
    told = marked.select(*key_of_row, F.array_distinct(F.col(f"{found_as}.entity")).alias("listed"))
    fresh = surrogates(materialise(entities(told, "listed")), key)
    uses = told.select(*keys, F.explode("listed").alias("entity")).select(*keys, F.regexp_extract("entity", "(?s)^([^\x1f]*\x1f[^\x1f]*)", 1).alias("entity")).distinct()
    names = fresh.select(F.concat_ws("\x1f", "kind", "canonical").alias("entity"), "surrogate")
    own = uses.join(names, "entity").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(fresh_as))
    held = marked.select(*columns, found_as, *key_of_row).join(own, keys).select(*columns, found_as, fresh_as)
    return docs.mapInArrow(plain, docs.schema).unionAll(held.mapInArrow(replaced, docs.schema))


def session_key(spark) -> bytes:
    """The key that the session names, or the one for tests."""
    named = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(named) if named else TEST_KEY


def op4_surrogates(spark, sf_dir):
    return protect(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
