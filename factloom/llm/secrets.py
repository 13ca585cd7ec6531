"""Secret scans by sliding-window entropy, in column expressions alone: no shuffle and no Python.

Three fixed kinds are found by pattern. Beside them every candidate string, a run of the characters of one class, is
read through a window that moves one character at a time. A window's Shannon entropy is log2(w) - sum(c log2 c) / w over
the counts c of its characters, so a step changes two terms of the sum only, that of the character that leaves and that
of the one that enters. The terms are whole numbers (``SCALE`` to a bit), which makes sums exact and independent of the
way they were reached. Windows above the class's bound are joined where they overlap; what an allow-list knows to be
harmless is left out. A secret that a fixed kind finds too is listed under both kinds.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, table

#: Whole numbers to a bit of entropy.
SCALE = 1 << 20

#: The kinds found by pattern, in the order of their listing, with what counts of a match: a group of the
#: pattern and its least number of characters.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Patterns that find the same in less time: the first letters tell where a key can begin, and of runs those too short
#: to count aren't matched at all.
QUICK = {"assign": f"(?=[PpSsTtAa]){BASE['assign'][0]}", "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``characters``; a window of ``window`` of them is hot from ``bits`` of entropy on."""

    characters: str
    pattern: str
    window: int
    bits: float
    folded: bool = False

    @property
    def most_sum(self) -> int:
        """The largest scaled sum of c log2 c that a hot window may have."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * SCALE)

    @property
    def candidate(self) -> str:
        return f"(?<![{self.pattern}])[{self.pattern}]{{{self.window},}}"


#: Random characters of each class have about 3.3 and 4.0 bits in such windows; words run together have less.
CLASSES = {
    "entropy_hex": CharacterClass(string.digits + "abcdef", "0-9A-Fa-f", 16, 2.9, folded=True),
    "entropy_base64": CharacterClass(string.ascii_letters + string.digits + "+/_=-", "A-Za-z0-9+/_=-", 20, 3.75),
}
#: Patterns of harmless text: a hot span whose candidate holds one of them is left out.
ALLOWED = (
    r"^[0-9]+$",  # numbers of cards, accounts, phones
    r"^[0-9]+([-/_][0-9]+)+$",  # dates, ranges
    r"^[A-Za-z]+([-/_+=][A-Za-z]+)*[-/_+=]*$",  # words, joined or in a path
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # identifiers that are no secret
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",  # rows of the alphabet and of keys
    r"(?i)^d41d8cd98f00b204e9800998ecf8427e$|^da39a3ee5e6b4b0d3255bfef95601890afd80709$"
    r"|^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",  # digests of nothing
)
#: Elements folded into one list before lists are joined, which keeps running sums of long lists from growing quadratic.
BLOCK = 256
SPAN = "array<struct<kind:string,start:int,stop:int,text:string>>"


def terms(window: int) -> list[int]:
    """c log2 c for every count c of a window, scaled."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, where lambdas would compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def _blocks(values: Column) -> Column:
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))


def _running(sizes: Column) -> Column:
    """For each element the sum of those before it."""

    def before(values: Column) -> Column:
        grown = F.aggregate(
            values,
            F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("seen")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["seen"], F.array(acc["sum"])).alias("seen")),
        )
        return grown["seen"]

    cut = lambda v: F.transform(_blocks(v), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda v: F.aggregate(v, F.lit(0), lambda acc, x: acc + x)
    joined = lambda parts: F.flatten(
        F.zip_with(parts, before(F.transform(parts, total)), lambda part, start: F.transform(before(part), lambda x: x + start))
    )
    return _let(sizes, lambda v: _let(cut(v), joined))


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, with their places in code points: array of (start, stop, text)."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        sizes = F.transform(found, F.char_length)
        offset = lambda gaps: F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)), F.concat(F.slice(F.concat(F.array(F.lit(0)), sizes), F.lit(1), F.size(found))), lambda a, b: a + b
        )
        starts = _let(gaps, lambda g: _let(offset(g), lambda steps: F.zip_with(_running(steps), steps, lambda a, b: a + b)))
        return F.zip_with(starts, found, lambda s, t: F.struct(s.alias("start"), (s + F.char_length(t)).alias("stop"), t.alias("text")))

    empty = F.array().cast("array<struct<start:int,stop:int,text:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), _let(found, placed)).otherwise(empty)


def fixed_spans(text: Column, kind: str) -> Column:
    """The matches of a fixed kind that are long enough."""
    pattern, group, least = BASE[kind]
    enough = lambda m: F.char_length(F.regexp_extract(m["text"], pattern, group)) >= least
    return _kind(F.filter(located(text, QUICK[kind]), enough), kind)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["stop"], m["text"])).cast(SPAN)


def hot_windows(candidate: Column, start: Column, c: CharacterClass) -> Column:
    """Joined windows of a candidate whose entropy reaches the class's bound: array of (start, stop).

    One pass: the state has the counts of the window's characters, the sum of their terms, the span that may still grow
    and the spans before it.
    """
    size, table_of = len(c.characters), terms(c.window)
    term = lambda n: F.get(F.lit(table_of), n)
    codes = F.transform(F.split(F.lower(candidate) if c.folded else candidate, ""), lambda x: F.position(x, F.lit(c.characters)) - 1)

    def steps(codes: Column) -> Column:
        left = F.concat(F.array_repeat(F.lit(-1), c.window), codes)
        return F.zip_with(codes, F.slice(left, F.lit(1), F.size(codes)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))

    spans = "array<struct<start:int,stop:int>>"
    state = f"struct<counts:array<int>,sum:bigint,at:int,low:int,high:int,done:{spans}>"
    nothing = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"),
        F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.array().cast(spans).alias("done"),
    ).cast(state)

    def moved(acc: Column, step: Column) -> Column:
        n_out = F.coalesce(F.get(acc["counts"], step["leaves"]), F.lit(0))
        same = step["leaves"] == step["enters"]
        n_in = F.get(acc["counts"], step["enters"])
        grown = F.when(same, acc["sum"]).otherwise(
            acc["sum"] + F.when(n_out > 0, term(n_out - 1) - term(n_out)).otherwise(0) + term(n_in + 1) - term(n_in)
        )
        counts = F.transform(
            acc["counts"], lambda n, i: n + (i == step["enters"]).cast("int") - (i == step["leaves"]).cast("int")
        )
        stop = acc["at"] + 1
        hot = (stop >= c.window) & (grown <= c.most_sum)
        begins = stop - c.window
        apart = hot & (begins > acc["high"])
        closed = F.when(apart & (acc["low"] >= 0), F.concat(acc["done"], F.array(F.struct(acc["low"].alias("start"), acc["high"].alias("stop")))))
        return F.struct(
            counts.alias("counts"), grown.cast("long").alias("sum"), stop.alias("at"),
            F.when(apart, begins).otherwise(acc["low"]).alias("low"), F.when(hot, stop).otherwise(acc["high"]).alias("high"),
            closed.otherwise(acc["done"]).alias("done"),
        ).cast(state)

    def ended(acc: Column) -> Column:
        last = F.array(F.struct(acc["low"].alias("start"), acc["high"].alias("stop")))
        return F.when(acc["low"] >= 0, F.concat(acc["done"], last)).otherwise(F.array().cast(spans))

    found = _let(codes, lambda v: F.aggregate(steps(v), nothing, moved, ended))
    return F.transform(found, lambda s: F.struct(
        (start + s["start"]).alias("start"), (start + s["stop"]).alias("stop"), F.lit("").alias("text")
    ))


def entropy_spans(text: Column, kind: str, allowed: tuple[str, ...]) -> Column:
    """Hot spans of all candidates of a class that the allow-list doesn't know."""
    c = CLASSES[kind]
    harmless = lambda m: F.coalesce(*[F.when(F.rlike(m["text"], F.lit(p)), True) for p in allowed], F.lit(False))
    candidates = F.filter(located(text, c.candidate), lambda m: ~harmless(m))
    return _kind(F.flatten(F.transform(candidates, lambda m: hot_windows(m["text"], m["start"], c))), kind)


def _listed(spans: Column) -> Column:
    """kind:start:stop of spans by start, then by the order of kinds, joined by commas."""
    order = {k: i for i, k in enumerate([*BASE, *CLASSES])}
    rank = lambda s: F.coalesce(*[F.when(s["kind"] == k, i) for k, i in order.items()])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Add ``secret_spans``, an array of (kind, start, stop, text) with places in code points and ends exclusive.

    The fixed kinds come first, then the hot spans. Null and empty texts have none, texts may
    be of any length, and every row stays with its other columns; a column named secret_spans is replaced. ``allowed``
    are patterns of candidates that are no secrets.
    """
    body = clean_text(text)
    hot = [entropy_spans(body, k, allowed) for k in CLASSES]
    return docs.withColumn("secret_spans", F.concat(*[fixed_spans(body, k) for k in BASE], *hot))


def op13_secrets(spark, sf_dir):
    """Every row's secrets by kind; see scan for nulls, empty and very long texts. Repeated rows stay."""
    found = scan(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    n = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_entropy"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan in DuckDB SQL; each window is counted anew."""
    wanted = [(k, *v) for k, v in BASE.items()] + [(k, f"[{c.pattern}]{{{c.window},}}", 0, c.window) for k, c in CLASSES.items()]
    matches = " union all ".join(
        f"select r, {i} as rank, '{kind}' as kind, {least} as least, {f'regexp_extract(found, {_quoted(p)}, {group})' if group else 'found'} as held, found, stop - length(found) as start, stop "
        f"from (select r, found, sum(length(gap) + length(found)) over (partition by r order by i) as stop from "
        f"(select r, unnest(range(len(f))) as i, unnest(f) as found, unnest(g[:len(f)]) as gap from "
        f"(select r, regexp_extract_all(text, {_quoted(p)}, 0) as f, string_split_regex(text, {_quoted(p)}) as g from d)))"
        for i, (kind, p, group, least) in enumerate(wanted)
    )
    harmless = " or ".join(f"regexp_matches(found, {_quoted(p)})" for p in ALLOWED)
    bounds = ", ".join(f"('{k}', {c.window}, {c.most_sum}, {str(c.folded).lower()})" for k, c in CLASSES.items())
    longest = max(c.window for c in CLASSES.values())
    values = ", ".join(f"({n}, {t})" for n, t in enumerate(terms(longest)))
    listed = "string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank)"
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    b(kind, w, most, folded) as (values {bounds}), t(n, term) as (values {values}),
    m as (select * from ({matches}) where length(held) >= least),
    c as (select row_number() over () as k, m.*, w, most, case when folded then lower(found) else found end as x
          from m join b using (kind) where not ({harmless})),
    p as (select k, r, rank, kind, start, w, most, x, unnest(range(length(x) - w + 1)) as pos from c),
    l as (select k, r, rank, kind, start, w, most, pos, unnest(string_split(x[pos + 1:pos + w], '')) as letter from p),
    n as (select k, r, rank, kind, start, w, most, pos, letter, count(*) as n from l group by all),
    h as (select k, r, rank, kind, start, w, pos from n join t using (n) group by all having sum(term) <= any_value(most)),
    a as (select *, case when pos - lag(pos) over (partition by k order by pos) <= w then 0 else 1 end as apart from h),
    i as (select *, sum(apart) over (partition by k order by pos) as island from a),
    s as (select r, rank, kind, start + min(pos) as start, start + max(pos) + w as stop from i group by k, r, rank, kind, start, w, island
          union all select r, rank, kind, start, stop from m where kind in ({base})),
    g as (select r, {counts}, {listed} filter (where kind in ({base})) as listed, {listed} as spans,
                 count(*) filter (where kind not in ({base})) as n_entropy from (select r, rank, kind, start::bigint as start, stop::bigint as stop from s) group by r)
    select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(listed, '')) as base_sha256,
           coalesce(spans, '') as spans, coalesce(n_entropy, 0)::bigint as n_entropy
    from d left join g using (r)
    """
