"""Notations of classes: one key for all spellings, and classes as vectors that are only partly in order."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cyrillic capitals and the Latin ones that they are read as, signs read as a hyphen, and the letters that
#: stand for a digit where one is likely.
CYRILLIC, LATIN = "АВСЕНКМОРТХУІ", "ABCEHKMOPTXYI"
DASHES, DIGIT_LIKE = "‐‑‒–—−", {"O": "0", "З": "3"}
#: Letters before a digit that ends a short class.
SHORT = 3

DIMENSIONS = "array<struct<name:string,kind:string,tokens:array<string>,implies:map<string,array<string>>>>"
PART = "struct<number:double,flags:array<string>>"


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatible forms (full width, ligatures, Roman numerals as one sign) as plain ones; other texts don't leave the JVM."""
    plain = r"^[\x00-\x7FА-яЁёІі" + DASHES + "]*$"
    return F.when(text.rlike(plain), text).otherwise(_compatible(F.when(~text.rlike(plain), text)))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _rewritten(key: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """Each sign by a rule over itself and the signs before and after it (empty at the ends)."""

    def every(signs: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(signs, i), F.lit(""))
        return F.array_join(F.transform(signs, lambda c, i: rule(c, beside(i - 1), beside(i + 1))), "")

    return _let(F.filter(F.split(key, ""), lambda c: c != ""), every)


def fold_class(text: Column) -> Column:
    """Key of a class's notation, the same for all its spellings; the text is in compatible form (``nfkc``).

    Capitals without white space; dashes are hyphens, of which one between a letter and a digit goes; a comma is a point;
    look-alike letters are Latin; letters that look like digits are digits beside one, and after one to three letters
    that are the rest of the class.
    """
    digit = lambda c: c.rlike("[0-9]")

    def folded(t: Column) -> Column:
        bare = F.translate(F.regexp_replace(F.upper(t), "[\\s\u00a0\u202f]+", ""), DASHES + ",", "-" * len(DASHES) + ".")
        key = _rewritten(bare, lambda c, before, after: F.when((c == "-") & before.rlike(r"\p{L}") & digit(after), "").otherwise(c))
        key = F.translate(key, CYRILLIC, LATIN)
        for letter, number in DIGIT_LIKE.items():
            key = _rewritten(key, lambda c, before, after: F.when((c == letter) & (digit(before) | digit(after)), number).otherwise(c))  # noqa: B023
        for letter, number in DIGIT_LIKE.items():
            short = lambda k: F.when(k.rlike(rf"^\p{{L}}{{1,{SHORT}}}{letter}$"), F.concat(F.left(k, F.length(k) - 1), F.lit(number))).otherwise(k)  # noqa: B023, E731
            key = _let(key, short)
        return key

    return _let(text, folded)


def vector(dimensions: Column, value: Column) -> Column:
    """A class by the dimensions of its scale: array of struct(number, flags).

    A number is the first in the notation; a ladder's is the place of the longest of its tokens that the notation has;
    flags are the tokens it has and what these imply. What isn't found is null.
    """
    return _let(fold_class(value), lambda key: F.transform(dimensions, lambda d: _part(d, key)))


def _part(d: Column, key: Column) -> Column:
    has = lambda t: F.contains(key, fold_class(t))
    number = F.nullif(F.regexp_extract(key, r"[0-9]+(\.[0-9]+)?", 0), F.lit("")).cast("double")
    steps = F.filter(F.transform(d["tokens"], lambda t, i: F.struct(F.length(fold_class(t)).alias("n"), (-i).alias("i"), has(t).alias("has"))), lambda s: s["has"])
    step = -F.array_max(steps)["i"].cast("double")
    flags = F.filter(d["tokens"], has)
    more = F.flatten(F.transform(flags, lambda t: F.coalesce(F.element_at(d["implies"], t), F.array().cast("array<string>"))))
    every = F.array_distinct(F.concat(flags, F.coalesce(more, F.array().cast("array<string>"))))
    return F.struct(
        F.when(d["kind"] == "number", number).when(d["kind"] == "ladder", step).alias("number"), F.when(d["kind"] == "flags", every).alias("flags")
    ).cast(PART)


def known(v: Column) -> Column:
    """Whether a vector has a value in every dimension, so that it can be compared."""
    return F.forall(v, lambda x: x["number"].isNotNull() & ~F.isnan(x["number"]) | x["flags"].isNotNull())


def lost(was: Column, now: Column) -> Column:
    """In how many dimensions the second class is worse: less, a lower step, or a flag missing."""
    worse = F.zip_with(was, now, lambda a, b: F.coalesce(b["number"] < a["number"], F.lit(False)) | F.coalesce(F.size(F.array_except(a["flags"], b["flags"])) > 0, F.lit(False)))
    return F.size(F.filter(worse, lambda x: x))


def relation(was: Column, now: Column) -> Column:
    """EQUAL, WORSE, BETTER, or CROSSING where one is better here and the other there; null if either isn't known."""
    down, up = lost(was, now) > 0, lost(now, was) > 0
    return F.when(known(was) & known(now), F.when(down & up, "CROSSING").when(down, "WORSE").when(up, "BETTER").otherwise("EQUAL"))
