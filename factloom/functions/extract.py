"""Mentions in text: quantities, counts, classes, presence, directions and layers, as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import AMOUNT, plain_number

NUMBER = f"({AMOUNT})"


def quantities(text: Column, units: list[str]) -> Column:
    """Numbers followed by one of the units, with what stands before: at least, at most, about or nothing."""
    alternatives = "|".join(sorted(units, key=len, reverse=True))
    pattern = rf"(?:(at least|not less than|at most|not more than|about)\s+)?{NUMBER}\s*({alternatives})(?![\p{{L}}\d])"
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))

    def read(m: Column) -> Column:
        word = F.regexp_extract(m, pattern, 1)
        qualifier = F.when(word.isin("at least", "not less than"), "MIN").when(word.isin("at most", "not more than"), "MAX").when(word == "about", "ABOUT")
        return F.struct(plain_number(F.regexp_extract(m, pattern, 2)).alias("num"), F.regexp_extract(m, pattern, 3).alias("unit"), qualifier.alias("qualifier"), m.alias("raw"))

    return F.transform(found, read)


def counts(text: Column, nouns: list[str]) -> Column:
    """Whole numbers of things: "3 exits", "exits: 3" and "exits - 3"."""
    names = "|".join(nouns)
    pattern = rf"\b(\d+)\s+({names})\b|\b({names})\s*[:–-]\s*(\d+)\b"
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    pick = lambda m, a, b: F.coalesce(F.nullif(F.regexp_extract(m, pattern, a), F.lit("")), F.nullif(F.regexp_extract(m, pattern, b), F.lit("")))
    return F.transform(found, lambda m: F.struct(pick(m, 2, 3).alias("item"), pick(m, 1, 4).cast("long").alias("n")))


def classes(text: Column, scale: list[str]) -> Column:
    """Members of an ordinal scale named in the text, look-alike letters and digits read as meant."""
    folded = F.translate(F.upper(text), "АВЕКМНОРСТХ", "ABEKMHOPCTX")
    pattern = rf"(?<![\p{{L}}\d])({'|'.join(sorted(scale, key=len, reverse=True))})(?![\p{{L}}\d])"
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(pattern), F.lit(1)))


def presence(text: Column, item: str) -> Column:
    """PRESENT, ABSENT, MIXED or SILENT: what the text says of an item."""
    low = F.lower(text)
    absent = low.rlike(rf"(?:no|without|not provided:?)\s+(?:\w+\s+)?{item}")
    present = F.regexp_replace(low, rf"(?:no|without|not provided:?)\s+(?:\w+\s+)?{item}", "").contains(item)
    return F.when(present & absent, "MIXED").when(present, "PRESENT").when(absent, "ABSENT").otherwise("SILENT")


def direction(text: Column) -> Column:
    """Which way a door opens."""
    low = F.lower(text)
    return F.when(low.contains("sliding"), "SLIDING").when(low.rlike("outward|to the outside"), "OUT").when(low.rlike("inward|to the inside"), "IN")


def layers(text: Column) -> Column:
    """Layers of a build-up, "material - 120 mm; ..." from the top down."""
    pattern = rf"([\p{{L}} ]+?)\s*[–-]\s*{NUMBER}\s*mm"
    return F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)),
        lambda m: F.struct(F.trim(F.regexp_extract(m, pattern, 1)).alias("m"), plain_number(F.regexp_extract(m, pattern, 2)).alias("t")),
    )
