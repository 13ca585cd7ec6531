"""Text functions over columns: folding, numbers, units, identifiers, similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Capital letters that look alike in the two alphabets.
LATIN_TWINS, CYRILLIC_TWINS = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    """Lower case, ё as е, punctuation as spaces."""
    lowered = F.translate(F.lower(text), "ё", "е")
    return collapse(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "))


def to_latin_code(text: Column) -> Column:
    """Key of a document code: capitals, look-alike Cyrillic letters as Latin, no spaces."""
    return F.regexp_replace(F.translate(F.upper(text), CYRILLIC_TWINS, LATIN_TWINS), r"\s+", "")


def to_cyrillic_key(text: Column) -> Column:
    """Key of a table row: folded with look-alike Latin letters as Cyrillic."""
    return fold(F.translate(text, LATIN_TWINS, CYRILLIC_TWINS))


#: A number whose digits may be parted by spaces in groups of three, with a decimal comma or point.
PARTING = "[ \u00a0\u202f]"
AMOUNT = rf"-?\d+(?:{PARTING}\d{{3}}(?!\d))*(?:[.,]\d+)?"


def plain_number(amount: Column) -> Column:
    """The value of a text that is such a number; null for another."""
    return F.translate(F.regexp_replace(amount, PARTING, ""), ",", ".").try_cast("double")


def parse_number(text: Column) -> Column:
    """The first number of a text: thousands grouped by spaces, decimal comma or point; null without one."""
    return plain_number(F.nullif(F.regexp_extract(text, AMOUNT, 0), F.lit("")))


def format_number(value: Column, digits: int = 2) -> Column:
    """At most so many decimals, halves up, decimal comma, no trailing zeros."""
    k = 10**digits
    text = F.format_string(f"%.{digits}f", F.floor(value * k + 0.5) / k)
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), ".", ",")


#: Spellings of units, their canonical names and factors to the base unit.
UNITS = {"mm": ("mm", 0.001), "cm": ("cm", 0.01), "m": ("m", 1.0), "km": ("km", 1000.0), "kg": ("kg", 1.0), "t": ("t", 1000.0), "g": ("g", 0.001), "h": ("h", 1.0), "d": ("d", 24.0)}


def unit_factor(unit: Column) -> Column:
    """Factor of a unit to the base of its dimension; null for an unknown one."""
    pairs = [F.lit(x) for name, (_, factor) in UNITS.items() for x in (name, factor)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_replace(unit, r"[\s.]", "")))


def words(text: Column, least: int = 1) -> Column:
    """Folded words of at least so many letters."""
    return F.filter(F.split(fold(text), " "), lambda w: F.length(w) >= least)


def stem(word: Column) -> Column:
    """Words of five letters or more without their usual endings."""
    return F.when(F.length(word) >= 5, F.regexp_replace(word, r"(ing|ed|es|s|ами|ов|ый|ая|ое|ы|и|а)$", "")).otherwise(word)


def jaccard(a: Column, b: Column) -> Column:
    """Share of shared items among all; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap_of_shorter(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def replaced(text: Column, pattern: str, how: Callable[[Column], Column]) -> Column:
    """The text with how(match) in place of every match of a pattern."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, F.transform(found, how), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


#: What parts the words around an address, and what a host is made of.
MAIL_BREAK, HOST = r"\s,;:<>()\[\]\"@", r"[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+"


def mask_mail(text: Column) -> Column:
    """Of the word before an at sign, if a host follows it, the first sign stays."""
    parts = F.split(text, "@")
    name = lambda part: F.regexp_extract(part, f"[^{MAIL_BREAK}]+$", 0)
    hidden = lambda part: F.concat(F.left(part, F.length(part) - F.length(name(part)) + 1), F.lit("***"))
    mask = lambda part, i: F.when((name(part) != "") & F.coalesce(F.get(parts, i + 1).rlike(f"^{HOST}"), F.lit(False)), hidden(part)).otherwise(part)
    return F.array_join(F.transform(parts, mask), "@")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mask_phone(text: Column) -> Column:
    """Eleven digits, however grouped, of which the first is 8, or 7 after a plus: the last two stay."""
    ten_more = r"(?:[\s()-]{0,2}[0-9]){10}"
    return replaced(text, rf"(?<![\p{{L}}\p{{N}}_+])(?:8|\+7){ten_more}(?![\p{{L}}\p{{N}}_])", lambda m: F.concat(F.lit("+7***-**-"), F.right(_digits(m), F.lit(2))))


def mask_insurance(text: Column) -> Column:
    """Digits joined by hyphens, with two more after a space or not, in the form 999-999-999 99: the last two stay."""
    form = lambda m: F.regexp_replace(F.regexp_replace(m, "[0-9]", "9"), r"\s", " ")
    hide = lambda m: F.when(form(m).isin("999-999-999 99", "999-999-999-99"), F.concat(F.lit("***-***-*** "), F.right(m, F.lit(2)))).otherwise(m)
    return replaced(text, r"[0-9]+(?:-[0-9]+)+(?:\s[0-9]{2}(?![0-9-]))?", hide)


def mask_text(text: Column) -> Column:
    return mask_mail(mask_phone(mask_insurance(text)))


def _bytes_of_v6(address: Column) -> Column:
    """Sixteen bytes in hexadecimal; null for what is no such address. Two colons stand for the zeros that are missing."""
    wide = lambda side: F.array_join(F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")
    sound = address.rlike("^[0-9A-Fa-f:]+$") & ~address.rlike(":::|[0-9A-Fa-f]{5}|^:[^:]|[^:]:$") & (F.size(F.split(address, "::")) <= 2)
    before, after = wide(F.substring_index(address, "::", 1)), F.when(address.contains("::"), wide(F.substring_index(address, "::", -1))).otherwise("")
    room = 32 - F.length(before) - F.length(after)
    whole = F.concat(before, F.repeat(F.lit("0"), F.greatest(room, F.lit(0))), after)
    return F.when(sound & F.when(address.contains("::"), room >= 4).otherwise(room == 0), F.lower(whole))


def mask_ip(address: Column) -> Column:
    """An address without what tells hosts of a network apart: its last byte of four, ten of its sixteen; stars for others.

    Four bytes may also be written within sixteen, after ::ffff: in any case.
    """
    a = F.trim(address)
    inner = F.when(F.lower(F.left(a, F.lit(7))) == "::ffff:", F.substr(a, F.lit(8))).otherwise(a)
    parts = F.split(inner, r"\.")
    is_byte = lambda p: p.rlike("^[0-9]{1,3}$") & F.coalesce(p.try_cast("int") <= 255, F.lit(False))
    four = (F.size(parts) == 4) & F.forall(parts, is_byte)
    kept = F.concat(F.left(a, F.length(a) - F.length(inner)), F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0"))
    network = _bytes_of_v6(a)
    groups = [F.lower(F.conv(F.substring(network, at, 4), 16, 16)) for at in (1, 5, 9)]
    return F.when(address == "", "").when(four, kept).when(address.isNotNull(), F.coalesce(F.concat(F.concat_ws(":", *groups), F.when(network.isNotNull(), "::/48")), F.lit("***")))


#: Fields of a record that tell who someone is, and those that hold an address; both are a caller's to choose.
PERSONAL = ("address", "author", "birth_date", "contact", "email", "first_name", "full_name", "last_name", "login", "name", "passport", "phone", "signer", "tax_number")
NETWORK = ("host", "ip", "ip_address", "remote_addr")


def mask_field(key: Column, value: Column, personal: Iterable[str] = PERSONAL, network: Iterable[str] = NETWORK) -> Column:
    """A field of a record by its name: who someone is goes whole, addresses and texts as above."""
    low = F.lower(key)
    return F.when(value.isNull(), value).when(low.isin(*network), mask_ip(value)).when(low.isin(*personal), "***").otherwise(mask_text(value))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed form of letters with marks; texts of ASCII alone don't leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _composed(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _edits(a: list, b: list) -> int:
    """Levenshtein distance of two sequences by bits: a bit of a whole number for each word of the first."""
    places, last, full = {}, 1 << len(a) >> 1, (1 << len(a)) - 1
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    if not a:
        return len(b)
    more, less, score = full, 0, len(a)
    for word in b:
        equal = places.get(word, 0)
        across = equal | less
        equal |= (((equal & more) + more) ^ more)
        up, down = less | (full & ~(equal | more)), more & equal
        score += 1 if up & last else -1 if down & last else 0
        up, down = (up << 1 | 1) & full, (down << 1) & full
        more, less = down | (full & ~(across | up)), up & across
    return score


@F.arrow_udf(T.IntegerType())
def word_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edits of whole words that turn one array of words into the other; words that are null don't count."""
    found = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        found.append(None if x is None or y is None else _edits([w for w in x if w is not None], [w for w in y if w is not None]))
    return pa.array(found, pa.int32())


def iso_date(text: Column) -> Column:
    """First day.month.year or year-month-day date of a text as an ISO date; null if it is no date."""
    dotted = F.regexp_extract(text, r"\b(\d{2})\.(\d{2})\.(\d{4})\b", 0)
    plain = F.regexp_extract(text, r"\b\d{4}-\d{2}-\d{2}\b", 0)
    found = F.when(dotted != "", F.try_to_date(dotted, "dd.MM.yyyy")).when(plain != "", F.try_to_date(plain, "yyyy-MM-dd"))
    return F.date_format(found, "yyyy-MM-dd")


def document_type(text: Column) -> Column:
    """Kind of a document by the first pattern it has."""
    low = F.lower(text)
    return (
        F.when(low.rlike("licen[cs]e"), "LICENSE").when(low.rlike(r"token\s*="), "SECRET").when(low.rlike(r"\S+@\S+\.\S+"), "CONTACT")
        .when(low.rlike(r" \| "), "TABLE").otherwise("PROSE")
    )


def deletions(text: Column, most: int) -> Column:
    """The distinct forms of a text that so many deletions or fewer leave; texts within that many edits share one."""
    forms = F.array(text)
    for _ in range(most):
        one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, one))))
    return forms
