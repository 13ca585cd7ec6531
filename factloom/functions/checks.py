"""Small predicates and conversions over columns: what counts, what is asked for, how fields of a kind are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import AMOUNT, CYRILLIC_TWINS, LATIN_TWINS, UNITS, collapse, plain_number

#: A source that isn't asked for, types of documents that are no source unless allowed, the mark of made-up
#: objects, statuses that make a gold item, and days of a unit.
UNASKED, ASIDE, MADE_UP = ("", "—", "-"), ("estimate", "questionnaire"), "СИНТЕТИКА"
GOLD = {"CONFIRMED_VIOLATION": "POSITIVE", "NEGATIVE_VERIFIED": "NEGATIVE"}
DAYS = {"day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
#: Codes of stages in two alphabets, and scenarios by the stages that are whole.
STAGE_CODES = {"PD": "П", "RD": "Р", "ID": "ИД"}
SCENARIOS = {"PD+RD+ID": "FULL", "PD+RD": "PD_RD_ONLY", "PD+ID": "PD_ID_ONLY", "RD+ID": "RD_ID_ONLY", "": "NO_DOCUMENTS"}


def stage_required(source: Column) -> Column:
    """Whether a param names a source for the stage."""
    return F.coalesce(~F.trim(source).isin(*UNASKED), F.lit(False))


def is_named_source(sources: Column, discipline: Column) -> Column:
    """Whether a discipline is in the list, or the list takes all by a star; an empty list has no source."""
    return F.coalesce(F.exists(sources, lambda s: (s == "*") | F.coalesce(s == discipline, F.lit(False))), F.lit(False))


def is_document_source(kind: Column, allowed: Column) -> Column:
    """Documents of a type that stands aside count only where the list allows them; those without a type count."""
    return ~F.coalesce(kind.isin(*ASIDE), F.lit(False)) | F.coalesce(F.array_contains(allowed, kind), F.lit(False))


def is_real(name: Column, synthetic: Column) -> Column:
    """Neither marked as made up nor named so."""
    return ~F.coalesce(synthetic, F.lit(False)) & ~F.upper(F.ltrim(F.coalesce(name, F.lit("")))).startswith(MADE_UP)


def gold_label(status: Column, fragments: Column, expert: Column) -> Column:
    """POSITIVE or NEGATIVE for a settled card with evidence and an expert; null for others."""
    label = F.coalesce(*[F.when(status == s, name) for s, name in GOLD.items()])
    return F.when((fragments > 0) & (F.coalesce(expert, F.lit("")) != ""), label)


def stage_load(uploaded: Column, declared: Column, incomplete: Column) -> Column:
    short = F.coalesce(incomplete, F.lit(0))
    return F.when((uploaded == 0) & (short == 0), "MISSING").when((short > 0) | (uploaded < declared), "PARTIAL").otherwise("UPLOADED")


def scenario(loads: dict[str, Column]) -> Column:
    """What can be compared by the load of each stage, in order of stages."""
    partial = F.lit(False)
    for load in loads.values():
        partial = partial | (load == "PARTIAL")
    whole = F.array_join(F.array_compact(F.array(*[F.when(load == "UPLOADED", stage) for stage, load in loads.items()])), "+")
    return F.when(partial, "PARTIALLY_LOADED").otherwise(F.coalesce(*[F.when(whole == key, name) for key, name in SCENARIOS.items()], F.lit("SINGLE_ONLY")))


def to_days(value: Column, unit: Column) -> Column:
    return F.round(value * F.coalesce(*[F.when(unit == u, n) for u, n in DAYS.items()]), 3)


def event_time(text: Column) -> Column:
    """An ISO date or time with or without an offset as UTC with milliseconds; null for what is none."""
    form = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    timed = F.regexp_replace(F.when(F.length(text) > 10, text).otherwise(F.concat(text, F.lit("T00:00:00"))), r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    zoned = F.when(timed.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(text) > 10), timed).otherwise(F.concat(timed, F.lit("Z")))
    at = F.when(text.rlike(form) & (F.left(text, F.lit(4)) >= "1000"), F.try_to_timestamp(zoned))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def range_of(text: Column) -> Column:
    """struct(low, high, unit) of a cell that is a number, or two with a dash, dots or a word between; else null."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    form = rf"(?i)^(?:от\s+|±\s*)?({AMOUNT})\s*(?:(?:\.\.\.?|…|÷|–|—|-|до)\s*({AMOUNT}))?\s*({units})?\.?$"
    part = lambda i: F.nullif(F.regexp_extract(text, form, i), F.lit(""))
    one, two = plain_number(part(1)), plain_number(part(2))
    found = F.struct(F.least(one, F.coalesce(two, one)).alias("low"), F.greatest(one, F.coalesce(two, one)).alias("high"), F.lower(part(3)).alias("unit"))
    return F.when(collapse(text).rlike(form) & one.isNotNull(), found)


def field_key(kind: Column, value: Column) -> Column:
    """A field in the form that its kind is compared in; look-alike letters are one alphabet's."""
    text = collapse(value)
    twins = lambda c: F.translate(c, LATIN_TWINS, CYRILLIC_TWINS)
    code = F.regexp_replace(twins(text), r"\s*([-./])\s*", "$1")
    stage = twins(F.coalesce(*[F.when(F.upper(text) == a, b) for a, b in STAGE_CODES.items()], F.upper(text)))
    whole = F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("decimal(38,0)").cast("string"), text)
    room = F.regexp_replace(twins(F.upper(text)), " ", "")
    return F.when(kind == "code", code).when(kind == "stage", stage).when(kind == "revision", twins(text)).when(kind == "sheet", whole).when(kind == "room", room).otherwise(text)


def same_field(kind: Column, gold: Column, read: Column) -> Column:
    return F.coalesce(field_key(kind, gold) == field_key(kind, read), F.lit(False))


def log_route(level: Column, stream: Column, security: Column) -> Column:
    """Where a line of a log goes: its level or that of its stream; debugging is dropped (null), security goes apart."""
    known = F.coalesce(F.upper(level), F.when(stream <= 3, "ERROR").otherwise("INFO"))
    return F.when(known == "DEBUG", None).when(F.coalesce(security, F.lit(False)), "security").otherwise(F.lower(known))
