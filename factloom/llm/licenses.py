"""License scans by diagonal voting, in DataFrame operations alone.

Every pair of neighbouring words of a text is hashed and joined to the places of equal pairs in the license templates.
A join row votes for a diagonal, its place in the text less its place in the template: a passage copied from a template
puts all its votes on one diagonal, and a word put in or left out moves the rest to a neighbouring one. Diagonals are
counted, neighbours merged, and a span is kept if it holds enough of its template. The words themselves are compared in
the join, so a verified span has the words and not only their hashes.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, table

#: What counts as a word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this far apart are one span; a span needs this share of its template's word pairs
#: and the last of them, which tells versions apart.
NEIGHBOUR, ENOUGH = 2, 0.85

#: Phrases that alone decide a base label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Usual wordings of license notices and the labels of their spans.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0-text",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "under the terms of the gnu general public license": "gpl-terms",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd-text",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution": "cc-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}


#: Word pairs of templates that are few enough to send to every task.
SENT = 500_000


def templates(notices: dict[str, str]) -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is base, its pairs, place, first word, second word) of every word pair."""
    rows = []
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for number, (text, label) in enumerate([*BASE.items(), *notices.items()]):
        words = re.findall(WORD, text.translate(lower))
        rows += [(number, label, text in BASE, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def words_of(column: str):
    lowered = F.translate(clean_text(column), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_pairs(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """The pairs of the base phrases and the notices, sent to every task where their number is small."""
    rows = templates(notices)
    schema = "template int, label string, is_base boolean, pairs int, place int, one string, two string"
    pairs = spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("one", "two"))
    return F.broadcast(pairs) if len(rows) <= SENT else pairs


def votes(docs: DataFrame, notices: dict[str, str]) -> DataFrame:
    """A row for each hit of a word pair, and one at least for each row of documents.

    ``row`` numbers the rows of documents, so repeated ones and those with null ids stay apart.
    """
    words = docs.select("doc_id", words_of("text").alias("words")).withColumn("row", F.monotonically_increasing_id())
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    rolled = words.withColumn("pairs_of_text", pairs).select(
        "row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("pairs_of_text").alias("at", "pair")
    )
    known = template_pairs(docs.sparkSession, notices).alias("t")
    same = (
        (F.col("d.pair") == F.col("t.pair"))
        & (F.try_element_at("words", F.col("at") + 1) == F.col("t.one"))
        & (F.try_element_at("words", F.col("at") + 2) == F.col("t.two"))
    )
    hits = rolled.alias("d").join(known, same, "left").where("template is not null or coalesce(at, 0) = 0")
    return hits.select(
        "row", "doc_id", "n_words", "template", "label", "is_base", "pairs", "place", F.col("at").cast("long").alias("at"),
        (F.col("at") - F.col("place")).cast("long").alias("diagonal"),
    )


def spans(found: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals of each row and template and measure what they hold of the template.

    Adds a row for each merged span: start, stop (word places), whole (diagonals that hold the template unbroken),
    first and last place of those, and coverage; rows without a hit pass through with nulls.
    """
    keys = ["row", "doc_id", "n_words", "template", "label", "is_base", "pairs"]
    lines = found.groupBy(*keys, "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("low"), (F.max("at") + 2).alias("high")
    )
    by = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR).cast("int"), F.lit(1))
    lines = lines.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by))
    whole = (F.size("places") == F.col("pairs")) & F.col("diagonal").isNotNull()
    return lines.groupBy(*keys, "island").agg(
        F.min("low").alias("start"),
        F.max("high").alias("stop"),
        F.count_if(whole).alias("whole"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_whole"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_whole"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.col("pairs")).alias("coverage"),
        F.bool_or(F.array_contains("places", F.col("pairs") - 1)).alias("ended"),
    )


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of documents: its words, base places and labels. Null texts are empty; other columns go.

    ``notices`` maps texts of any length, such as whole licenses, to labels, in place of the usual wordings; one of fewer
    than two words is never found. Texts may be of any length, and repeated rows stay.
    """
    merged = spans(votes(docs, NOTICES if notices is None else notices).repartition("row"))  # the one shuffle; all later groups are parts of a row
    base = F.coalesce("is_base", F.lit(False))
    verified = ~base & F.col("ended") & (F.col("coverage") >= ENOUGH)
    name = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    hit = base & (F.col("whole") > 0)
    return merged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sum(F.when(hit, F.col("whole")).otherwise(0)).alias("n_base"),
        F.min(F.when(hit, F.col("first_whole"))).alias("first_word"),
        F.max(F.when(hit, F.col("last_whole"))).alias("last_word"),
        name(hit).alias("base_labels"),
        name(hit | verified).alias("labels"),
        F.coalesce(F.max(F.when(hit, 1.0).when(verified, F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op8_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same scan in DuckDB SQL, over words instead of hashes."""
    values = ", ".join(f"({t}, '{label}', {str(b).lower()}, {n}, {i}, '{x}', '{y}')" for t, label, b, n, i, x, y in templates(NOTICES))
    return rf"""
    with t(template, label, is_base, pairs, place, one, two) as (values {values}),
    d as (select row_number() over () as row_no, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                                    '{WORD}') as words from documents),
    g as (select row_no, words, unnest(range(greatest(len(words) - 1, 0))) as pos from d),
    v as (select row_no, template, label, is_base, pairs, place, pos, pos - place as diagonal
          from g join t on one = words[pos + 1] and two = words[pos + 2]),
    l as (select row_no, template, label, is_base, pairs, diagonal, list(distinct place) as places
          from v group by row_no, template, label, is_base, pairs, diagonal),
    a as (select *, case when diagonal - lag(diagonal) over w <= {NEIGHBOUR} then 0 else 1 end as apart
          from l window w as (partition by row_no, template order by diagonal)),
    i as (select *, sum(apart) over (partition by row_no, template order by diagonal) as island from a),
    s as (select row_no, template, label, is_base, pairs, island,
                 count(*) filter (where len(places) = pairs) as whole,
                 min(diagonal) filter (where len(places) = pairs) as first_whole,
                 max(diagonal) filter (where len(places) = pairs) as last_whole,
                 len(list_distinct(flatten(list(places)))) / pairs::double as coverage,
                 bool_or(list_contains(places, pairs - 1)) as ended
          from i group by row_no, template, label, is_base, pairs, island),
    f as (select *, is_base and whole > 0 as hit, not is_base and ended and coverage >= {ENOUGH} as verified from s),
    r as (select row_no, sum(case when hit then whole else 0 end) as n_base,
                 min(first_whole) filter (where hit) as first_word, max(last_whole) filter (where hit) as last_word,
                 string_agg(distinct label, ',' order by label) filter (where hit) as base_labels,
                 string_agg(distinct label, ',' order by label) filter (where hit or verified) as labels,
                 max(case when hit then 1.0::double when verified then coverage end) as score
          from f group by row_no)
    select d.doc_id, len(d.words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
           first_word::bigint as first_word, last_word::bigint as last_word,
           coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
    from d left join r using (row_no)
    """
