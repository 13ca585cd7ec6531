"""Tables read from their cells: how deep the header is, what each column holds, and the rows with their sections.

Cells have the keys of a table, r and c (from 0) and text. Header words are a caller's to choose.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import AMOUNT, UNITS, collapse, fold, plain_number

#: Header rows at most, and signs of a section's title at most.
HEADER, SECTION = 3, 80
#: Beginnings of words that tell what a column holds, the first role that fits counting.
WORDS = {
    "number": ["№", "no", "поз"], "unit": ["ед", "единиц", "unit"], "value": ["значени", "величин", "количеств", "value", "amount"],
    "name": ["наименовани", "показател", "name", "item"],
}
DASHES = ("", "—", "–", "-", "−")


def typed(cells: DataFrame) -> DataFrame:
    """Filled cells with what they are: amount (number), unit, words (three letters or more), short (a row's number)."""
    text = collapse(F.col("text"))
    rows = cells.withColumn("text", text).where(~F.col("text").isin(*DASHES))
    plain = F.translate("text", " .", "")
    unit = F.when(F.length(plain) <= max(map(len, UNITS)), F.lower(plain).isin(*UNITS)).otherwise(False)  # lower() of other alphabets is slow
    amount = plain_number(F.regexp_extract("text", rf"^({AMOUNT})(\s*\p{{L}}{{1,4}}\.?)?$", 1))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return rows.withColumns({"amount": amount, "is_unit": unit, "letters": letters, "short": F.col("text").rlike(r"^\d{1,4}([.-]\d{1,3})?\p{L}?$")})


def _with_depth(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``typed`` cells with labels and depth of their table: all windows of a table are dealt out by its keys, once."""
    line, whole = W.partitionBy(*keys, "r"), W.partitionBy(*keys)
    place = F.row_number().over(line.orderBy("c"))
    rows = cells.withColumn("_step", F.when(F.col("text").rlike(r"^\d{1,3}$"), F.col("text").cast("int") - place)).withColumns({
        "_n": F.count("*").over(line), "_steps": F.count("_step").over(line), "_even": F.max("_step").over(line) == F.min("_step").over(line),
        "_numbers": F.count("amount").over(line) > 0, "_most": F.max("letters").over(line),
    })
    label = (F.col("_n") >= 2) & ~F.col("_numbers") & (F.col("_most") >= 2) & (F.col("r") < HEADER)
    counting = (F.col("_n") >= 2) & (F.col("_steps") == F.col("_n")) & F.col("_even")
    end = F.max("r").over(whole) + 1
    rows = rows.withColumn("_counting", counting).withColumns({"_end": end, "labels": F.coalesce(F.min(F.when(~label, F.col("r"))).over(whole), end)})
    first = F.min(F.when((F.col("r") >= F.col("labels")) & ~F.col("_counting"), F.col("r"))).over(whole)
    return rows.withColumn("depth", F.coalesce(first, "_end")).drop("_step", "_n", "_steps", "_even", "_numbers", "_most", "_counting", "_end")


def header_depth(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, labels and depth of ``typed`` cells: rows of labels at the top, and with the row that numbers columns below."""
    return _with_depth(cells, keys).groupBy(*keys).agg(F.min("labels").alias("labels"), F.min("depth").alias("depth"))


def _said(key: Column, words: dict[str, list[str]]) -> Column:
    """The role whose words a title's key has."""
    fits = lambda stems: reduce(or_, [F.contains(key, F.lit(f" {s}")) for s in stems])
    return F.coalesce(*[F.when(fits(stems), role) for role, stems in words.items()])


def _about() -> dict[str, Column]:
    """What is counted of each column, and its title, of cells with their table's labels and depth."""
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)) & (F.col("r") >= F.col("depth")))
    amount = F.col("amount").isNotNull()
    return {
        "filled": n(F.lit(True)), "amounts": n(amount), "units": n(~amount & F.col("is_unit")),
        "wordy": n(~amount & ~F.col("is_unit") & (F.col("letters") >= 3)), "shorts": n(F.col("short")),
        "_titles": F.collect_list(F.when(F.col("r") < F.col("labels"), F.struct("r", "text"))),
    }


def _with_roles(found: DataFrame, keys: list[str], words: dict[str, list[str]] | None) -> DataFrame:
    """title and role of rows that tell ``_about`` their column; any number of rows of a column says the same."""
    found = found.withColumn("title", F.array_join(F.transform(F.array_sort("_titles"), lambda x: x["text"]), " · ")).drop("_titles")
    # a title is folded once for its column, by its first row; the key is a column, else each word would fold it again
    key = F.concat(F.lit(" "), F.when(F.trim("title").startswith("№"), "№").otherwise(fold(F.col("title"))))
    found = found.withColumn("_key", F.when((F.col("title") != "") & F.col("_first"), key))
    column = W.partitionBy(*keys, "c")
    found = found.withColumn("_said", F.max(_said(F.col("_key"), words or WORDS)).over(column)).drop("_key")
    table, c, said = W.partitionBy(*keys), F.col("c"), F.col("_said")
    earlier = F.coalesce(F.min(F.when(said == "name", c)).over(table) < c, F.lit(False))
    found = found.withColumn("_earlier", earlier).withColumn("_said", F.when((said != "name") | ~F.col("_earlier"), said))
    free = F.when(said.isNull() & (F.col("wordy") > 0), F.struct("wordy", -c))
    named = F.max(F.when(said == "name", 1)).over(table).isNotNull()
    found = found.withColumn("_free", free).withColumn("_word", ~named & F.coalesce(F.col("_free") == F.max("_free").over(table), F.lit(False)))
    found = found.withColumn("_said", F.when(F.col("_word"), "name").otherwise(said))
    name, has_unit = F.min(F.when(said == "name", c)).over(table), F.max(F.when(said == "unit", 1)).over(table).isNotNull()
    found = found.withColumns({"_name": name, "_has_unit": has_unit})
    found = found.withColumn("_like_unit", said.isNull() & ~F.col("_has_unit") & (F.col("filled") > 0) & (F.col("units") * 2 >= F.col("filled")))
    found = found.withColumn("_unit", F.min(F.when(F.col("_like_unit"), c)).over(table))
    role = (
        F.when(said.isNotNull(), said).when(F.col("_like_unit") & (c == F.col("_unit")), "unit")
        .when((F.col("filled") > 0) & (c < F.col("_name")) & (F.col("shorts") * 2 >= F.col("filled")), "number")
        .when((F.col("filled") > 0) & (F.col("amounts") * 2 >= F.col("filled")), "value").otherwise("text")
    )
    return found.withColumn("role", role)


def columns(cells: DataFrame, keys: list[str], words: dict[str, list[str]] | None = None) -> DataFrame:
    """keys, c, title and role (number, name, unit, value or text) of each column.

    The header's word for a column counts, the first name only. Else the column with most words is the name, the first of
    mostly units the unit, one of mostly short numbers before the name the number, and one of mostly amounts a value.
    """
    found = _with_depth(typed(cells), keys).groupBy(*keys, "c").agg(*[v.alias(k) for k, v in _about().items()]).withColumn("_first", F.lit(True))
    return _with_roles(found, keys, words).select(*keys, "c", "title", "role")


def read_rows(cells: DataFrame, keys: list[str], words: dict[str, list[str]] | None = None) -> DataFrame:
    """keys, r, section, number, name, unit and values (column, amount) of each body row that has a name.

    A body row of a single cell without a number is the title of the section below it. Cells learn of their column by
    windows and aren't joined back to it, so they are read and dealt out once.
    """
    column = W.partitionBy(*keys, "c")
    rows = _with_depth(typed(cells), keys).withColumns({k: v.over(column) for k, v in _about().items()})
    rows = rows.withColumn("_first", F.row_number().over(column.orderBy("r")) == 1)
    body = _with_roles(rows, keys, words).where("r >= depth").select(*keys, "r", "c", "text", "amount", "title", "role")
    one = lambda role: F.min(F.when(F.col("role") == role, F.struct("c", "text")))["text"]
    value = F.when((F.col("role") == "value") & F.col("amount").isNotNull(), F.struct("c", F.col("title").alias("column"), "amount"))
    wide = body.groupBy(*keys, "r").agg(
        F.count("*").alias("n"), F.min("text").alias("_only"), (F.count("amount") > 0).alias("_numbers"),
        *[one(role).alias(role) for role in ("number", "name", "unit")], F.array_sort(F.collect_list(value)).alias("values"),
    )
    title = (F.col("n") == 1) & ~F.col("_numbers") & (F.length("_only") <= SECTION)
    section = F.last(F.when(title, F.col("_only")), ignorenulls=True).over(W.partitionBy(*keys).orderBy("r"))
    values = F.transform("values", lambda v: F.struct(v["column"].alias("column"), v["amount"].alias("amount")))
    return wide.withColumn("section", section).where(~title & F.col("name").isNotNull()).select(*keys, "r", "section", "number", "name", "unit", values.alias("values"))
