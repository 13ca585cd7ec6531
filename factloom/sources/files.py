"""Files as rows: kinds by magic bytes, documents as lines, the registry that paths imply, and plans of portions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.picks import first_per

LINES = "path string, kind string, page int, line int, text string"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def file_kind(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(text.rlike(r"^(\xEF\xBB\xBF)?\s*<\?xml|^\s*<[A-Za-z]"), "xml")
        .when(text.rlike(r"^\s*[\[{]"), "json")
        .otherwise("other")
    )


def _office_lines(content: bytes) -> tuple[str, list[tuple[int, str]]]:
    """Kind and (page, text) lines of an office file: paragraphs of a document, rows of a workbook's sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        local = lambda e: e.tag.rpartition("}")[2]
        text = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t")
        if "word/document.xml" in names:
            root = ElementTree.fromstring(z.read("word/document.xml"))
            return "docx", [(1, t) for p in root.iter() if local(p) == "p" and (t := text(p).strip())]
        if "xl/workbook.xml" in names:
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = [text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            lines = []
            sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
            for page, name in enumerate(sheets, 1):
                for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if local(r) == "row"):
                    cells = []
                    for c in (c for c in row if local(c) == "c"):
                        value = next((v.text or "" for v in c if local(v) == "v"), text(c))
                        cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                    if any(cells):
                        lines.append((page, "\t".join(cells)))
            return "xlsx", lines
    return "zip", []


def document_lines(files: DataFrame) -> DataFrame:
    """Lines of office files; a file that can't be read gives one row without text."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                try:
                    kind, lines = _office_lines(bytes(content))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
                    kind, lines = "broken", []
                rows += [(path, kind, page, i, text) for i, (page, text) in enumerate(lines)] or [(path, kind, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "kind", "page", "line", "text"]).astype({"page": "Int32", "line": "Int32"})

    return files.select("path", "content").mapInPandas(batches, LINES)


def xml_values(texts: DataFrame, column: str = "text") -> DataFrame:
    """Rows of <value name= unit=>1 234,5</value> elements in XML text, numbers with decimal comma read."""
    schema = "value array<struct<_VALUE: string, _name: string, _unit: string>>"
    parsed = F.from_xml(F.col(column), F.lit(schema), {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"})
    rows = texts.withColumn("_x", parsed).select("*", F.explode("_x.value").alias("_v")).drop("_x")
    number = F.translate(F.regexp_replace("_v._VALUE", r"[\s ]", ""), ",", ".").try_cast("double")
    return rows.withColumns({"name": F.col("_v._name"), "unit": F.col("_v._unit"), "num": number}).drop("_v")


def registry(files: DataFrame) -> DataFrame:
    """Stage, discipline, code and revision that a path implies, added to rows with ``path`` and ``sha``."""
    low = F.lower("path")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    stage = F.when(low.rlike("(^|/)(pd|design)(/|_)"), "PD").when(low.rlike("(^|/)(rd|working)(/|_)"), "RD").when(low.rlike("(^|/)(id|built)(/|_)"), "ID")
    return files.withColumns({
        "stage": stage,
        "code": F.upper(F.regexp_replace(name, r"[_-](?:rev|r)\d+$", "")),
        "revision": F.nullif(F.regexp_extract(F.lower(name), r"[_-](?:rev|r)(\d+)$", 1), F.lit("")).cast("int"),
    })


def distinct_content(files: DataFrame) -> DataFrame:
    """Files of one content are one file: the first path stays."""
    return first_per(files, ["sha"], [F.asc("path")])


def batches(files: DataFrame, keys: list[str], most_bytes: int, most_files: int) -> DataFrame:
    """Greedy batches in order of path: a batch closes before the file that would overfill it.

    Each key's files come to one task in order and pass it as a stream: it remembers the open batch, not the files.
    """
    columns = [*keys, "path", "bytes"]
    dealt = files.select(*columns).repartition(*keys).sortWithinPartitions(*columns)

    def placed(frames):
        key, no, filled, count = None, 0, 0, 0
        for frame in frames:
            numbers = []
            for row in frame.itertuples(index=False, name=None):
                if row[: len(keys)] != key:
                    key, no, filled, count = row[: len(keys)], 0, 0, 0
                elif filled + row[-1] > most_bytes or count >= most_files:
                    no, filled, count = no + 1, 0, 0
                filled, count = filled + row[-1], count + 1
                numbers.append(no)
            yield frame.assign(batch=numbers)

    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in columns)
    return dealt.mapInPandas(placed, f"{kinds}, batch int")


def page_ranges(pages: Column, size: int) -> Column:
    """Array of (first, last) page ranges of at most so many pages."""
    firsts = F.when(pages > 0, F.sequence(F.lit(1), pages, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda f: F.struct(f.alias("first"), F.least(f + size - 1, pages).alias("last")))


def assembled(parts: DataFrame) -> DataFrame:
    """Documents from their parts (doc, first, last, text): in order, and complete only without a gap or overlap."""
    listed = F.array_sort(F.collect_list(F.struct("first", "last", "text")))
    whole = parts.groupBy("doc").agg(listed.alias("p"))
    gapless = (F.col("p")[0]["first"] == 1) & F.forall(
        F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))),
        lambda i: (i > F.size("p")) | (F.try_element_at("p", i)["first"] == F.element_at("p", i - 1)["last"] + 1),
    )
    return whole.select("doc", gapless.alias("complete"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.array_max(F.transform("p", lambda x: x["last"])).alias("pages"))
