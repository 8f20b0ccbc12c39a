"""Sources: ordered JSON arrays, newest files, name lists, office documents, transcriptions."""

from __future__ import annotations

import difflib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from tallgrass.functions.records import SCHEMA
from tallgrass.functions.text import clean_text, decode_fallback


def read_records(spark: SparkSession, path: str, fields: str = SCHEMA) -> DataFrame:
    """Records of JSON arrays, one array a file: the fields, ``path``, and ``ord``, the place in the array.

    A file whose top level is no array fails the query. For large sets of records one JSON object a line
    (``spark.read.json``) splits better; an array must be read whole, as its order counts.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    checked = F.when(F.ltrim(F.regexp_replace("value", "^﻿", "")).startswith("["), F.from_json("value", f"array<struct<{_struct(fields)}>>")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": a list of records is needed"))))
    return text.select("path", F.posexplode(checked).alias("ord", "record")).select("path", F.col("ord").cast("long").alias("ord"), "record.*")


def _struct(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in fields.split(",")))


def newest_file(spark: SparkSession, folders: list[str], pattern: str = "*.json") -> DataFrame:
    """One row: ``path`` and ``modificationTime`` of the file changed last; no row without files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folders).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).filter("m IS NOT NULL").select("m.path", "m.modificationTime")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a JSON array: ``ord name``; what is no string or blank is null in ``name``, so it can be counted."""
    items = F.from_json("value", "array<variant>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode_outer(items).alias("ord", "item"))
    name = F.nullif(F.trim(F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string"))), F.lit(""))
    return rows.select(F.col("ord").cast("long").alias("ord"), name.alias("name"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array of any layout, with the fields of ``schema``; a broken file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON object from name to text, or to a list of questions with answers: ``name text pairs``, of which one is null."""
    entries = F.from_json("value", "map<string,variant>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("name", "v"))
    pairs = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<struct<question:string,answer:string>>"))
    return rows.select("name", F.when(pairs.isNull(), F.try_variant_get("v", "$", "string")).alias("text"), pairs.alias("pairs"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_blocks(data: bytes) -> list[dict[str, object]]:
    """Paragraphs of a Word file in order, those of tables too: text, highlighted text, ids of its pictures."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    inside = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    out = []
    for p in root.iter(f"{_W}p"):
        runs = [("".join(t.text or "" for t in r.iter(f"{_W}t")), (r.find(f"{_W}rPr/{_W}highlight"))) for r in p.iter(f"{_W}r")]
        marked = "".join(t for t, h in runs if h is not None and h.get(f"{_W}val") == "yellow")
        pictures = [x.get(f"{_R}embed") for x in p.iter() if x.get(f"{_R}embed")]
        out.append({"kind": "table" if id(p) in inside else "paragraph", "text": "".join(t for t, _ in runs), "marked": marked, "pictures": pictures})
    return out


def docx_pictures(data: bytes) -> list[dict[str, object]]:
    """Pictures of a Word file: relation id, name in the archive, bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        relations = ElementTree.fromstring(archive.read("word/_rels/document.xml.rels"))
        names = {r.get("Id"): f"word/{r.get('Target')}" for r in relations if "image" in (r.get("Type") or "")}
        return [{"id": i, "name": n, "data": archive.read(n)} for i, n in names.items() if n in archive.namelist()]


_BLOCKS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("marked", StringType()), StructField("pictures", ArrayType(StringType()))]))
_PICTURES = ArrayType(StructType([StructField("id", StringType()), StructField("name", StringType()), StructField("data", BinaryType())]))


def _per_file(rule, kind):  # noqa: ANN001, ANN202
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for files in batches:
            yield files.map(lambda data: rule(bytes(data)))

    return run


_docx_blocks, _docx_pictures = _per_file(docx_blocks, _BLOCKS), _per_file(docx_pictures, _PICTURES)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of Word files: ``path idx kind text marked pictures``. Files are read in parallel, each by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", F.posexplode(_docx_blocks("content")).alias("idx", "b")).select("path", "idx", "b.*")


def read_docx_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of Word files: ``path id name data``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", F.explode(_docx_pictures("content")).alias("p")).select("path", "p.*")


def highlighted_records(blocks: DataFrame) -> DataFrame:
    """A record for each paragraph with highlighted text: the paragraph is the question, the highlighted text the answer."""
    marked = clean_text("marked")
    return blocks.select("path", "idx", clean_text("text").alias("question"), marked.alias("answer")).filter("answer <> ''")


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of PDF files: ``path idx text``. Needs the optional package pypdf on the executors."""

    def lines(data: bytes) -> list[str]:
        from pypdf import PdfReader

        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages).split("\n")

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", F.posexplode(_per_file(lines, ArrayType(StringType()))("content")).alias("idx", "text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in any of the usual encodings: ``path idx text``."""
    files = spark.read.format("binaryFile").load(path).select("path", decode_fallback(F.col("content")).alias("value"))
    return files.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("idx", "text"))


def close_names(names: DataFrame, name_col: str, wanted: str, cutoff: float = 0.4, n: int = 3) -> DataFrame:
    """The ``n`` names most like ``wanted`` by matching blocks, at ``cutoff`` or more: ``name ratio``."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: difflib.SequenceMatcher(None, wanted.lower(), (x or "").lower()).ratio())

    scored = names.select(F.col(name_col).alias("name"), ratio(name_col).alias("ratio"))
    return scored.filter(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), "name").limit(n)


def resolve_name(names: DataFrame, name_col: str, wanted: str, cutoff: float = 0.5) -> DataFrame:
    """The name meant by ``wanted``: equal but for case and spaces, else the only one, else the closest."""
    same = F.lower(F.regexp_replace(F.col(name_col), r"\s+", "")) == re.sub(r"\s+", "", wanted).lower()
    exact = names.filter(same).select(F.col(name_col).alias("name"), F.lit(2.0).alias("ratio"))
    sole = names.groupBy().agg(F.count("*").alias("n"), F.min(name_col).alias("name")).filter("n = 1").select("name", F.lit(1.5).alias("ratio"))
    return exact.unionByName(sole).unionByName(close_names(names, name_col, wanted, cutoff, 1)).orderBy(F.desc("ratio"), "name").limit(1)
