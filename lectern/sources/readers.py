"""Readers of the files that the pipeline takes in: markdown folders, JSON stores, id-to-text files, CSV in any
encoding, and a registry of file loaders."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip

CHUNK = "chunk_id bigint, title string, content string, metadata map<string,string>, path_titles array<string>, path_numbering array<string>"
NODE = "struct<label:string, properties:struct<name:string, schema_type:string, `chunk id`:string>>"
END_NODE = "struct<label:string, properties:struct<name:string, `chunk id`:string, chunk:string>>"
EDGE = f"start_node {NODE}, relation string, end_node {END_NODE}"
#: How a chunk of a chunk file is written out, and an entry of an id-to-text file.
CHUNK_FORMAT = "\nheading_chain:\n%s\ncontent:\n%s\nhtml_content:\n%s\n"
ENTRY = r"(?s)id:\s*([^\t\n]+)\s*Chunk:\s*(.*?)(?=id:\s*[^\t\n]+\s*Chunk:|\z)"
ITEM = "question string, chapter string, answer string"


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of the ``.md`` files of a folder; the name is the file's, by which ids are ordered later."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file))


def json_array(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """The objects of a JSON array. A missing file raises, or is an empty table with ``missing_ok``."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def docstore(spark: SparkSession, path: str) -> DataFrame:
    """Chunks by id; of an id that occurs again one row stays (that of the greatest content)."""
    rows = json_array(spark, path, CHUNK)
    best = rows.groupBy("chunk_id").agg(F.max_by(F.struct("*"), F.coalesce("content", F.lit(""))).alias("r"))
    return best.select("r.*")


def knowledge_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges; a missing file is an empty graph."""
    return json_array(spark, path, EDGE, missing_ok=True)


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """The items of a question bank; a missing or broken file raises."""
    return json_array(spark, path, ITEM)


def id_to_chunk(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_key, text`` of a text file of ``id: ... Chunk: ...`` entries; white space squeezed, the last of an id counts."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(ENTRY), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(ENTRY), F.lit(2)).alias("t"))).alias("pos", "e"))
    rows = found.select("pos", strip(F.col("e.k")).alias("chunk_key"), strip(F.regexp_replace("e.t", r"(?U)\s+", " ")).alias("text"))
    return rows.groupBy("chunk_key").agg(F.max_by("text", "pos").alias("text"))


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """``concept, prereq, chunk_key`` of a JSON object of objects."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    top = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("concept", "m"))
    return top.select("concept", F.explode("m").alias("prereq", "chunk_key"))


def prerequisites(spark: SparkSession, path: str) -> DataFrame:
    """``concept, prereq`` of a JSON object of lists."""
    kind = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    top = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("concept", "l"))
    return top.select("concept", F.explode("l").alias("prereq"))


def chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """``name, pos, content`` of JSON files with ``chunks`` of heading chain and content, formatted as one text each."""
    schema = "chunks array<struct<heading_chain:string, content:string, html_content:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.posexplode("chunks").alias("pos", "c"))
    return rows.select("name", "pos", F.format_string(CHUNK_FORMAT, *(F.coalesce(f"c.{x}", F.lit("")) for x in ("heading_chain", "content", "html_content"))).alias("content"))


def csv_any_encoding(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header in UTF-8, with or without a byte-order mark, or else in Latin-1.

    The encoding is told from the file's bytes: they either are valid UTF-8 or not. A missing column raises.
    """
    bad = spark.read.format("binaryFile").load(path).agg(F.count_if(~F.is_valid_utf8(F.col("content").cast("string")))).first()[0]
    encoding = "ISO-8859-1" if bad else "UTF-8"
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if gone := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {gone}")
    return df


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def loader(*extensions: str) -> Callable:
    """Registers a loader for file extensions (with their dot, in any letter case)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        LOADERS.update({e.lower(): f for e in extensions})
        return f

    return add


loader(".json")(chunk_file)
loader(".csv")(csv_any_encoding)


@loader(".md", ".txt")
def text_file(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of one text file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


@loader(".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")
def external_file(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes``: what an external converter gets (a function of bytes, applied with ``mapInPandas``)."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("bytes"))


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file by the loader of its extension; an unknown one raises."""
    extension = os.path.splitext(path)[1].lower()
    if extension not in LOADERS:
        raise ValueError(f"no loader for {extension!r}")
    return LOADERS[extension](spark, path)


METHODS = ("ocr", "text")


def converted(files: DataFrame, convert: Callable[[bytes, str], str], method: str = "text") -> DataFrame:
    """``name, text`` of files (name, bytes) by an external converter, a function of bytes and method; an unknown method
    raises. A file that can't be converted has a null text."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}")

    @F.udf("string")
    def run(content: bytes | None) -> str | None:
        try:
            return None if content is None else convert(bytes(content), method)
        except Exception:  # noqa: BLE001
            return None

    return files.select("name", run("bytes").alias("text"))


def cache_name(name: Column) -> Column:
    """The folder of a file's converted text: its name without extension, and eight hex digits of the name's MD5."""
    return F.concat_ws("_", F.regexp_replace(name, r"\.[^.]*$", ""), F.substring(F.md5(name), 1, 8))


def uncached(files: DataFrame, cache: str, force: bool = False) -> DataFrame:
    """The files (name, ...) that have no converted text in the table ``cache`` (name, text); all of them by force."""
    spark = files.sparkSession
    if force or not _exists(spark, cache):
        return files
    return files.join(spark.read.parquet(cache).where("text is not null").select("name"), "name", "left_anti")
