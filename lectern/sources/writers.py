"""Writers: tables, JSON and CSV exports, checkpoints of resumable work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_blank, prefix
from lectern.operators.textbook import FAILED


def write_table(df: DataFrame, path: str) -> None:
    """A catalogued table: chunks, vectors, postings."""
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_answered(df: DataFrame, full: str, answered: str) -> bool:
    """All items, and those with an answer other than the failure mark; the second only if there are any."""
    write_json(df, full)
    # what was written is read, so that ``df`` isn't made again
    df = df.sparkSession.read.schema(df.schema).json(full)
    good = df.where(F.col("answer").isNotNull() & (F.col("answer") != FAILED))
    if good.isEmpty():
        return False
    write_json(good, answered)
    return True


def write_summary(df: DataFrame, path: str) -> None:
    """The summary file: type, id, chapter, difficulty, question cut to 100 characters, an empty line number."""
    rows = df.select(F.col("type").alias("类型"), F.col("id").alias("ID"), F.col("chapter").alias("章节"), F.lit("normal").alias("难度"), prefix(F.col("question"), 100).alias("题目内容"), F.lit("").alias("行号"))
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def split_source(df: DataFrame) -> DataFrame:
    """``book_name, chapter, content`` of questions with a source of "chapter | book" or a book alone."""
    parts = F.split("source", r" \| ")
    two = F.size(parts) >= 2
    return df.select(F.when(two, parts[1]).otherwise(parts[0]).alias("book_name"), F.when(two, parts[0]).otherwise("").alias("chapter"), F.col("content"))


def write_mapping(df: DataFrame, path: str) -> None:
    """``concept, prereq, chunk_key`` rows as one JSON object a concept."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("prereq", "chunk_key"))))
    df.distinct().groupBy("concept").agg(m.alias("m")).select(F.to_json(F.create_map("concept", "m")).alias("value")).write.mode("overwrite").text(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Adds a batch of finished rows."""
    df.write.mode("append").parquet(path)


def pending(spark: SparkSession, df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of ``df`` that no checkpoint under ``path`` has; all of them before the first."""
    from lectern.sources.readers import _exists

    if not _exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(key), key, "left_anti")


def resumable(df: DataFrame, title: str, answer: str) -> DataFrame:
    """Rows with a title and without an answer yet."""
    return df.where(~is_blank(F.col(title)) & is_blank(F.col(answer)))


def swap_json(df: DataFrame, path: str) -> None:
    """Replaces the JSON list at ``path``, which ``df`` may have been read from: written beside it, then renamed."""
    context = df.sparkSession.sparkContext
    fs_path = context._jvm.org.apache.hadoop.fs.Path
    new, old = fs_path(f"{path}.new"), fs_path(path)
    files = old.getFileSystem(context._jsc.hadoopConfiguration())
    df.write.mode("overwrite").json(f"{path}.new")
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{path} could not be replaced; the new rows are in {path}.new")


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file, or a folder of them, whose top level must be a list or one object a line; else it raises."""
    first = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace(F.substring("value", 1, 100), "^\ufeff", "")).alias("v")).where("v <> ''").select(F.substring("v", 1, 1).alias("c")).distinct()
    listed = {r["c"] for r in first.limit(3).collect()}
    if listed - {"[", "{"} or len(listed) > 1:
        raise ValueError(f"{path} is no list")
    return spark.read.schema(schema).json(path, multiLine=listed == {"["})


def write_excel_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that spreadsheet programs read as UTF-8: the first name carries a byte-order mark."""
    df.toDF(*(("\ufeff" + c if i == 0 else c) for i, c in enumerate(df.columns))).write.mode("overwrite").csv(path, header=True, escape='"')


def write_object(df: DataFrame, key: str, value: str, path: str) -> None:
    """``key: value`` rows as one JSON object a line and row; a repeated key has its greatest value."""
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.max(value).alias("v"))
    once.select(F.to_json(F.create_map("k", "v")).alias("value")).write.mode("overwrite").text(path)


def write_prerequisites(df: DataFrame, path: str) -> None:
    """``concept, prereq`` rows as one JSON object a concept: its sorted prerequisites."""
    lists = df.where("concept is not null").distinct().groupBy("concept").agg(F.array_sort(F.collect_set("prereq")).alias("p"))
    lists.select(F.to_json(F.create_map("concept", "p")).alias("value")).write.mode("overwrite").text(path)
