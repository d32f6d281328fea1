"""Readers of documents in the formats that corpora come in, and sinks."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import first_text

BLANK = " \t\r\n"
TEXT_FIELDS = ("text", "content", "document", "body")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines. Strict reading fails on a bad line; lenient reading keeps it in _corrupt_record."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema else reader).json(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with one object or one array of objects each."""
    return spark.read.option("mode", "FAILFAST").option("multiLine", True).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parquet_column(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One column; the scan reads no other."""
    return spark.read.parquet(path).select(column)


def xml_records(spark: SparkSession, path: str, element: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", element).load(path)


def lenient_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, valid) of JSON lines; blank ones are left out."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.col("value").alias("line"), F.try_parse_json("value").isNotNull().alias("valid"))


def blank_line_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, text): files cut at blank lines, as tests in SQL logic format are."""
    whole = whole_texts(spark, path)
    cut = whole.select("path", F.posexplode(F.split("text", "\n[ \\t]*\n")).alias("position", "text"))
    return cut.select("path", "position", F.btrim("text", F.lit(BLANK)).alias("text")).where("text <> ''")


def yaml_records(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, position, text): YAML documents between lines of three dashes, up to a size."""
    whole = whole_texts(spark, path)
    cut = whole.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), "\n---[ \\t]*(?=\n|$)")).alias("position", "text"))
    return cut.where((F.btrim("text", F.lit(BLANK)) != "") & (F.octet_length("text") <= most_bytes))


def zip_members(spark: SparkSession, path: str, include: str = "*", exclude: str = "", most_bytes: int = 1 << 26) -> DataFrame:
    """(archive, member, text) of members that match, are small enough, and are UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if m.is_dir() or m.file_size > most_bytes or not fnmatch.fnmatch(m.filename, include) or (exclude and fnmatch.fnmatch(m.filename, exclude)):
                            continue
                        try:
                            text = z.read(m).decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        yield pd.DataFrame({"archive": [archive], "member": [m.filename], "text": [text]})

    return files.mapInPandas(run, "archive string, member string, text string")


def with_text(df: DataFrame) -> DataFrame:
    """Adds text: the first of the usual fields that is not blank. Fails if there is none of them."""
    have = [c for c in TEXT_FIELDS if c in df.columns]
    if not have:
        raise ValueError(f"none of {TEXT_FIELDS} in {df.columns}")
    return df.withColumn("text", first_text(*[F.col(c).cast("string") for c in have]))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str, kind: str = "json", by: list[str] | None = None) -> None:
    """Fails if the target is there; one folder for each value of `by`, such as the split or the bucket."""
    writer = df.write.mode("errorifexists").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
