"""Delimited, JSON and Parquet files, single ones, folders or globs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import col

FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "parquet": "parquet"}
FALLBACK_ENCODING = "ISO-8859-1"


def _delimited(spark, path, sep, encoding, schema, multiline) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", multiline)
    reader = reader.option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_csv(spark: SparkSession, path, encoding: str | None = None, schema=None, multiline: bool = False) -> DataFrame:
    """Comma-separated with a header. Without an encoding: UTF-8, but Latin-1 for each file that holds bytes which are not valid UTF-8.

    Give an encoding and a schema for large inputs; each saves a pass over the files.
    """
    if encoding is not None:
        return _delimited(spark, path, ",", encoding, schema, multiline)
    lines = spark.read.text(path)  # lines keep their bytes
    odd = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("p")).distinct()
    latin = sorted(r["p"] for r in odd.collect())  # names of files
    if not latin:
        return _delimited(spark, path, ",", "UTF-8", schema, multiline)
    good = sorted(set(map(_plain, lines.inputFiles())) - set(map(_plain, latin)))
    if not good:
        return _delimited(spark, path, ",", FALLBACK_ENCODING, schema, multiline)
    if schema is None:  # one schema for all files: types do not depend on the encoding, names come from valid files
        types = _delimited(spark, path, ",", FALLBACK_ENCODING, None, multiline).schema.fields
        names = _delimited(spark, good, ",", "UTF-8", None, multiline).columns
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, types)])
    return _delimited(spark, good, ",", "UTF-8", schema, multiline).unionByName(_delimited(spark, latin, ",", FALLBACK_ENCODING, schema, multiline))


def _plain(uri: str) -> str:
    """One spelling of a local file's address."""
    return re.sub("^file:/+", "file:///", uri)


def read_tsv(spark: SparkSession, path, schema=None, multiline: bool = False) -> DataFrame:
    return _delimited(spark, path, "\t", "UTF-8", schema, multiline)


def read_json(spark: SparkSession, path, schema=None, lines: bool | None = None) -> DataFrame:
    """JSON lines (splittable), or one array of records per file; without the argument each file is told by its first character."""
    if lines is not None:
        return _json(spark, path, schema, lines)
    text = spark.read.text(path)
    filled = text.select(
        F.col("_metadata.file_path").alias("p"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
        F.substring(F.ltrim("value"), 1, 1).alias("c"),
    ).where("c <> ''")
    arrays = sorted(r["p"] for r in filled.groupBy("p").agg(F.min_by("c", "at").alias("c")).where("c = '['").collect())  # names of files
    if not arrays:
        return _json(spark, path, schema, True)
    plain = sorted(set(map(_plain, text.inputFiles())) - set(map(_plain, arrays)))
    if not plain:
        return _json(spark, path, schema, False)
    both = _json(spark, plain, schema, True), _json(spark, arrays, schema, False)
    return both[0].unionByName(both[1], allowMissingColumns=True)


def _json(spark, path, schema, lines: bool) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Reads by the given format or the file suffix."""
    suffix = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported format '{suffix}'; supported: {', '.join(FORMATS)}")
    readers = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet}
    return readers[FORMATS[suffix]](spark, path, **options)


def file_info(df: DataFrame) -> DataFrame:
    """(name, type, bytes, size) of every file behind a freshly read table."""
    # Names and lengths only: the contents of the files are not read.
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles()).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    kb, mb = F.col("bytes") / 1024.0, F.col("bytes") / (1024.0 * 1024.0)
    size = F.when(mb < 1, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))
    return files.select("name", F.lower(F.element_at(F.split("name", "[.]"), -1)).alias("type"), "bytes", size.alias("size"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def preview(df: DataFrame, n: int = 100, by: list[str] | None = None) -> DataFrame:
    """The first rows, by key where the choice must be reproducible."""
    return (df.orderBy(*[col(c) for c in by]) if by else df).limit(n)
