"""Dataset readers and writers: JSON arrays, JSON lines, Parquet, result files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rubrica.sources import arrays

#: Logical schemas of the training tables, as DDL.
SCHEMAS = {
    "sft_raw": "instruction string, input string, output string",
    "sft": "prompt string, response string",
    "sft_chat": "conversations array<struct<role: string, content: string>>",
    "rl": "prompt string, ground_truth string, data_source string",
    "preference": "prompt string, chosen string, rejected string",
}


def read_json(
    spark: SparkSession, path: str, schema: str | StructType | None = None, split: bool | None = None
) -> DataFrame:
    """JSON arrays, or files of one object each.

    With ``split`` a file is read by many tasks, else by one; unless told, files longer than a scan
    split are. Both give the same rows.
    """
    if split is None:
        split = arrays.longest_file(spark, path) > _split_bytes(spark)
    if split:
        return arrays.read_arrays(spark, path, schema)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def _split_bytes(spark: SparkSession) -> int:
    """The longest split of a scan, from a setting such as 134217728b or 128m."""
    digits, unit = re.match(r"(\d+)\s*([a-z]?)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def read_json_lines(
    spark: SparkSession, path: str, schema: str | StructType | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text in ``value``, for the rules that tell a missing key from a null."""
    return spark.read.text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, nulls kept, text unescaped."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_to_parquet(
    spark: SparkSession, json_path: str, parquet_path: str, schema: str | StructType | None = None
) -> str:
    read_json(spark, json_path, schema).write.parquet(parquet_path)
    return parquet_path


def parquet_to_json(spark: SparkSession, parquet_path: str, json_path: str) -> str:
    write_json(spark.read.parquet(parquet_path), json_path)
    return json_path


def load_dataset(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Training data by suffix: ``.json`` array, ``.jsonl`` lines, ``.csv`` with header, else Parquet."""
    if path.endswith(".json"):
        return read_json(spark, path, schema)
    if path.endswith(".jsonl"):
        return read_json_lines(spark, path, schema)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Result table by suffix: ``.csv``, ``.parquet``, else JSON lines. Returns the path written.

    Spreadsheets hold one machine's data and are refused.
    """
    if path.endswith((".xlsx", ".xls")):
        raise ValueError(f"spreadsheets are not written: {path}")
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        write_json(df, path, mode)
    return path
