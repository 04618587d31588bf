"""Sources of documents (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import numbered


def from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Any table with an id and a text; rows without text are left out, repeated texts stay."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, empty lines left out; ids grow in file order."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def from_json(spark: SparkSession, path: str, field: str = "title") -> DataFrame:
    """The distinct values of a field of JSON records; ids follow the text's order."""
    return distinct_texts(spark.read.json(path), field)


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    texts = df.select(F.col(column).alias("text")).where("text is not null").distinct()
    return numbered(texts, "doc_id", "text").select("doc_id", "text")
