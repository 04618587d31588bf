"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before; all but the last return the columns of
``documents``. The result of a stage is written as Parquet in the shared folder and read again.

Every row is a document of its own, told apart by a number that a stage gives it: rows without a doc_id and rows that repeat one are
judged like any others. Null texts count as empty. An empty table gives an empty table. Columns other than doc_id, text and
n_chars pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonolex.llm import decontaminate, minhash, packing, suffixtree, toxicity
from sonolex.llm.common import Scratch, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fifth. Without labels all stay."""
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (shingles of five words, 0.8 or more); of repeated
    rows one stays. Texts without words all stay."""
    return minhash.without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows of 35 words go from the texts; texts that lose nothing stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffixtree.remove_repeated_passages(docs, carry=rest, all_texts=False).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items, none do."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of what is left; an empty or null text has its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substring", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A fitted classifier can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
