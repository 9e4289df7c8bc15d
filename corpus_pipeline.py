"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and its
result is written as Parquet and read again for the next. All but the last return the columns of
``documents``; extra columns ride along.

1. ``quality``: documents that fail the base rules or the fertility bands go.
2. ``line_dedup``: globally repeated chunks of lines, and repeated passages of over 50 words in whole
   lines, go; a document of which nothing is left goes.
3. ``near_dedup``: of each group of near duplicates (five-word shingles, Jaccard 0.8) the document
   with the smallest id stays. Documents without words, or without an id, stay.
4. ``decontaminate``: documents with a benchmark passage go.
5. ``pack``: all that is left becomes sequences of 2048 tokens.

Rows that repeat an id share the fate of that id; empty input gives empty output of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import table
from fleetgrid.llm.bottomk import near_duplicates
from fleetgrid.llm.fertility import fertility
from fleetgrid.llm.linechunks import remove_repeated_chunks
from fleetgrid.llm.packing import pack
from fleetgrid.llm.queries import vocabulary
from fleetgrid.llm.seeds import without_contaminated
from fleetgrid.session import work_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows that repeat (id, text) are judged once."""
    judged = fertility(docs, vocabulary("piece_bpe_32k.model"), carry=True)
    return judged.filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks and passages of lines, ``n_chars`` counted anew; emptied ones go."""
    kept = remove_repeated_chunks(docs, passages=True).filter("n_kept_lines > 0")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    groups = near_duplicates(docs, width=5, percent=80)
    gone = groups.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack_documents),
]

# Tokenisation and component search are not SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
