"""Corpus cleaning in stages: each stage is (name, function of (spark, docs, sf_dir)).

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import attention_mil, bpe_trie, fuzzy_lines, positional_index, queries, superminhash
from pitchside.sources.stage import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Jaccard similarity of 5-word shingles from which documents are near duplicates.
NEAR = (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 10) does not reject.

    Each row is judged by its own text, so repeated rows share their lot; null and empty texts are scored as a text without words.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return attention_mil.keep_good(docs, queries.quality_model(docs, labels), queries.QUALITY_THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat a line kept elsewhere (operator 2).

    ``n_chars`` follows the text where it changed; a document of which only blank lines would be left goes.
    Null and empty texts and rows with a null id stay as they are; rows that share an id count as versions of one document.
    """
    # Columns that the operator adds are put aside under other names where documents have them already.
    aside = {c: f"_{c}_of_documents" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = fuzzy_lines.dedup_lines(docs.withColumnsRenamed(aside))
    changed = F.col("n_removed") > 0
    out = out.filter(~changed | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near duplicates (operator 9).

    Rows with a null id and texts without words are in no group; of fully repeated rows one stays; a row that
    only shares its id with a near duplicate stays. Clashing column names are kept as they are.
    """
    return superminhash.first_of_groups(docs, numerator=NEAR[0], denominator=NEAR[1]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not contaminate (operator 6).

    Null and empty texts have no words and stay; repeated rows share their lot; null ids are compared like any other.
    """
    return positional_index.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit numbers), their number and the decoded text of every document (operator 4).

    One row per row of ``docs``, repeated ones and null ids included; null and empty texts have no tokens.
    """
    coded = bpe_trie.encode_documents(docs, queries.TOKENIZER, keep_encoder=False)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("bpe_encoding", encode)]

#: SQL cannot express the classifier's stage; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
