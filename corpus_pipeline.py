"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, packing.

A stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept, as documents written to
Parquet and read again; all but the last return the columns of documents, those that it does not know among them. Rows
that repeat a doc_id are documents of their own, very long texts are read whole, ties go to the smallest doc_id, and an
empty table stays empty. SQL cannot express the stages (trained
spans, hashed draws, token ids), so ORACLE_SQL is None and tests/llm compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import exact_dedup, language_id, mixing, ngram_join, packing
from sparkfolio.llm.common import held_out, stored, table, unused

#: A document goes if no language is found or the most frequent one holds less than this share of its letters.
LEAST_LANGUAGE = 0.5
#: Five-word shingles, Jaccard similarity 4/5 or more.
SHINGLE, NUM, DEN = 5, 4, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; where `lang` is null it becomes the language found. Null, empty and letterless texts go."""
    model = language_id.train(docs.where(~held_out()))
    own = unused(docs, "_folio_")
    found = language_id.identify(docs, model, prefix=own)
    kept = found.where((F.col(f"{own}lang_pred") != "und") & (F.col(f"{own}lang_score") >= LEAST_LANGUAGE))
    return kept.withColumn("lang", F.coalesce("lang", f"{own}lang_pred")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the one with the smallest doc_id; null texts count as empty ones."""
    return exact_dedup.kept_rows(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of near copies connect, the document with the smallest doc_id. Rows without a doc_id or without words stay."""
    classes = ngram_join.similarity_classes(docs, SHINGLE, NUM, DEN, count_links=False)
    key = unused(docs, "_folio_gone")
    gone = stored(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked shares of sources, languages and topics; a null source or language is one of its own."""
    return mixing.sampled_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with the sequence and the offset of each; a null text is empty and still has its end token."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
