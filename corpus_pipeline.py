"""The corpus pipeline: five stages, each on all that the one before it kept.

Quality rules reject documents, near-duplicate groups keep one document each,
contaminated documents go, personal data is masked, and what is left is packed
into sequences. Every stage but the last returns the columns of documents.

Defined cases, for every stage
  columns of documents         pass all stages but the last unchanged, whatever their names, but for text and n_chars
                               where a stage changes the text; operators see only the columns that they work on
  null or empty text           rejected by the quality rules; other stages keep it, the last packs its end mark
  null doc_id                  a document like any other; it never stands for a group of near copies with an id
  repeated rows                judged alike; the second stage keeps one
  ties                         the smallest doc_id of a group of near copies stays
  very long text               whole in every stage, held by one task; the last cuts it into pieces
  empty table                  empty result
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import line_frequency, minmax, packing, pii, winnowing
from foliospark.llm.common import all_columns, own_columns, stored
from foliospark.tables import table

#: The tokenizer's file, on every machine.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Documents that a sequence holds at most.
DOCUMENTS = 64


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are frequent at their host."""
    judged = line_frequency.line_frequency_rules(own_columns(docs, "text", "source"))
    fresh = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    judged = stored(judged.select(F.struct(*all_columns(docs.columns, "text", "source", **fresh)).alias("row"), "kept"), "judged")
    return judged.filter("kept").select("row.*")  # stored, as a filter would have the rules evaluated twice


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    kept = minmax.keep_one(own_columns(docs, "doc_id", "text"), size=5, percent=80)
    return kept.select(*all_columns(docs.columns, "doc_id", "text"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    judged = winnowing.decontaminate(own_columns(docs, "text"), table(spark, sf_dir, "benchmark"))
    return judged.filter("not contaminated").select(*all_columns(docs.columns, "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts."""
    masked = pii.redact(own_columns(docs, "text"))
    fresh = {"n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return masked.select(*all_columns(docs.columns, "text", **fresh))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their ids, and the sequence and the place that each is packed into."""
    return packing.pack(stored(packing.tokenize(docs.select("doc_id", "text"), TOKENIZER), "pieces"), documents=DOCUMENTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can express neither the near-duplicate groups nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
