"""The thin queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import chat, host_reputation, language, licenses, line_frequency, minmax, packing, pii, repeats, search, sharding, spelling, sql, winnowing
from foliospark.llm.common import stored
from foliospark.tables import table


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_frequency.line_frequency_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_removed")


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = host_reputation.host_reputation(pages, table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "bad_rate", "bad_bound")


def op2_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_exact(docs, 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = stored(packing.digest(packing.tokenize(docs, tokenizer)), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minmax.near_duplicates(docs, size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op6_column_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.remove_repeats(docs, keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnowing.digest(winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")), "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify_language(docs, keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score", "family")


def op10_bootstrap_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_personal(docs, keep=["doc_id"]), "doc_id")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_turns(rows))


def op12_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), damage=199)


def op13_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "op1_host_reputation": op1_host_reputation,
    "op2_hypergeometric_shuffle": op2_hypergeometric_shuffle,
    "op3_licenses": op3_licenses,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minmax": op5_minmax,
    "op6_column_repeats": op6_column_repeats,
    "op7_winnowing": op7_winnowing,
    "op8_line_frequency": op8_line_frequency,
    "op9_language": op9_language,
    "op10_bootstrap_pii": op10_bootstrap_pii,
    "op11_chat_format": op11_chat_format,
    "op12_variable_grams": op12_variable_grams,
    "op13_block_max_maxscore": op13_block_max_maxscore,
}
ORACLES = {
    "op1_host_reputation": sql.OP1,
    "op5_minmax": sql.OP5,
    "op6_column_repeats": sql.OP6,
    "op7_winnowing": sql.OP7,
    "op8_line_frequency": sql.OP8,
    "op11_chat_format": sql.OP11,
    "op12_variable_grams": sql.OP12,
    "op13_block_max_maxscore": sql.OP13,
}
