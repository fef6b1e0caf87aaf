"""The registered queries of this package: thin wrappers that give the operators their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bsi_topk, exact_dedup, line_dedup
from brindle.llm.cost_packing import cost_packing
from brindle.llm.entropy_mix import entropy_mix
from brindle.llm.hd_language import hd_language
from brindle.llm.html_extract import html_extract
from brindle.llm.nnpu_toxicity import nnpu_toxicity
from brindle.llm.omh_neardup import near_duplicates
from brindle.llm.shared import remainder, table
from brindle.llm.token_attribution import token_attribution


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op7_omh_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    found = hd_language(docs.select("doc_id", "text", "lang", held.alias("held_out")), ~F.col("held_out"), keep=("held_out",))
    return found.select("doc_id", "kept.held_out", "lang_pred", "score")


def op9_bsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi_topk.bsi_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_token_attribution, op2_entropy_mix, op3_nnpu_toxicity, op4_line_dedup, op5_exact_dedup, op6_html_extract, op7_omh_neardup, op8_hd_language, op9_bsi_topk, op10_cost_packing)}

ORACLE_SQL = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_bsi_topk": bsi_topk.ORACLE_SQL,
}
