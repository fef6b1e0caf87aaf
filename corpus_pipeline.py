"""From raw documents to packed sequences: the stages of a training corpus, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.cost_packing import cost_packing
from brindle.llm.entropy_mix import entropy_mix
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.hd_language import hd_language
from brindle.llm.omh_neardup import near_duplicates
from brindle.llm.shared import checkpoint_dir, remainder, text_of

#: No SQL expresses learned languages, sketches and balanced copies.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed to column_0 ... in order, which clash with nothing that an operator adds, and the new names of the first
    columns that have the old ones."""
    names = {c: f"column_{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))]), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that have no language (null texts, texts without a letter). Learned as op8 is: the
    rows with crc32(doc_id as text) mod 4 = 2 take no part. If nothing can be learned (no row that takes part has
    a language), every text with a letter stays all the same.

    Nulls: a null text goes, a null id or language is no reason to. Rows that share an id, and equal rows, stand or fall by
    themselves. Ties between languages change nothing here. Texts are read whole, however long. An empty table
    stays empty. Other columns come along, whatever their names."""
    plain, at = _plain(docs)
    others = tuple(c for c in plain.columns if c not in (at["doc_id"], at["text"]))
    found = hd_language(plain, remainder(F.col(at["doc_id"]), 4) != 2, at["doc_id"], at["text"], at["lang"], keep=others, keep_text=True, tell_letters=True)
    back = {at["doc_id"]: F.col("doc_id"), at["text"]: F.col("text")}
    return found.where("has_letter").select(*[back.get(c, F.col(f"kept.{c}")) for c in plain.columns]).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts keep the one with the largest doc_id; a row that repeats with its id stays as often.

    Nulls: a null text is an empty one; a null id is the smallest. There are no ties but between rows of one id, which
    all stay. Texts count whole, however long. An empty table stays empty. Other columns come along, whatever their names."""
    plain, at = _plain(docs)
    kept = exact_dedup(plain, at["doc_id"], at["text"]).where("kept").select("doc_id", "text_sha256").distinct()
    same = F.col(at["doc_id"]).eqNullSafe(kept["doc_id"]) & (F.sha2(text_of(F.col(at["text"])), 256) == kept["text_sha256"])
    return plain.join(kept, same, "left_semi").toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates keep the document with the smallest doc_id; rows that share an id stand or fall together.

    Nulls: a null or empty text is like no other and stays; a null id is the largest. There are no ties but between
    rows of one id. Texts count whole, however long. An empty table stays empty. Other columns come along, whatever
    their names."""
    plain, at = _plain(docs)
    kept = near_duplicates(plain, at["doc_id"], at["text"]).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    return plain.join(kept, F.col(at["doc_id"]).eqNullSafe(kept["doc_id"]), "left_semi").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources come near their target shares of words. Each copy is a
    row; every row is repeated by its own copies, also where ids are null or repeat.

    Nulls: a null text has no words and is left out; a null source is one of its own, the last. Equal rows may change
    places. Texts count whole, however long. An empty table stays empty. Other columns come along, whatever their
    names."""
    plain, at = _plain(docs)
    found = entropy_mix(plain, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"], keep=tuple(plain.columns)).where("copies > 0")
    return found.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("kept.*").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens; each copy of a document is packed on its own.

    Nulls: a null text is an empty one, of one token; a null id stays. Equal rows are documents of their own. Texts longer than
    a sequence are cut. An empty table gives no pieces. Other columns, whatever their names, are left."""
    plain, at = _plain(docs)
    return cost_packing(plain, public_tokenizers.path("word_bpe_49k.json"), at["doc_id"], at["text"])


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("packing", pack)]


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later stage reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage returns is written to the shared folder and read again as the next one's
    input; then what that stage read is deleted. The last stage's input stays, as its rows are computed when they are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _drop(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
