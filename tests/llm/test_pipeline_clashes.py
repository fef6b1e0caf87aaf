"""Stages on a table with extra columns that have the names which operators use inside, and with columns of every kind."""

from collections import Counter

import pytest

import corpus_pipeline
from brindle.llm.hd_language import hd_language
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ["score", "lang_pred", "has_letter", "kept", "kept_id", "kept_text", "text_sha256", "keep_id", "copy", "copies", "times", "mix_id", "size", "rank", "col", "class_id", "node", "column_0", "Text", "key", "salt"]
ROWS = [(1, "the cat sat on the mat with a hat", "en", "a", 1), (2, "the cat sat on the mat with a hat", "en", "a", 2), (3, "der hund und die katze im haus", "de", "b", 3), (4, None, "en", None, None), (5, "", None, "a", 0), (None, "a row that has no id", "en", None, 7), (6, "123", None, "b", 8), (3, "der hund und die katze im haus", "de", "b", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = [F.concat(F.lit(n + " "), F.coalesce("n_chars", F.lit(-1))).alias(n) for n in NAMES if n != "Text"]
    return df.select("*", *extra, F.array("n_chars").alias("list"), F.struct("source", "n_chars").alias("pair"), F.col("n_chars").cast("decimal(20,2)").alias("money"))


@pytest.mark.parametrize("number", range(4))
def test_clashing_columns_come_along(spark, docs, number):
    stage = corpus_pipeline.STAGES[number][1]
    out, bare = stage(spark, docs, ""), stage(spark, spark.createDataFrame(ROWS, SCHEMA), "")
    assert out.dtypes == docs.dtypes
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(map(tuple, bare.collect()))
    given = {repr(r) for r in docs.collect()}
    assert all(repr(r) in given for r in out.collect())
    assert stage(spark, docs.limit(0), "").count() == 0


def test_packing_leaves_other_columns(spark, docs):
    wide = docs.select("*", F.lit(1).alias("start"), F.lit("x").alias("offset"), F.lit(0).alias("sequence_id"))
    pack = corpus_pipeline.STAGES[4][1]
    assert sorted(map(repr, pack(spark, wide.coalesce(1), "").collect())) == sorted(map(repr, pack(spark, spark.createDataFrame(ROWS, SCHEMA).coalesce(1), "").collect()))


def test_a_column_whose_name_differs_in_case(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        wide = df.withColumn("Text", F.lit("TEXT"))
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, wide, "").columns == wide.columns
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_kept_columns_of_language(spark, docs):
    found = hd_language(docs, keep=("score", "lang_pred", "list"))
    assert found.columns == ["doc_id", "lang_pred", "score", "kept"] and {r["kept"]["score"].split()[0] for r in found.collect()} == {"score"}
    with pytest.raises(ValueError):
        from brindle.llm.hd_language import learn

        learn(docs.withColumn("lang", F.col("score")), most=2)


def test_entry_does_not_hide_import_errors():
    from pathlib import Path

    source = (Path(corpus_pipeline.__file__).parent / "__spark_entry__.py").read_text()
    assert "except ModuleNotFoundError" in source and "raise" in source
