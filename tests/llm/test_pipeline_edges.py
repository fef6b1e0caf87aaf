"""Tables whose columns say little: no language anywhere, ids that are null or repeat."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from brindle.llm.entropy_mix import entropy_mix

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_no_language_to_learn_from(spark, tmp_path):
    texts = ["the cat and the dog", "der hund und die katze", None, "", "123 !!", "\u00e9t\u00e9"]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    for name, rows in {
        "null": [(i, t, None, "s", 0) for i, t in enumerate(texts)],
        "held": [(i, t, "en", "s", 0) for i, t in zip(held, texts)] + [(1000 + i, t, None, "s", 0) for i, t in enumerate(texts)],
        "und": [(i, t, "und", "s", 0) for i, t in enumerate(texts)],
    }.items():
        df = spark.createDataFrame(rows, SCHEMA)
        kept = corpus_pipeline.language(spark, df, "").collect()
        assert sorted(map(tuple, kept), key=repr) == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=repr)
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0


@pytest.mark.parametrize("id_of", [lambda i: None, lambda i: i % 3, lambda i: i])
def test_mix_gives_each_row_its_own_copies(spark, id_of):
    sources = ["a", "a", "a", "a", "a", "b", "c", None]
    rows = [(id_of(i), " ".join([f"w{i}"] * (1 + i % 37)), "en", sources[i % 8], i) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = corpus_pipeline.mix(spark, df, "")
    assert mixed.dtypes == df.dtypes
    got = Counter(map(tuple, mixed.collect()))
    assert set(got) <= set(rows) and max(got.values()) <= 3
    words, targets = Counter(), {}
    for row, n in got.items():
        words[row[3]] += n * len(row[1].split())
    for r in entropy_mix(df).collect():
        targets[r["source"]] = r["target"]
    assert all(abs(words[s] - t) <= 4 for s, t in targets.items())
    assert got == Counter(map(tuple, corpus_pipeline.mix(spark, df.repartition(7), "").collect()))
    if id_of(5) == 5:
        assert {r[0]: n for r, n in got.items()} == {r["doc_id"]: r["copies"] for r in entropy_mix(df).collect() if r["copies"]}
