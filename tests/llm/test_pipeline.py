"""The corpus pipeline on a small table: every stage on what the one before kept, and its decisions against brute force."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from brindle.llm.omh_neardup import aligned_similarity, labelled_kmers, words_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = np.random.default_rng(4)
    words = {lang: [lang + w for w in "abel bro cul dim est fan gor hul".split()] for lang in ("en", "de")}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang], int(rng.integers(20, 80)))), lang, f"s{i % 4}" if i % 7 else None, 0))
    for i in range(120, 140):  # exact copies, then near ones
        rows.append((i, rows[i - 120][1], rows[i - 120][2], "s1", 0))
    for i in range(140, 150):
        rows.append((i, rows[i - 100][1] + " more", rows[i - 100][2], "s2", 0))
    return rows + [(150, None, "en", "s1", 0), (151, "", None, None, None), (152, "123 !!", "en", "s1", 0), (None, "enabel without an id", "en", "s1", 0)]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing", "packing"]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert number == 4 or out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        kept.append(docs.collect())
    texts = {r[0]: r[1] for r in rows}
    assert {r["doc_id"] for r in kept[0]} == set(texts) - {150, 151, 152}
    winners = {}
    for r in kept[0]:
        winners[r["text"]] = max(winners.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert {r["doc_id"] for r in kept[1]} == {None if i == -1 else i for i in winners.values()}
    ids = sorted((r["doc_id"] for r in kept[1]), key=lambda i: (i is None, i))
    kmers = {i: labelled_kmers(words_of(texts[i]), 5) for i in ids}
    comp = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if comp[i] != comp[j] and aligned_similarity(kmers[i], kmers[j], 0.8):
                old, new = comp[i], comp[j]
                comp = {k: new if c == old else c for k, c in comp.items()}
    first = {}
    for i in ids:
        first.setdefault(comp[i], i)
    assert {r["doc_id"] for r in kept[2]} == set(first.values())
    copies = defaultdict(int)
    for r in kept[3]:
        copies[r["doc_id"]] += 1
        assert r["text"] == texts[r["doc_id"]]
    assert set(copies) <= {r["doc_id"] for r in kept[2]} and max(copies.values()) <= 3
    pieces = defaultdict(int)
    for r in kept[4]:
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {i: total // tokens for (i, tokens), total in pieces.items()} == dict(copies)
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
