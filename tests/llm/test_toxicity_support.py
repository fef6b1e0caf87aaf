"""Toxic words that few toxic texts have: features are counted over all of them, by one rule at any size."""

import numpy as np

from brindle.llm.nnpu_toxicity import nnpu_toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_rare_toxic_words_become_features(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    plain, slurs = [word() for _ in range(50)], [word() for _ in range(150)]
    rows, labels = [], []
    for i in range(7500):
        toxic = i % 5 == 0
        rows.append((i, " ".join([*rng.choice(plain, 8), *([slurs[i // 5 % 150]] if toxic else [])]), "en", "s", 0))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = [r for r in nnpu_toxicity(docs, marks, max_positive=1000).collect() if r["held_out"]]
    caught = [r["predicted"] for r in held if r["doc_id"] % 5 == 0]
    assert sum(caught) >= 0.9 * len(caught)
    assert not any(r["predicted"] for r in held if r["doc_id"] % 5)
