"""Parts of the operators against plain versions of the same: gradients, the dual's optimum, alignments, vectors, sections."""

import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from brindle.llm.entropy_mix import entropy_mix, source_targets
from brindle.llm.hd_language import Space, hd_language, letters
from brindle.llm.nnpu_toxicity import Rows, direction, nnpu_toxicity, risks
from brindle.llm.omh_neardup import aligned_similarity, labelled_kmers
from brindle.llm.token_attribution import spans, token_attribution

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("prior", [0.05, 0.4, 0.9])
def test_gradient_of_the_risk(prior):
    rng = np.random.default_rng(7)
    draw = lambda n: Rows([np.nonzero(rng.random(6) < 0.5)[0] for _ in range(n)], 6)
    xp, xu, signs = draw(20), draw(50), set()
    for _ in range(30):
        w = rng.normal(0, 3, 7)
        negative = risks(xp, xu, w, prior)[1] >= 0
        signs.add(negative)
        aim = (lambda v: sum(risks(xp, xu, v, prior))) if negative else (lambda v: -2 * risks(xp, xu, v, prior)[1])
        numeric = [(aim(w + 1e-6 * e) - aim(w - 1e-6 * e)) / 2e-6 for e in np.eye(7)]
        assert np.allclose(direction(xp, xu, w, prior, 2.0), numeric, atol=1e-6)
    assert prior < 0.9 or signs == {True, False}


def test_ids_by_shuffle_or_broadcast_are_the_same(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" slurword" if i % 9 == 0 else ""), "en", "s", 0) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    one, two = (sorted(map(tuple, nnpu_toxicity(docs, labels, broadcast_rows=n).collect())) for n in (0, 1000))
    assert one == two and sum(r[3] for r in one) == 34


def brute_targets(sizes, weights, cap):
    """Share out by weight again and again, until no source is above its cap."""
    keys, whole = sorted(sizes, key=lambda s: (s is None, s)), sum(sizes.values())
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    full = set()
    while True:
        spare, open_weight = whole - sum(cap * sizes[k] for k in full), sum(weight[k] for k in keys if k not in full)
        over = {k for k in keys if k not in full and spare * weight[k] / open_weight > cap * sizes[k]}
        if not over:
            return {k: cap * sizes[k] if k in full else spare * weight[k] / open_weight for k in keys}
        full |= over


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        sizes = {f"host{i:04d}": int(x) for i, x in enumerate(rng.pareto(0.7, n) * 20 + 1)}
        frame = spark.createDataFrame(list(sizes.items()), "key string, total long").repartition(7)
        found = {r["key"]: r["target"] for r in source_targets(frame, (5, 2, 1), 3.0).collect()}
        want = brute_targets(sizes, (5, 2, 1), 3.0)
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)


def brute_tilt(sizes, target, cap):
    """The multiplier whose rates min(cap, exp(lam * size)) give the target, by halving an interval."""
    got = lambda lam: sum(s * min(cap, math.exp(min(50, lam * s))) for s in sizes)
    low, high = -50.0, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if got(middle) < target else (low, middle)
    return low


def test_rates_are_the_optimum_and_rounding_is_tight(spark):
    rng = np.random.default_rng(9)
    rows = []
    for source, n, largest in (("a", 40, 30), ("b", 200, 300), ("c", 25, 2000), (None, 90, 60)):
        rows += [(len(rows) + i, " ".join(["w"] * (1 if i == 0 else int(rng.integers(1, largest)))), "en", source, 0) for i in range(n)]
    rows.append((len(rows), " ".join(["w"] * 20_000), "en", "b", 0))
    found = entropy_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    want = brute_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()}, (5, 2, 1), 3.0)
    for source, listed in by.items():
        target, sizes = listed[0]["target"], [r["size"] for r in listed]
        assert math.isclose(target, want[source], rel_tol=1e-9)
        if target < 3 * sum(sizes) * (1 - 1e-9):
            lam = brute_tilt(sizes, target, 3.0)
            assert all(math.isclose(r["rate"], min(3.0, math.exp(lam * r["size"])), rel_tol=1e-4, abs_tol=1e-9) for r in listed)
        assert all(0 <= r["copies"] <= 3 for r in listed)
        assert sum(abs(r["copies"] - r["rate"]) >= 1 for r in listed) <= len(listed) / 10
        smallest = sorted(set(sizes))[2 if source == "c" else 0]  # c has two short documents, which can't make up for much
        assert abs(sum(r["taken"] for r in listed) - target) <= smallest / 2 + 1e-6


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(2)
    hits = 0
    for _ in range(400):
        words = [f"w{x}" for x in rng.integers(0, 12, int(rng.integers(5, 40)))]
        other = list(words)
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(other)))
            other[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(0, 9)}"] * int(rng.integers(0, 2))
            other = other or ["x"]
        if rng.random() < 0.2:
            cut = int(rng.integers(0, len(other)))
            other = other[cut:] + other[:cut]
        a, b = labelled_kmers(words, 2), labelled_kmers(other, 2)
        n = lcs(a.tolist(), b.tolist())
        true = n / (len(a) + len(b) - n)
        found = aligned_similarity(a, b, 0.6)
        assert math.isclose(found, true) if true >= 0.6 else found == 0.0
        hits += true >= 0.6
    assert hits > 50


def test_bundles_are_sums_of_bound_vectors():
    own, text = Space(64, 3, 5), "Ab éc, dab\U0001d400 ab"
    symbols = letters(text).tolist()
    total = np.zeros(64)
    for i in range(len(symbols) - 2):
        bound = np.ones(64)
        for k in range(3):
            bound *= np.roll(own.atoms[symbols[i + k]].astype(float), 2 - k)
        total += bound
    assert np.allclose(own.bundles([letters(text)])[0], total / np.linalg.norm(total), atol=1e-6)


def test_language_by_explicit_prototypes(spark):
    rng = np.random.default_rng(6)
    words = {lang: ["".join(rng.choice(list(alphabet), 5)) for _ in range(30)] for lang, alphabet in (("aa", "abcdef"), ("bb", "efghij"), ("cc", "hijabc"))}
    rows = [(i, " ".join(rng.choice(words[lang], 8)), lang if i % 5 else None, None, 0) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in hd_language(spark.createDataFrame(rows, SCHEMA).repartition(3), dims=256).collect()}
    own = Space(256, 3, 5)
    vectors = own.bundles([letters(r[1]) for r in rows])
    langs = ["aa", "bb", "cc"]
    prototypes = np.array([sum(v for v, r in zip(vectors, rows) if r[2] == lang) for lang in langs])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    centred = prototypes - prototypes.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    for r, v in zip(rows, vectors):
        best = int(np.argmax(centred @ v))
        assert found[r[0]][0] == langs[best] and math.isclose(found[r[0]][1], max(0, float(prototypes[best] @ v)), abs_tol=1e-4)


def test_sections_by_character(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = np.random.default_rng(4)
    pieces = ["the cat", "\n", "\n\n", "déjà vu", "中文", " ", "\U0001f600\U0001f601", "x" * 9, "\t", "", "end.\n", " 12345"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(150)]
    found = defaultdict(dict)
    for r in token_attribution(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), path, pattern).collect():
        found[r["doc_id"]][r["section"]] = (r["start"], r["stop"], r["n_tokens"], r["n_crossing"])
    for i, text in enumerate(texts):
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        counts, crossing = [0] * len(lines), [0] * len(lines)
        for a, b in zip(*(x.tolist() for x in spans(text, path, pattern))) if text else ():
            held = [sum(lo <= c < hi for c in range(a, b)) for lo, hi in lines]
            first = max(k for k, (lo, _) in enumerate(lines) if lo <= a)
            best = max(range(len(lines)), key=lambda k: (held[k], -k)) if any(held) else first
            counts[best] += 1
            crossing[best] += not (lines[best][0] <= a and b <= lines[best][1])
        assert [found[i][k] for k in range(len(lines))] == [(lo, hi, n, c) for (lo, hi), n, c in zip(lines, counts, crossing)]


def test_components_of_stars_chains_and_cycles(spark):
    from brindle.llm.components import components

    rng = np.random.default_rng(3)
    edges = [(f"h{0:05d}", f"h{i:05d}") for i in range(1, 600)] + [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(70)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s", "s")]
    edges += [(f"x{a:05d}", f"x{b:05d}") for a, b in rng.integers(0, 400, (250, 2)).tolist()]
    edges += edges[:40]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges, "a string, b string")
    for per_task in (100_000, 50):
        assert {r["node"]: r["comp"] for r in components(df, per_task=per_task).collect()} == {x: find(x) for x in list(root)}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{"block": 300}, {"block_nodes": 3}, {"block": 2_000, "block_nodes": 4, "min_shared": 1}, {}])
def test_blocks_lose_no_link(spark, options):
    """A bucket that all texts share (a long common passage), short texts, and one text far longer than a block."""
    from brindle.llm.omh_neardup import near_duplicates, words_of

    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(160)]
    texts = []
    for i in range(30):
        own = [f"o{i}x{j}" for j in range(int(rng.integers(5, 60)))]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + ["end"])]
    texts += ["one two three four five six seven eight nine", "one two three four five six seven eight", "one two three four", "One two, three four!", "a b", "a b c"]
    long = [f"w{x}" for x in rng.integers(0, 3000, 6000)]
    texts += [" ".join(long), " ".join(long[:5990]), " ".join(reversed(long))]
    kmers = [labelled_kmers(words_of(t), 5) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and aligned_similarity(kmers[i], kmers[j], 0.8):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    found = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), **options).collect()}
    assert found == {i: (c, comp.count(c)) for i, c in enumerate(comp)}
