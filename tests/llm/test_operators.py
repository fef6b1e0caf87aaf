"""The training-data operators on small tables, against brute force; nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from brindle.llm.bsi_topk import bsi_topk
from brindle.llm.cost_packing import WordEncoder, capacities, cost_packing
from brindle.llm.entropy_mix import entropy_mix
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.hd_language import hd_language
from brindle.llm.html_extract import extract, html_extract
from brindle.llm.line_dedup import line_dedup
from brindle.llm.nnpu_toxicity import Rows, fit_nnpu, nnpu_toxicity
from brindle.llm.omh_neardup import aligned_similarity, labelled_kmers, near_duplicates, order_minhash, words_of
from brindle.llm.token_attribution import attribute, token_attribution
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i}" for i in range(6000)) + "\n" + "tail line of it"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog\nshared line number one\nend", "en", "a", 1),
    (2, "Shared Line number one \nanother text altogether here now", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "\tshared line number one", "en", None, 3),
    (6, LONG, "de", "b", 4),
    (7, LONG, "de", "b", 5),
    (7, LONG, "de", "b", 5),
    (8, "été à la maison %%% don't <|endoftext|> x", "fr", "c", 6),
    (9, "!!! 123 ***", "en", "c", 7),
    (None, "a row without an id but with words", "en", "c", 8),
]
#: Names that the operators use inside.
CLASHES = ["size", "key", "rank", "copies", "keep_id", "node", "text_hash", "pos", "line", "score", "held_out_", "x", "dims", "salt", "n", "i", "h1", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, nothing):
    found = exact_dedup(docs).collect()
    texts = [r[1] or "" for r in ROWS]
    assert len(found) == len(ROWS)
    for r in found:
        same = [x[0] for x in ROWS if hashlib.sha256((x[1] or "").encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == max([i for i in same if i is not None], default=None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert len({r["text_sha256"] for r in found}) == len(set(texts))
    assert exact_dedup(nothing).count() == 0
    assert exact_dedup(docs, normalise=F.lower, counters=16).count() == len(ROWS)


def brute_lines(rows):
    blank, first = " \t\n\x0b\x0c\r", {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    order = lambda i: (i is None, i or 0)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, nothing):
    found = sorted((tuple(r) for r in line_dedup(docs).collect()), key=repr)
    assert found == brute_lines(ROWS)
    assert line_dedup(nothing).count() == 0
    many = [(i, "\n".join(f"line {j % 7} of {i % 3} and {'A' * (j % 4)}" for j in range(200 + i)), "en", "s", 0) for i in range(20)]
    assert sorted((tuple(r) for r in line_dedup(spark.createDataFrame(many, SCHEMA)).collect()), key=repr) == brute_lines(many)


def test_entropy_mix(spark, docs, nothing):
    found = entropy_mix(docs).collect()
    assert len(found) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in found)
    assert next(r for r in found if r["doc_id"] == 3)["size"] == 0
    assert entropy_mix(nothing).count() == 0
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", [None, "s1", "s2", "s10"][i % 4] if i % 3 else "s1", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (sorted(map(tuple, entropy_mix(df).collect()), key=repr) for _ in range(2))
    assert one == two
    sums = defaultdict(lambda: [0, 0, 0.0])
    for _, source, size, total, target, _, _, taken in one:
        sums[source][0] += size
        sums[source][1] += taken
        sums[source][2] = (target, total)
    assert abs(sum(t for _, _, (t, _) in sums.values()) - sum(s for s, _, _ in sums.values())) < 1e-6
    weights = dict(zip(["s1", "s10", "s2", None], [5, 2, 1, 5]))
    level = {s: t / weights[s] for s, (_, _, (t, total)) in sums.items() if t < 3 * total - 1e-6}
    assert max(level.values()) - min(level.values()) < 1e-6
    for size, taken, (target, total) in sums.values():
        assert size == total and abs(taken - target) <= 4 and target <= 3 * total + 1e-6


def test_word_encoder_is_exact():
    own = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[1] or "" for r in ROWS] + ["İstanbul ΣΑΣ don't I'LL. 'tis x' ''  \x1c a\x1cb \t\x85z é … 3.14% (a) [b]. ½.", "中文字。 かな!", "’s it’s IT’S. 's a_b _c."]
    for text, ids in zip(texts, own.ids(texts)):
        assert own.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_cost_packing(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    for options in ({}, {"group_tokens": 5000}, {"size": 64, "group_tokens": 1000}):
        size = options.get("size", 2048)
        found = [tuple(r) for r in cost_packing(docs.coalesce(1), path, **options).collect()]
        own, pieces, places = WordEncoder(path), defaultdict(list), defaultdict(list)
        for i, start, length, crc, total, sequence, offset in found:
            pieces[i].append((start, length, crc, total))
            places[sequence].append((offset, length))
        for i, text in {(r[0], r[1] or "") for r in ROWS}:
            times = sum(r[0] == i for r in ROWS)
            ids = np.append(own.ids([text])[0], 1).astype("<u4")
            assert sum(p[1] for p in pieces[i]) == len(ids) * times
            for start, length, crc, total in pieces[i]:
                assert total == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
        for listed in places.values():
            at = 0
            for offset, length in sorted(listed):
                assert offset == at
                at += length
            assert at == size or at & (at - 1) == 0 and at < size
    assert cost_packing(nothing, path).count() == 0
    assert capacities(2048 * 3 + 5, 2048) == (3, [4, 1])


def test_near_duplicates(spark, docs, nothing):
    rng = np.random.default_rng(0)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(12)]
    rows = []
    for b in range(12):
        for c in range(6):
            words = list(base[b])
            for _ in range(c if b % 2 else 8 * c):
                words[int(rng.integers(0, 120))] = "changed"
            rows.append((len(rows), " ".join(words), "en", "s", 0))
    rows += [(len(rows), " ".join(reversed(base[0])), "en", "s", 0), (len(rows) + 1, " ".join(base[1]).upper() + " !", "en", "s", 0)]
    kmers = [labelled_kmers(words_of(r[1]), 5) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if aligned_similarity(kmers[i], kmers[j], 0.8) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {r[0]: comp[i] for i, r in enumerate(rows)}
    small = [tuple(r)[:3] for r in near_duplicates(docs).collect()]
    assert sorted(small, key=repr) == sorted([(r[0], {7: 6}.get(r[0], r[0]), 3 if r[0] in (6, 7) else 1) for r in ROWS], key=repr)
    assert near_duplicates(nothing).count() == 0


def test_order_minhash_sees_order():
    words = [f"w{i}" for i in range(300)]
    a = labelled_kmers(words, 5)
    assert (order_minhash(a, 24, 3) == order_minhash(a.copy(), 24, 3)).all()
    assert (order_minhash(a, 24, 3) == order_minhash(a[::-1], 24, 3)).mean() < 0.3
    assert aligned_similarity(a, a[::-1].copy(), 0.8) == 0.0 and aligned_similarity(a, a, 0.8) == 1.0
    assert len(set(labelled_kmers(["x"] * 50, 5).tolist())) == 46


def test_language(spark, docs, nothing):
    rows = [(i, text, lang, None, 0) for i, (text, lang) in enumerate([("the cat and the dog with this", "en"), ("der hund und die katze mit nicht", "de"), ("le chat et le chien avec une", "fr")] * 8)]
    df = spark.createDataFrame(rows + [(100, "the dog and this cat", None, None, 0), (101, "und die hund nicht", None, None, 0)], SCHEMA)
    found = {r["doc_id"]: r["lang_pred"] for r in hd_language(df).collect()}
    assert all(found[i] == lang for i, _, lang, _, _ in rows) and (found[100], found[101]) == ("en", "de")
    edge = [tuple(r) for r in hd_language(docs).select("doc_id", "lang_pred", "score").collect()]
    assert len(edge) == len(ROWS) and {i for i, lang, _ in edge if lang == "und"} == {3, 4, 9} and all(0 <= s <= 1 for *_, s in edge)
    assert hd_language(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        text = list(rng.choice(words, 40)) + (["nastily" + str(rng.integers(0, 50)), "slur"] if toxic else [])
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(toxic)))
    schema = "doc_id bigint, toxic int"
    found = nnpu_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, schema)).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in held)
    none = nnpu_toxicity(docs, spark.createDataFrame([(1, None), (2, 0), (2, 0)], schema)).collect()
    assert len(none) == len(ROWS) and all(r["predicted"] == 0 for r in none)
    assert nnpu_toxicity(nothing, spark.createDataFrame([], schema)).count() == 0


def test_pu_risk_separates():
    has, lacks = np.array([0]), np.array([1])
    w, b = fit_nnpu(Rows([has] * 20, 2), Rows([has] * 10 + [lacks] * 90, 2), 0.1)
    assert w[0] + b > 0 > w[1] + b


def brute_topk(rows, k):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in ok.items():
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok.items() if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_bsi_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in np.round(rng.normal(0, 0.3, 7), 1)]) for i in range(230)]
    rows += [(300, None), (301, [0.1] * 6 + [None]), (350, [float("nan")] + [0.1] * 6), (351, [0.5, 0.5]), (400, [0.5, -0.5]), (450, []), (451, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("score", F.lit(0))
    for options in ({}, {"block_rows": 40, "block_queries": 2}):
        found = sorted(map(tuple, bsi_topk(df, F.col("vec_id") % 50 == 0, **options).collect()))
        assert found == brute_topk(rows, 5)
    assert bsi_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_token_attribution(docs, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for rule in ("most", "start"):
        found = token_attribution(docs, path, pattern, rule=rule).collect()
        for i, text in {(r[0], r[1] or "") for r in ROWS}:
            mine = [r for r in found if r["doc_id"] == i]
            times = sum(r[0] == i for r in ROWS)
            n = len(whole.encode(text, add_special_tokens=False).ids) if text else 0
            assert sum(r["n_tokens"] for r in mine) == n * times and {r["doc_tokens"] for r in mine} == {n}
            assert len(mine) == len(text.split("\n")) * times
    assert token_attribution(nothing, path, pattern).count() == 0
    sections = np.array([[0, 4], [6, 10]])
    start, stop = np.array([0, 3, 4, 5, 8]), np.array([3, 7, 6, 9, 10])
    assert attribute(start, stop, sections, "start")[0].tolist() == [4, 1]
    n, crossing = attribute(start, stop, sections, "most")
    assert n.tolist() == [3, 2] and crossing.tolist() == [2, 1]  # a tie (3-7) goes to the earlier section, a gap to the one before


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and many others for reasons of ours that nobody reads.</div>
<article><h1>Title &amp; more</h1><p>First  paragraph with <b>bold</b>
words &lt;here&gt; and enough of them to read on.<p>Short.<br>Line two<!-- note --></p><ul><li>An item of the text, not a link</li></ul></article>
<aside>Related: a long list of things that stand beside the text of the page and are not of it.</aside>
<section id="comments"><article><p>I liked this article very much, and here are many words to say so at length.</p></article></section>
<form><label>Your name</label><textarea>x</textarea></form><footer>&copy; Site</footer></body></html>"""


def test_html_extract(spark):
    wanted = "Title & more\nFirst paragraph with bold words <here> and enough of them to read on.\nShort.\nLine two\nAn item of the text, not a link"
    assert extract(PAGE) == wanted
    plain = "<div><p>" + "A page without an article element has paragraphs of many words all the same. " * 3 + "</p></div><div><a href=/>one</a> <a href=/>two</a></div>"
    assert extract(plain).startswith("A page") and "two" not in extract(plain)
    assert extract("") == "" and extract("<p") == "" and extract("<article><p>cut off in the") == "cut off in the"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    found = html_extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 0), (1, len(wanted)), (1, len(wanted)), (2, 0), (3, 249_999)]
    assert html_extract(df.limit(0)).count() == 0
