"""Token ids by parts against the tokenizer, on seeded random texts and on letters that change their number in lower case."""

import random
import sys
import unicodedata

import public_tokenizers
import pytest

from brindle.llm.cost_packing import TAIL, WordEncoder


@pytest.fixture(scope="module")
def own():
    return WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def differences(own, texts):
    want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [t for t, ids, w in zip(texts, own.ids(texts), want) if ids.tolist() != w]


def test_dotted_capital_before_punctuation(own):
    texts = ["DEVLET\u0130.", "T\u00dcRK\u0130YE CUMHUR\u0130YET\u0130, ANKARA", "REJ\u0130M\u0130)", "\u0130", "\u0130!", "i\u0307.", "I\u0307?", "\u0130\u0130.,x", "\u01f0.", "\u1e9e!", "\u03a3\u0391\u03a3.", "\u212a.", "\u2126;"]
    assert differences(own, texts) == []


def test_every_letter_before_punctuation(own):
    letters = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM" and not (0x3400 <= c < 0x9FFF or 0xAC00 <= c < 0xD7A4 or 0x17000 <= c < 0x18D00 or 0x12000 <= c < 0x14700)]
    assert differences(own, [f"a{c}. {c}) x" for c in letters]) == []


def test_random_texts(own):
    rng = random.Random(11)
    alphabet = "abcXYZ\u00e9\u00c9\u00df\u0130\u0131\u01c5\u0391\u03a3\u03c2\u0416\u4e2d\u3042\uac00\u1100\u1161\u0301\u0307\u0308\u00bd\u2167\u0663\u00b2 '\u2019-_\n\t\u00a0\u0085\x1c\u200b\u2028" + TAIL
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 24))) for _ in range(24_000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x250, 0x2FFF), rng.randint(0xE000, min(sys.maxunicode, 0x1F9FF))])) for _ in range(rng.randint(1, 12))) + rng.choice(TAIL) for _ in range(6_000)]
    assert differences(own, texts) == []
