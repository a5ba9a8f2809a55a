"""Very long pre-tokens: chunks side by side equal the library, pairs equal plain merging, caches are bounded in bytes."""

import random

import numpy as np
import pytest

from runtrail.llm import fingerprints, longwords, tokens


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter(path):
    return tokens.Counter(path)


@pytest.fixture(scope="module")
def library(path):
    whole = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


def words():
    pick = random.Random(1)
    letters = lambda alphabet, n: "".join(pick.choice(alphabet) for _ in range(n))
    out = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (65, 95, 96, 97, 127, 128, 129, 192, 193, 300, 20_000)]
    out += ["a" * 5000, "ab" * 3000, "xyz" * 2000 + "q", "=" * 7000, "-" * 130 + "=" * 130, "the" * 3000, "thequickbrownfoxjumps" * 200, "日本語テキスト" * 500, "é" * 999, letters("étaoinshrdlu", 3000), letters("日本語中文字", 2000)]
    return out


def test_long_words_equal_the_library(counter, library):
    for text in words():
        assert counter.counts([text]).tolist() == [library(text)], text[:20]
    mixed = [" ".join(words()), None, "", "word " + words()[0] * 40 + " word", words()[-1], words()[-1]]
    assert counter.counts(mixed).tolist() == [library(t or "") for t in mixed]


def test_most_long_words_need_no_state_by_state_pass(counter):
    table = longwords.LongWords(counter.merges)
    got = table.counts([w.encode() for w in words()])
    assert (got >= 0).mean() > 0.8 and table.counts([]).tolist() == []


def test_pairs_equal_plain_merging(counter, monkeypatch):
    monkeypatch.setattr(longwords, "SLOT_BITS", 6)  # answers are overwritten all the time
    table = longwords.LongWords(counter.merges)
    names = [bytes([b]) for b in range(256)] + [a + b for a, b in counter.merges]
    pick = np.random.default_rng(2)
    first, second = (np.concatenate((pick.integers(0, len(names), 1500), pick.integers(0, 1500, 3000))) for _ in range(2))
    wanted = [counter.merger.merged(names[a] + names[b]) == [names[a], names[b]] for a, b in zip(first, second)]
    assert table.compatible(first, second).tolist() == wanted == table.compatible(first, second).tolist()


def test_a_vocabulary_with_a_product_of_two_merges_is_left_to_the_transducer():
    pairs = [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")]
    assert not longwords.LongWords(pairs).usable


def test_caches_hold_short_words_only(counter):
    counter.words.clear()
    counter.counts(["x" * 5000 + " short"])
    assert set(map(len, counter.words)) <= set(range(tokens.LONG + 1)) and counter.words
    fingerprints._WORDS.clear()
    hashes = fingerprints.word_hashes([b"short", b"y" * 5000, b"short"])
    assert list(fingerprints._WORDS) == [b"short"] and hashes[0] == hashes[2] != hashes[1]
