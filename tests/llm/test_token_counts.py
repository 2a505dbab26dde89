"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import helpers as H
from tributary.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_vocabulary(PATH))


def _library(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character(library, counter):
    texts = [f"a{chr(p)}b1{chr(p)}" for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        assert [counter.count(t) for t in part] == _library(library, part)


def test_random_texts(library, counter):
    rng = random.Random(11)
    pools = ["abc ABC's 'll don't ISN'T 12 ½²  \t\n", "éÈêñßäÖ \x85\xa0  　", "日本語 \U0001f600", "!!!...   ---\n\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else "<|endoftext|>" for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == _library(library, texts)


def test_long_words_and_texts(library, counter, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (2, 70, 300, 50_000)] + [" " * 30_000, "ab " * 20_000, "a" * 9_999]
    assert [counter.count(t) for t in texts] == _library(library, texts)
    monkeypatch.setattr(token_counts, "WHOLE", 10)
    assert [counter.count(t) for t in texts] == _library(library, texts)


def test_forgotten_words_change_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    text = H.prose(5, 500)
    assert [counter.count(text)] == _library(library, [text])


def test_query_matches_the_library(spark, library):
    texts = H.texts(spark)
    rows = queries.op11_token_counts(spark, H.SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = _library(library, [texts[r["doc_id"]] or ""])[0]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 512)


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
