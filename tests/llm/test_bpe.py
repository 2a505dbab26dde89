"""Encoding against the tokenizers library, the lexicon against a dictionary."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import helpers as H
from tributary.llm import bpe, columns, lexicon, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


def test_random_texts(library, encoder):
    rng = random.Random(6)
    pools = [
        "abc ABC's 'll don't ISN'T 12 ½² \t\n", "éÈêñßäÖÜ çÇ ΣΑΣ ςσ İI ıſ", "\x00\x1c\x1d\x1f\x85\xa0  　​﻿",
        "<|startoftext|><|endoftext|> <|", "日本語 中文 한국어 \U0001f600 é Å ﬁ ǅ Ⅷ", "!!!???...---***&&&%%%",
    ]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else "<|endoftext|>" for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert encoder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_character(library, encoder):
    texts = [f"a{chr(p)}b1{chr(p)} {chr(p)}{chr(p)}" for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, text


def test_forgotten_words_change_nothing(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = H.prose(6, 400)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_most_frequent_is_cut_at_a_count(spark):
    rows = [(f"w{i}", n) for i, n in enumerate([5, 5, 5, 7, 300, 301, 100_000, 2**40, 1, 1])]
    df = spark.createDataFrame(rows, "word string, n bigint").repartition(3)

    def kept(most):
        return sorted(r["n"] for r in columns.most_frequent(df, "n", most).collect())

    assert kept(0) == [] and kept(1) == [2**40] and kept(3) == [100_000, 2**40] and kept(4) == [300, 301, 100_000, 2**40]
    assert kept(5) == [7, 300, 301, 100_000, 2**40] == kept(7) and kept(8)[:3] == [5, 5, 5] and len(kept(10)) == 10
    assert columns.most_frequent(df.limit(0), "n", 5).collect() == []


def test_long_words_take_the_heap(library, encoder):
    rng = random.Random(7)
    for n in (49, 200, 20_000):
        word = "".join(rng.choice("abcdeéß") for _ in range(n))
        assert np.frombuffer(encoder.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_query_matches_the_library(spark, library):
    texts = H.texts(spark)
    rows = queries.op6_bpe(spark, H.SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_lexicon_holds_its_words_and_no_others(tmp_path):
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): [rng.randint(0, 9) for _ in range(rng.randint(0, 4))] for _ in range(3000)}
    path = tmp_path / "words"
    path.write_bytes(lexicon.compiled(words))
    found = lexicon.Lexicon(str(path))
    assert found.words == len(words)
    for word, ids in words.items():
        assert np.frombuffer(found.ids(word.encode()), "<u4").tolist() == ids
    for _ in range(3000):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 10)))
        assert (found.ids(word.encode()) is None) == (word not in words)
    assert found.ids(b"") is None and found.ids(b"abz") is None


def test_suffixes_are_shared(tmp_path):
    endings = ["ing", "ed", "ation", "ations"]
    stems = [a + b for a in "bcdfg" for b in "lmnpr"]
    path = tmp_path / "words"
    path.write_bytes(lexicon.compiled({s + e: [0] for s in stems for e in endings}))
    shared = lexicon.Lexicon(str(path)).states
    path.write_bytes(lexicon.compiled({e: [0] for e in endings}))
    assert shared <= lexicon.Lexicon(str(path)).states + 2


def test_lexicon_does_not_change_ids(spark, encoder, tmp_path):
    texts = list(H.texts(spark).values())
    words = {w for t in texts for w in encoder.pieces(t)}
    path = tmp_path / "words"
    path.write_bytes(lexicon.compiled({w: encoder.merged(w) for w in sorted(words)[::2]}))
    both = bpe.Encoder(bpe.read_vocabulary(PATH), lexicon.Lexicon(str(path)))
    assert all(both.encode(t) == encoder.encode(t) for t in texts)


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
