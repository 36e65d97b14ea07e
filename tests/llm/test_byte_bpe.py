import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import byte_bpe as B
from cairn.session import table


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(B.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(*B.load())


def test_corpus_equals_the_library(spark, data, reference):
    rows = B.encode(table(spark, data, "documents")).collect()
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    assert [list(r.ids) for r in rows] == reference([texts[r.doc_id] or "" for r in rows])


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    t = Tokenizer.from_file(B.VOCABULARY)
    t.encode_special_tokens = True
    e = B.Encoder(*_loaded())
    assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


_cache = []


def _loaded():
    if not _cache:
        _cache.append(B.load())
    return _cache[0]


def test_random_words_and_long_ones(encoder, reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdetins") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    texts += ["x" * 100_000, " " * 30_000, "ation" * 5000, "<|endoftext|>", "=" * 999, "\u001c a", "　 　"]
    got = [encoder.encode(t) for t in texts]
    assert got == reference(texts)
    assert all("".join(B.decode(i, encoder.machine.tokens)) == t for i, t in zip(got, texts))


def test_reset_keeps_results(reference):
    tokens, pairs = B.load()
    m = B.Transducer(tokens, pairs, most_states=50)
    words = ["transmitter", "modulation", "unbelievably", "zzzzqqqq", "travelling"] * 3
    assert [m.word(w.encode()) for w in words] == reference(words)


def test_broken_bytes_decode():
    tokens, _ = B.load()
    ids = [next(i for i, t in enumerate(tokens) if t == bytes([b])) for b in (0xE4, 0xB8, 0x41, 0xFF)]
    assert "".join(B.decode(ids, tokens)) == "�A�"


def test_hostile_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (None, "a", 5), (3, " ", 5)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id or 0, list(r.ids)) for r in B.encode(df).collect()) == [(0, [64]), (1, []), (2, []), (3, [220]), (3, [220])]
    assert B.encode(df.limit(0)).count() == 0
