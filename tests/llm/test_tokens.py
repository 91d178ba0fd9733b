import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import tokens as K

FILE = f"{K.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files here")
SCHEMA = "doc_id bigint, text string, ids string"
TEXTS = [None, "", " ", "\n\n", "Hello world", "<|endoftext|> x", "a" * 30000, "Ω привіт ñ 東京 🙂🙃", "it's we'll I'D  x\t\ty", "é ­﻿", "1,234.56€ §12(3)b", "\x00\x7f", "=" * 999]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_as_the_public_tokenizer(public):
    own = K.automaton(FILE)
    for t in TEXTS:
        assert own.encode_text(t) == (public(t) if t else []), t
        assert own.decode(own.encode_text(t)) == (t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abehtrnisEAéñ' .\n0"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(public, t):
    own = K.automaton(FILE)
    assert own.encode_text(t) == public(t)
    assert own.decode(own.encode_text(t)) == t


def naive(merges, word):
    """Merge the pair of least rank until none is left."""
    rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(merges)}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]
        if not found:
            return word
        (_, new), i = min(found)
        word = word[:i] + [new] + word[i + 2 :]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_any_merges(data):
    """Random small vocabularies, repeated letters and unreachable merges included."""
    labels, merges = {0: b"a", 1: b"b"}, []
    for _ in range(data.draw(st.integers(0, 8))):
        a, b = (data.draw(st.sampled_from(sorted(labels))) for _ in "ab")
        if labels[a] + labels[b] not in labels.values():
            labels[len(labels)] = labels[a] + labels[b]
            merges.append((a, b, len(labels) - 1))
    word = data.draw(st.text("ab", min_size=1, max_size=14)).encode()
    assert K.Automaton(merges, labels).encode(word) == naive(merges, [x - 97 for x in word])


def test_memory_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(K, "MEMORY", 3)
    own = K.Automaton(*K.load(FILE))
    t = "one two three four five six one two three " * 3
    assert own.encode_text(t) == public(t)


def test_table(spark, public):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "x", ""), (4, "Hello world", "")], SCHEMA)
    got = K.encode(df)
    assert got.columns == ["doc_id", "ids"] and got.schema["ids"].dataType.simpleString() == "array<int>"
    by = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert by[0] == [] and by[1] == [] and by[4] == public("Hello world") and got.count() == len(TEXTS) + 2
    back = {r["doc_id"]: r["text"] for r in K.decode(got).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS))
    assert K.encode(df.limit(0)).count() == 0
