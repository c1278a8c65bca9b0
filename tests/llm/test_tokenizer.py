import os
import random

import pytest

from runloom.llm import tokenizer as T
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(T.BYTE_BPE), reason="the public vocabulary is not here")
ALPHABET = ["a", "b", "e", "t", "h", " ", "the", "in", "ing", "é", "日本", "\n", "1", "x", "xx", "==", "--", "\x1c", "　", " ", "👩", "'s", "<|endoftext|>", "​", "\r\n", "\t"]


@pytest.fixture(scope="module")
def automaton():
    return T.TokenAutomaton.load(T.BYTE_BPE)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.BYTE_BPE)
    t.encode_special_tokens = True
    return t


def test_against_the_public_tokenizer(automaton, public):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + ["é" * 5000, "x" * 3000, " " * 700, "=" * 900]
    encoder = T.Encoder(automaton)
    for text, want in zip(texts, public.encode_batch(texts, add_special_tokens=False)):
        got = list(encoder.encode(text))
        assert got == want.ids, text
        assert automaton.decode(got) == text


def test_merges_of_a_toy_vocabulary():
    """Against the rule itself: the first of the merges that applies, leftmost, until none does."""
    rng = random.Random(3)
    for _ in range(30):
        vocabulary = {bytes([b]): b for b in range(256)}
        merges = []
        while len(merges) < 25:
            u, v = rng.choice(list(vocabulary)[97:99] + list(vocabulary)[256:]), rng.choice(list(vocabulary)[97:99] + list(vocabulary)[256:])
            if u + v not in vocabulary and len(u + v) < 9:
                vocabulary[u + v] = len(vocabulary)
                merges.append((u, v))
        a = T.TokenAutomaton.compile(vocabulary, merges)
        rank = {m: k for k, m in enumerate(merges)}
        own = {}
        for w in vocabulary:
            own[w] = plain(w, rank)
        if any(len(x) > 1 for x in own.values()):
            continue  # a token that its own merges don't lead to: no such vocabulary comes from training
        for _ in range(200):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))
            assert [a.label[k] for k in a.encode_word(word)] == plain(word, rank)


def plain(word, rank):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_long_texts_are_read_in_parts(automaton, monkeypatch):
    encoder = T.Encoder(automaton)
    text = "The build of web fails when 42 jobs share a port. " * 50
    whole = list(encoder.encode(text))
    monkeypatch.setattr(T, "LONG_TEXT", 10)
    assert list(encoder.encode(text)) == whole


def test_frame(spark, public):
    texts = ["Hello wörld", "", None, " \n", "<|endoftext|>", "Hello wörld"]
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in T.token_ids(df).collect()}
    assert got == {k: public.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert rows(T.token_counts(df)) == [(k, len(v)) for k, v in sorted(got.items())]
    assert T.token_ids(df.limit(0)).count() == 0


def test_ascii_texts_are_split_alike():
    """The pattern for ASCII texts against the general one, over all ASCII characters, control characters too."""
    encoder, rng = T.Encoder(T.TokenAutomaton(256)), random.Random(9)
    for _ in range(20_000):
        text = "".join(rng.choice([chr(rng.randrange(128)), rng.choice(" \n\t'sltred09aZ")]) for _ in range(rng.randrange(30)))
        assert encoder.ascii_pattern.findall(text) == encoder.pattern.findall(text), repr(text)
