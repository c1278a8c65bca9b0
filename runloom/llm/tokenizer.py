"""Byte-pair encoding by a deterministic automaton.

The automaton reads tokens: its state is the token read last, and it accepts exactly the token sequences that byte-pair
encoding produces. It starts as the automaton of single bytes, all of which may follow each other. Each merge u v -> w, in the order
of the merges, adds a gadget: an arc labelled w wherever u and v could be read in a row, and u no longer goes on to
v. What a gadget forbids is inherited by the tokens built later: x may not be followed by y if, while their
outer parts are built up merge by merge, some u at the end of x and v at the start of y meet before a later merge takes
one of them away. The arcs are not written out for all pairs of tokens; the gadget table and the outer parts decide
each one when it is first needed, and it is kept. Bytes lead through the trie of the arcs' labels.

A text is split by the tokenizer's pattern; every word has exactly one accepted path, found from left to right: a
prefix has one state, the token it ends with, and a token goes on to the state where it ends if the automaton has
the arc. The path's arcs are the ids; ``decode`` puts out their labels.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import spread

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII characters only, for the faster engine: letters, digits and white space are spelt out.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
START = -1
NEVER = 1 << 40
KEPT_WORDS = 300_000
SLICE = 1000
LONG_TEXT = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the others follow after 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenAutomaton:
    def __init__(self, n: int):
        self.label: list[bytes] = [b""] * n
        self.left, self.right = array("i", [START]) * n, array("i", [START]) * n
        self.made = array("q", [0]) * n  # the rank of the merge that makes a token; bytes are there from the start
        self.gadget: dict[int, int] = {}
        self.step: dict[int, int] = {}
        self.token_at = array("i", [START])
        self.arc: dict[int, bool] = {}

    @staticmethod
    def compile(vocabulary: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]) -> TokenAutomaton:
        a = TokenAutomaton(max(vocabulary.values()) + 1)
        for b in range(256):
            a.add_label(vocabulary[bytes([b])], bytes([b]))
        for rank, (u, v) in enumerate(merges, 1):
            a.add_gadget(rank, vocabulary[u], vocabulary[v], vocabulary[u + v])
        return a

    @staticmethod
    def load(path: str) -> TokenAutomaton:
        """From a vocabulary file with ``model.vocab`` and ``model.merges`` in byte letters."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_letters()
        raw = lambda word: bytes(of[c] for c in word)
        vocabulary = {raw(w): k for w, k in model["vocab"].items() if all(c in of for c in w)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return TokenAutomaton.compile(vocabulary, ((raw(u), raw(v)) for u, v in pairs))

    def add_label(self, token: int, label: bytes) -> None:
        self.label[token] = label
        node = 0
        for byte in label:
            key = node << 8 | byte
            node = self.step.get(key, 0)
            if not node:
                node = self.step[key] = len(self.token_at)
                self.token_at.append(START)
        self.token_at[node] = token

    def add_gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.gadget[u << 20 | v] = rank
        self.left[w], self.right[w], self.made[w] = u, v, rank
        self.add_label(w, self.label[u] + self.label[v])

    def _outer(self, token: int, side: array) -> list[tuple[int, int]]:
        """The outermost parts of a token on one side, innermost (a byte) first, each with the rank that takes it away."""
        out, until = [], NEVER
        while token != START:
            out.append((token, until))
            until = self.made[token]
            token = side[token]
        return out[::-1]

    def has_arc(self, x: int, y: int) -> bool:
        """Whether y can be read in state x."""
        key = x << 20 | y
        known = self.arc.get(key)
        if known is None:
            ends, starts = self._outer(x, self.right), self._outer(y, self.left)
            i = j = 0
            while True:
                (u, u_until), (v, v_until) = ends[i], starts[j]
                rank = self.gadget.get(u << 20 | v)
                # Of equal merges the leftmost comes first: one inside x takes u away, one inside y comes too late.
                if rank is not None and rank < u_until and rank <= v_until:
                    known = False
                    break
                if u_until == v_until == NEVER:
                    known = True
                    break
                if u_until <= v_until:
                    i += 1
                else:
                    j += 1
            if len(self.arc) > 4 * KEPT_WORDS:
                self.arc.clear()
            self.arc[key] = known
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n, step, token_at = len(word), self.step, self.token_at
        state = [START] * (n + 1)
        for start in range(n):
            here, node, at = state[start], 0, start
            while at < n:
                node = step.get(node << 8 | word[at], 0)
                if not node:
                    break
                at += 1
                token = token_at[node]
                if token != START and state[at] == START and (start == 0 or self.has_arc(here, token)):
                    state[at] = token
        out = []
        while n:
            out.append(state[n])
            n -= len(self.label[state[n]])
        return tuple(reversed(out))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.label[k] for k in ids).decode("utf-8", "replace")


class Encoder:
    """Texts to ids; words met before are looked up."""

    class _Words(dict):
        def __init__(self, automaton: TokenAutomaton):
            self.automaton = automaton

        def __missing__(self, word: str) -> tuple[int, ...]:
            if len(self) >= KEPT_WORDS:
                self.clear()
            ids = self.automaton.encode_word(word.encode("utf-8", "replace"))
            if len(word) < 100:
                self[word] = ids
            return ids

    def __init__(self, automaton: TokenAutomaton):
        import re

        import regex

        self.words, self.pattern, self.ascii_pattern = Encoder._Words(automaton), regex.compile(PATTERN), re.compile(ASCII_PATTERN)

    def encode(self, text: str | None) -> array:
        """The ids of a text; none for an empty or null one."""
        if not text:
            return array("i")
        pattern = self.ascii_pattern if text.isascii() else self.pattern
        if len(text) < LONG_TEXT:
            return array("i", chain.from_iterable(map(self.words.__getitem__, pattern.findall(text))))
        out, found = array("i"), pattern.finditer(text)
        while part := [m.group() for m in islice(found, 100_000)]:
            out.extend(chain.from_iterable(map(self.words.__getitem__, part)))
        return out


def _encoded(documents: DataFrame, vocabulary: str, schema: str, emit) -> DataFrame:
    """``emit`` makes the result's columns of the doc ids and the token lists of a slice of documents."""
    model = documents.sparkSession.sparkContext.broadcast(TokenAutomaton.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_pydict(emit(part.column(0), [encoder.encode(t) for t in part.column(1).to_pylist()]))

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, schema)


def token_ids(documents: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``documents`` (doc_id, text).

    An empty and a null text have no ids (an empty list); no special tokens, their strings are ordinary text. Texts
    of any length are encoded whole; repeated rows come out repeated; other columns are ignored.
    """

    def emit(ids: pa.Array, tokens: Sequence[array]) -> dict:
        ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        values = np.concatenate([np.frombuffer(t, dtype=np.int32) for t in tokens if len(t)] or [np.zeros(0, np.int32)])
        return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))}

    return _encoded(documents, vocabulary, "doc_id bigint, ids array<int>", emit)


def token_counts(documents: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, tokens): the lengths of ``token_ids``."""
    return _encoded(documents, vocabulary, "doc_id bigint, tokens bigint", lambda ids, tokens: {"doc_id": ids, "tokens": pa.array([len(t) for t in tokens], pa.int64())})
