"""Greedy word-piece lengths by a linear longest-match automaton.

A byte trie of the vocabulary gets failure links and, for each node, how many pieces
are popped when its link is taken (Song et al. 2021). A word's greedy longest-match
piece count is then found in one pass, without backing up and without building pieces.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, table

#: White-space chunks whose counts a task keeps.
MEMO = 800_000
#: Words of a chunk: letters, one digit, or a run of other characters (fixed pattern of the public vocabulary).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies, by its rule: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a tokenizer file as bytes, word-end marks removed, and every single byte."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    end, back = model.get("end_of_word_suffix") or "", byte_symbols()
    pieces = {bytes([b]) for b in range(256)}
    for token in model["vocab"]:
        token = token.removesuffix(end) if end else token
        if token and all(c in back for c in token):
            pieces.add(bytes(back[c] for c in token))
    return sorted(pieces)


class LongestMatch:
    """Trie with failure links and popped counts. ``next[node * 256 + byte]`` is a child."""

    def __init__(self, pieces: list[bytes]):
        self.next: dict[int, int] = {}
        ends = set()
        size = 1
        for piece in pieces:
            node = 0
            for b in piece:
                child = self.next.get(node * 256 + b)
                if child is None:
                    child = self.next[node * 256 + b] = size
                    size += 1
                node = child
            ends.add(node)
        self.fail, self.popped = [-1] * size, [0] * size
        kids: dict[int, list] = {}
        for key, child in self.next.items():
            kids.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in kids.get(u, ()):
                if v in ends:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and z * 256 + b not in self.next:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z * 256 + b], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split."""
        node, n, step, fail, popped = 0, 0, self.next, self.fail, self.popped
        for b in word:
            child = step.get(node * 256 + b)
            while child is None:
                n += popped[node]
                node = fail[node]
                child = step.get(node * 256 + b)
            node = child
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n


class ChunkCounts(dict):
    """``pieces + (words << 40)`` of white-space chunks."""

    def __init__(self, automaton: LongestMatch):
        self.automaton, self.words = automaton, regex.compile(WORD)

    def __missing__(self, chunk: str) -> int:
        words = self.words.findall(chunk)
        value = sum(self.automaton.count(w.encode("utf-8", "surrogatepass")) for w in words) + (len(words) << 40)
        self[chunk] = value
        return value

    def of(self, text: str) -> tuple[int, int]:
        if len(self) > MEMO:
            self.clear()
        total = sum(map(self.__getitem__, text.lower().split()))
        return total >> 40, total & ((1 << 40) - 1)


#: Counts by vocabulary, for each worker process.
_SHARED: dict[str, ChunkCounts] = {}


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens)``, one row for each input row.

    Text is lower-cased. Null and blank text has no words. Equal rows give equal rows,
    a null doc_id stays null.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary(tokenizer)))  # as large as the vocabulary

    def make():
        if tokenizer not in _SHARED:
            _SHARED[tokenizer] = ChunkCounts(automaton.value)
        counts = _SHARED[tokenizer]

        def batch_of(texts, batch):
            found = [counts.of(t) if t else (0, 0) for t in texts]
            return {"doc_id": batch.column("doc_id"), "n_words": pa.array([f[0] for f in found], pa.int64()), "n_tokens": pa.array([f[1] for f in found], pa.int64())}

        return batch_of

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
