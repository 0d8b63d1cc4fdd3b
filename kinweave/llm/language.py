"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A document is parsed
against it into the longest phrases that occur in that text; the entropy estimate is
phrases times the logarithm of the text's length, by character (Ziv and Merhav 1993).
The language that needs fewest normalised phrases wins.

Automata are dense transition tables, and a batch's texts are parsed in lockstep: whole
texts are cut into segments where each parse begins anew, in every language alike, and
one numpy step advances all segments against all languages by a character.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import BATCH_BYTES, table

#: The bounded sample that the classifier is fitted on: rows of a language, characters
#: taken from one row, characters of a language; symbols of the alphabet; segment length.
ROWS, ROW_CHARS, CHARS, SYMBOLS, SEGMENT = 64, 600, 16_000, 120, 512
UNKNOWN = "und"


def letters(text: str) -> str:
    """Lower case; whatever is no letter is a space, runs of spaces are one."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class CrossParser:
    """Languages, alphabet and transition tables. Symbol 0 is any letter outside the alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        counts: dict[str, int] = {}
        for parts in texts.values():
            for c in "".join(parts):
                counts[c] = counts.get(c, 0) + 1
        self.alphabet = sorted(sorted(counts, key=lambda c: (-counts[c], c))[:SYMBOLS])
        index, self.width = {c: i + 1 for i, c in enumerate(self.alphabet)}, len(self.alphabet) + 1
        tables, roots, base, self.bits = [], [], 0, []
        for language in self.languages:
            joined: list[int] = []
            for part in texts[language]:
                joined += [index.get(c, 0) for c in part] + [0]
            states = suffix_automaton(joined)
            dense = np.zeros((len(states), self.width), np.int32)
            for i, step in enumerate(states):
                for c, to in step.items():
                    if c:
                        dense[i, c] = base + to * self.width
            roots.append(np.where(dense[0] > 0, dense[0], base))
            dense[0] = 0  # a parse at the root always begins a phrase
            tables.append(dense.ravel())
            base += dense.size
            self.bits.append(np.log2(max(2, len(joined))))
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)
        self.root = np.array(roots, np.int64).reshape(len(self.languages), self.width)
        self.start = np.concatenate(([0], np.cumsum([t.size for t in tables])[:-1])).astype(np.int64) if tables else np.empty(0, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def _symbols(self, texts: list[str]) -> list[np.ndarray]:
        if "lookup" not in self.__dict__:
            space = self.alphabet.index(" ") + 1 if " " in self.alphabet else 0
            self.space = space if space else self.width  # of no transition
            self.lookup = np.array([0 if chr(i).isalpha() else self.space for i in range(0x110000)], np.int16)
            for i, c in enumerate(self.alphabet):
                self.lookup[ord(c)] = i + 1
        out = []
        for text in texts:
            s = self.lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
            blank = s == self.space
            keep = ~blank
            keep[1:] |= ~blank[:-1]  # one blank after a letter
            out.append(s[keep])
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each language for each text, and characters."""
        symbols = self._symbols(texts)
        sizes = np.array([len(s) for s in symbols], np.int64)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(SEGMENT, sizes[owner] - at * SEGMENT)
        begin = (np.cumsum(sizes) - sizes)[owner] + at * SEGMENT
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        if len(owner):
            flat = np.concatenate(symbols).astype(np.int64)
            flat[flat >= self.width] = 0
            active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
            state = np.repeat(self.start[:, None], len(owner), axis=1)
            count = np.zeros(state.shape, np.int32)
            for step, n in enumerate(active.tolist()):
                c = flat[begin[:n] + step]
                to = self.table[state[:, :n] + c]
                fresh = to == 0
                count[:, :n] += fresh
                state[:, :n] = np.where(fresh, self.root[:, c], to)
            for i in range(len(self.languages)):
                total[i] = np.bincount(owner, count[i], len(texts)).astype(np.int64)
        return total, sizes

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """The language of each text and a score: by how much the runner-up needs more."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        rows = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
        at = 0
        while at < len(rows):
            to, size = at, 0
            while to < len(rows) and (to == at or size + len(texts[rows[to]]) < BATCH_BYTES // 2):
                size += len(texts[rows[to]])
                to += 1
            found, sizes = self.phrases([texts[i] for i in rows[at:to]])
            rate = found * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
            order = np.argsort(rate, axis=0, kind="stable")
            for k, i in enumerate(rows[at:to]):
                best = rate[order[0, k], k]
                names[i] = self.languages[order[0, k]]
                scores[i] = float(min(1.0, max(0.0, 1 - best / rate[order[1, k], k]))) if len(self.languages) > 1 else 1.0
            at = to
        return names, scores


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: CRC-32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = ROWS, row_chars: int = ROW_CHARS, chars: int = CHARS) -> CrossParser:
    """Learn from a bounded sample of labelled rows that aren't held out: ``rows`` of each
    language by the order of a hash, an excerpt of at most ``row_chars`` of each, ``chars`` in all.
    Rows with a null id, language or text teach nothing."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out("doc_id"))
    known = known.select("lang", "text", F.xxhash64("doc_id").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "c"))
    # The driver gets an excerpt of each text, from a place that the text itself tells.
    wide = 4 * row_chars
    start = F.pmod(F.col("c"), F.greatest(F.lit(1), F.length("text") - wide + 1)) + 1
    excerpt = F.substring(F.col("text"), start.cast("int"), F.lit(wide)).alias("text")
    sample = known.withColumn("k", rank).where(F.col("k") <= rows).select("lang", excerpt, "k").collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["k"])):
        clean = letters(row["text"])
        parts = texts.setdefault(row["lang"], [])
        room = min(row_chars, chars - sum(map(len, parts)))
        if clean and room > 0:
            start = zlib.crc32(clean.encode("utf-8", "surrogatepass")) % max(1, len(clean) - room)
            parts.append(clean[start : start + room])
    return CrossParser({k: v for k, v in texts.items() if v})


def predictor(spark: SparkSession, model: CrossParser):
    """A column function: text to struct of ``lang_pred`` and ``score``."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample: languages x states x symbols

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predicted


def identify(docs: DataFrame, model: CrossParser) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each input row.

    Null text and text without a letter is ``und`` with score 0, as is every text if
    nothing was learned. Ties go to the first language by name. Equal texts get equal
    predictions. A null doc_id stays null and counts as not held out.
    """
    found = predictor(docs.sparkSession, model)(F.col("text"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), found.alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; text that is null or has no letter goes. Where no row
    has a language to learn from, all texts with a letter stay. Rows without doc_id count like others; no row gives none."""
    model = fit(docs)
    if not model.languages:
        return docs.where(F.regexp_like(F.col("text"), F.lit(r"\p{L}")))
    found = predictor(spark, model)(F.col("text"))
    return docs.where(F.coalesce(found["lang_pred"], F.lit(UNKNOWN)) != UNKNOWN)
