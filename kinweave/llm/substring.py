"""Substring dedup by level-wise doubling of word windows.

The lengths of the levels halve, rounded up, from the wanted window down to ``FIRST`` words:
each level's window is twice the one before, less the shared word where it is odd. At
every level but the last, each wanted window that is still a candidate is stood for by the
smallest hash among its windows of the level's length: two equal wanted windows have the
same one, so nothing is lost while only part of the positions travel. What occurs in one document
alone ends there; the rest is extended to the next length, until no candidates survive or the
wanted length is reached, where windows are hashed to 96 bits and the smallest doc_id
that starts each is found. Words covered by a window that also starts in a document with a
smaller doc_id are removed.

All levels group rows by hash. A hash that occurs in many documents of one Arrow
batch is settled there: all but one of its rows are marked as known and are dealt
out under a key of their own, so a passage that a third of all documents share
sends one row per batch to its group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, table
from kinweave.plans.staging import dealt, release, staged

WINDOW = 13
#: Words up to which the levels' lengths are halved.
FIRST = 7
#: Words whose hashes a task keeps.
MEMO = 300_000
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Two 64-bit hashes of each word, remembered by position in two arrays."""

    def __init__(self):
        self.first, self.second = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.first):
            self.first, self.second = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.second))
        value = xxhash.xxh3_128_intdigest(word)
        self.first[at], self.second[at] = value & 0xFFFFFFFFFFFFFFFF, value >> 64
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > MEMO:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.first[at], self.second[at]


def rolled(hashes: np.ndarray, width: int, step: int) -> np.ndarray:
    """A mixed hash of every ``width`` consecutive word hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(step)
        out += hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def levels(window: int, first: int = FIRST) -> list[int]:
    """The lengths from the shortest to the window itself."""
    found = [window]
    while found[0] > first:
        found.insert(0, (found[0] + 1) // 2)
    return found


def least_short(first: np.ndarray, window: int, short: int) -> np.ndarray:
    """For each window the smallest hash of its windows of a shorter length."""
    low = rolled(first, short, _STEP[0])
    n = len(first) - window + 1
    out = low[:n].copy()
    for j in range(1, window - short + 1):
        np.minimum(out, low[j : j + n], out=out)
    return out


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Flat:
    """The words of a batch's texts in a row, and which window starts lie within one text."""

    def __init__(self, texts: list, window: int):
        parts = [_split(t) for t in texts]
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.words = [w for p in parts for w in p]
        self.row = np.repeat(np.arange(len(parts)), self.counts)
        ends = np.cumsum(self.counts)
        self.at = np.flatnonzero(np.arange(len(self.words)) + window <= ends[self.row]) if len(self.words) else np.empty(0, np.int64)


def _settled(keys: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    """What a batch knows of its rows: 0 nothing (the key is in one document), -1 the
    key repeats and this is the smallest document, else a salt: a smaller one has it."""
    salt = np.zeros(len(docs), np.int32)
    if len(docs):
        order = np.lexsort((docs, *keys))
        d, new = docs[order], np.ones(len(docs), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        group = np.cumsum(new) - 1
        low = d[np.flatnonzero(new)][group]
        high = d[np.concatenate((np.flatnonzero(new)[1:], [len(d)])) - 1][group]
        salt[order] = np.where(d > low, (d & 0x3FFFFFFF) + 1, np.where(high > low, -1, 0))
    return salt


def _alive(flat: Flat, first: np.ndarray, window: int, short: int, sets: pa.Array) -> np.ndarray:
    """Which windows have their least window of the level before in their text's set."""
    least, row = least_short(first, window, short)[flat.at].view(np.int64), flat.row[flat.at]
    keep = np.zeros(len(row), bool)
    bounds = np.searchsorted(row, np.arange(len(flat.counts) + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[i], bounds[i + 1]
        keep[a:b] = np.isin(least[a:b], sets[int(i)].values.to_numpy())
    return keep


def short_windows(docs: DataFrame, window: int, length: int, before: int | None = None) -> DataFrame:
    """``(h, salt, doc_id)``: the least window of a length of every window, or of those that
    the column ``alive`` of the level ``before`` has. A null text, doc_id or set gives no row."""

    def make():
        memo = WordHashes()

        def batch_of(texts, batch):
            ids = batch.column("doc_id")
            usable = ids.is_valid().to_pylist() if before is None else pc.and_(ids.is_valid(), batch.column("alive").is_valid()).to_pylist()
            flat = Flat([t if u else None for t, u in zip(texts, usable)], window)
            none = {"h": pa.array([], pa.int64()), "salt": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64())}
            if not len(flat.at):
                return none
            first = memo.of(flat.words)[0]
            at, row = flat.at, flat.row[flat.at]
            if before is not None:
                keep = _alive(flat, first, window, before, batch.column("alive"))
                at, row = at[keep], row[keep]
                if not len(at):
                    return none
            least = least_short(first, window, length)[at]
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])))
            least, doc = least[new], ids.fill_null(0).to_numpy(zero_copy_only=False)[row[new]]
            return {"h": pa.array(least.view(np.int64)), "salt": pa.array(_settled([least], doc)), "doc_id": pa.array(doc)}

        return batch_of

    return map_texts(docs, make, "h long, salt int, doc_id long")


def long_windows(docs: DataFrame, window: int, before: int | None) -> DataFrame:
    """``(x, y, salt, doc_id)`` for every window of texts that are no copy, or for those that the column
    ``alive`` of the level ``before`` has. A null text, doc_id or set gives no row."""

    def make():
        memo = WordHashes()

        def batch_of(texts, batch):
            ids = batch.column("doc_id")
            usable = pc.and_(ids.is_valid(), pc.invert(batch.column("copy").fill_null(False)))
            if before is not None:
                usable = pc.and_(usable, batch.column("alive").is_valid())
            flat = Flat([t if u else None for t, u in zip(texts, usable.to_pylist())], window)
            none = {"x": pa.array([], pa.int64()), "y": pa.array([], pa.int32()), "salt": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64())}
            if not len(flat.at):
                return none
            first, second = memo.of(flat.words)
            at = flat.at if before is None else flat.at[_alive(flat, first, window, before, batch.column("alive"))]
            row = flat.row[at]
            x, y = (rolled(h, window, s)[at].view(np.int64) for h, s in ((first, _STEP[0]), (second, _STEP[1])))
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[row]
            # equal windows of one document need one row
            order = np.lexsort((x, doc))
            new = np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(order) else np.empty(0, bool)
            one = np.sort(order[new])
            x, y, doc = x[one], (y[one] >> np.int64(32)).astype(np.int32), doc[one]
            return {"x": pa.array(x), "y": pa.array(y), "salt": pa.array(_settled([x, y], doc)), "doc_id": pa.array(doc)}

        return batch_of

    return map_texts(docs, make, "x long, y int, salt int, doc_id long")


def without_repeats(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Per row: counts, the digest of the words that stay and, if wanted, those words."""

    def make():
        memo = WordHashes()

        def batch_of(texts, batch):
            gone = batch.column("gone")
            flat = Flat(texts, window)
            ends = np.cumsum(flat.counts)
            removed = np.zeros(len(flat.words), bool)
            hit = gone.is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False) & (flat.counts >= window)):
                removed[ends[i] - flat.counts[i] : ends[i]] = True
                hit[i] = False
            if hit.any():
                x = rolled(memo.of(flat.words)[0], window, _STEP[0]).view(np.int64) if len(flat.words) else np.empty(0, np.int64)
                for i in np.flatnonzero(hit):
                    a, b = ends[i] - flat.counts[i], ends[i]
                    starts = a + np.flatnonzero(np.isin(x[a : max(a, b - window + 1)], gone[int(i)].values.to_numpy()))
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, starts - a, 1)
                    np.add.at(edge, starts - a + window, -1)
                    removed[a:b] = np.cumsum(edge[:-1]) > 0
            kept, lost = [], []
            for a, b in zip((ends - flat.counts).tolist(), ends.tolist()):
                r = removed[a:b]
                n = int(r.sum())
                lost.append(n)
                kept.append(b" ".join([w for w, x in zip(flat.words[a:b], r) if not x] if n else flat.words[a:b]))
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(flat.counts), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            if with_text:
                out["kept"] = pa.array([k.decode("utf-8", "surrogatepass") for k in kept])
            return out

        return batch_of

    return map_texts(docs, make, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, first: int = FIRST) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])``, one row for each input row.

    Null, blank and short texts have no window and keep their words. A row without
    doc_id is neither searched nor a witness: it keeps its words. Rows that share a
    doc_id are one document and don't remove each other's words. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    copies = staged(later_copies(docs), "copies")
    lengths = levels(window, first)
    known, alive, by_hash = docs, None, Window.partitionBy("h", "own")
    for before, length in zip([None, *lengths], lengths[:-1]):
        found = (
            short_windows(known, window, length, before).withColumn("own", F.greatest("salt", F.lit(0)))
            .withColumns({"lo": F.min("doc_id").over(by_hash), "hi": F.max("doc_id").over(by_hash)})
            .where("salt <> 0 or lo < hi").select("doc_id", "h")
        )
        last, alive = alive, staged(found.groupBy("doc_id").agg(F.collect_set("h").alias("alive")), "alive")
        release(last)
        known = docs.join(alive, "doc_id", "left")
        if alive.isEmpty():
            break
    by_window = Window.partitionBy("x", "y", "own")
    before = lengths[-2] if len(lengths) > 1 else None
    gone = (
        long_windows(known.join(copies, "doc_id", "left"), window, before).withColumn("own", F.greatest("salt", F.lit(0)))
        .withColumn("lo", F.min("doc_id").over(by_window))
        .where("salt > 0 or lo < doc_id").groupBy("doc_id").agg(F.collect_set("x").alias("gone"))
    )
    gone = staged(gone, "gone")
    release(alive)
    return without_repeats(docs.join(gone, "doc_id", "left").join(copies, "doc_id", "left"), window, with_text)


def later_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy)`` of documents whose entire text a smaller doc_id has: every window
    of theirs repeats, so only the first copy's windows need to travel. A doc_id with more
    than one text counts if a smaller one has each of them."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    low = texts.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "lo")
    found = texts.join(dealt(low), ["a", "b"], "left").groupBy("doc_id").agg(F.min(F.coalesce(F.col("lo") < F.col("doc_id"), F.lit(False))).alias("copy"))
    return found.where("copy")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13
), keyed AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM win
), low AS (
  SELECT k, min(doc_id) AS lo FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)
), flagged AS (
  SELECT doc_id, p FROM keyed JOIN low USING (k) WHERE lo < doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w
), marked AS (
  SELECT words.doc_id, words.p, word,
         max(CASE WHEN f.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN flagged f ON f.doc_id = words.doc_id AND f.p = words.p
), kept AS (
  SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '') AS k FROM marked GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
