"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed in Arrow batches; equal fingerprints are merged by an
aggregation before anything is compared. Distinct fingerprints are dealt out by
each of ``budget + 1`` blocks of bits: two that differ in at most ``budget`` bits
agree in one block at least. Each block's bits are rotated to the top of a binary
trie over the sorted fingerprints, so a bucket is the subtree below a node that
both sides share. Node pairs of that subtree are traversed together, differing
bits are accumulated, and a pair is dropped once they exceed the budget.

A bucket returns one edge from each fingerprint to the smallest of those it is
linked with there, not all pairs: the components are the same and the output is
linear however dense a group is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, table
from kinweave.operators.components import connected_components
from kinweave.plans.staging import staged

SEED, WIDTH, BITS, BUDGET = 42, 3, 64, 3
#: Pairs that a leaf of the traversal compares directly, node pairs and leaf pairs held at once, rows of a chunk.
LEAF, FRONTIER, COMPARE, CHUNK = 64, 1 << 18, 1 << 20, 1 << 18
#: Fingerprints up to which a bucket is one subtree of one task.
HOT = 1 << 18


def shingle_hashes(text: str, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle; words are split at ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none: 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit fingerprint as a signed long. Null text has no words."""

    def make():
        def batch_of(texts, batch):
            values = [fingerprint(shingle_hashes(t, width)) if t else 0 for t in texts]
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(values, np.uint64).view(np.int64))}

        return batch_of

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fp long")


class Links:
    """Union-find over positions, in numpy; roots are the smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _leaves(keys: np.ndarray, links: Links, a_lo, a_hi, b_lo, b_hi, budget: int) -> None:
    """Compare every pair of small node pairs; each row of A times the rows of B."""
    size = (a_hi - a_lo) * (b_hi - b_lo)
    at = 0
    stop = np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + COMPARE, "right")))
        n, wide = size[at:to], (b_hi - b_lo)[at:to]
        pair = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a_lo[at:to][pair] + k // wide[pair], b_lo[at:to][pair] + k % wide[pair]
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        links.join(i[near], j[near])
        at = to


def trie_links(keys: np.ndarray, bounds: np.ndarray, top: int, budget: int = BUDGET) -> np.ndarray:
    """For each sorted distinct key the smallest position it is linked to.

    ``bounds``: the first position of each subtree and the end; keys of a subtree
    agree in their ``top`` highest bits.
    """
    links = Links(len(keys))
    lo, hi = bounds[:-1], bounds[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(top, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a_lo, a_hi, b_lo, b_hi, err = stack.pop()
        if len(a_lo) > FRONTIER:
            half = len(a_lo) // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((depth, *(x[part] for x in (a_lo, a_hi, b_lo, b_hi, err))))
            continue
        small = (a_hi - a_lo) * (b_hi - b_lo) <= LEAF
        if depth == BITS:
            small[:] = True
        if small.any():
            _leaves(keys, links, a_lo[small], a_hi[small], b_lo[small], b_hi[small], budget)
            a_lo, a_hi, b_lo, b_hi, err = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if not len(a_lo):
            continue
        if depth not in ones:
            bit = ((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)
            ones[depth] = np.concatenate(([0], np.cumsum(bit)))
        c = ones[depth]
        a_mid, b_mid = a_hi - (c[a_hi] - c[a_lo]), b_hi - (c[b_hi] - c[b_lo])
        own = a_lo == b_lo  # a node with itself: its two halves meet once
        kids = [
            (a_lo, a_mid, b_lo, b_mid, err),
            (a_mid, a_hi, b_mid, b_hi, err),
            (a_lo, a_mid, b_mid, b_hi, err + np.int8(1)),
            tuple(x[~own] for x in (a_mid, a_hi, b_lo, b_mid, err + np.int8(1))),
        ]
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*kids))
        keep = (err <= budget) & (a_hi > a_lo) & (b_hi > b_lo) & ~((a_lo == b_lo) & (a_hi - a_lo < 2))
        stack.append((depth + 1, *(x[keep] for x in (a_lo, a_hi, b_lo, b_hi, err))))
    return links.root


def _rotated(fp, shift: int):
    return F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, BITS - shift)) if shift else fp


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1


def fingerprint_edges(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """``(src, dst)`` between ``rep`` values whose distinct ``fp`` link; connects as all links would.

    Rows need a ``rep``. A bucket of more than ``hot`` fingerprints is split: two that link within it
    agree in one of ``budget + 1`` parts of their other bits too, so it is dealt out again by each of these.
    """
    starts = [round(BITS * k / (budget + 1)) for k in range(budget + 2)]
    widths = [b - a for a, b in zip(starts, starts[1:])]
    turned = F.array(*(
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(_rotated(F.col("fp"), starts[k]), BITS - widths[k]).alias("bucket"), _rotated(F.col("fp"), starts[k]).alias("key"))
        for k in range(budget + 1)
    ))
    whole = prints.select("rep", F.inline(turned))
    # At most a row for each value of each block.
    large = whole.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block", "bucket", F.lit(True).alias("large"))
    told = whole.join(F.broadcast(large), ["block", "bucket"], "left")

    def parts(k: int) -> F.Column:
        left = BITS - widths[k]
        cuts = [round(left * j / (budget + 1)) for j in range(budget + 2)]
        return F.array(*(F.struct(F.lit(j).alias("part"), F.shiftrightunsigned(F.shiftleft("key", widths[k] + cuts[j]), BITS - cuts[j + 1] + cuts[j]).alias("piece")) for j in range(budget + 1)))

    again = F.lit(None)
    for k in range(budget + 1):
        again = F.when(F.col("block") == k, parts(k)).otherwise(again)
    once = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("piece")))
    groups = ["block", "bucket", "part", "piece"]
    split = told.select("rep", "key", "block", "bucket", F.inline(F.when(F.col("large"), again).otherwise(once)))
    dealt = split.repartition(*groups).sortWithinPartitions(*groups)

    def run(batches):
        held, rows = [], 0

        def edges(batch: pa.Table):
            columns = {n: batch.column(n).to_numpy() for n in (*groups, "rep")}
            key = batch.column("key").to_numpy().view(np.uint64)
            order = np.lexsort((key, *(columns[n] for n in reversed(groups))))
            columns, key = {n: c[order] for n, c in columns.items()}, key[order]
            cuts = _changes([columns[n] for n in groups])
            for k in np.unique(columns["block"]):
                a, b = np.searchsorted(columns["block"], k), np.searchsorted(columns["block"], k, "right")
                bounds = np.concatenate(([0], cuts[(cuts > a) & (cuts < b)] - a, [b - a]))
                reps, root = columns["rep"][a:b], trie_links(key[a:b], bounds, widths[k], budget)
                linked = np.flatnonzero(root != np.arange(len(root)))
                if len(linked):
                    yield pa.RecordBatch.from_pydict({"src": reps[linked], "dst": reps[root[linked]]})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                whole = pa.Table.from_batches(held)
                cut = _changes([whole.column(n).to_numpy() for n in groups])
                if len(cut):  # up to the last bucket that is surely whole
                    at = int(cut[-1])
                    yield from edges(whole.slice(0, at))
                    held = whole.slice(at).to_batches()
                    rows = whole.num_rows - at
        if held:
            yield from edges(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    Null or blank text has fingerprint zero and is linked like any other. Rows that
    share a doc_id keep a row each. A row without doc_id gets its fingerprint, links
    nothing and has a null component. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    # A row with a doc_id under several fingerprints ties them together, as equal ids are one document.
    distinct = staged(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    ties = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    twice = (
        prints.join(ties.select("doc_id"), "doc_id", "left_semi").join(distinct, "fp").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    )
    groups = connected_components(fingerprint_edges(distinct, budget).union(twice))
    named = distinct.join(groups, distinct["rep"] == groups["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group, and rows without doc_id."""
    found = near_duplicates(docs)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
