"""Best-fit packing by the linear grouping scheme.

Documents become token pieces of at most ``capacity``; what the plan needs of them is
the number of pieces of each length, at most ``capacity`` numbers however large the
corpus is. On those the driver

1. sorts the large lengths into groups of equal cardinality and rounds each up to the
   longest of its group,
2. solves the few-size problem by column generation: configurations of rounded
   lengths that fill a sequence, and how often each is used,
3. substitutes the actual lengths, group by group in order, for the rounded ones,
4. places what rounding down left over, then the small lengths, where they fit best.

All steps work on runs of sequences that look alike, so the plan's size is bounded by
``capacity`` and the number of groups. Executors rank the pieces of each length in
salted buckets and look their run up.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import slices, table
from kinweave.plans.staging import staged

CAPACITY, GROUPS, BUCKETS = 2048, 64, 128
#: Lengths up to such a share of the capacity count as small; the share that packs best is taken.
SMALL = (1 / 8, 1 / 4, 1 / 3, 0.45, 1 / 2)
#: Chunks whose token ids a worker keeps, and their characters.
MEMO, MEMO_CHARS = 800_000, 16 << 20
_WHOLE = r"<\||[\x1c-\x1f]"


class ChunkTokens:
    """Token ids of texts by white-space chunks, each chunk encoded once.

    The tokenizer drops white space and never joins across it, parts letters from the
    punctuation that follows, and lower-cases all, so a text's ids are those of its chunks,
    also with a space put before such punctuation and with ASCII chunks in lower case.
    A text with a special token's opening or a control character that only one side takes
    for white space is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size, self.again = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.zeros(1 << 14, bool)

    def _shrink(self) -> None:
        """Keep the chunks that came up in more than one batch, unless they alone are too many."""
        keep = np.flatnonzero(self.again[: len(self.at)])
        chunks = [c for c, more in zip(self.at, self.again[: len(self.at)].tolist()) if more]
        chars = sum(map(len, chunks))
        begin, size, flat = self.begin[keep], self.size[keep], self.flat
        self._reset()
        if len(chunks) > MEMO // 2 or chars > MEMO_CHARS // 2:
            return
        stop = np.cumsum(size, dtype=np.int64)
        self.flat = flat[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        self.begin, self.size, self.again = stop - size, size, np.zeros(len(size), bool)
        self.used, self.chars, self.at = len(self.flat), chars, dict(zip(chunks, range(len(chunks))))

    def _learn(self, chunks: list[str]) -> None:
        """Make sure of these distinct chunks."""
        if len(self.at) > MEMO or self.chars > MEMO_CHARS:
            self._shrink()
        found = [self.at.get(c, -1) for c in chunks]
        new = [c for c, k in zip(chunks, found) if k < 0]
        self.again[[k for k in found if k >= 0]] = True
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            # One call for all of them; a token belongs to the chunk that its offset lies in.
            enc = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(c) + 1 for c in part])
            owner = np.searchsorted(starts, np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc.ids)), "right") - 1
            size, k = np.bincount(owner, minlength=len(part)), len(self.at)
            while k + len(part) > len(self.begin):
                self.begin, self.size, self.again = (np.concatenate((x, np.zeros(max(1 << 14, len(x)), x.dtype))) for x in (self.begin, self.size, self.again))
            while self.used + len(owner) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty(max(1 << 16, len(self.flat)), np.uint32)))
            self.flat[self.used : self.used + len(owner)] = enc.ids
            self.size[k : k + len(part)] = size
            self.begin[k : k + len(part)] = self.used + np.cumsum(size) - size
            self.used += len(owner)
            self.chars += int(starts[-1])
            self.at.update(zip(part, range(k, k + len(part))))

    def ids(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers; null is empty."""
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, _WHOLE)
        whole = {i: self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()}
        parts = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.if_else(apart, "", texts), r"([A-Za-z])([.,;:!?])", r"\1 \2"))
        each = parts.flatten()
        # Python sees each different chunk of a batch once; white space at an end gives an empty one, of no tokens.
        coded = pc.if_else(pc.string_is_ascii(each), pc.ascii_lower(each), each).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        self._learn([c for c in chunks if c])
        known = np.fromiter((self.at[c] if c else -1 for c in chunks), np.int64, len(chunks))
        k = known[coded.indices.to_numpy()] if len(chunks) else np.empty(0, np.int64)
        size = np.where(k < 0, 0, self.size[k])
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[k] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        edges = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))]
        return [np.array(whole[i], np.uint32) if i in whole else flat[edges[i] : edges[i + 1]] for i in range(len(texts))]


@lru_cache(maxsize=2)
def _shared_tokens(path: str) -> ChunkTokens:
    """One for each worker process, whose later tasks find the chunks of earlier ones."""
    return ChunkTokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; null text is empty, ``end_id`` follows every text."""

    def make():
        tokens = _shared_tokens(tokenizer)

        def batch_of(batch):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokens.ids(batch.column("text").cast(pa.string()))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i), piece.append(p), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            return {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

        return batch_of

    def run(batches):
        batch_of = make()
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(batch_of(batch))

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the few-size problem: (copies of each size, times used).

    Column generation: a revised simplex whose columns come from an unbounded knapsack.
    """
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[i] * (capacity // s) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best = [np.zeros(capacity + 1)]
        for s, p in zip(sizes, price):
            f = best[-1].copy()
            for _ in range(capacity // s if p > 1e-12 else 0):
                np.maximum(f[s:], f[:-s] + p, out=f[s:])
            best.append(f)
        if best[-1][capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k, int), capacity
        for i in range(k - 1, -1, -1):
            while room >= sizes[i] and best[i + 1][room] > best[i][room] + 1e-12:
                column[i] += 1
                room -= sizes[i]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        move = ratio[out]
        x = np.maximum(x - move * step, 0)
        x[out] = move
        columns[out] = column
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return [(c, t) for c, t in zip(columns, x) if t >= 1]


class Plan:
    """Runs ``(length, first rank, count, first sequence, offset)`` and sequences by their room."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def shelve(self, first: int, n: int, room: int) -> None:
        if n and room:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((first, n))

    def fit(self, length: int, rank: int, n: int) -> None:
        """Place ``n`` pieces of one length, each where the least room is left."""
        while n:
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, m = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.rooms[i]
                take = min(n, m)
                self.shelve(first + take, m - take, room)
                self.runs.append((length, rank, take, first, self.capacity - room))
                self.shelve(first, take, room - length)
                rank, n = rank + take, n - take
                continue
            each = self.capacity // length
            full, rest = divmod(n, each)
            for sequences, copies in ((full, each), (1 if rest else 0, rest)):
                if sequences:
                    first = self.open(sequences)
                    for j in range(copies):
                        self.runs.append((length, rank, sequences, first, j * length))
                        rank += sequences
                    self.shelve(first, sequences, self.capacity - copies * length)
            n = 0


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple = SMALL) -> Plan:
    """The packing of ``counts[length]`` pieces of each length, for the best share of small ones."""
    return min((grouped_packing(counts, capacity, groups, int(s * capacity)) for s in small), key=lambda p: p.sequences)


def grouped_packing(counts: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    """The scheme for one bound between small and large lengths."""
    plan = Plan(capacity)
    large = sorted((n for n in counts if small < n <= capacity), reverse=True)
    total = sum(counts[n] for n in large)
    # Groups of equal cardinality; pieces of one length stay together unless they fill groups.
    members: list[list[int]] = []
    held, share = 0, max(1, -(-total // groups))
    for n in large:
        if not members or held >= share:
            members.append([])
            held = 0
        members[-1].append(n)
        held += counts[n]
    rank = dict.fromkeys(counts, 0)
    if members:
        sizes = [m[0] for m in members]
        demand = [sum(counts[n] for n in m) for m in members]
        found = configurations(sizes, demand, capacity)
        left = list(demand)
        place = [0] * len(members)
        for copies, times in found:
            used = [i for i in np.flatnonzero(copies)]
            times = min([int(times + 1e-6), *(left[i] // int(copies[i]) for i in used)])
            if times <= 0:
                continue
            slots, cuts = [], {0, times}
            for i in used:
                for _ in range(int(copies[i])):
                    at, parts = 0, []
                    while at < times:
                        n = members[i][place[i]]
                        take = min(times - at, counts[n] - rank[n])
                        if take:
                            parts.append((at, n, rank[n]))
                            rank[n] += take
                            at += take
                            cuts.add(at)
                        if rank[n] == counts[n]:
                            place[i] += 1
                    slots.append(parts)
                left[i] -= times * int(copies[i])
            first = plan.open(times)
            edges = sorted(cuts)
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for parts in slots:
                    start, n, r = parts[bisect.bisect_right(parts, (a, 1 << 60)) - 1]
                    plan.runs.append((n, r + a - start, b - a, first + a, offset))
                    offset += n
                plan.shelve(first + a, b - a, capacity - offset)
    for n in sorted(counts, reverse=True):
        if counts[n] > rank[n]:
            plan.fit(n, rank[n], counts[n] - rank[n])
    return plan


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS, small: tuple = SMALL, end_id: int = 0) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Every row gives one piece at least: null and empty text is its end id alone. Equal
    rows are packed one by one; a null doc_id stays null. No row, no sequence.
    """
    pieces = staged(token_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, capacity, end_id), "pieces")
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    tally = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    runs = np.array(sorted(plan_packing(counts, capacity, groups, small).runs) or np.empty((0, 5)), np.int64)
    before = tally.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))

    def place(batches):
        key = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                run = runs[np.searchsorted(key, (length << 44) + rank, "right") - 1]
                columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
                yield pa.RecordBatch.from_pydict(columns | {"sequence_id": run[:, 3] + rank - run[:, 1], "offset": np.ascontiguousarray(run[:, 4])})

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    """The public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents that are left."""
    return packed(docs, default_tokenizer())
