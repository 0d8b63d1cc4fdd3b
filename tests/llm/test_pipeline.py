"""The pipeline and each of its stages against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from kinweave.llm import packing
from tests.llm.test_lines import linked_by_edits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_lines string, _held int, bucket int"
ITEM = "which of the following planets is known to have the largest number of moons in our system"


def corpus(seed=3):
    rng = random.Random(seed)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(400)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "éàüöstuv"))}
    docs = []
    for d in range(60):
        lang = rng.choice(sorted(words))
        lines = [" ".join(rng.choices(words[lang], k=rng.randint(6, 30))) for _ in range(rng.randint(1, 5))]
        if docs and d % 5 == 0:
            lines.append(rng.choice(docs)[1].split("\n")[0])
        if docs and d % 7 == 0:
            other = rng.choice(docs)[1].split("\n")[0].split()
            other[len(other) // 2] = "changed"
            lines.insert(0, " ".join(other))
        if d % 11 == 3:
            lines.append(f"Well, {ITEM.capitalize()}?")
        docs.append((d, "\n".join(lines), lang))
    docs += [(100, docs[7][1], "aa"), (101, docs[7][1] + " x", "aa"), (102, None, "aa"), (103, "", None), (104, "123 -- 456\n!!", "bb"), (105, " \n ", "cc")]
    return [(*d, "web", len(d[1] or ""), "kept", 7, 9) for d in docs]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "no such words anywhere"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def languages(docs):
    return [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]


def lines(docs):
    texts = dict(linked_by_edits_with_blanks([(d[0], d[1]) for d in docs]))
    return [(d[0], texts[d[0]], d[2], d[3], len(texts[d[0]]) if texts[d[0]] != d[1] else d[4], *d[5:]) for d in docs]


def linked_by_edits_with_blanks(docs):
    """Lines without a word stay where they are; the others go through the brute-force version one text at a time."""
    own = [(d, p, x) for d, t in docs for p, x in enumerate(t.split("\n"))]
    wordy = [(d, p, x) for d, p, x in own if re.search(r"[^\W_]", x)]
    # A document of one line for each occurrence, in order.
    kept = linked_by_edits([(i, x) for i, (_, _, x) in enumerate(sorted(wordy))])
    gone = {(d, p) for (d, p, _), (_, t) in zip(sorted(wordy), kept) if t == ""}
    return [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)) for d, t in docs]


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def near(docs):
    root = {d[0]: d[0] for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = {d[0]: fingerprint(d[1]) for d in docs}
    for a in root:
        for b in root:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in docs if find(d[0]) == d[0]]


def shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def clean(docs):
    item = shingles(ITEM)
    return [d for d in docs if len(item & shingles(d[1])) < 0.8 * len(item)]


PLAIN = {"language_id": languages, "line_dedup": lines, "simhash_near_dedup": near, "benchmark_decontamination": clean}


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def packed_whole(frame, docs):
    """Pieces are whole, in place and without gaps, and few sequences are used."""
    tokens = packing.ChunkTokens(packing.default_tokenizer()).tokenizer
    got = [r.asDict() for r in frame.collect()]
    length = {d[0]: len(tokens.encode(d[1] or "", add_special_tokens=False).ids) + 1 for d in docs}
    assert {d: sum(r["length"] for r in got if r["doc_id"] == d) for d in length} == length
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-sum(length.values()) // 2048) + 1


def test_stages_and_run(spark, folder):
    docs = corpus()
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = PLAIN[name](docs)
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns
        assert rows(out) == sorted(want), name
        assert len(want) < len(docs) or any(a[1] != b[1] for a, b in zip(want, docs)), f"{name} has nothing to do"
        docs, frame = want, spark.createDataFrame(want, SCHEMA)
    packed_whole(corpus_pipeline.STAGES[-1][1](spark, frame, folder), docs)
    packed_whole(corpus_pipeline.run(spark, folder), docs)


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, folder, k):
    """No rows, rows without an id, repeated rows."""
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder).collect() == []
    odd = [(None, "lost words are here for all to see", "aa", "w", 1, "x", 1, 2), (None, None, None, None, None, None, None, None), (5, "some words that stay here", "aa", "w", 1, "x", 1, 2), (5, "some words that stay here", "aa", "w", 1, "x", 1, 2)]
    out = stage(spark, spark.createDataFrame(odd, SCHEMA), folder)
    assert out.where("doc_id is null").count() >= 1
    if k < 4:
        assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    if k in (2, 3):
        assert out.count() == 4
