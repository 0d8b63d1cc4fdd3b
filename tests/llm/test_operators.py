"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from kinweave.llm import decontaminate, jpeg, language, licences, packing, secretscan, simhash, substring, tokencount

DOCS = "doc_id long, text string, lang string, h string, salt int"
#: Null, empty, blank, repeated, long and odd texts, with columns whose names operators use inside.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "lost words here"), (None, None),
    (7, " ".join(f"w{i % 977}" for i in range(30_000))), (8, "x" * 5000), (9, "ÄÖ ß İ ﬁ   é́ 中文 <|endoftext|> a\x1cb"), (10, "`" * 300),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def path():
    return packing.default_tokenizer()


# --- token counts ---------------------------------------------------------------------------


def greedy(word, pieces, most):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in pieces)
        n += 1
    return n


def test_longest_match_counts():
    rng = random.Random(5)
    for _ in range(30):
        pieces = {bytes([b]) for b in b"abcd"} | {bytes(rng.choices(b"abcd", k=rng.randint(2, 6))) for _ in range(rng.randint(0, 25))}
        automaton, most = tokencount.LongestMatch(sorted(pieces)), max(map(len, pieces))
        for _ in range(60):
            word = bytes(rng.choices(b"abcd", k=rng.randint(0, 20)))
            assert automaton.count(word) == greedy(word, pieces, most)


def test_token_counts(odd, empty):
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(odd, path()).collect()}
    assert (1, 0, 0) in got and (3, 0, 0) in got and (5, 2, 2) in got and (None, 0, 0) in got
    assert tokencount.token_counts(odd, path()).count() == len(ODD)
    assert rows(tokencount.token_counts(empty, path())) == []


# --- language -------------------------------------------------------------------------------------


def test_cross_parse_matches_plain_greedy_parse():
    rng = random.Random(2)
    texts = {k: ["".join(rng.choices(a, k=400))] for k, a in (("aa", "abc "), ("bb", "bcd "))}
    model = language.CrossParser(texts)
    for _ in range(20):
        text = "".join(rng.choices("abcdz ", k=rng.randint(1, 300))).strip() or "a"
        clean = language.letters(text)
        counts, sizes = model.phrases([clean])
        for i, k in enumerate(model.languages):
            n = at = 0
            joined = texts[k][0]
            while at < len(clean):
                k2 = 0
                while at + k2 < len(clean) and clean[at : at + k2 + 1] in joined:
                    k2 += 1
                at, n = at + max(1, k2), n + 1
            assert counts[i, 0] == n and sizes[0] == len(clean)


def test_language_edges(spark, odd, empty):
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}
    got = language.identify(odd, language.fit(spark.createDataFrame([(i, f"the cat and the dog {i}", "en", "", 0) for i in range(9)], DOCS)))
    by = {(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()}
    assert (1, "und", 0.0) in by and (3, "und", 0.0) in by and (4, "en", 1.0) in by and (10, "und", 0.0) in by
    assert rows(language.identify(empty, language.fit(empty))) == []


def test_language_held_out_accuracy(spark, sf_dir):
    got = language.op2_language_id(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)


# --- decontamination and licences ---------------------------------------------------------------------


def test_decontamination(spark, odd, empty):
    words = [f"word{i}" for i in range(25)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "Tiny Item"), (None, "no id at all is here"), (1, "another text under one id ok")], "item_id long, text string")
    near = list(words)
    near[0] = near[24] = "changed"
    far = list(words)
    far[5] = far[12] = far[19] = "changed"
    docs = spark.createDataFrame([
        (10, "before " * 500 + " ".join(words).upper() + "! after" * 300), (11, ", ".join(near)), (12, " ".join(far)), (13, "a tiny, item b"), (14, None), (15, ""), (None, " ".join(words)), (16, " ".join(words)), (16, " ".join(words)),
    ], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_found"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(10, 1, 21), (11, 1, 19), (16, 1, 21), (13, 4, 1)}
    nothing = items.where("item_id = 99")
    assert decontaminate.contaminated(docs, nothing).count() == 0 and decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items).count() == 0


def test_licences(spark, odd, empty):
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and t.startswith("MIT License"))
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "sublicense")), (2, "text\nreleased UNDER the mit licence\nmore"), (3, mit + " and more"), (4, None), (None, "SPDX-License-Identifier: ISC")], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"], r["license_id"]) for r in licences.license_scan(docs).collect()}
    assert got == {(1, -1, "MIT"), (2, 1, "MIT"), (None, -1, "ISC"), (None, 0, "ISC")}
    assert licences.license_scan(odd).count() == 0 and licences.license_scan(empty).count() == 0


# --- packing -----------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(path()), []
    for i, t in ODD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    got = packing.packed(odd, path()).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert rows(packing.packed(empty, path())) == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 2048): rng.randint(1, 3000) for _ in range(rng.choice([1, 5, 80, 600]))}
    plan = packing.plan_packing(counts)
    seen, filled = {n: np.zeros(c, int) for n, c in counts.items()}, np.zeros(plan.sequences, int)
    for n, rank, k, first, offset in plan.runs:
        seen[n][rank : rank + k] += 1
        filled[first : first + k] += n
    assert all((s == 1).all() for s in seen.values()) and (filled <= 2048).all() and (filled > 0).all()
    bound = max(-(-sum(n * c for n, c in counts.items()) // 2048), sum(c for n, c in counts.items() if n > 1024))
    assert plan.sequences <= 1.12 * bound + 2


# --- media -------------------------------------------------------------------------------------------------------


def test_media_round_trip(odd, empty):
    got = jpeg.media_features(jpeg.with_media(odd)).collect()
    want = {}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want.setdefault(i, set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert len(got) == len(ODD) and all(tuple(r)[1:5] in want[r["doc_id"]] for r in got)
    assert rows(jpeg.media_features(jpeg.with_media(empty))) == []


def test_media_any_bytes():
    writer = jpeg.Writer()
    payloads = [os.urandom(64 * n) for n in (1, 2, 7, 300)] + [bytes([b]) * 128 for b in (0, 95, 96, 97, 255)]
    images = jpeg.decode(writer.encode(payloads))
    assert [jpeg.payload_of(i) for i in images] == payloads
    for bad in (b"", b"\xff\xd8", b"GIF89a", writer.encode(payloads[:1])[0][:200]):
        with pytest.raises((jpeg.MediaError, IndexError)):
            jpeg.decode([bad])


def _colour_image(rng, restart):
    """A 4:2:0 image with random coefficients, written one symbol at a time."""
    (dc, dcs), (ac, acs) = jpeg._writer_tables()
    codes = [{s: (c, n) for s, c, n in jpeg._codes(*t)} for t in ((dc, dcs), (ac, acs))]
    rows_, columns = 2, 3
    layout = [(0, y, x) for y in range(2) for x in range(2)] + [(1, 0, 0), (2, 0, 0)]
    blocks, bits, out, before = {}, "", b"", [0, 0, 0]

    def put(bits, table, symbol, value, size):
        c, n = codes[table][symbol]
        bits += format(c, f"0{n}b")
        return bits + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "")

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(rows_ * columns):
        if restart and m and m % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", [0, 0, 0]
        for k, y, x in layout:
            block = [0] * 64
            block[0] = rng.randint(-100, 100)
            for _ in range(rng.randint(0, 12)):
                block[rng.randrange(1, 64)] = rng.randint(-255, 255)
            blocks[(k, m, y, x)] = block
            diff = block[0] - before[k]
            before[k] = block[0]
            bits = put(bits, 0, abs(diff).bit_length(), diff, abs(diff).bit_length())
            run = 0
            last = max((i for i in range(64) if block[i]), default=0)
            for v in block[1 : last + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = put(bits, 1, 0xF0, 0, 0), run - 16
                size = abs(v).bit_length()
                bits, run = put(bits, 1, run << 4 | size, v, size), 0
            if last < 63:
                bits = put(bits, 1, 0, 0, 0)
    out += flush(bits)
    writer = jpeg.Writer()
    import struct

    tables = b"".join(bytes([kind]) + bytes(c) + bytes(s) for kind, c, s in ((0, dc, dcs), (0x10, ac, acs)))
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16 * rows_, 16 * columns - 5, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + writer.fixed + frame + b"\xff\xc4" + struct.pack(">H", 2 + len(tables)) + tables
    head += (b"\xff\xdd" + struct.pack(">HH", 4, restart) if restart else b"") + b"\xff\xda" + struct.pack(">HB", 12, 3) + bytes([1, 0, 2, 0, 3, 0, 0, 63, 0])
    return head + out + b"\xff\xd9", blocks, columns


@pytest.mark.parametrize("restart", [0, 1, 4])
def test_reader_takes_colour_images(restart):
    data, blocks, columns = _colour_image(random.Random(restart), restart)
    image = jpeg.decode([data])[0]
    for (k, m, y, x), block in blocks.items():
        v = 2 if k == 0 else 1
        assert image.blocks[k][(m // columns) * v + y, (m % columns) * v + x].tolist() == block
    assert jpeg.luminance(image).shape == (4, 6)


# --- secrets -----------------------------------------------------------------------------------------------------------


def test_secret_kinds(spark, odd, empty):
    import base64
    import json

    def der(tag, body):
        size = len(body)
        head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
        return bytes([tag]) + head + body

    key = der(0x30, der(2, b"\0") + b"".join(der(2, os.urandom(1).replace(b"\0", b"\1") + bytes(range(1, 65))) for _ in range(8)))
    b64 = base64.b64encode(key).decode()
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{enc({'alg': 'HS256', 'typ': 'JWT'})}.{enc({'sub': '1'})}.{base64.urlsafe_b64encode(bytes(32)).decode().rstrip('=')}"
    fake = "eyJhbGciOiJub3QganNvbg.eyJ4.AAAA"
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{b64}\n-----END RSA PRIVATE KEY-----"
    texts = ['é password: "hunter2hunter2" TOKEN=short', "AKIA" + "A" * 12 + " AKIAAB", "f" * 40 + " " + "a" * 31, jwt, fake, b64, b64[:-9], armour, key.hex(), "token=" + key.hex()]
    out = secretscan.secret_scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    spans = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert spans[0] == "assign:2:27" and spans[1] == "access:0:16" and spans[2] == "hex:0:40"
    assert spans[3] == f"jwt:0:{len(jwt)}" and spans[4] == "" and spans[5] == f"key:0:{len(b64)}" and "key" not in spans[6]
    assert spans[7] == f"key:0:{len(armour)}" and spans[8] == f"hex:0:{2 * len(key)},key:0:{2 * len(key)}" and spans[9].startswith("assign:0:")
    assert secretscan.secret_scan(odd).where("spans <> ''").count() == 0 and secretscan.secret_scan(empty).count() == 0


# --- simhash and substrings ------------------------------------------------------------------------------------------------


def test_trie_links_are_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6)]))
    root = simhash.trie_links(keys, np.array([0, len(keys)]), 0)
    links = simhash.Links(len(keys))
    i, j = np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3)
    links.join(i, j)
    assert (root == links.root).all()


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    docs = []
    for base in range(6):
        text = rng.choices(words, k=400)
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(400)] = rng.choice(words)
            docs.append(" ".join(copy))
    prints = np.array([simhash.fingerprint(simhash.shingle_hashes(t)) for t in docs], np.uint64)
    links = simhash.Links(len(docs))
    links.join(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {i: (f"{int(prints[i]):016x}", int(links.root[i])) for i in range(len(docs))}
    out = simhash.near_duplicates(odd).collect()
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out}
    assert len(out) == len(ODD) and by[1] == ("0" * 16, 1) and by[3] == ("0" * 16, 1) and by[6][1] == 5 and by[None][1] is None
    assert rows(simhash.near_duplicates(empty)) == []


def brute_substring(docs, window=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passages = [rng.choices(words, k=k) for k in (12, 13, 14, 40, 90)]
    docs = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices(words, k=rng.randint(0, 30)) + rng.choice(passages)
        docs.append((rng.choice([d, d, d, None]), " ".join(text)))
    docs += [docs[3], docs[4], (100, docs[5][1]), (101, docs[5][1])]
    got = substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got) == brute_substring(docs)


def test_substring_edges(odd, empty):
    assert rows(substring.substring_dedup(odd)) == brute_substring(ODD)
    assert rows(substring.substring_dedup(empty)) == []


@pytest.mark.parametrize("window, first, lengths", [(5, 2, [2, 3, 5]), (26, 3, [2, 4, 7, 13, 26]), (3, 7, [3]), (1, 7, [1])])
def test_substring_levels(spark, window, first, lengths):
    assert substring.levels(window, first) == lengths
    rng = random.Random(window)
    words = [f"v{i}" for i in range(60)]
    passages = [rng.choices(words, k=k) for k in (6, 25, 26, 27, 60)]
    docs = [(d, " ".join(rng.choices(words, k=rng.randint(0, 20)) + rng.choice(passages) + rng.choices(words, k=5))) for d in range(40)]
    got = substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), window=window, first=first)
    assert rows(got) == brute_substring(docs, window)


def test_substring_without_repeats_ends_early(spark):
    docs = [(d, " ".join(f"w{d}_{i}" for i in range(40))) for d in range(5)]
    assert rows(substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), first=3)) == brute_substring(docs)


@pytest.mark.parametrize("hot", [1 << 18, 3])
def test_fingerprint_edges_of_one_huge_bucket(spark, hot):
    """Fingerprints that all agree in one block: the components are those of all links, however buckets are split."""
    from kinweave.operators.components import connected_components

    rng = random.Random(8)
    base = [rng.getrandbits(48) for _ in range(25)]
    prints = sorted({(x ^ sum(1 << rng.randrange(48) for _ in range(rng.randint(0, 4))) & ((1 << 48) - 1)) | 0xABCD << 48 for x in base for _ in range(30)})
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "rep long, fp long")
    got = {r["id"]: r["component"] for r in connected_components(simhash.fingerprint_edges(frame, hot=hot)).collect()}
    place = {x: i for i, x in enumerate(prints)}
    want = {place[x]: place[find(x)] for x in prints}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(want)


def test_short_items_have_sql(spark, tmp_path):
    import duckdb

    docs = [(1, "The cat sat on the mat today."), (2, "A cat"), (3, None), (4, ""), (5, "one two three four five six seven"), (6, "two THREE! four"), (6, "cat")]
    items = [(10, "Cat!"), (11, "the mat"), (12, "two three four"), (13, "one two three four five six"), (14, "--"), (15, None), (10, "sat on the mat")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = rows(decontaminate.op3_benchmark_decontamination(spark, str(tmp_path)))
    assert got == sorted(c.sql(decontaminate.ORACLE).fetchall(), key=repr) and len(got) >= 6
