"""Secrets: base spans restated without patterns, and the shapes that decoding confirms."""

import base64
import json
import random
import string

import pyarrow.parquet as pq
import pytest

from kinweave.llm import secretscan as scan

WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def assign_at(text, at):
    """Where an assignment that begins at ``at`` ends, and its value's length; None if there is none."""
    for word in WORDS:
        if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at : at + len(word)]) != word:
            continue
        end = at + len(word)
        for quote in (True, False):
            i = end
            if quote:
                if text[i : i + 1] not in ("'", '"') or not text[i : i + 1]:
                    continue
                i += 1
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] not in (":", "=") or not text[i : i + 1]:
                continue
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] in ("'", '"') and text[i : i + 1]:
                i += 1
            stop = i
            while stop < len(text) and text[stop] in VALUE:
                stop += 1
            if stop > i:
                return stop, stop - i
    return None


def plain(text):
    found, at = [], 0
    while at < len(text):
        hit = assign_at(text, at) if text[at] in "pPsStTaA" else None
        if hit:
            if hit[1] >= 8:
                found.append((at, 0, hit[0]))
            at = hit[0]
        else:
            at += 1
    for kind, head, letters, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            stop = at + len(head)
            if text[at:stop] != head:
                at += 1
                continue
            begin = stop
            while stop < len(text) and text[stop] in letters:
                stop += 1
            if stop > begin and stop - at >= least:
                found.append((at, kind, stop))
            at = max(stop, at + 1) if stop > begin else at + 1
    return sorted(found)


def test_base_spans_of_documents(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    rng = random.Random(2)
    parts = ["password", "API_KEY", "apikey", "Token", '"', "'", " ", "  ", ":", "=", "abc12345", "x/y+z==", "AKIA", "AKIAABCDEFGHIJKL1", "0123456789abcdef" * 2, "é", "\n", "k", "ſecret", "to\u212aen"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(2000)]
    for t in texts:
        assert scan.base_spans(t or "") == plain(t or ""), t
    assert any(scan.base_spans(t or "") for t in texts)


def der(tag, *parts):
    body = b"".join(parts)
    n = (len(body).bit_length() + 7) // 8
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x80 | n]) + len(body).to_bytes(n, "big")) + body


def number(size, seed):
    return der(2, b"\1" + random.Random(seed).randbytes(size - 1))


def ssh(data):
    return len(data).to_bytes(4, "big") + data


ALGORITHM = der(0x30, der(6, b"\x2b\x65\x70"))
KEYS = {
    "rsa": der(0x30, der(2, b"\0"), *(number(128, i) for i in range(8))),
    "dsa": der(0x30, der(2, b"\0"), *(number(64, i) for i in range(5))),
    "sec1": der(0x30, der(2, b"\1"), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86")), der(0xA1, der(3, b"\0" + bytes(64)))),
    "pkcs8": der(0x30, der(2, b"\0"), ALGORITHM, der(4, der(4, bytes(range(32))))),
    "encrypted": der(0x30, der(0x30, der(6, b"\x2a\x86"), der(0x30)), der(4, bytes(range(100)))),
    "openssh": b"openssh-key-v1\0" + ssh(b"none") + ssh(b"none") + ssh(b"") + (1).to_bytes(4, "big") + ssh(bytes(51)) + ssh(bytes(range(136))),
}


def keys_of(text):
    return [(a, b) for a, k, b in scan.confirmed_spans(text) if k == 4]


@pytest.mark.parametrize("kind", KEYS)
def test_keys_in_every_dress(kind):
    key = KEYS[kind]
    b64, digits = base64.b64encode(key).decode(), key.hex()
    lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    for body in (b64, base64.urlsafe_b64encode(key).decode(), lines, lines.replace("\n", "\\n"), lines.replace("\n", "\r\n"), digits, digits.upper()):
        for before, after in (("", ""), ("my key: ", " and on"), ("x", "\n")):
            assert keys_of(before + body + after) == [(len(before), len(before) + len(body))], (body, before)
        assert keys_of(body + "\n" + "!" + body) == [(0, len(body)), (len(body) + 2, 2 * len(body) + 2)]
    assert keys_of(b64[: len(b64) // 2]) == [] and keys_of(digits[: len(digits) // 2]) == []


def test_what_only_looks_like_a_key():
    text = der(0x30, der(2, b"\1"), der(4, b"hello, this is no key at all and far too long for a private number, as it has over 66 bytes"))
    other = der(0x30, *(number(20, i) for i in range(4)))
    public = der(0x30, ALGORITHM, der(3, bytes(40)))
    for data in (text, other, public, KEYS["rsa"][:-3], KEYS["rsa"][:1] + b"\x81" + KEYS["rsa"][2:]):
        assert keys_of(base64.b64encode(data).decode()) == [] and keys_of(data.hex()) == []
    # A number altered without moving a length still has a key's structure.
    assert keys_of(base64.b64encode(KEYS["rsa"][:-6] + bytes(6)).decode())


def test_tokens():
    enc = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    sign = enc("s" * 32)
    for head in ('{"alg":"HS256"}', '{ "alg": "RS256"}', '{\n"alg":"ES256"}', ' {"alg":"HS256"}'):
        jwt = f"{enc(head)}.{enc(json.dumps({'sub': 1}))}.{sign}"
        assert [(0, 3, len(jwt))] == [x for x in scan.confirmed_spans(jwt) if x[1] == 3]
    for bad in (f"{enc('[1, 2, 3, 4]')}.{enc('{}')}.{sign}", f"{enc('{}')}.{enc('{}')}.{sign}", "www.example.com", "e" * 40 + ".a.b"):
        assert scan.confirmed_spans(bad) == []
