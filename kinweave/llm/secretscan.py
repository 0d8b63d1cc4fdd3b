"""Secret scans with structural confirmation.

Patterns find assignments, access ids and long hexadecimal strings. Beyond those,
base64 and hexadecimal candidates are decoded and reported only if what they hold parses:
the DER encoding of a private key, whose nested lengths add up and whose elements are
those of PKCS#1, DSA, SEC 1 or PKCS#8 (plain or encrypted), the length-prefixed fields of an
OpenSSH key, or a signed token whose header and claims are JSON. Structure can't tell a key from
one whose numbers were altered without moving a length. Public keys are no secrets.

An encoding says how long it is, so a candidate may follow or precede other characters, be
broken into lines, use either base64 alphabet, or hexadecimal digits of either case.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, table

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Kinds in their order: the base ones, then those that decoding confirms.
KINDS = ("assign", "access", "hex", "jwt", "key")

_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# A header's first byte is a brace or JSON white space.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[eICD][A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s\\]*)-----END \1PRIVATE KEY-----")
# How a SEQUENCE of some length, and an OpenSSH key, begin in base64 and in hexadecimal digits.
_STARTS = (
    (re.compile(r"M[A-P][A-Za-z0-9+/_-]{6}"), 64), (re.compile(r"b3BlbnNzaC1rZXktdjEA"), 64),
    (re.compile(r"30[0-9A-Fa-f]{6}"), 16), (re.compile(r"6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100"), 16),
)
_RUN = {64: re.compile(r"[A-Za-z0-9+/_-]+"), 16: re.compile(r"[0-9A-Fa-f]+")}
_BREAK = re.compile(r"(?:\\[rn]|[\r\n\t ])*")
_SAFE = str.maketrans("-_", "+/")
#: Bytes that a key's encoding may take: four times those of the largest keys in use.
MOST = 1 << 16


def der_end(data: bytes, at: int, stop: int, depth: int = 0) -> int:
    """Where the DER value at ``at`` ends; -1 if its lengths don't nest."""
    if at + 2 > stop or depth > 16:
        return -1
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > stop:
            return -1
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or n > 1 and size >> (8 * (n - 1)) == 0:
            return -1  # not the shortest form
        at += n
    if at + size > stop or tag == 0:
        return -1
    if tag & 0x20:
        inner = at
        while inner < at + size:
            inner = der_end(data, inner, at + size, depth + 1)
            if inner < 0:
                return -1
    return at + size


def _header(data: bytes) -> tuple[int, int]:
    """Of a DER value its content's offset and its end, by its own first bytes."""
    size = data[1]
    if size < 0x80:
        return 2, 2 + size
    n = size & 0x7F
    return 2 + n, 2 + n + int.from_bytes(data[2 : 2 + n], "big")


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over all the bytes, nested right, with the elements of a private key's encoding."""
    if len(data) < 24 or data[0] != 0x30 or der_end(data, 0, len(data)) != len(data):
        return False
    at, parts = _header(data)[0], []
    while at < len(data) and len(parts) < 11:
        end = der_end(data, at, len(data))
        parts.append(data[at:end])
        at = end
    kinds, version = bytes(p[0] for p in parts), parts[0][2:] if parts and parts[0][0] == 2 else b""
    if kinds in (b"\2" * 9, b"\2" * 9 + b"\x30"):  # PKCS#1; a tenth element lists more primes
        return version == (b"\0" if len(parts) == 9 else b"\1") and len(parts[1]) > 32
    if kinds == b"\2" * 6:  # DSA
        return version == b"\0" and len(parts[1]) > 32
    if kinds[:2] == b"\2\4":  # SEC 1: a number, then the curve and the public point if they are there
        return version == b"\1" and 20 <= len(parts[1]) - 2 <= 66 and kinds[2:] in (b"", b"\xa0", b"\xa1", b"\xa0\xa1")
    names_algorithm = lambda p: p[0] == 0x30 and p[_header(p)[0] :][:1] == b"\6"
    if kinds[:3] == b"\2\x30\4":  # PKCS#8
        return version in (b"\0", b"\1") and names_algorithm(parts[1]) and set(kinds[3:]) <= {0xA0, 0xA1, 0x81}
    return kinds == b"\x30\4" and names_algorithm(parts[0]) and len(parts[1]) > 24  # PKCS#8, encrypted


def openssh_end(data: bytes) -> int:
    """Where an ``openssh-key-v1`` ends: cipher, derivation, options, then as many keys as it says; -1 if it is none."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return -1
    at = len(magic)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1 if 1 <= keys <= 16 else 0):
        if at + 4 > len(data):
            return -1
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if 1 <= keys <= 16 and at <= len(data) else -1


def is_openssh_key(data: bytes) -> bool:
    return openssh_end(data) == len(data)


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def _decoded(text: str, safe: bool = False, base: int = 64) -> bytes | None:
    """The bytes that digits stand for; what is left of an incomplete byte is dropped."""
    if base == 16:
        return bytes.fromhex(text[: len(text) // 2 * 2])
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        if safe:
            return None
        text = text[:-1]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if safe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """A header that names its algorithm, claims in JSON, and a signature unless the algorithm is none."""
    head, claims, signature = text.split(".")
    try:
        header, body = (json.loads((_decoded(x, True) or b"").decode()) for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(body, dict):
        return False
    return header["alg"].lower() == "none" or len(_decoded(signature, True) or b"") >= 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds: leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if (":" in low or "=" in low) and any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoded_key(text: str, at: int, base: int) -> int:
    """Where the key that begins at ``at``, in base64 or base 16, ends in the text; -1 if there is none."""
    first, per = text[at : at + 8].translate(_SAFE), 4 / 3 if base == 64 else 2
    head = base64.b64decode(first) if base == 64 else bytes.fromhex(first)
    if head[0] == 0x30:
        size = _header(head)[1] if head[1] <= 0x82 else 0
        if not 24 <= size <= MOST:
            return -1
    else:
        size = MOST
    need = -int(-size * per // 1)
    # Runs of digits, joined over line breaks, up to what the header asks for.
    digits, ends, where = [], [], at
    held = 0
    while held < need:
        run = _RUN[base].match(text, where, min(len(text), where + need - held))
        if not run:
            break
        held += len(run[0])
        digits.append(run[0])
        ends.append((held, run.end()))
        where = _BREAK.match(text, run.end()).end()
    if head[0] == 0x30 and held < need:
        return -1
    whole = "".join(digits)
    data = _decoded(whole.translate(_SAFE) if base == 64 else whole, base=base)
    if data is None:
        return -1
    end = len(data) if head[0] == 0x30 and is_der_key(data[:size]) else openssh_end(data)
    if end < 0:
        return -1
    need = -int(-(size if head[0] == 0x30 else end) * per // 1)
    held, stop = next(x for x in ends if x[0] >= need)
    stop -= held - need
    if base == 64 and need % 4 and text.startswith("=" * (4 - need % 4), stop):
        stop += 4 - need % 4
    return stop


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans whose decoded bytes parse, keys without overlap."""
    found, taken = set(), []
    if "." in text:
        found |= {(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])}
    if "PRIVATE KEY-----" in text:
        for m in _ARMOUR.finditer(text):
            data = _decoded(re.sub(r"\\[nr]|\s|\\", "", m[2]))
            if data and is_key(data):
                taken.append((m.start(), m.end()))
    for pattern, digits in _STARTS:
        m = pattern.search(text)
        while m:
            a = m.start()
            b = next((y for x, y in taken if x <= a < y), -1)
            if b < 0 and (b := encoded_key(text, a, digits)) >= 0:
                taken.append((a, b))
            m = pattern.search(text, max(a + 1, b))
    return sorted(found | {(a, 4, b) for a, b in taken})


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row for each input row.

    Offsets are code points, ends exclusive. Null text is empty: no spans, the digest of
    nothing. A null doc_id stays null; equal texts give equal values.
    """

    def make():
        def batch_of(texts, batch):
            base = [base_spans(t) if t else [] for t in texts]
            spans = [_listed(b + confirmed_spans(t)) if t else "" for t, b in zip(texts, base)]
            count = lambda k: pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())
            return {"doc_id": batch.column("doc_id"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], "spans": spans}

        return batch_of

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
