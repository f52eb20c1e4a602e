"""Secrets in texts: patterns, and candidates confirmed by their structure.

Runs of base64 or hex and dotted tokens are decoded, and reported only where the bytes are what they
would have to be: a private key whose DER lengths nest to the last byte (PKCS#1, PKCS#8, SEC 1), an
OpenSSH private key whose length-prefixed fields fit, or a signed token whose header is a JSON object
that names its algorithm and whose payload is JSON as well. Base matches always stay.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import arrow_pass, free_name, table

NAME = "op10_secret_scans"

#: Fixed values of the contract: kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?:(?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Kinds that structure confirms, in their order behind the base kinds.
CONFIRMED = ("token", "key")
#: Object identifiers (DER bodies) of key algorithms: RSA, EC, Ed25519, X25519, DSA.
KEY_ALGORITHMS = tuple(bytes.fromhex(x) for x in (
    "2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401"))

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]++")
_ARMOUR = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\+[nrt/])++)-----END \1-----")
#: White space or its escaped form, as in JSON and source strings (``\\/`` is a slash there).
_BREAK = re.compile(r"\\+[nrt]|\s|\\+(?=/)")
#: A DER sequence of over 30 bytes, or the OpenSSH magic, in base64; a DER sequence in hex.
_ENCODED = re.compile(
    r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))"
    r"(?:(?:MC|MD|MF|MG|MH|MI)[A-Za-z0-9+/_-]{38,}+|b3BlbnNzaC[A-Za-z0-9+/_-]{30,}+)={0,2}"
    r"|(?<![0-9A-Fa-f])30[0-9A-Fa-f]{80,}+")
#: The same from its start over line ends, real or escaped, as far as lines are base64.
_WRAPPED = re.compile(
    r"[A-Za-z0-9+/_-]++(?:[\x20\t]*+(?:\r?\n|(?:\\+[nr])++)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Characters of a wrapped key that are looked at first; more as its lengths ask for.
WRAPPED_CHARS = 400
_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW_SPANS = pa.list_(pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text)
                  if len(m.group(1)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)
                  if len(m.group()) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def decode(encoded: str) -> bytes | None:
    """Bytes of base64 (either alphabet, padding optional), or None."""
    plain = encoded.translate({45: "+", 95: "/"}).rstrip("=")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def fields_of(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER fields ``(tag, body)`` that fill ``data`` exactly, or None."""
    fields, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            return None
        fields.append((tag, data[at : at + size]))
        at += size
    return fields


def private_key(data: bytes) -> bool:
    """Whether bytes are a private key by their nested lengths."""
    if data.startswith(b"openssh-key-v1\0"):
        return _openssh(data)
    outer = fields_of(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = fields_of(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02:
        return False
    tags, version = [tag for tag, _ in inner], inner[0][1]
    if tags[:9] == [0x02] * 9 and version in (b"\0", b"\1"):  # PKCS#1: modulus, exponents, primes
        return len(inner[1][1]) >= 32 and all(body for _, body in inner)
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and version in (b"\0", b"\1"):  # PKCS#8
        kind = fields_of(inner[1][1])
        return bool(kind) and kind[0][0] == 0x06 and kind[0][1] in KEY_ALGORITHMS and bool(inner[2][1])
    if version == b"\1" and tags[1] == 0x04 and len(inner[1][1]) in (20, 24, 28, 32, 48, 66):  # SEC 1
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return False


def _openssh(data: bytes) -> bool:
    at, fields = 15, 0

    def read(at):
        size = int.from_bytes(data[at : at + 4], "big")
        return None if at + 4 > len(data) or at + 4 + size > len(data) else at + 4 + size

    for fields in range(3):  # cipher, key derivation, its options
        at = read(at)
        if at is None:
            return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):  # public keys and the private part; each has four bytes at least
        at = read(at)
        if at is None:
            return False
    return keys >= 1 and at == len(data)


def signed_token(candidate: str) -> bool:
    """Whether a dotted token has a header that names its algorithm and a payload of JSON."""
    head, body, _ = candidate.split(".")
    try:
        header = json.loads(decode(head) or b"")
        payload = json.loads(decode(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def key_size(data: bytes) -> int | None:
    """Bytes of the DER value or the OpenSSH key that ``data`` begins with, as its lengths say; None
    where ``data`` ends before they do."""
    if data.startswith(b"openssh-key-v1\0"):
        at, left, keys = 15, 3, None
        while left:
            if at + 4 > len(data):
                return None
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
            if not left and keys is None:
                if at + 4 > len(data):
                    return None
                keys = int.from_bytes(data[at : at + 4], "big")
                at, left = at + 4, keys + 1
        return at
    more = data[1] & 0x7F if len(data) > 1 and data[1] & 0x80 else 0
    if len(data) < 2 + more:
        return None
    return 2 + more + (int.from_bytes(data[2 : 2 + more], "big") if more else data[1])


def _starts_key(data: bytes) -> bool:
    """Whether bytes may begin a private key: the OpenSSH magic, or a sequence that begins with
    the number 0 or 1."""
    more = data[1] & 0x7F if len(data) > 1 and data[1] & 0x80 else 0
    return data.startswith(b"openssh-key-v1\0") or data[2 + more : 5 + more] in (b"\x02\x01\0", b"\x02\x01\1")


def wrapped_key(text: str, start: int) -> int | None:
    """The end of a private key in base64 that goes on over lines from ``start``, or None. Its own
    lengths say where it ends, so words in the next line do not matter and no length is too long."""
    if not _starts_key(decode(text[start : start + 40]) or b""):
        return None
    window, before = WRAPPED_CHARS, -1
    while True:
        m = _WRAPPED.match(text, start, start + window)
        if m:
            plain = _BREAK.sub("", m.group()).rstrip("=")
            size = key_size(decode(plain[: len(plain) // 4 * 4]) or b"")
            chars = -(-(size or 0) * 4 // 3)
            if chars > len(text) - start:
                return None
            if size is not None and chars <= len(plain):
                break
            if m.end() == before:  # the lines end before the key does
                return None
            before = m.end()
            window = max(window, chars)
        if start + window >= len(text):
            return None
        window *= 2
    data = decode(plain[:chars]) if chars else None
    if not data or not private_key(data):
        return None
    end, left = start, chars
    while left:
        gap = _BREAK.match(text, end)
        left -= not gap
        end = gap.end() if gap else end + 1
    while end < m.end() and text[end] == "=":
        end += 1
    # Behind its last sign the line ends.
    return None if re.match(r"[A-Za-z0-9+/_-]", text[end : end + 1]) else end


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens and private keys, by structure."""
    found = []
    if "ey" in text:
        found += [("token", *m.span()) for m in _SIGNED.finditer(text) if signed_token(m.group())]
    for m in _ARMOUR.finditer(text) if "-----BEGIN" in text else ():
        data = decode(_BREAK.sub("", m.group(2)))
        if data and private_key(data):
            found.append(("key", *m.span()))
    covered = [(a, b) for kind, a, b in found if kind == "key"]
    behind = 0
    for m in _ENCODED.finditer(text):
        a, b = m.span()
        if a < behind or any(x <= a and b <= y for x, y in covered):
            continue
        raw = m.group()
        data = (bytes.fromhex(raw[: len(raw) // 2 * 2]) if raw[:2] == "30" else decode(raw))
        if data and private_key(data):
            found.append(("key", a, b))
        elif raw[:2] != "30" and (end := wrapped_key(text, a)):
            found.append(("key", a, end))
            behind = end
    return found


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Base and confirmed spans by start, then kind."""
    order = (*KINDS, *CONFIRMED)
    spans = [(*s, True) for s in base_spans(text)] + [(*s, False) for s in confirmed_spans(text)]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns and, last, ``_spans``: kind, start and end in code points, and whether the
    span is a base match. Where the table has a column of that name, underscores go in front. Null and
    empty texts have none; rows are taken one by one."""
    name = free_name(docs, "_spans")
    schema = T.StructType([*docs.schema, T._parse_datatype_string(f"{name} {_SPANS}")[0]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in all_spans(t or "")]
                 for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(spans, _ARROW_SPANS)], names=[*batch.schema.names, name])

    return arrow_pass(docs, text, schema, work)


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base matches by kind, their digest, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("_spans")).alias("spans"))
