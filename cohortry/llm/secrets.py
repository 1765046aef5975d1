"""Secret scan: base patterns, and spans confirmed by decoding their structure.

Base kinds are found by pattern alone. Structural kinds are reported only when the
candidate decodes: a JSON header with an algorithm and a JSON body for signed tokens,
nested DER lengths that fill the blob for keys, and length-prefixed fields for SSH
keys. Null and empty texts have no spans. Positions are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order they are listed in the result.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|"
                    + _either("api") + "_?" + _either("key")
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # a run of 32 or more starts where its maximal run starts
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BLOB = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")


def _unbase64(text: str, url: bool = False) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(text: str) -> bool:
    """Three parts; header and body are JSON objects, the header names an algorithm."""
    parts = text.split(".")
    found = []
    for part in parts[:2]:
        raw = _unbase64(part, url=True)
        try:
            found.append(json.loads(raw) if raw else None)
        except (ValueError, RecursionError):
            return False
    return len(parts) == 3 and all(isinstance(x, dict) for x in found) and isinstance(found[0].get("alg"), str)


def _der_item(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at ``at``, if its length fits."""
    if at + 2 > len(raw):
        return None
    size, body = raw[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > len(raw):
            return None
        size, body = int.from_bytes(raw[body:body + n], "big"), body + n
    return (raw[at], body, body + size) if body + size <= len(raw) else None


def der_key(raw: bytes) -> bool:
    """A sequence that fills the blob, whose elements fill it in turn, and holds an
    integer or key string: the common frame of PKCS#1, PKCS#8, SEC1 and SPKI keys."""
    top = _der_item(raw, 0)
    if top is None or top[0] != 0x30 or top[2] != len(raw) or len(raw) < 32:
        return False
    at, tags = top[1], []
    while at < top[2]:
        item = _der_item(raw[:top[2]], at)
        if item is None:
            return False
        tag, body, at = item
        if tag == 0x30:  # one level down: inner lengths must fill the inner sequence too
            inner = body
            while inner < at:
                step = _der_item(raw[:at], inner)
                if step is None:
                    return False
                inner = step[2]
        tags.append(tag)
    return len(tags) >= 2 and tags[0] in (0x02, 0x30) and any(t in (0x02, 0x03, 0x04) for t in tags)


def ssh_key(raw: bytes) -> bool:
    """Length-prefixed fields that fill the blob, the first a key type, or the private-key magic."""
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4:at + 4 + size])
        at += 4 + size
    return at == len(raw) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if signed_token(m[0])]
    inside = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            raw = _unbase64(m[2])
            if raw and (der_key(raw) or ssh_key(raw)):
                out.append((m.start(), m.end(), "pem"))
            inside.append((m.start(), m.end()))
    free = lambda m: not any(a <= m.start() < b for a, b in inside)
    for m in BLOB.finditer(text):
        if m[0].startswith(("M", "AAAA")) and free(m):
            raw = _unbase64(m[0])
            if raw and der_key(raw):
                out.append((m.start(), m.end(), "der"))
            elif raw and ssh_key(raw):
                out.append((m.start(), m.end(), "ssh"))
    for m in HEX_BLOB.finditer(text):
        if len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_<kind>`` for the base kinds, ``base_spans``, ``spans`` and ``redacted``.

    ``redacted`` is the text with every span replaced by its kind in brackets (overlapping
    spans as one, named after the first). A map over rows: no shuffle, memory of one batch.
    Columns of these names in the input are replaced.
    """
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted"]
    docs = docs.drop(*new)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, max(batch.num_rows, 1), 1000)):
                cols: dict[str, list] = {c: [] for c in new}
                for value in part.column(part.schema.get_field_index(text)).to_pylist():
                    value = value or ""
                    base = base_spans(value)
                    spans = base + confirmed_spans(value)
                    for kind in KINDS[:3]:
                        cols[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                    cols["base_spans"].append(joined(base))
                    cols["spans"].append(joined(spans))
                    cols["redacted"].append(redact(value, spans) if spans else value)
                types = [pa.int64()] * 3 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(cols[c], t) for c, t in zip(new, types))],
                    names=[*part.schema.names, *new])

    return docs.mapInArrow(run, f"{fields}, n_assign long, n_access long, n_hex long, base_spans string, "
                                "spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
