"""Secret scans: patterns for candidates, and structure to confirm what they hold.

Base kinds are found by pattern alone. The method adds spans that are confirmed by structure:

* pem: a private key block whose base64 body decodes to DER with consistent nested lengths, to an
  OpenSSH key container, or to the length-prefixed strings of one.
* token: three base64url parts whose first decodes to a JSON object with an algorithm and whose
  second to a JSON object; the signature may be empty only for the algorithm "none".
* key: a bare base64, base64url or hexadecimal run that decodes to a DER private or public key
  structure (a sequence whose nested lengths add up, with a version or an algorithm identifier in
  front), or to SSH key fields. Every run that is long enough for a key is decoded. Base64 may be
  wrapped: lines are joined up to the one that ends the structure.

Lines of a pem or a key may also be parted by backslash-n or backslash-r as written in JSON or
settings files, and may have quote marks (>) in front.

Spans are code point offsets, end exclusive. Letters in patterns are ASCII ones. Null texts count
as empty and have no spans; repeated rows get equal results. Extra columns pass through; a column
named like an output is replaced by it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bytekit, common

#: The base patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "pem", "token", "key")

_BEGIN = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,.>-]|\\+[nr])*")
#: A header of 14 characters is the shortest that can name an algorithm.
_TOKEN = re.compile(r"(?:(?<![A-Za-z0-9_\\-])|(?<=\\[nr])|(?<=\\)(?![nr]))(?=([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
_PARTS = re.compile(r"(?:[\s>]|\\+[nr])+")
_NEXT = re.compile(r"[ \t>]*(?:\r?\n|\r|(?:\\+r)?\\+n|\\+r)[ \t>]*([A-Za-z0-9+/]+={0,2})")
#: Runs of 32 bytes and more; no key is shorter.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/\\])|(?<=\\[nr])|(?<=\\)(?![nr]))[A-Za-z0-9+/]{42,}={0,2}")
_URL = re.compile(r"(?:(?<![A-Za-z0-9_\\-])|(?<=\\[nr])|(?<=\\)(?![nr]))[A-Za-z0-9_-]{42,}={0,2}")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
#: Bytes of the shortest word that a token or a run can stand in.
_LEAST_TOKEN, _LEAST_RUN = 17, 42
_CONTAINER = b"openssh-key-v1\0"
_SSH_NAME = re.compile(rb"\0\0\0[\x05-\x40](?:ssh|ecdsa|sk)-")


def _base64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of the DER element at `at`, if it ends by `end`."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 0 < n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
        if size < 0x80 or n > 1 and not size >> 8 * (n - 1):
            return None  # DER lengths are as short as can be
    return (tag, at, at + size) if at + size <= end else None


def _nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Whether elements fill data[at:end] exactly, constructed ones down to their leaves."""
    while at < end:
        found = _element(data, at, end)
        if found is None or depth > 16:
            return False
        tag, inner, at = found
        if tag & 0x20 and not _nested(data, inner, at, depth + 1):
            return False
    return at == end


def is_der_key(data: bytes) -> bool:
    """A sequence that holds all of data, begun by a version or an algorithm identifier, long enough for a key."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or len(data) < 32 or not _nested(data, top[1], top[2]):
        return False
    first = _element(data, top[1], top[2])
    second = first and _element(data, first[2], top[2])
    if not first or not second:
        return False
    if first[0] == 0x02:  # version, or the modulus of a public key
        return second[0] in (0x02, 0x04, 0x30)
    if first[0] == 0x30:  # algorithm identifier, then the key
        inner = _element(data, first[1], first[2])
        return inner is not None and inner[0] == 0x06 and second[0] in (0x03, 0x04)
    return False


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill data, the first one naming an algorithm; or an OpenSSH container."""
    held = data.startswith(_CONTAINER)
    if held:
        data = data[len(_CONTAINER) :]
    at, fields = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return held and len(fields) > 3
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
        if len(fields) == 3 and fields[0] in (b"none", b"aes256-ctr"):
            return True
    return len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def _key_ends(data: bytes) -> list[int]:
    """Where a DER element, an OpenSSH container or the fields of an SSH key that data begins with may end."""
    if data[:1] == b"\x30":
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        return [2 + n + (int.from_bytes(data[2 : 2 + n]) if n else data[1])] if n <= 4 else []
    held = data.startswith(_CONTAINER)
    if not held and not _SSH_NAME.match(data):
        return []
    at, ends = len(_CONTAINER) * held, []
    while at + 4 <= len(data):
        if held and len(ends) == 3:  # the number of keys stands between the fields
            at += 4
        at += 4 + int.from_bytes(data[at : at + 4])
        ends.append(at)
    return ends


def _wrapped_end(text: str, m: re.Match) -> int | None:
    """Where a key whose base64 goes on over lines after the match ends, if it is one."""
    first = m[0][: len(m[0]) // 4 * 4]
    head = _base64(first)
    if m[0].endswith("=") or not head or not (ends := _key_ends(head)):
        return None
    need = (4 * ends[0] + 2) // 3 if head[0] == 0x30 else None
    lines, size, stops = [m[0]], len(m[0]), []
    at = m.end()
    while (need is None or size < need) and not lines[-1].endswith("=") and (line := _NEXT.match(text, at)):
        lines.append(line[1])
        size, at = size + len(line[1].rstrip("=")), line.end()
        stops.append((size, at))
    joined = "".join(lines).rstrip("=")
    if need is None:
        ends = _key_ends(_base64(joined[: size // 4 * 4]) or b"")
    sizes = {(4 * end + 2) // 3 for end in ends}
    for size, at in reversed(stops):
        if size in sizes and (data := _base64(joined[:size])) and (is_der_key(data) or is_ssh_key(data)):
            return at
    return None


def is_signed_token(header: str, body: str, signature: str) -> bool:
    try:
        head, claims = (json.loads(x) if (x := _base64(part, url=True)) else None for part in (header, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(claims, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" if not signature else _base64(signature, url=True) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _pem_spans(text: str) -> list[tuple[str, int, int]]:
    """Each BEGIN line with the next line of its kind, if that is its END; one pass over the text."""
    out, begun = [], None
    for m in _BEGIN.finditer(text):
        if m[1] == "END" and begun is not None and begun[2] == m[2] and _BODY.fullmatch(text, begun.end(), m.start()):
            body = "".join(line for line in _PARTS.split(text[begun.end() : m.start()]) if ":" not in line and "," not in line)
            data = _base64(body)
            if data and (is_der_key(data) or is_ssh_key(data) or ("ENCRYPTED" in text[begun.start() : m.end()] and len(data) % 8 == 0 and len(data) >= 32)):
                out.append(("pem", begun.start(), m.end()))
        begun = m if m[1] == "BEGIN" else None
    return out


def confirmed_spans(text: str, longest: int | None = None) -> list[tuple[str, int, int]]:
    """Spans confirmed by structure. `longest` may give the bytes of the longest word, to save looking for what can't be there."""
    longest = len(text) * 4 if longest is None else longest
    out = _pem_spans(text) if "PRIVATE KEY-----" in text else []
    armoured = [(a, b) for _, a, b in out]
    if longest >= _LEAST_TOKEN and "." in text:
        out += [("token", m.start(), m.end(3)) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    if longest < _LEAST_RUN:
        return out
    keys: set[tuple[int, int]] = set()
    covered, at = 0, 0
    for m in _BASE64.finditer(text):
        while at < len(armoured) and armoured[at][1] <= m.start():
            at += 1
        if m.start() < covered or at < len(armoured) and armoured[at][0] <= m.start():
            continue
        if end := _wrapped_end(text, m):
            covered = end
            keys.add((m.start(), end))
        elif (data := _base64(m[0])) and (is_der_key(data) or is_ssh_key(data)):
            keys.add(m.span())
    keys |= {m.span() for m in _URL.finditer(text) if ("-" in m[0] or "_" in m[0]) and (data := _base64(m[0], url=True)) and (is_der_key(data) or is_ssh_key(data))}
    keys |= {m.span() for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and (is_der_key(data := bytes.fromhex(m[0])) or is_ssh_key(data))}
    return out + [("key", *span) for span in sorted(keys)]


def longest_words(texts: bytekit.Texts) -> list[int]:
    """Bytes of the longest word of each text."""
    first, last, bounds = texts.words()
    out = np.zeros(len(texts.blobs), np.int64)
    np.maximum.at(out, bytekit.owners(bounds), last - first)
    return out.tolist()


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=_order))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each union of overlapping spans replaced by the name of its first kind in brackets."""
    out, at, spans = [], 0, sorted(spans, key=_order)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    docs = docs.drop(*added)
    names = docs.columns

    def scanned(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            base = [base_spans(text) for text in (b.decode() for b in texts.blobs)]
            more = [confirmed_spans(b.decode(), n) for b, n in zip(texts.blobs, longest_words(texts), strict=True)]
            counts = [pa.array(np.array([sum(s[0] == kind for s in spans) for spans in base], np.int64)) for kind in KINDS[:3]]
            digests = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base])
            yield pa.RecordBatch.from_arrays([*part.columns, *counts, digests, pa.array([joined(a + b) for a, b in zip(base, more, strict=True)])], names=[*names, *added])

    return docs.mapInArrow(scanned, common.widened(docs.schema, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span replaced in text, and n_chars, where there is one, counted anew."""
    names = docs.columns

    def cleaned(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            given = part.column(names.index("text")).to_pylist()
            fresh = [None if text is None else redacted(text, base_spans(text) + confirmed_spans(text, n)) for text, n in zip(given, longest_words(texts), strict=True)]
            columns = list(part.columns)
            columns[names.index("text")] = pa.array(fresh, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([n if a == b else len(b) for n, a, b in zip(old, given, fresh, strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(cleaned, docs.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
