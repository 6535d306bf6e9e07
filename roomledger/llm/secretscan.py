"""Secrets in texts: named assignments, access key ids and hex strings, and keys confirmed by structure.

The base patterns report what looks like a secret. Encoded material is reported only after it has been
decoded and its inside has been parsed: DER keys, encrypted ones too, by nested lengths that fill the whole blob,
OpenSSH keys by their header and length-prefixed fields, PGP secret keys by their first packet and the block's
checksum, signed tokens by a header and claims that are JSON objects. What was encoded twice is decoded twice.
Line breaks inside encoded material may be real or written as a backslash and n, as in JSON and env files.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as a run is taken whole from its first character
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

KINDS = ("assign", "access", "hex", "signed_token", "der_key", "ssh_key", "pgp_key")
BASE_KINDS = KINDS[:3]

_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----")
_KEY_START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M[A-P]|b3Bl)[A-Za-z0-9+/_-]{12,37}(?![A-Za-z0-9+/_-])")  # of a key in short lines
_AFTER_SLASH = re.compile(r"(?<=/)(?:M[A-P]|b3Bl)")
_HEX_START = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{14,}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_TWICE = re.compile(r"T[Q-Za-f]|YjNC|LS0tLS1CRUdJT")  # base64 of what begins a key in base64 or PEM
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"(?:[\x20\t]|\\*[\r\n]|\\+[nr])+")  # between lines of one blob; also written as backslash and n
_ESCAPED_BREAK = re.compile(r"\\+[nr]")
_HEX_BLOB = re.compile(r"[0-9A-Fa-f]{64,}")
_MARKS = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
_SSH_MAGIC = b"openssh-key-v1\x00"
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # object ids of PKCS#5 and PKCS#12


def _base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[start:end] exactly, or None."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length, body = data[start], data[start + 1], start + 2
        if length >= 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or body + width > end or data[body] == 0:
                return None
            length, body = int.from_bytes(data[body : body + width], "big"), body + width
            if length < 0x80:
                return None  # DER asks for the short form
        if body + length > end:
            return None
        items.append((tag, body, body + length))
        start = body + length
    return items


def is_der_key(data: bytes) -> bool:
    """A sequence that fills the blob and has the fields of a private key.

    RSA: version and eight integers; PKCS#8: version, algorithm sequence with an object id, octets;
    elliptic curve: version 1, octets; encrypted: the object id of a password scheme in a sequence, octets.
    """
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _, _ in inner]
    if tags == [0x30, 0x04]:
        scheme = der_items(data, inner[0][1], inner[0][2])
        return bool(scheme) and scheme[0][0] == 0x06 and data[scheme[0][1] : scheme[0][2]].startswith(_PASSWORD_SCHEMES)
    if inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    if len(tags) >= 9 and tags[:9] == [0x02] * 9:
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = der_items(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[:2] == [0x02, 0x04] and data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH container: cipher, derivation and options, a key count, then as many public keys."""
    return _ssh_end(data) == len(data)


def _ssh_end(data: bytes) -> int | None:
    """Where the OpenSSH container that data begins with ends, None if it is none or isn't whole."""
    if not data.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def field(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):
        if (at := field(at)) is None:
            return None
    count = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
    at += 4
    for _ in range(count + 1 if 1 <= count <= 16 else 0):
        if (at := field(at)) is None:
            return None
    return at if 1 <= count <= 16 else None


def _der_end(head: bytes) -> int | None:
    """Where the sequence that begins with this head ends, as its length says.

    Its first item is a one-byte integer or a sequence, as in keys and encrypted keys.
    """
    if len(head) < 8 or head[0] != 0x30:
        return None
    width = head[1] & 0x7F if head[1] >= 0x80 else 0
    first = head[2 + width : 4 + width]
    if width > 4 or head[1] == 0x80 or first != b"\x02\x01" and first[:1] != b"\x30":
        return None
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])


def wrapped_key(text: str, start: int) -> tuple[int, str] | None:
    """End and kind of a key that begins there and goes on over several lines; its own lengths say how far."""
    run = _RUN.match(text, start)
    head = _base64(run[0][: min(40, len(run[0]) // 4 * 4)]) or b""
    total = _der_end(head)
    if total is None and not head.startswith(_SSH_MAGIC):
        return None
    wanted = None if total is None else (8 * total + 5) // 6
    pieces, ends, count = [], {}, 0  # ends: of lines, by the characters up to there
    while run:
        pieces.append(run[0])
        count += len(run[0])
        ends[count] = run.end()
        if wanted is not None and count >= wanted:
            break
        between = _BREAK.match(text, run.end())
        run = _RUN.match(text, between.end()) if between else None
    body = "".join(pieces)
    if wanted is None:
        total = _ssh_end(_base64(body[: len(body) // 4 * 4]) or b"") or _ssh_end(_base64(body) or b"")
        if total is None:
            return None
        wanted = (8 * total + 5) // 6
    if wanted not in ends or not (kind := _structure(_base64(body[:wanted]))):
        return None
    end = ends[wanted]
    while end < len(text) and text[end] == "=" and end < ends[wanted] + 2:
        end += 1
    return end, kind


def wrapped_hex_key(text: str, start: int) -> tuple[int, str] | None:
    """End and kind of a DER key in hex that begins there, over one line or several."""
    run = _HEX_RUN.match(text, start)
    total = _der_end(bytes.fromhex(run[0][: min(32, len(run[0]) // 2 * 2)]))
    if total is None:
        return None
    pieces, count, end = [], 0, start
    while run and count < 2 * total:
        pieces.append(run[0])
        count, end = count + len(run[0]), run.end()
        between = _BREAK.match(text, end)
        run = _HEX_RUN.match(text, between.end()) if between else None
    return (end, kind) if count == 2 * total and (kind := _structure(bytes.fromhex("".join(pieces)))) else None


def _checksum24(data: bytes) -> int:
    """The checksum of armoured blocks: 24 bits, polynomial 0x864CFB, start 0xB704CE."""
    value = 0xB704CE
    for byte in data:
        value ^= byte << 16
        for _ in range(8):
            value <<= 1
            if value & 0x1000000:
                value ^= 0x1864CFB
    return value


def is_pgp_key(data: bytes) -> bool:
    """A secret key or secret subkey packet of a known version that ends within the data."""
    if len(data) < 6 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:  # new format
        tag, one = data[0] & 0x3F, data[1]
        if one < 192:
            body, size = 2, one
        elif one < 224:
            body, size = 3, ((one - 192) << 8) + data[2] + 192
        elif one == 255:
            body, size = 6, int.from_bytes(data[2:6], "big")
        else:
            return False  # keys don't come in parts
    else:
        width = (1, 2, 4, 0)[data[0] & 3]
        tag, body, size = data[0] >> 2 & 0xF, 1 + width, int.from_bytes(data[1 : 1 + width], "big")
    return tag in (5, 7) and 6 <= size <= len(data) - body and data[body] in (3, 4, 5, 6)


def _block_kind(label: str, lines: list[str]) -> str | None:
    """Kind of the key in the lines between BEGIN and END."""
    lines = [line.strip() for line in lines if ":" not in line]  # without the headers
    if not label.startswith("PGP "):
        return _structure(_base64("".join("".join(lines).split())))
    lines = [line for line in lines if line]
    checksum = lines.pop()[1:] if lines and re.fullmatch(r"=[A-Za-z0-9+/]{4}", lines[-1]) else None
    data = _base64("".join(lines))
    if not data or checksum is not None and int.from_bytes(_base64(checksum) or b"", "big") != _checksum24(data):
        return None
    return "pgp_key" if is_pgp_key(data) else None


def is_signed_token(header: str, claims: str) -> bool:
    """Header and claims decode to JSON objects, and the header names an algorithm."""
    parsed = []
    for part in (header, claims):
        data = _base64(part)
        try:
            parsed.append(json.loads(data) if data else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parsed) and isinstance(parsed[0].get("alg"), str)


def _structure(data: bytes | None) -> str | None:
    if not data or len(data) < 24:
        return None
    if data[0] == 0x30 and is_der_key(data):
        return "der_key"
    return "ssh_key" if is_ssh_key(data) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    spans = []
    if _MARKS.search(text):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def _blocks(text: str) -> list[tuple[int, int, str]]:
    """Spans of the key blocks with BEGIN and END lines. Every part of the text is looked at once."""
    spans, at = [], 0
    while begin := _PEM_BEGIN.search(text, at):
        at = begin.end()
        close = text.find("-----", at)
        while close >= 0 and text.startswith("-----BEGIN ", close):  # the block before has no end
            begin = _PEM_BEGIN.match(text, close) or begin
            at = max(begin.end(), close + 5)
            close = text.find("-----", at)
        end = f"-----END {begin[1]}-----"
        if close < 0 or not text.startswith(end, close):
            continue
        body = _ESCAPED_BREAK.sub("\n", text[begin.end() : close]).replace("\\", "")  # what else is escaped are slashes
        at = close + len(end)
        if kind := _block_kind(begin[1], body.split("\n")):
            spans.append((begin.start(), at, kind))
    return spans


def _twice(body: str) -> str | None:
    """Kind of the key that base64 hides which decodes to base64 or a block with BEGIN and END lines."""
    data = _base64(body)
    if not data or not data.isascii():
        return None
    inner = data.decode().strip()
    if inner.startswith("-----BEGIN "):
        return next((kind for start, _, kind in _blocks(inner) if start == 0), None)
    return _structure(_base64("".join(inner.split())))


def _encoded_key(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    """The key in a run of base64 or hex characters, which may begin after a slash and go on over further lines."""
    body = text[start:end]
    if body[0] in "nr" and text[start - 1 : start] == "\\":
        start, body = start + 1, body[1:]  # the break before it
    if (h := _HEX_BLOB.fullmatch(body)) and len(body) % 2 == 0 and (kind := _structure(bytes.fromhex(h[0]))):
        return start, end, kind
    if _TWICE.match(body) and (kind := _twice(body)):
        return start, end, kind
    for at in [0, *(m.start() for m in _AFTER_SLASH.finditer(body))]:
        if body[at : at + 1] not in ("M", "b"):  # 0x30 0x8? or the magic's first byte
            continue
        head = _base64(body[at : at + 40])
        if not head or not head.startswith(_SSH_MAGIC) and _der_end(head) is None:
            continue
        if kind := _structure(_base64(body[at:])):
            return start + at, end, kind
        if wrapped := wrapped_key(text, start + at):
            return start + at, *wrapped
    return None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of encoded material whose decoded structure is that of a key or signed token."""
    spans = _blocks(text) if "-----BEGIN " in text else []
    taken = list(spans)
    if ".ey" in text or "ey" in text and "." in text:
        for m in _SIGNED.finditer(text):
            if is_signed_token(m[1], m[2]):
                spans.append((m.start(), m.end(), "signed_token"))
    starts = [(m.start(), m.end(), False) for m in _ENCODED.finditer(text)]
    if "M" in text or "b3Bl" in text:
        starts += [(m.start(), m.end(), False) for m in _KEY_START.finditer(text)]
    starts += [(m.start(), m.end(), True) for m in _HEX_START.finditer(text)]
    done, block = 0, 0
    for start, end, is_hex in sorted(starts):
        while block < len(taken) and taken[block][1] <= start:
            block += 1
        if start < done or block < len(taken) and taken[block][0] <= start:
            continue
        if is_hex:
            found = (start, *wrapped) if (wrapped := wrapped_hex_key(text, start)) else None
        else:
            found = _encoded_key(text, start, end)
        if found:
            spans.append(found)
            done = found[1]
    return spans


def all_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind as listed in KINDS."""
    if not text:
        return []
    spans = base_spans(text) + confirmed_spans(text)
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in square brackets; spans that meet become one."""
    spans = all_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans per kind, a digest of them, and all spans of every row.

    Spans are ``kind:start:end`` in code points, comma-joined. A null or empty text has none.
    Repeated rows come out repeated, a null id stays null, other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(text) for text in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
        counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS]
        digests = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(_joined, found), pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        in_batches(scan),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with secrets in the text replaced; the length column, where there is one, is counted anew.

    Rows without a secret come out unchanged, a null text stays null.
    """
    at = docs.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([redact(text) for text in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    bounded_batches(docs.sparkSession)
    out = docs.mapInArrow(in_batches(clean), docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
