"""Operator 4: secret scans with structural confirmation.

Base patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost and without overlap and kept by length. Beside
them, candidates that look like encoded keys are decoded and parsed, and reported only if what they hold is well formed:

* ``jwt``: three base64url parts of which the first decodes to a JSON object with ``alg`` and the second to a JSON object;
* ``pem``: an armoured private key whose body decodes to a private key's DER or to an ``openssh-key-v1`` container; or, under the headers of traditional encryption (``Proc-Type``,
  ``DEK-Info`` with a cipher and a hex start value), to whole cipher blocks;
* ``der``: a base64 (plain or url-safe, maybe over several lines) or hex run that is a private key's DER: RSA, DSA, elliptic curve, PKCS 8 plain or encrypted;
* ``ssh``: an ``openssh-key-v1`` container in base64 without armour, all of whose lengths fit;
* ``public``, only where asked for: public keys in DER, and ``ssh-…`` or ``ecdsa-…`` ones whose length-prefixed fields fill them and whose first names the algorithm.

DER counts if each length, at every depth, is in its shortest form and filled exactly, and the outermost values are those of the key's type. Certificates are neither.

Positions are code points, ends exclusive. Defined results: a null text counts as empty; rows are scanned one by one, so repeated
rows repeat their results and null ids stay null; very long texts are scanned whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import table, text_or_empty

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh", "public")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")  # the same runs: a run of 32 or more is matched whole either way
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+\.e[wy3][A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")  # { and a quote or white space come out as ey or ew, {} as e3
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----)[\s\S])*)-----END \1-----")
HEADERS = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]{16,32})\s")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-I][A-Za-z0-9+/_-]{38,}")  # a sequence (0x30) comes out as M
LINE, BREAK = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"(?:\r?\n|\\n)[ \t]*")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
SSH_PRIVATE, OPENSSH = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]+={0,2}"), b"openssh-key-v1\0"
SSH = re.compile(r"(ssh-[a-z0-9-]+|ecdsa-[a-z0-9-]+) (AAAA[A-Za-z0-9+/]+={0,2})")
#: No candidate but an assignment or armour has a run of non-spaces shorter than this.
SHORTEST = 16


def unbase64(text: str, urlsafe: bool = False) -> bytes | None:
    if urlsafe:
        text = text.replace("-", "+").replace("_", "/")
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill ``data`` exactly; None if they don't."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
            if n < 0x80:
                return None  # not the shortest form
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def well_formed(items: list[tuple[int, bytes]], depth: int = 32) -> bool:
    """Whether all constructed values among ``items``, at every depth, are filled exactly by values of their own."""
    level = items
    while level and depth:
        below: list[tuple[int, bytes]] = []
        for tag, content in level:
            if tag & 0x20:
                inside = der_items(content)
                if inside is None:
                    return False
                below += inside
        level, depth = below, depth - 1
    return not level


def key_kind(data: bytes | None) -> str | None:
    """``private`` or ``public`` for the DER of a key, else None."""
    top = der_items(data) if data else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    inside = der_items(top[0][1])
    if not inside or len(inside) < 2 or not well_formed(inside):
        return None
    tags, first, second = [t for t, _ in inside], inside[0][1], inside[1][1]
    names_algorithm = lambda content: (der_items(content) or [(0, b"")])[0][0] == 0x06
    if tags[0] == 0x02 and first in (b"\0", b"\1"):
        rsa = tags[1:9] == [0x02] * 8 and tags[9:] in ([], [0x30])
        curve = first == b"\1" and tags[1] == 0x04 and bool(second) and set(tags[2:]) <= {0xA0, 0xA1}
        pkcs8 = tags[1:3] == [0x30, 0x04] and names_algorithm(second) and bool(inside[2][1]) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
        return "private" if rsa or curve or pkcs8 or tags == [0x02] * 6 else None
    if tags[0] == 0x30 and len(tags) == 2 and names_algorithm(first) and second:
        return {0x04: "private", 0x03: "public"}.get(tags[1])
    return None


def encoded_der(text: str, at: int) -> tuple[bytes, int] | None:
    """The DER value whose base64 begins at ``at``, as long as its own length says, and where its encoding ends; None if it isn't there or begins like no key."""
    head = unbase64(text[at : at + 24], True) or b""
    if len(head) < 12:
        return None
    n, begin = (head[1], 2) if head[1] < 0x80 else (int.from_bytes(head[2 : 2 + (head[1] & 0x7F)], "big"), 2 + (head[1] & 0x7F))
    inner = head[begin : begin + 5]
    if begin > 6 or not (inner[:3] in (b"\2\1\0", b"\2\1\1") or (inner[:1] == b"\x30" and 0x06 in inner[2:])):
        return None
    wanted = -(-(begin + n) * 4 // 3)
    if wanted > len(text) - at:
        return None
    parts = []
    while True:
        line = LINE.match(text, at)
        if line is None:
            return None
        parts.append(line[0][:wanted])
        wanted -= len(parts[-1])
        at = line.end()
        if not wanted:
            break
        turn = BREAK.match(text, at)
        if turn is None:
            return None
        at = turn.end()
    if len(parts[-1]) < len(line[0]):  # the run goes on
        return None
    padding = re.compile("={0,2}").match(text, at)
    data = unbase64("".join(parts), True)
    return (data, padding.end()) if data is not None and len(data) == begin + n else None


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Fields with four-byte lengths that fill ``data`` exactly; None if they don't."""
    fields, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields


def _is_object(data: bytes | None, key: str | None = None) -> bool:
    try:
        value = json.loads(data or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (key is None or isinstance(value.get(key), str))


def is_openssh(data: bytes | None) -> bool:
    """Whether ``data`` is an ``openssh-key-v1`` container: three names, a number of public keys, these, and the private part, with lengths that fill it."""
    if not data or not data.startswith(OPENSSH):
        return False
    at, fields, wanted = len(OPENSSH), 0, None
    while at + 4 <= len(data) and fields != wanted:
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if fields == 3 and wanted is None:  # the number of keys
            wanted = 3 + n + 1
            continue
        at, fields = at + n, fields + 1
    return fields == wanted and at == len(data)


def _armoured(body: str) -> bool:
    body = body.replace("\\r", "").replace("\\n", "\n")
    encrypted = HEADERS.match(body)
    data = unbase64("".join(body[encrypted.end() if encrypted else 0 :].split()))
    if encrypted:
        return bool(data) and len(data) % (len(encrypted[2]) // 2) == 0
    return key_kind(data) == "private" or is_openssh(data)


def _confirmed(text: str, runs_long: bool, public: bool) -> Iterator[tuple[int, int, str]]:
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if _armoured(m[2]):
                yield m.start(), m.end(), "pem"
    if not runs_long:
        return
    if ".e" in text:
        for m in JWT.finditer(text):
            head, claims, _ = m[0].split(".")
            if _is_object(unbase64(head, True), "alg") and _is_object(unbase64(claims, True)):
                yield m.start(), m.end(), "jwt"
    kinds = {"private": "der"} | ({"public": "public"} if public else {})
    for m in BASE64.finditer(text):
        found = encoded_der(text, m.start())
        if found and (kind := kinds.get(key_kind(found[0]))):
            yield m.start(), found[1], kind
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := kinds.get(key_kind(bytes.fromhex(m[0])))):
            yield m.start(), m.end(), kind
    if "b3BlbnNzaC1rZXktdjEA" in text:
        for m in SSH_PRIVATE.finditer(text):
            if is_openssh(unbase64(m[0])):
                yield m.start(), m.end(), "ssh"
    if public and "AAAA" in text:
        for m in SSH.finditer(text):
            fields = ssh_fields(unbase64(m[2]) or b"\0")
            if fields and len(fields) > 1 and fields[0] == m[1].encode():
                yield m.start(), m.end(), "public"


def scan(text: str, public: bool = False) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start, then kind as listed in ``KINDS``; those of public keys if ``public``."""
    low = text.lower()
    spans = []
    if any(h in low for h in HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs_long = max(map(len, text.split()), default=0) >= SHORTEST
    if runs_long:
        if "AKIA" in text:
            spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        spans += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    spans += _confirmed(text, runs_long, public)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if len(spans) > 1 else spans


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", public: bool = False) -> DataFrame:
    """id and ``spans``: array of (start, end, kind) of each row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(x.as_py(), public)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=[id_col, "spans"])

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
