"""Secret scan: regular candidates plus structural confirmation of encoded keys and signed tokens.

Base kinds (assignments, access keys, long hex) follow fixed patterns. On top of them every
base64 or hex candidate is decoded and parsed: DER keys, also encrypted ones, with their
nested lengths, SSH keys with their length-prefixed fields, PEM blocks whose body is such a
key or fits the cipher that the block's headers declare, and signed tokens whose header is
JSON with an algorithm. Only what parses is reported.

Defined results: null text counts as empty; empty text has no spans; repeated rows are
reported each; texts are scanned whole, in any number of characters.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch.llm.common import give_back

# The base patterns and their minimal lengths, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
ASSIGN_MIN = 6

# Header lines end before a line break, and may go on in lines that begin with a blank.
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*(?:PRIVATE|PUBLIC) KEY)-----(?P<headers>(?:\s*\n[A-Za-z][A-Za-z0-9-]*:[^\n]*(?:\n[ \t]+[^\s][^\n]*)*(?=\n))*)"
    r"(?P<body>[A-Za-z0-9+/=\s]+?)-----END \1-----",
    re.A,
)
ENCRYPTED = re.compile(r"^Proc-Type:\s*4\s*,\s*ENCRYPTED\s*$", re.M | re.A)
CIPHER = re.compile(r"^DEK-Info:\s*([A-Z0-9]+(?:-[A-Z0-9]+)*)\s*,\s*([0-9A-Fa-f]{32}|[0-9A-Fa-f]{16})\s*$", re.M | re.A)
# Identifiers of encryption by password: PKCS 5 (1.2.840.113549.1.5) and PKCS 12 (1.2.840.113549.1.12.1).
BY_PASSWORD = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)", re.A)
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_-]{40,}={0,2}", re.A)
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}", re.A)
SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
OPENSSH_MAGIC = b"openssh-key-v1\x00"
SIGNATURES = ("none", "HS", "RS", "ES", "PS", "EdDSA")
SCHEMA = "array<struct<kind string, start int, end int>>"


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, with or without padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the DER element at `at`, if its length fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 0 < n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None  # DER takes the short form here
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while at < end:
        x = _element(data, at, end)
        if x is None:
            return None
        found.append(x)
        at = x[2]
    return found


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the bytes and nests as a private or public key does."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    if tags[0] == 0x30:
        inner = _children(data, parts[0][1], parts[0][2])
        if not inner or inner[0][0] != 0x06:
            return False
        if tags == [0x30, 0x04]:  # private, encrypted: algorithm, octets; a digest is built alike but names another algorithm
            return data[inner[0][1] : inner[0][2]].startswith(BY_PASSWORD)
        return tags[1] == 0x03  # public: algorithm, bit string
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        # public in the older form: modulus and exponent alone
        return tags == [0x02, 0x02] and parts[0][2] - parts[0][1] >= 32 and parts[1][2] - parts[1][1] <= 8
    if tags[1] == 0x30 and 0x04 in tags:  # private: version, algorithm, octets
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[1] == 0x04:  # elliptic: version, octets, parameters
        return parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66)
    return len(tags) >= 6 and set(tags) == {0x02}  # version and the numbers of the key


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the bytes, the first of which names a key type."""
    if data.startswith(OPENSSH_MAGIC):
        data, named = data[len(OPENSSH_MAGIC) :], False
        at = 0
        for _ in range(3):  # cipher, key derivation and its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 8 > len(data) or not 0 < int.from_bytes(data[at : at + 4], "big") < 100:
            return False
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        return at + 8 + size <= len(data) and is_ssh_key(data[at + 8 : at + 8 + size])
    at, fields, named = 0, 0, False
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        if not fields:
            named = data[at + 4 : at + 4 + size].startswith(SSH_KINDS)
        at, fields = at + 4 + size, fields + 1
    return named and fields >= 2 and at == len(data)


def is_token_header(part: str) -> bool:
    data = decode64(part)
    if not data or data[:1] != b"{":
        return False
    try:
        header = json.loads(data)
    except ValueError:
        return False
    return isinstance(header, dict) and str(header.get("alg", "")).startswith(SIGNATURES)


def _keyed(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _pem_key(headers: str, body: str) -> bool:
    """Whether a block's body is a key, or can be one under the cipher that its headers declare."""
    data = decode64(re.sub(r"\s", "", body))
    if _keyed(data):
        return True
    cipher = CIPHER.search(headers) if ENCRYPTED.search(headers) else None
    if not data or cipher is None:
        return False
    # The initial vector is as long as a block; other modes take any length.
    block = len(cipher[2]) // 2
    return len(data) >= block and (len(data) % block == 0 or not cipher[1].endswith(("-CBC", "-ECB", "-EDE3", "-EDE")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds, leftmost and non-overlapping within each kind."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class Taken:
    """Spans that do not overlap, in order, so that looking one up does not grow with their number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        """Join a span to those that it overlaps; the list stays in order."""
        lo, hi = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]

    def meets(self, start: int, end: int) -> bool:
        """Whether a span overlaps one that is taken."""
        return bisect_right(self.ends, start) < bisect_left(self.starts, end)


def structured_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that decode to a key or carry a signed token's header."""
    out: list[tuple[str, int, int]] = []
    taken = Taken()
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if _pem_key(m["headers"], m["body"]):
                out.append(("pem", *m.span()))
                taken.add(*m.span())
    if "eyJ" in text:
        for m in JWT.finditer(text):
            body = decode64(m[2])
            if is_token_header(m[1]) and body and body[:1] == b"{":
                out.append(("jwt", *m.span()))
                taken.add(*m.span())
    for m in BASE64.finditer(text):
        kind = _keyed(decode64(m[0])) if not taken.meets(*m.span()) else None
        if kind:
            out.append((kind, *m.span()))
            taken.add(*m.span())
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and not taken.meets(*m.span()):
            kind = _keyed(bytes.fromhex(m[0]))
            if kind:
                out.append((kind, *m.span()))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds `out`: the spans (kind, start, end; code points, end exclusive) of each whole text, in order.

    All other columns stay; a column that is already called `out` is replaced.
    """

    @F.pandas_udf(SCHEMA)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(
                [
                    [{"kind": k, "start": s, "end": e} for k, s, e in in_order(base_spans(t) + structured_spans(t))]
                    for t in texts.fillna("")
                ],
                dtype=object,
            )
        give_back()

    return docs.withColumn(out, scan(F.col(f"`{text}`")))


def redact(docs: DataFrame, text: str = "text", mask: str = "<secret>") -> DataFrame:
    """Replaces every span of every kind by `mask`; overlapping spans become one. Other columns stay."""
    found = find_secrets(docs, text, "_secrets")
    merged = F.aggregate(
        F.transform("_secrets", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))),
        F.expr("cast(array() as array<struct<s int, e int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] < F.element_at(acc, -1)["e"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    body = F.col(f"`{text}`")
    cut = F.concat(
        F.array_join(
            F.transform(
                F.col("_spans"),
                lambda x, i: F.substring(
                    body,
                    F.when(i == 0, 1).otherwise(F.get(F.col("_spans"), i - 1)["e"] + 1),
                    x["s"] - F.when(i == 0, 0).otherwise(F.get(F.col("_spans"), i - 1)["e"]),
                ),
            ),
            mask,
        ),
        F.lit(mask),
        F.substring(body, F.element_at("_spans", -1)["e"] + 1, F.length(body)),
    )
    return (
        found.withColumn("_spans", merged)
        .withColumn(text, F.when(F.size("_spans") > 0, cut).otherwise(body))
        .drop("_secrets", "_spans")
    )
