"""Operator 11, secret scans: structural confirmation.

Three kinds are found by patterns: assigned secrets, access keys and long hex runs. The method adds kinds that no pattern can
tell: base64 and hex candidates are decoded, and reported only if what they hold parses as a secret.

* jwt: three base64url parts; the first decodes to a JSON object that names a signing algorithm, the second to a JSON
  object, and the signature has the length of that algorithm. Unsigned tokens are no secrets.
* der: base64 (over line breaks, as armoured keys are written) or hex, whose bytes are nested tag-length-value fields that
  fill each other exactly and have the shape of a private key: RSA, DSA, elliptic curve, wrapped or encrypted.
* openssh: base64 of the private key format with that name: its magic bytes, the cipher and derivation names, as many public
  keys as it says, each with inner lengths that fill it, and the private part.

Certificates, public keys and random base64 of any length have another shape and are left alone.

Defined results: a null text is an empty text and has no spans; every row is scanned by itself, so repeated rows and null
identifiers are kept, and an empty table gives an empty result. Texts are scanned whole. Where a key without a mark of its end
stands in a longer candidate, its own length ends it, at the end of a line. Further columns pass through; one that is named
`secrets` is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.packaging import ship

#: The kinds in their order, with the patterns of the contract and the least length of what counts.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "jwt", "der", "openssh"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What a text must hold for a kind to be looked for (linear-time expressions over the whole column).
HINTS = {
    "assign": "(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": "AKIA[A-Z0-9]{12}",
    "hex": "[0-9a-f]{32}",
    "jwt": r"e[w-z0-9+/_-][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]",
    "der": "M[A-I][A-Za-z0-9+/_-]{20}|30[0-9A-Fa-f]{30}",
    "openssh": "b3BlbnNzaC1rZXktdjEA",
}
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9+/_-][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
#: A base64 run; it goes on over a line break (also a written-out one) after a line of 40 digits or more.
BREAK = r"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
ARMOUR = re.compile(rf"(?:(?<![A-Za-z0-9+/_=-])|(?<=\\n))(?=M[A-I]|b3Blb)(?:[A-Za-z0-9+/_-]{{40,}}+{BREAK})*+[A-Za-z0-9+/_-]*+={{0,2}}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}+")
BREAKS = re.compile(BREAK)
#: Bytes of a signature by the name of its algorithm; the RSA ones have 128 bytes or more.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64}
RSA_SIGNATURES = ["RS256", "RS384", "RS512", "PS256", "PS384", "PS512"]
MAGIC = b"openssh-key-v1\0"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,detail:string>>"


@dataclass(frozen=True)
class SecretParams:
    """Least lengths of an assigned value, of an access key and of a hex run (32 or more)."""

    assigned: int = 8
    access: int = 16
    hexadecimal: int = 32


def decoded(text: str) -> bytes | None:
    """Bytes of base64 or base64url digits without padding, or None."""
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def token_algorithm(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token whose parts confirm each other, else None."""
    found = []
    for part in (header, payload):
        data = decoded(part)
        try:
            value = json.loads(data) if data else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, dict):
            return None
        found.append(value)
    name, signed = found[0].get("alg"), decoded(signature)
    if not isinstance(name, str) or signed is None:
        return None
    if name in RSA_SIGNATURES:
        return name if len(signed) >= 128 else None
    return name if SIGNATURES.get(name) == len(signed) else None


def field(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte of the value, byte after it) of the tag-length-value field at a place, or None if it is none."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80 or tag & 0x1F == 0x1F:  # no end given; tags of several bytes, which keys do not use
        return None
    if size > 0x80:
        n = size - 0x80
        if n > 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The fields that fill a stretch exactly, or None."""
    found = []
    while at < end:
        one = field(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def key_shape(data: bytes, at: int, end: int) -> str | None:
    """Which kind of private key the value of a sequence is, else None."""
    parts = fields(data, at, end)
    if not parts:
        return None
    tags = [p[0] for p in parts]
    small = data[parts[0][1]] if tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 else None

    def named(i: int) -> bool:  # a sequence that begins with an object identifier
        inner = fields(data, *parts[i][1:])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]

    if small == 0 and tags == [0x02] * 9:
        return "rsa"
    if small == 1 and tags == [0x02] * 9 + [0x30]:
        return "rsa"
    if small == 0 and tags == [0x02] * 6:
        return "dsa"
    if small == 1 and tags[1:2] == [0x04] and len(tags) <= 4 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and parts[1][2] - parts[1][1] >= 16:
        return "ec"
    if small in (0, 1) and tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]) and named(1):
        return "wrapped"
    if tags == [0x30, 0x04] and named(0) and parts[1][2] - parts[1][1] >= 16:
        return "encrypted"
    return None


def der_key(data: bytes) -> tuple[str, int] | None:
    """(shape, bytes) of the private key that data begins with, else None."""
    top = field(data, 0, len(data))
    shape = key_shape(data, top[1], top[2]) if top and top[0] == 0x30 else None
    return (shape, top[2]) if shape else None


def ssh_key(data: bytes) -> tuple[str, int] | None:
    """(first key's type, bytes) of the key file that data begins with, else None."""
    at = len(MAGIC)

    def block(end: int) -> tuple[int, int] | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > end:
            return None
        at += 4 + size
        return at - size, at

    if not data.startswith(MAGIC):
        return None
    names = [block(len(data)) for _ in range(3)]
    if None in names or not data[names[0][0] : names[0][1]].isascii():
        return None
    n, at, kind = int.from_bytes(data[at : at + 4], "big"), at + 4, None
    if not 1 <= n <= len(data):
        return None
    for _ in range(n):
        key = block(len(data))
        if key is None:
            return None
        back, at = at, key[0]
        inner = []
        while at < key[1] and inner[-1:] != [None]:
            inner.append(block(key[1]))
        if len(inner) < 2 or None in inner:
            return None
        kind, at = kind or data[inner[0][0] : inner[0][1]].decode("ascii", "replace"), back
    private = block(len(data))
    return (kind, at) if private and private[1] - private[0] >= 8 else None


def armoured(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of the base64 candidates that hold a private key."""
    for m in ARMOUR.finditer(text):
        lines, at, digits = [], m.start(), 0  # (digits up to the line's end, place of the line's end)
        for gap in [*BREAKS.finditer(text, m.start(), m.end()), None]:
            end = gap.start() if gap else m.end()
            digits += len(text[at:end].rstrip("="))
            lines.append((digits, end))
            at = gap.end() if gap else end
        data = decoded_prefix(BREAKS.sub("", m.group()).rstrip("="))
        for kind, parse in (("der", der_key), ("openssh", ssh_key)):
            found = parse(data)
            ends = [end for n, end in lines if found and n == -(-found[1] * 4 // 3)]
            if ends:
                yield m.start(), ends[0], kind, found[0]
                break


def decoded_prefix(text: str) -> bytes:
    """Bytes of the digits; of a candidate that ends within a byte, those before."""
    return decoded(text) or decoded(text[:-1]) or b""


def scan(text: str, kinds: list[str], params: SecretParams) -> list[tuple[int, int, int, str, str | None]]:
    """Spans (start, rank, end, kind, detail) of the kinds that a text may hold, by start and then by kind."""
    found: list[tuple[int, int, str, str | None]] = []
    if "assign" in kinds:
        found += [(m.start(), m.end(), "assign", m.group(1).lower()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= params.assigned]
    if "access" in kinds:
        found += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text) if m.end() - m.start() >= params.access]
    if "hex" in kinds:
        found += [(m.start(), m.end(), "hex", None) for m in HEX.finditer(text) if m.end() - m.start() >= params.hexadecimal]
    if "jwt" in kinds:
        found += [(m.start(), m.end(), "jwt", name) for m in TOKEN.finditer(text) if (name := token_algorithm(*m.groups()))]
    if "der" in kinds:
        for m in HEX_KEY.finditer(text):
            key = der_key(bytes.fromhex(m.group())) if len(m.group()) % 2 == 0 else None
            if key and 2 * key[1] == len(m.group()):
                found.append((m.start(), m.end(), "der", key[0]))
    if "der" in kinds or "openssh" in kinds:
        found += armoured(text)
    return sorted((start, KINDS.index(kind), end, kind, detail) for start, end, kind, detail in found)


def secret_spans(text: Column, params: SecretParams = SecretParams()) -> Column:
    """array of (start, rank, end, kind, detail) for a text column; places in code points, ends exclusive. Whole columns are
    tried against the hints first, so only texts that may hold a kind are handled one by one."""
    names = ["start", "rank", "end", "kind", "detail"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("detail", pa.string())]))

    def spans(texts: pa.Array) -> pa.Array:
        hit = {k: pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_pylist() for k, pattern in HINTS.items()}
        rows = []
        for i in range(len(texts)):
            kinds = [k for k in KINDS if hit[k][i]]
            rows.append([dict(zip(names, s)) for s in scan(texts[i].as_py(), kinds, params)] if kinds else [])
        return pa.array(rows, kind)

    return F.arrow_udf(spans, SPAN)(text)


def find_secrets(docs: DataFrame, params: SecretParams = SecretParams(), text_col: str = "text") -> DataFrame:
    """The rows with `secrets`: an array of (start, rank, end, kind, detail), by start and then by kind."""
    ship(docs.sparkSession)
    return docs.select(*[F.col(c) for c in docs.columns if c != "secrets"], secret_spans(F.col(text_col), params).alias("secrets"))


def redact(docs: DataFrame, params: SecretParams = SecretParams(), text_col: str = "text") -> DataFrame:
    """The input with `clean_text`: each secret becomes its kind in brackets; where spans overlap, the first one's."""
    rows = find_secrets(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), params)

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(kept).alias("out"))

    rows = rows.withColumn("done", F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step))
    clean = F.concat("done.out", F.substring(F.col("text"), F.col("done.at") + 1, F.length("text")))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "clean_text"], clean.alias("clean_text"))
