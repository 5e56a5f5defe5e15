"""Secret scans against plain patterns and hand-built keys, and their edge cases."""

import base64
import json
import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracelake.llm import queries, secret_scan
from tracelake.llm.common import read

DOCS = "doc_id long, text string, secrets string"


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + body


def number(rng, size):
    return tlv(2, bytes([rng.randrange(1, 128)]) + rng.randbytes(size - 1))


def block(body):
    return len(body).to_bytes(4, "big") + body


RNG = random.Random(4)
RSA = tlv(0x30, tlv(2, b"\0") + b"".join(number(RNG, 64 if i % 2 else 33) for i in range(8)))
DSA = tlv(0x30, tlv(2, b"\0") + b"".join(number(RNG, 20) for _ in range(5)))
EC = tlv(0x30, tlv(2, b"\1") + tlv(4, RNG.randbytes(32)) + tlv(0xA0, tlv(6, b"\x2a\x86\x48")))
WRAPPED = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7") + b"\x05\0") + tlv(4, RSA))
SEALED = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7") + tlv(0x30, b"")) + tlv(4, RNG.randbytes(64)))
PUBLIC = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7") + b"\x05\0") + tlv(3, b"\0" + RNG.randbytes(140)))
CERTIFICATE = tlv(0x30, tlv(0x30, number(RNG, 8) + tlv(0x30, tlv(6, b"\x2a"))) + tlv(0x30, tlv(6, b"\x2a")) + tlv(3, RNG.randbytes(64)))
SSH = secret_scan.MAGIC + block(b"none") + block(b"none") + block(b"") + (1).to_bytes(4, "big") + block(block(b"ssh-ed25519") + block(RNG.randbytes(32))) + block(RNG.randbytes(136))


def armour(data, width=64, gap="\n"):
    digits = base64.b64encode(data).decode()
    return gap.join(digits[i : i + width] for i in range(0, len(digits), width))


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def token(header, size=32, payload=b'{"sub":"x"}'):
    return ".".join([url64(json.dumps(header).encode()), url64(payload), url64(RNG.randbytes(size))])


def kinds(text, params=secret_scan.SecretParams()):
    return [(k, text[a:b], d) for a, _, b, k, d in secret_scan.scan(text, secret_scan.KINDS, params) if k not in secret_scan.BASE]


@pytest.mark.parametrize("data,shape", [(RSA, "rsa"), (DSA, "dsa"), (EC, "ec"), (WRAPPED, "wrapped"), (SEALED, "encrypted")])
@pytest.mark.parametrize("width,gap", [(64, "\n"), (76, "\r\n"), (10**6, ""), (64, "\\n")])
def test_private_keys_are_confirmed(data, shape, width, gap):
    told = armour(data, width, gap)
    assert kinds(f"-----BEGIN KEY-----{gap or ' '}{told}{gap or ' '}-----END KEY----- and words") == [("der", told, shape)]
    assert kinds(f"key {data.hex()} end") == [("der", data.hex(), shape)] and kinds(data.hex().upper()) == [("der", data.hex().upper(), shape)]
    assert kinds(f"{told}\nordinary words follow") == [("der", told, shape)]


@pytest.mark.parametrize("data", [PUBLIC, CERTIFICATE, RSA[:-1], RSA[:42] + b"\x02\x7f" + RSA[44:], b"\x30\x82" + RNG.randbytes(300), SSH[:-20], SSH[:15] + b"\xff" + SSH[16:]])
def test_other_bytes_are_left_alone(data):
    assert kinds(armour(data)) == [] and kinds(data.hex()) == []


def test_key_files_and_tokens():
    assert kinds(armour(SSH, 70)) == [("openssh", armour(SSH, 70), "ssh-ed25519")]
    good = token({"alg": "HS256", "typ": "JWT"})
    assert kinds(f"Bearer {good}, then") == [("jwt", good, "HS256")]
    assert kinds(token({"alg": "RS256"}, 256))[0][2] == "RS256"
    for bad in [token({"alg": "HS256"}, 31), token({"alg": "none"}), token({"typ": "JWT"}), token(["alg"]), token({"alg": "HS256"}, payload=b"[1]"), "eyJhbGci.eyJh.x", token({"alg": 5})]:
        assert kinds(bad) == []
    assert kinds("x" * 5 + good) == [] and kinds("eyJ" + "A" * 100_000 + "." + "B" * 100_000) == []


def brute_base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_query_equals_patterns(spark):
    docs = {r.doc_id: r.text or "" for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = queries.op11_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in rows} == set(docs) and sum(r.n_assign + r.n_hex for r in rows) > 0
    for r in rows:
        wanted = brute_base(docs[r.doc_id])
        assert r.base_sha256 == sha256(wanted.encode()).hexdigest() and (r.n_confirmed or r.spans == wanted)


def test_random_texts_equal_patterns():
    rng, parts = random.Random(8), ["password", "PASSWD", "ſecret", "secret", "toKen", "api_key", "APIKEY", "Api", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "é", "\n", "value/+_.-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        held = [k for k in secret_scan.KINDS if re.search(secret_scan.HINTS[k], text, re.ASCII)]
        spans = [s for s in secret_scan.scan(text, held, secret_scan.SecretParams()) if s[3] in secret_scan.BASE]
        assert ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans) == brute_base(text)


def test_edge_rows(spark):
    long = "word " * 300_000 + "password = hunter2hunter2 " + "é" * 10
    rows = [(1, None, "s"), (2, "", None), (3, long, "s"), (4, "token:abcdefgh", "s"), (4, "token:abcdefgh", "s"), (None, "x", None)]
    found = secret_scan.find_secrets(spark.createDataFrame(rows, DOCS))
    assert found.columns == ["doc_id", "text", "secrets"]
    told = sorted((r.doc_id or 0, [(s.start, s.end, s.kind) for s in r.secrets]) for r in found.collect())
    at = len("word " * 300_000)
    assert told == [(0, []), (1, []), (2, []), (3, [(at, at + 25, "assign")]), (4, [(0, 14, "assign")]), (4, [(0, 14, "assign")])]
    assert secret_scan.find_secrets(spark.createDataFrame([], DOCS)).count() == 0
    clean = secret_scan.redact(spark.createDataFrame([(1, "a token = 0123456789abcdef0123456789abcdef é", "x"), (2, None, None)], DOCS)).orderBy("doc_id").collect()
    assert [r.clean_text for r in clean] == ["a [assign] é", ""] and clean[0].secrets == "x"
    assert found.filter(F.size("secrets") < 0).count() == 0
