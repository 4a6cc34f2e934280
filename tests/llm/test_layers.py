"""Layers of secrets: all packings, spans through escapes of unequal width, nested escapes in linear time."""

import base64
import bz2
import gzip
import lzma
import random
import time
import zlib

import pytest
import zstandard

from keyloom.llm import secrets

PLAIN = "password=abcdefghijkl1"


def spans(text):
    return secrets.scan(text)[-1]


def deflated(raw):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress, deflated])
def test_every_packing(pack):
    token = base64.b64encode(pack(("some words first " * 4 + PLAIN).encode())).decode()
    assert spans(f"see {token} there") == f"assign:4:{4 + len(token.rstrip('='))}" or spans(f"see {token} there") == f"assign:4:{4 + len(token)}"


def test_broken_packings_are_no_layer():
    for raw in (b"BZh9", b"\xfd7zXZ\x00abc", b"\x28\xb5\x2f\xfdabcdefgh", b"\x1f\x8babcdefghij"):
        assert spans(base64.b64encode(raw * 3).decode()) == ""


@pytest.mark.parametrize("width", [16, 24, 64, 76, 120])
def test_wrapped_base64_of_any_width(width):
    token = base64.b64encode(("some words first " * 6 + PLAIN).encode()).decode()
    lines = "\n".join(token[k : k + width] for k in range(0, len(token), width))
    assert any(s.startswith("assign:") for s in spans(lines).split(","))


def test_spans_through_escapes_of_unequal_width():
    """Every character escaped at random, some of them twice: the span covers just the escapes of the secret."""
    r = random.Random(4)
    ways = [lambda c: c, lambda c: f"%{ord(c):02X}", lambda c: f"%25{ord(c):02X}", lambda c: f"%25%32%35{ord(c):02x}"]
    for _ in range(200):
        code = lambda t: "".join(r.choice(ways)(c) for c in t)
        before, secret = code("caf") + "%C3%A9?", code(PLAIN)
        text = f"{before}{secret}%26next"
        got = [tuple(map(int, s.split(":")[1:])) for s in spans(text).split(",") if s.startswith("assign")]
        assert (len(before), len(before) + len(secret)) in got, text


def test_nested_escapes_take_linear_time():
    start = time.time()
    tail = "41KIAABCDEFGHIJKLMNOPQ"
    for text in ("%" + "25" * 100_000 + tail, "\\x5c" + "x5c" * 100_000 + "x" + tail, "%3" * 50_000 + "%35", "%5cx25" * 1 + "5cx25" * 50_000 + tail):
        found = spans(text)
        assert "access:0:" in found or not text.endswith(tail)
    assert time.time() - start < 20
