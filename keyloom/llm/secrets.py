"""Secret scans: a worklist of decoded layers, unwrapped until nothing new appears.

Every layer is scanned. A finding inside a layer is reported where it stands in the original text: percent
and backslash escapes and base64 are mapped back character by character; a compressed layer (gzip, zlib, bzip2,
xz, zstandard, raw deflate), and a token whose percent escapes are not UTF-8, stand for the whole of the token.
Escapes inside escapes are undone to their end in one pass: a token gives the layer of one decoding and the
layer where no escape is left. Layers seen before at the same place are not opened again, so cycles end.
Base64 of less than 16 characters cannot hold a finding, packed or not. Null and empty texts have no findings;
repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from urllib.parse import unquote_to_bytes

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import named, renumbered

# The kinds in their order, pattern, group whose length counts, least length.
KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
]
ORDER = {k[0]: n for n, k in enumerate(KINDS)}
TOKEN = re.compile(r"\S+")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}+\r?\n)+[A-Za-z0-9+/]+={0,2}")
# The bytes that packed data begins with.
ZLIB = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
MAGIC = {b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ\x00": lzma.LZMADecompressor, b"\x28\xb5\x2f\xfd": lambda: zstandard.ZstdDecompressor().decompressobj()} | {m: lambda: zlib.decompressobj(47) for m in ZLIB}
HEX = frozenset("0123456789abcdefABCDEF")


def found(text: str):
    for kind, pattern, group, least in KINDS:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def opener(raw: bytes):
    return next((new for magic, new in MAGIC.items() if raw.startswith(magic)), None)


def unpacked(raw: bytes) -> bytes:
    """All members of packed bytes, joined; what follows the last valid one is left out."""
    out = []
    while new := opener(raw):
        d = new()
        try:
            out.append(d.decompress(raw))
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError):
            break
        raw = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def inflated(raw: bytes) -> bytes:
    """Raw deflate has no mark: bytes that end where a stream does, and hold UTF-8, are taken as one."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(raw)
    except zlib.error:
        return b""
    return out if d.eof and not d.unused_data and utf8(out) else b""


def opened(raw: bytes) -> tuple[str, bool]:
    """The text of decoded bytes, all compression around it undone, and whether there was any. Bytes that are
    not UTF-8 are read one to one."""
    seen, packed = set(), False
    while opener(raw) and raw not in seen:
        seen.add(raw)
        inner = unpacked(raw)
        if not inner:
            break
        raw, packed = inner, True
    plain = utf8(raw)
    if not plain and not packed and (inner := inflated(raw)):
        return inner.decode("utf-8"), True
    return raw.decode("utf-8" if plain else "latin-1"), packed


def replaced(token: str, pattern: re.Pattern, decoded) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Text with every match decoded; for each decoded character its place in the result and in the token."""
    out, places, at, size = [], [], 0, 0
    for m in pattern.finditer(token):
        out.append(token[at : m.start()])
        size += m.start() - at
        at = m.start()
        for char, width in decoded(m):
            out.append(char)
            places.append((size, size + 1, at, at + width))
            at, size = at + width, size + 1
    return "".join(out) + token[at:], places


def outside(places: list, begin: int):
    """Maps a span of a text whose decoded characters stand at these places back to the text around it."""
    starts = [p[0] for p in places]

    def one(x: int, end: bool) -> int:
        k = bisect.bisect_right(starts, x - end) - 1
        if k < 0:
            return begin + x
        _, b, c, d = places[k]
        if x >= b + (not end) or x > b:
            return begin + d + x - b
        return begin + (d if end or x >= b else c)

    return lambda a, b: (one(a, False), one(b, True))


def escaped(m: re.Match):
    yield chr(int(m[1] or m[2], 16)), len(m[0])


def utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def characters(raw: bytes) -> list[tuple[str, int]]:
    """Characters and their numbers of bytes; bytes that are not UTF-8 are read one to one."""
    if not utf8(raw):
        return [(chr(x), 1) for x in raw]
    return [(c, len(c.encode("utf-8"))) for c in raw.decode("utf-8")]


def unquoted(m: re.Match):
    for char, n in characters(unquote_to_bytes(m[0])):
        yield char, 3 * n


def escape_before(out: list) -> tuple[int, int] | None:
    """How many of the last characters are an escape, and what it stands for."""
    for n, mark, digits in ((3, "%", 2), (4, "\\x", 2), (6, "\\u", 4)):
        if len(out) >= n and all(x[0] in HEX for x in out[-digits:]) and "".join(x[0] for x in out[-n:-digits]) == mark:
            return n, int("".join(x[0] for x in out[-digits:]), 16)
    return None


def settled(token: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The token with all escapes undone until none is left, and the places of what was decoded."""
    out: list[tuple] = []  # character, its part of the token, whether it is a byte of a percent escape
    for at, char in enumerate(token):
        out.append((char, at, at + 1, False))
        while out[-1][0] in HEX and (got := escape_before(out)):
            n, code = got
            out[-n:] = [(chr(code), out[-n][1], at + 1, n == 3 and code > 127)]
    text, places, k = [], [], 0
    while k < len(out):
        end = k + 1
        if out[k][3]:
            while end < len(out) and out[end][3]:
                end += 1
            for char, n in characters(bytes(ord(x[0]) for x in out[k:end])):
                places.append((len(text), len(text) + 1, out[k][1], out[k + n - 1][2]))
                text.append(char)
                k += n
        else:
            if out[k][2] - out[k][1] > 1:
                places.append((len(text), len(text) + 1, out[k][1], out[k][2]))
            text.append(out[k][0])
            k = end
    return "".join(text), places


def inside_base64(text: str, token: str, begin: int, utf8: bool):
    """Maps a span of decoded characters to the characters of the token that hold them."""

    def one(x: int, end: bool) -> int:
        k = len(text[:x].encode("utf-8")) if utf8 else x
        return begin + min((k * 4 + 2) // 3 if end else k * 4 // 3, len(token))

    return lambda a, b: (one(a, False), one(b, True))


def layers(text: str, escapes: bool = True):
    """(decoded text, map of its spans to spans of text, whether its escapes are still to be undone) of each
    encoded token."""
    for mark, pattern, decoded in (("%", PERCENT, unquoted), ("\\", ESCAPE, escaped)):
        if escapes and mark in text:
            for m in TOKEN.finditer(text):
                if mark not in m[0]:
                    continue
                new, places = replaced(m[0], pattern, decoded)
                if not places:
                    continue
                known = mark != "%" or all(utf8(unquote_to_bytes(x[0])) for x in PERCENT.finditer(m[0]))
                yield new, outside(places, m.start()) if known else (lambda a, b, span=m.span(): span), False
                if PERCENT.search(new) or ESCAPE.search(new):
                    new, places = settled(m[0])
                    yield new, outside(places, m.start()) if known else (lambda a, b, span=m.span(): span), False
    wrapped = WRAPPED.finditer(text) if "\n" in text else ()
    for m in (*B64.finditer(text), *wrapped):
        token = re.sub(r"[\r\n]", "", m[0]).rstrip("=")
        if len(token) % 4 == 1:
            continue
        try:
            raw = base64.b64decode(token.replace("-", "+").replace("_", "/") + "=" * (-len(token) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        new, compressed = opened(raw)
        if compressed or len(token) < len(m[0].rstrip("=")):
            yield new, (lambda a, b, span=m.span(): span), True
        elif new:
            yield new, inside_base64(new, m[0], m.start(), new.encode("utf-8", "surrogatepass") == raw), True


def listed(spans) -> list[str]:
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted((a, ORDER[k], b, k) for k, a, b in spans)]


def mapped(way: tuple | None, a: int, b: int) -> tuple[int, int]:
    """A span of a layer in the text; way: (map to the layer around it, the way from there), of any length."""
    while way:
        step, way = way
        a, b = step(a, b)
    return a, b


def scan(text: str):
    base = list(found(text))
    spans, seen = set(base), set()
    todo = [(new, (back, None), escapes) for new, back, escapes in layers(text)]
    while todo:
        layer, way, escapes = todo.pop()
        key = (layer, mapped(way, 0, len(layer)))
        if key in seen:
            continue
        seen.add(key)
        spans.update((k, *mapped(way, a, b)) for k, a, b in found(layer))
        todo += [(new, (inner, way), more) for new, inner, more in layers(layer, escapes) if new != layer]
    n = [sum(k == kind for k, _, _ in base) for kind in ORDER]
    return *n, hashlib.sha256(",".join(listed(base)).encode()).hexdigest(), ",".join(listed(spans))


def masked(text: str, spans: str) -> str:
    """Text with every found span replaced; overlapping spans merge."""
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if b > at:
            out += [text[at : max(a, at)], "[SECRET]"] if a >= at else []
            at = b
    return "".join(out) + text[at:]


SCHEMA = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document; map only, no shuffle."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(d, *scan(t)) for d, t in zip(f["doc_id"], f["text"])], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return renumbered(named(docs).mapInPandas(run, SCHEMA), docs)
