"""Secrets in texts, under any nesting of URL, Unicode, base64 and compressed layers.

A worklist starts with the text. Every layer is scanned for the three base kinds; then each encoded stretch in it
is unwrapped into a new layer, until nothing new appears. A layer seen before, by its content, is not taken up again,
so layers that unwrap to themselves end. Each character of a layer knows the stretch of the original text it came from:
exactly for URL and Unicode escapes, by groups of four for base64, also wrapped in lines, the whole stretch for compressed data. Secrets
found in layers are reported as spans of the original, next to the base spans of the text itself, which always stay.

Spans are in code points, end exclusive, ordered by start, then kind as listed, then end. Null and empty texts have
none. Texts are scanned whole; a layer is as large as what it unwraps to.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# the shortest secret, token=12345678, has 19 characters in base64 besides its padding
SHORTEST = 19
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
HEX = re.compile(r"[0-9a-f]{32,}")
URL = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
NON_BLANK = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]  # start, kind, end
Layer = tuple[str, list[int], list[int]]  # text, and for each character where its origin starts and ends


def base_spans(text: str, runs: list[re.Match]) -> list[Span]:
    """Leftmost non-overlapping matches per kind. runs: the long runs of the text, within which every hex span lies."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for r in runs for m in HEX.finditer(text, r.start(), r.end())]
    return found


def as_text(data: bytes) -> str | None:
    """The text if the bytes are one: UTF-8 with nearly no control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)
    return text if text and odd * 20 <= len(text) else None


def decompressed(data: bytes) -> bytes | None:
    """The content of gzip, zlib, bzip2, xz or zstandard data, by its first bytes."""
    try:
        if data[:2] == b"\x1f\x8b":
            return zlib.decompressobj(31).decompress(data)
        if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2]) % 31 == 0:
            return zlib.decompressobj().decompress(data)
        if data[:3] == b"BZh":
            return bz2.BZ2Decompressor().decompress(data)
        if data[:6] == b"\xfd7zXZ\x00":
            return lzma.LZMADecompressor().decompress(data)
        if data[:4] == b"\x28\xb5\x2f\xfd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return None
    return None


def unpacked(data: bytes) -> tuple[str, bool] | None:
    """Text in the bytes, through any number of compressed layers, and whether there was one."""
    seen, packed = set(), False
    while (inner := decompressed(data)) is not None and data not in seen:
        seen.add(data)
        data, packed = inner, True
    text = as_text(data)
    return None if text is None else (text, packed)


def without_url(part: str, a: int) -> list[tuple[str, int, int]] | None:
    """The characters of a part that starts at a, with URL escapes resolved, and where each starts and ends."""
    if "%" not in part or not URL.search(part):
        return None
    out, at = [], 0
    # neighbouring escapes are one sequence of bytes
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", part):
        out += [(c, a + i, a + i + 1) for i, c in enumerate(part[at:m.start()], at)]
        data = unquote_to_bytes(m.group())
        packed = unpacked(data) if decompressed(data) is not None else None
        if packed:
            out += [(c, a + m.start(), a + m.end()) for c in packed[0]]
        else:
            i = a + m.start()
            for c in data.decode("utf-8", "surrogateescape"):
                width = 3 * len(c.encode("utf-8", "surrogateescape"))
                out.append(("\ufffd" if "\udc80" <= c <= "\udcff" else c, i, i + width))
                i += width
        at = m.end()
    return out + [(c, a + i, a + i + 1) for i, c in enumerate(part[at:], at)]


def without_unicode(part: str, a: int) -> list[tuple[str, int, int]] | None:
    """The same for Unicode escapes."""
    if "\\" not in part and "&#" not in part or not ESCAPE.search(part):
        return None
    out, at = [], 0
    for m in ESCAPE.finditer(part):
        code = int(m.group(6)) if m.group(6) else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            continue
        out += [(c, a + i, a + i + 1) for i, c in enumerate(part[at:m.start()], at)]
        out.append((chr(code), a + m.start(), a + m.end()))
        at = m.end()
    out += [(c, a + i, a + i + 1) for i, c in enumerate(part[at:], at)]
    return out if len(out) < len(part) else None


def escapes(text: str, starts: list[int], ends: list[int]) -> Iterator[Layer]:
    """The whole layer, where a name may stand before an encoded value, and each stretch of non-blank characters by itself,
    with all URL or Unicode escapes of one sort resolved."""
    parts = [(0, text), *((m.start(), m.group()) for m in NON_BLANK.finditer(text) if m.end() - m.start() < len(text))]
    for a, part in parts:
        for resolved in (without_url, without_unicode):
            out = resolved(part, a)
            if out is not None:
                yield "".join(c for c, _, _ in out), [starts[i] for _, i, _ in out], [ends[j - 1] for _, _, j in out]


def wrapped(text: str) -> Iterator[tuple[str, list[int]]]:
    """Equally long lines, with and without a shorter last one, as one base64 run and the places of its characters."""
    for lines in LINES.finditer(text) if "\n" in text else ():
        parts = [(m.start(), m.end()) for m in LINE.finditer(text, lines.start(), lines.end())]
        size = [len(text[a:b].rstrip("=")) for a, b in parts]
        i = 0
        while i + 1 < len(parts):
            j = i + 1
            while j < len(parts) and size[j] == size[i]:
                j += 1
            tail = j < len(parts) and size[j] < size[i]
            for end in {j, j + tail}:
                places = [k for a, b in parts[i:end] for k in range(a, b)]
                if end > i + 1 and len(places) >= SHORTEST:
                    yield "".join(text[a:b] for a, b in parts[i:end]), places
            i = j


def packed(text: str, starts: list[int], ends: list[int], runs: list[re.Match]) -> Iterator[Layer]:
    """Runs, in one line or wrapped in lines, that are base64 of text, or of compressed text."""
    for whole, places in chain(((m.group(), range(m.start(), m.end())) for m in runs), wrapped(text)):
        run = whole.rstrip("=")
        if len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), altchars=b"-_" if "-" in run or "_" in run else None, validate=True)
        except (binascii.Error, ValueError):
            continue
        got = unpacked(data)
        if got is None:
            continue
        inner, was_packed = got
        last, byte, s, e = len(places) - 1, 0, [], []
        for c in inner:
            width = len(c.encode("utf-8"))
            a, b = (0, last) if was_packed else (byte // 3 * 4, min(last, (byte + width - 1) // 3 * 4 + 3))
            s.append(starts[places[a]])
            e.append(ends[places[b]])
            byte += width
        yield inner, s, e


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each in order."""
    base, every, seen = None, set(), set()
    work: list[Layer] = [(text, range(len(text)), range(1, len(text) + 1))]
    while work:
        layer, starts, ends = work.pop()
        # the same content at another place is another layer, content met again inside itself is not
        mark = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), starts[0], ends[-1]) if layer else None
        if mark is None or mark in seen:
            base = base or []
            continue
        seen.add(mark)
        runs = list(RUN.finditer(layer))
        spans = base_spans(layer, runs)
        if base is None:
            base = sorted(spans)
        every.update((starts[s], kind, ends[e - 1]) for s, kind, e in spans)
        if "%" in layer or "\\" in layer or "&#" in layer:
            work += escapes(layer, starts, ends)
        work += packed(layer, starts, ends, runs)
    return base, sorted(every)


def joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex (base spans), base_spans and spans."""
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()), ("spans", pa.string())])

    def one(t: str) -> dict:
        base, every = scan(t)
        return {**{f"n_{k}": sum(s[1] == i for s in base) for i, k in enumerate(KINDS)}, "base_spans": joined(base), "spans": joined(every)}

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([one(t or "") for t in texts.to_pylist()], kind)

    names = [*(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    fields = ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names)
    return docs.withColumn("_found", F.arrow_udf(batch, fields)(text_of(text))).withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")
