"""Secret scans with recursive decoding.

Every whole text is scanned; layers found in it (URL percent codes, Unicode and character escapes,
full-width and styled letters, base64, and compressed data within any of these) are decoded and go on a
worklist, until none gives a new layer. A layer of the same text and place as one before isn't taken up
again, so cycles end. A layer knows where in the layer before its characters come from, by the places of
its decoded characters alone, so findings map back to the document and long texts with few codes cost
little more than themselves.

Percent codes, escapes and letter forms are decoded in place, with the text around them, so that a secret may lie
partly in codes; base64 runs, wrapped over lines or not, become layers of their own, read from each offset, in their
readable stretches (UTF-8, or printable ASCII as UTF-16). Packed data (gzip, zlib, bzip2, xz) are unpacked member by
member and to the innermost, at most `unpack_limit` bytes at a time; chunks overlap by 64 KiB, so a finding or a coded
layer within a larger packing is whole unless it is longer than that and lies over the border of two chunks.

Defined results: null counts as empty; spans count code points, end exclusive; a span found in several
layers is one; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, table

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are maximal, so a least length within the pattern drops just those that fail it afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Cheap necessary condition of ASSIGN: its keyword and mark.
MARK = re.compile(r"(?:word|passwd|secret|token|key)[\"']?\x20*[:=]", re.I | re.A)

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
PERCENT_CODE = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Full-width, circled and mathematical letters; soft hyphens, zero-width and direction marks.
FORMS = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\uff01-\uff5e\u24b6-\u24e9\U0001d400-\U0001d7ff]+")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UNPACK_LIMIT = 64 << 20

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Base findings of one layer, by start, then kind as listed."""
    found: list[Span] = []
    if MARK.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Layer:
    """A text that was found in another layer. locate: from a stretch (start, end) of it to the stretch of
    the layer before; null: the document itself."""

    def __init__(self, text: str, parent: Layer | None = None, locate: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.parent, self.locate = text, parent, locate

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Span in the document of the characters start .. end - 1."""
        layer = self
        while layer.parent is not None:
            start, end = layer.locate(start, end)
            layer = layer.parent
        return start, end


def constant(start: int, end: int) -> Callable:
    return lambda *_: (start, end)


def edited(layer: Layer, edits: Iterable[tuple[int, int, str]]) -> Layer | None:
    """The layer with stretches (start, end, what stands for it: a character or none) replaced; rising."""
    text, parts, done, size = layer.text, [], 0, 0
    at, long, start, end = (array("q") for _ in range(4))
    for a, b, out in edits:
        if a > done:
            parts.append(text[done:a])
            size += a - done
        at.append(size)
        long.append(len(out))
        start.append(a)
        end.append(b)
        parts.append(out)
        size += len(out)
        done = b
    if not at:
        return None
    parts.append(text[done:])

    def place(i: int) -> tuple[int, int]:
        k = bisect_right(at, i) - 1
        if k < 0:
            return i, i + 1
        if i < at[k] + long[k]:
            return start[k], end[k]
        p = end[k] + i - at[k] - long[k]
        return p, p + 1

    return Layer("".join(parts), layer, lambda i, j: (place(i)[0], place(j - 1)[1]))


#: Stretches without control characters and bytes that aren't UTF-8.
READABLE = re.compile("[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]+")
#: Shortest readable stretch that can hold a finding or another layer: a coded character, as `%41`.
SHORTEST = 3


#: Printable ASCII as UTF-16, of either order of bytes.
WIDE = re.compile(rb"(?:[\t\n\r -~]\x00){3,}|(?:\x00[\t\n\r -~]){3,}")


def readable(raw: bytes) -> list[tuple[int, str, int]]:
    """The readable stretches of raw, each with the byte where it starts and the bytes that a character of UTF-16
    takes (1 for UTF-8, where they vary)."""
    text = raw.decode("utf-8", "surrogateescape")
    found, at, done = [], 0, 0
    for m in READABLE.finditer(text):
        at += len(text[done : m.start()].encode("utf-8", "surrogateescape"))
        done = m.start()
        if m.end() - m.start() >= SHORTEST:
            found.append((at, m[0], 1))
    if b"\x00" in raw:
        found += [(m.start(), m[0].replace(b"\x00", b"").decode("ascii"), 2) for m in WIDE.finditer(raw)]
    return found


class Inflater:
    """zlib's object for gzip and zlib, with the interface of bz2's and lzma's."""

    def __init__(self):
        self.z, self.held = zlib.decompressobj(wbits=47), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.z.decompress(self.held + data, most)
        self.held = self.z.unconsumed_tail
        self.full = len(out) == most
        return out

    eof = property(lambda self: self.z.eof)
    unused_data = property(lambda self: self.z.unused_data)
    needs_input = property(lambda self: not self.held and not self.full)


def unpacker(raw) -> Callable | None:
    """What unpacks data that begin so; null: nothing does."""
    first = bytes(raw[:6])
    if first[:2] == b"\x1f\x8b" or len(raw) > 2 and first[0] & 15 == 8 and (first[0] << 8 | first[1]) % 31 == 0:
        return Inflater
    return bz2.BZ2Decompressor if first[:3] == b"BZh" else lzma.LZMADecompressor if first == b"\xfd7zXZ\x00" else None


def members(chunks: Iterable[bytes], make: Callable, size: int) -> Iterator[bytes]:
    """What all members of a packed stream hold, at most `size` bytes at a time."""
    z = make()
    for data in chunks:
        while True:
            try:
                out = z.decompress(data, size)
            except (zlib.error, OSError, lzma.LZMAError):
                return
            if out:
                yield out
            data = b""
            if z.eof:
                data, z = z.unused_data, make()
                if not data:
                    break
            elif z.needs_input:
                break


def innermost(raw: bytes, size: int) -> Iterator[bytes]:
    """Content of packed data, unpacked until it isn't packed; a content met before ends it."""
    stream, seen = iter([raw]), set()
    while True:
        first = b""
        for chunk in stream:
            first += chunk
            if len(first) > size:
                break
        key, make = hashlib.sha256(first).digest(), unpacker(first)
        if make is None or key in seen:
            return chain([first], stream)
        seen.add(key)
        inner = members(chain([first], stream), make, size)
        if (begun := next(inner, None)) is None:  # text that only begins as packed data do
            return chain([first], stream)
        stream = chain([begun], inner)


def opens(raw) -> bool:
    """Whether data begin as packed data do and a first stretch of them unpacks."""
    make = unpacker(raw)
    if make is None:
        return False
    try:
        make().decompress(bytes(raw[:512]), 64)
    except (zlib.error, OSError, lzma.LZMAError):
        return False
    return True


#: Bytes by which neighbouring chunks of unpacked data overlap.
OVERLAP = 1 << 16


def unpacked(raw, size: int) -> Iterator[str]:
    """Readable stretches of what packed data hold at the innermost, in overlapping chunks."""
    if not opens(raw):
        return
    held = b""
    for chunk in innermost(bytes(raw), size):
        held += chunk
        yield from (text for _, text, _ in readable(held))
        held = held[-OVERLAP:]


#: Where packed data may begin.
HEADER = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00", re.S)
WRITTEN = re.compile(r"[!-~]+")
codecs.register_error("as-utf-8", lambda e: (e.object[e.start : e.end].encode("utf-8", "surrogatepass"), e.end))


def from_codes(layer: Layer, pattern: re.Pattern, size: int) -> Iterator[Layer]:
    """Layers of packed bytes written as percent codes or escapes, with plain characters between them."""
    char = lambda m: chr(int(m[0][1:], 16) if pattern is PERCENT_CODE else code_of(m))
    for run in WRITTEN.finditer(layer.text):
        if not pattern.search(run[0]):
            continue
        raw = memoryview(pattern.sub(char, run[0]).encode("latin-1", "as-utf-8"))
        for m in HEADER.finditer(raw):
            for text in unpacked(raw[m.start() :], size):
                yield Layer(text, layer, constant(*run.span()))


def percent_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Coded characters; bytes that aren't UTF-8 stay as they are written."""
    for m in PERCENT.finditer(text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            coded = not "\udc80" <= c <= "\udcff"
            size = 3 * len(c.encode()) if coded else 3
            if coded:
                yield at, at + size, c
            at += size


def code_of(m: re.Match) -> int:
    """Number of an escape's character; beyond Unicode: that of the replacement character."""
    code = int(next(g for g in m.groups() if g), 10 if m[6] else 16)
    return code if code <= 0x10FFFF else 0xFFFD


def escape_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in ESCAPE.finditer(text):
        code = int(next(g for g in m.groups() if g), 10 if m[6] else 16)
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code)


def form_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in FORMS.finditer(text):
        for i, c in enumerate(m[0], m.start()):
            yield i, i + 1, "" if INVISIBLE.match(c) else unicodedata.normalize("NFKC", c)


#: After a separator that is a letter of base64, too, packed data may begin: as gzip, bzip2, xz or zlib do, coded.
JOINED = re.compile(r"(?<=[/_-])(?=H4[s-v]|Qlpo|[/_]Td6|[CGKOSWae][A-P])")


#: A base64 run over several lines, and what parts them; the least letters of one that is looked at.
LEAST_RUN = 16
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*")


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """Wrapped runs on one line: lines of one length (the first may begin within its line), and the
    shorter one that ends them, which may itself be the first of others."""
    for m in WRAPPED.finditer(layer.text):
        if m.end() - m.start() <= LEAST_RUN:
            continue
        ends = [*LINE_END.finditer(m[0])]
        starts, stops = [0, *(x.end() for x in ends)], [*(x.start() for x in ends), len(m[0].rstrip("="))]
        long = [b - a for a, b in zip(starts, stops, strict=True)]
        first = 0
        while first + 1 < len(long):
            width = max(long[first], long[first + 1])
            last = next((i for i in range(first + 1, len(long)) if long[i] != width), len(long))
            shorter = last < len(long) and long[last] < width
            until = len(m[0]) if last + shorter == len(long) else stops[last + shorter - 1]
            text = m[0][starts[first] : until]
            if len(text) > LEAST_RUN:
                at = starts[first]
                run = Layer(text, layer, lambda i, j, at=m.start() + at: (at + i, at + j))
                yield edited(run, ((x.start() - at, x.end() - at, "") for x in ends[first : last + shorter - 1]))
            first = last


def from_base64(layer: Layer, m: re.Match, limit: int) -> Iterator[Layer]:
    """Contents of a base64 run, read from each of the four offsets and after each separator: readable
    stretches, or what unpacks to text. Offsets alike modulo 4 read the same, so four cover all starts of
    text; packed data begin at a start of their own."""
    body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
    for offset in range(4):
        part = body[offset:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        for first, text, step in readable(raw):

            def locate(i: int, j: int, start=m.start() + offset, first=first, text=text, step=step):
                a, b = (i * step, j * step) if text.isascii() else (len(text[:i].encode()), len(text[:j].encode()))
                return start + (first + a) * 4 // 3, start + -(-(first + b) * 4 // 3)

            yield Layer(text, layer, locate)
    for begin in dict.fromkeys([0, 1, 2, 3, *(x.end() for x in JOINED.finditer(m[0]))]):
        # a look at the first bytes, and at what they unpack to, before the rest is decoded
        head = body[begin : begin + 680]
        head = head[: len(head) // 4 * 4]
        if len(head) < 8 or unpacker(base64.b64decode(head[:8])) is None or not opens(base64.b64decode(head)):
            continue
        part = body[begin:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        for text in unpacked(base64.b64decode(part + "=" * (-len(part) % 4)), limit):
            yield Layer(text, layer, constant(m.start() + begin, m.end()))


def layers(layer: Layer, limit: int) -> Iterator[Layer | None]:
    """The layers found in one, made as they are asked for."""
    text = layer.text
    if "%" in text:
        yield edited(layer, percent_edits(text))
        yield from from_codes(layer, PERCENT_CODE, limit)
    if "\\" in text or "&#" in text:
        yield edited(layer, escape_edits(text))
        yield from from_codes(layer, ESCAPE, limit)
    if not text.isascii() and FORMS.search(text):
        yield edited(layer, form_edits(text))
    for m in BASE64.finditer(text):
        yield from from_base64(layer, m, limit)
    for joined in unwrapped(layer):
        for m in BASE64.finditer(joined.text):
            yield from from_base64(joined, m, limit)


def findings(text: str, unpack_limit: int = UNPACK_LIMIT) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans after unwrapping every layer."""
    base = scan(text)
    every = set(base)
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
    work, seen = [layers(Layer(text), unpack_limit)], {(digest(text), 0, len(text))}
    while work:
        try:
            layer = next(work[-1])
        except StopIteration:
            work.pop()
            continue
        if layer is None or not layer.text:
            continue
        key = (digest(layer.text), *layer.origin(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        every.update((k, *layer.origin(s, e)) for k, s, e in scan(layer.text))
        work.append(layers(layer, unpack_limit))
    return base, ordered(every)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPEC = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, counts of base spans by kind, their digest, all spans."""

    def make():
        def work(texts):
            got = [findings(t) for t in texts]
            count = lambda k: pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64())
            return {f"n_{k}": count(k) for k in KINDS} | {
                "base_sha256": pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in got], pa.string()),
                "spans": pa.array([listed(a) for _, a in got], pa.string()),
            }

        return work

    return over_texts(docs.select("doc_id", "text"), make, SPEC)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans as one."""
    out, at, until = [], 0, -1
    for kind, start, end in findings(text)[1]:
        if start >= until:
            out += (text[at:start], f"[{kind} removed]")
        until = at = max(until, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets taken out of the texts; n_chars follows; null texts and other columns stay."""

    def make():
        return lambda texts: {"__clean": pa.array([redacted(t) for t in texts], pa.string())}

    kinds = ", ".join(f"__{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    named = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)), F.col("text").alias("__text"))
    out = over_texts(named, make, f"{kinds}, __clean string", "__text")
    text = F.when(F.col(f"__{docs.columns.index('text')}").isNotNull(), F.col("__clean"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return out.select(*(new.get(c, F.col(f"__{i}")).alias(c) for i, c in enumerate(docs.columns)))


def query(spark, sf_dir):
    return secret_spans(table(spark, sf_dir, "documents"))
