"""Secret scans with a worklist of decoded layers.

A text is the first layer. Each layer is scanned for the three kinds of secrets,
and unwrapped: percent-encoded bytes and Unicode escapes are decoded in place over
the whole layer, runs of base64 become layers of their own, and compressed bytes
are unpacked. Layers are made as the worklist comes to them, the newest first, so no
more than one of each depth is held, until there are none; a layer whose
content was seen before (at the same place) is left, so texts that unpack to
themselves end. Every layer keeps where its characters came from, so a find is
reported as the span of the original text that carries it: exact characters
through escapes, groups of four through base64, the whole of compressed bytes.

Base64 is read at all four alignments, as other letters may stand before it, and
compressed bytes are looked for after '/', '-' and '_' as well. Compressed streams
go on through all their members, what they unpack to is unpacked as a stream, and
bytes after them are streams of their own. A stream whose bytes are those of one around
it is left, as it unpacks to itself. Base64 may be folded: into lines, indented ones,
quoted ones, and such whose ends are escapes. Backslashes before backslashes and quotes
go, so escapes inside strings inside strings are reached, and so do the zero bytes of UTF-16.

Null texts are empty, repeated rows stay rows. Decoded layers are scanned whole; what
compressed bytes unpack to is read in windows of 2 Mi characters that overlap by 64 Ki,
and a window goes on to 4 Mi where it would end within a longer run without white
space. So memory stays bounded. A window that ends within such a run all the same, and
a stream that asks for more than 128 MiB to be unpacked, are counted in ``n_cut``: where
that is 0, nothing was left out but secrets of more than 64 Ki characters inside
compressed bytes.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches

#: The kinds in their order, and what they look like.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: A secret has 16 characters at least, which are 22 in base64.
LEAST_BASE64 = 22
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}={{0,2}}")
#: Between the lines of folded base64: a line's end, as it is or as an escape, with white space, quotes, a comma or a plus sign around it.
FOLD = r"""(?:["']?+[ \t]*+[,+]?+[ \t]*+(?:\\r\\n|\\n|\\?\r?\n)[ \t]*+["']?+|["'][ \t]*+[,+][ \t]*+["'])"""
FOLDS = re.compile(FOLD)
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}+(?:{FOLD}[A-Za-z0-9+/_-]{{20,}}+)++(?:{FOLD}[A-Za-z0-9+/_-]++)?={{0,2}}")
#: What stands behind a backslash for itself, in strings inside of strings.
QUOTED = re.compile(r"""\\([\\"'/])""")
#: Characters of UTF-16 with their zero bytes, in both orders.
WIDE = (re.compile("(?:[\x20-\x7e\t\r\n]\x00){16,}"), re.compile("(?:\x00[\x20-\x7e\t\r\n]){16,}"))
RUN = re.compile(r"[A-Za-z0-9+/_=.%\\&#;{}-]*")
WINDOW, LONGEST, OVERLAP = 2 << 20, 4 << 20, 64 << 10
MOST_MEMORY = 128 << 20
#: Long streams that begin alike and are unpacked inside each other; what is inside of that many is counted as cut.
ALIKE = 8
#: Bytes without as many ASCII characters in a row, each perhaps with a zero byte as in UTF-16, hold nothing to find.
STRETCH = 16
#: How compressed bytes begin: in base64, and as escaped bytes between which others stand for themselves.
PACKED = re.compile(rb"(?<=[+/])(?:H4sI|Qlpo|/Td6WFoA|KLUv/|e[A-P])")
PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~-])++")
ESCAPED_BYTES = re.compile(r"(?:\\x1[fF]\\x8[bB]|(?:x|\\x78)\\x[0-9A-Fa-f]{2}|(?:x|\\x78)\^|BZh|\\xfd7zXZ\\x00|\(\\xb5/\\xfd)(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\]|[\x20-\x5b\x5d-\x7e])*+")
ESCAPED_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|(.)")
_SHORT = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0", strict=True))
ESCAPES = re.compile(rf"(?:{ESCAPE.pattern})+")
_PLAIN = bytes.maketrans(b"-_", b"+/")


def _run_table(members: str) -> bytes:
    return bytes(1 if chr(c) in members else 0 for c in range(256))


_HEX_RUN, _BASE64_RUN = _run_table("0123456789abcdef"), _run_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_TEXT_RUN = bytes(2 if c == 0 else 1 if 32 <= c < 127 or c in (9, 10, 13) else 0 for c in range(256))


def _wide(runs: bytes) -> bool:
    return b"\x02" in runs and (b"\x01\x02" * STRETCH in runs or b"\x02\x01" * STRETCH in runs)


def _readable(data: bytes) -> bool:
    runs = data.translate(_TEXT_RUN)
    return b"\x01" * STRETCH in runs or _wide(runs)


def find(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of all secrets of one layer; ``data`` is the text in UTF-8."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\x01" * LEAST_HEX in data.translate(_HEX_RUN):
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and where its characters came from in the original text: each ``starts`` and ``ends``, or all from one ``span``, or itself."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, span: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.span = text, starts, ends, span
        self.data = text.encode("utf-8", "surrogatepass")

    def at(self, start: int, end: int) -> tuple[int, int]:
        if self.span is not None:
            return self.span
        return (start, end) if self.starts is None else (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def key(self) -> tuple[bytes, tuple[int, int]]:
        return hashlib.blake2b(self.data, digest_size=16).digest(), self.at(0, len(self.text)) if self.text else (0, 0)

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """This layer with every match decoded in place, or None if nothing changes."""
        parts, spans, at = [], [], 0
        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is None:
                continue
            parts += [self.text[at : m.start()], new]
            spans += [(at, m.start(), m.start() - at), (m.start(), m.end(), -len(new))]
            at = m.end()
        if not parts:
            return None
        parts.append(self.text[at:])
        if self.span is not None:
            return Layer("".join(parts), span=self.span)
        spans.append((at, len(self.text), len(self.text) - at))
        starts, ends = [], []
        for a, b, n in spans:
            if n >= 0:
                starts.append(np.arange(a, b, dtype=np.int32) if self.starts is None else self.starts[a:b])
                ends.append(np.arange(a + 1, b + 1, dtype=np.int32) if self.ends is None else self.ends[a:b])
            else:
                a, b = self.at(a, b)
                starts.append(np.full(-n, a, np.int32))
                ends.append(np.full(-n, b, np.int32))
        return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))

    def unquoted(self) -> Layer | None:
        """This layer without backslashes before what stands behind them for itself, or None if there are none."""
        at = np.array([m.start() for m in QUOTED.finditer(self.text)], np.int64)
        if not len(at):
            return None
        text = QUOTED.sub(r"\1", self.text)
        if self.span is not None:
            return Layer(text, span=self.span)
        kept = np.ones(len(self.text), bool)
        kept[at] = False
        starts = np.arange(len(self.text), dtype=np.int32) if self.starts is None else self.starts.copy()
        ends = starts + 1 if self.ends is None else self.ends
        starts[at + 1] = np.minimum(starts[at], starts[at + 1])
        return Layer(text, starts[kept], ends[kept])


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return bytes.fromhex(run.replace("%", "")).decode("latin-1")


def _escape(x: str) -> str | None:
    if x.startswith("&#"):
        code = int(x[3:-1], 16) if x[2] in "xX" else int(x[2:-1])
    elif x.startswith("\\u{"):
        code = int(x[3:-1], 16)
    elif len(x) == 12:
        code = 0x10000 + ((int(x[2:6], 16) & 0x3FF) << 10) + (int(x[8:], 16) & 0x3FF)
    else:
        code = int(x[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class _Zstd:
    """A decompressor of zstandard that can keep what follows its frame."""

    def __init__(self, unpack):
        self.unpack, self.rest = unpack, b""
        self.decompress = unpack.decompress

    eof = property(lambda self: self.unpack.eof)
    unused_data = property(lambda self: self.unpack.unused_data)


def _decompressor(data: bytes):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0 and not data[1] & 32:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=MOST_MEMORY)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstd(zstandard.ZstdDecompressor(max_window_size=MOST_MEMORY).decompressobj())
    return None


#: What can go wrong with bytes that aren't what they look like.
BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def _unpacker(data: bytes):
    """A decompressor for bytes that begin like this, or None if they aren't compressed."""
    if (trial := _decompressor(data)) is not None:
        try:
            trial.decompress(data[:64])
        except BROKEN as e:
            if "memory" not in str(e).lower():
                return None
        return _decompressor(data)
    return None


def _gathered(parts: Iterator[bytes], least: int, data: bytes = b"") -> bytes:
    """``data`` and the next parts, up to ``least`` bytes or more, or the end."""
    held, size = [data], len(data)
    while size < least and (new := next(parts, None)) is not None:
        held.append(new)
        size += len(new)
    return b"".join(held)


def _member(unpack, parts: Iterator[bytes], data: bytes) -> Iterator[bytes]:
    """What one member or frame unpacks to, in pieces of bounded size; its end is known from ``unpack``."""
    while data:
        if hasattr(unpack, "unconsumed_tail"):
            yield unpack.decompress(data, WINDOW)
            data = unpack.unconsumed_tail
            if not data and not unpack.eof:
                while new := unpack.decompress(b"", WINDOW):
                    yield new
        elif hasattr(unpack, "needs_input"):
            yield unpack.decompress(data, WINDOW)
            while not unpack.eof and not unpack.needs_input:
                yield unpack.decompress(b"", WINDOW)
            data = b""
        else:
            # a block of a few bytes can stand for 128 KiB
            for at in range(0, len(data), 256):
                yield unpack.decompress(data[at : at + 256])
                if unpack.eof:
                    unpack.rest = unpack.unused_data + data[at + 256 :]
                    return
            data = b""
        if unpack.eof:
            return
        data = data or _gathered(parts, 1)


def _members(parts: Iterator[bytes], data: bytes, rest: list[bytes], cuts: list) -> Iterator[bytes]:
    """What all members of a compressed stream unpack to. Bytes after the last are put into ``rest``, before those left in ``parts``."""
    try:
        while (unpack := _unpacker(data)) is not None:
            for new in _member(unpack, parts, data):
                if new:
                    yield new
            if not unpack.eof:
                return
            data = _gathered(parts, 6, (unpack.rest if isinstance(unpack, _Zstd) else unpack.unused_data).lstrip(b"\0"))
            while data[:1] == b"\0":
                data = _gathered(parts, 6, data.lstrip(b"\0"))
        rest.append(data)
    except BROKEN as e:
        if "memory" in str(e).lower():
            cuts.append(e)


def _text_windows(parts: Iterator[bytes], cuts: list) -> Iterator[str]:
    """The windows of a text in UTF-8; bytes that aren't are escaped."""
    decoder, kept, fresh = codecs.getincrementaldecoder("utf-8")("surrogateescape"), "", 0
    for new in itertools.chain(parts, (None,)):
        text = decoder.decode(new or b"", new is None)
        kept, fresh = kept + text, fresh + len(text)
        if not fresh or (new is not None and fresh < WINDOW):
            continue
        if new is not None and len(kept) >= OVERLAP and RUN.fullmatch(kept, len(kept) - OVERLAP):
            if len(kept) < LONGEST:
                continue
            cuts.append(len(kept))
        yield kept
        kept, fresh = kept[-OVERLAP:], 0


def _unpack_all(parts: Iterator[bytes], seen: tuple[tuple[bytes, bool], ...] = (), cuts: list | None = None) -> Iterator[str]:
    """Windows of a stream of bytes that isn't compressed any more, through any depth. One whose bytes, all of them, are those of one around it unpacks to
    itself and is left; of longer ones (over 2 MiB, of which not all is at hand) that begin alike, a few are unpacked inside each other."""
    cuts = [] if cuts is None else cuts
    data = _gathered(parts, WINDOW)
    if _unpacker(data) is None:
        yield from _text_windows(itertools.chain((data,), parts), cuts)
        return
    key = hashlib.blake2b(data[:WINDOW]).digest(), len(data) < WINDOW
    if seen.count(key) >= (1 if key[1] else ALIKE):
        if not key[1]:
            cuts.append(len(data))
    else:
        rest: list[bytes] = []
        yield from _unpack_all(_members(parts, data, rest, cuts), (*seen, key), cuts)
        if rest and rest[0]:
            yield from _unpack_all(itertools.chain(rest, parts), seen, cuts)


def _packed_layers(layer: Layer, data: bytes, a: int, b: int, cuts: list) -> Iterator[Layer]:
    span = layer.at(a, b)
    for new in _unpack_all(iter((data,)), (), cuts):
        if _readable(new.encode("utf-8", "surrogateescape")):
            yield Layer(new, span=span)


def _escaped_layers(layer: Layer, cuts: list) -> Iterator[Layer]:
    """What compressed bytes unpack to that are written as escapes."""
    text = layer.text
    for m in PERCENT_BYTES.finditer(text) if "%" in text else ():
        for at in {m.start(), m.start() + m[0].find("%")} if "%" in m[0] else ():
            data = urllib.parse.unquote_to_bytes(text[at : m.end()])
            if _unpacker(data) is not None:
                yield from _packed_layers(layer, data, at, m.end(), cuts)
    for m in ESCAPED_BYTES.finditer(text) if "\\x" in text else ():
        data, end, quote = bytearray(), m.end(), text[m.start() - 1 : m.start()]
        for x in ESCAPED_BYTE.finditer(m[0]):
            if x[3] and x[3] in (quote if quote in ("'", '"') else "'\""):
                end = m.start() + x.start()
                break
            data.append(int(x[1], 16) if x[1] else ord(x[3] or _SHORT.get(x[2], x[2])))
        if _unpacker(data := bytes(data)) is not None:
            yield from _packed_layers(layer, data, m.start(), end, cuts)
    for m in ESCAPES.finditer(text) if "\\" in text or "&#" in text else ():
        codes = [_escape(x[0]) for x in ESCAPE.finditer(m[0])]
        if None not in codes and max(codes) < "\u0100" and _unpacker(data := "".join(codes).encode("latin-1")) is not None:
            yield from _packed_layers(layer, data, *m.span(), cuts)


def _base64_layers(layer: Layer, cuts: list) -> Iterator[Layer]:
    if b"\x01" * (LEAST_BASE64 - 2) not in layer.data.translate(_BASE64_RUN):
        return
    runs = [(m.start(), m.end(), False) for m in BASE64.finditer(layer.text)] + [(m.start(), m.end(), True) for m in WRAPPED.finditer(layer.text)]
    for a, b, wrapped in runs:
        run = np.frombuffer(layer.text[a:b].encode("ascii"), np.uint8)
        kept = run != 61
        for m in FOLDS.finditer(layer.text, a, b) if wrapped else ():
            kept[m.start() - a : m.end() - a] = False
        places, code = (a + np.flatnonzero(kept)).astype(np.int32), run[kept].tobytes()
        del run, kept
        plain = code.translate(_PLAIN)
        packed = {m.start() for m in PACKED.finditer(plain.replace(b"+", b"/"))} if b"/" in plain or b"+" in plain else set()
        for at in sorted({0, 1, 2, 3} | packed):
            if at > 3 and _unpacker(base64.b64decode(plain[at : at + 88] + b"=" * (-len(plain[at : at + 88]) % 4))) is None:
                continue
            size = len(code) - at
            size -= size % 4 == 1
            try:
                data = base64.b64decode(plain[at : at + size] + b"=" * (-size % 4))
            except binascii.Error:
                continue
            if _unpacker(data) is not None:
                yield from _packed_layers(layer, data, int(places[at]), b, cuts)
            if at > 3 or not _readable(data):
                continue
            if layer.span is not None:
                yield Layer(data.decode("utf-8", "surrogateescape"), span=layer.span)
            else:
                new, own = data.decode("utf-8", "surrogateescape"), places[at : at + size]
                n = np.arange(len(data), dtype=np.int32)
                first, last = own[n * 4 // 3], own[np.minimum(((n + 1) * 4 + 2) // 3, size) - 1]
                if len(new) != len(data):
                    codes = np.frombuffer(new.encode("utf-32-le", "surrogatepass"), np.uint32)
                    sizes = 1 + np.where((codes >= 0xDC80) & (codes <= 0xDCFF), 0, (codes >= 0x80).astype(int) + (codes >= 0x800) + (codes >= 0x10000))
                    ends = np.cumsum(sizes, dtype=np.int32)
                    first, last = first[ends - sizes], last[ends - 1]
                yield Layer(new, first, last + 1) if layer.starts is None else Layer(new, layer.starts[first], layer.ends[last])


def _unwrapped(layer: Layer, cuts: list) -> Iterator[Layer]:
    """The layers right under one."""
    for mark, pattern, decode in (("%", PERCENT, _percent), ("\\&", ESCAPE, _escape)):
        if any(x in layer.text for x in mark) and (new := layer.replaced(pattern, decode)) is not None:
            yield new
    if "\\" in layer.text and (new := layer.unquoted()) is not None:
        yield new
    for at, pattern in enumerate(WIDE) if "\0" in layer.text and _wide(layer.data.translate(_TEXT_RUN)) else ():
        if (new := layer.replaced(pattern, lambda x, at=at: x[at::2])) is not None:
            yield new
    yield from _escaped_layers(layer, cuts)
    yield from _base64_layers(layer, cuts)


def layers(text: str, cuts: list | None = None) -> Iterator[Layer]:
    """The text's layers, itself first. What ends before its end is added to ``cuts``."""
    cuts = [] if cuts is None else cuts
    first = Layer(text)
    yield first
    seen = {first.key()} if "%" in text or "\\" in text or "&#" in text else set()
    work = [_unwrapped(first, cuts)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            yield layer
            work.append(_unwrapped(layer, cuts))


def scan_text(text: str, cuts: list | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(those of the text itself, all spans), each (start, kind's number, end) in order."""
    base: list[tuple[int, int, int]] = []
    every: set[tuple[int, int, int]] = set()
    for depth, layer in enumerate(layers(text, cuts)):
        for kind, a, b in find(layer.text, layer.data):
            a, b = layer.at(a, b)
            every.add((a, kind, b))
            if not depth:
                base.append((a, kind, b))
    return sorted(base), sorted(every)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_nested, n_cut) of every whole text, in the input's own partitions.

    The counts and the digest are of secrets that stand in the text itself; ``spans`` has those of decoded layers too, and
    ``n_nested`` is how many there are of them, ``n_cut`` what of them was not read to its end.
    """

    def run(parts):
        for part in parts:
            rows = []
            for x in part.column(1):
                cuts: list = []
                base, every = scan_text(x.as_py() or "", cuts)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*counts, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every), len(every) - len(set(base)), len(cuts)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_nested", "n_cut"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_nested long, n_cut long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text``, nested ones included, replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda x: x if x is None else redact_text(x, scan_text(x)[1], mark))

    small_batches(docs.sparkSession)
    return docs.withColumn(text, clean(F.col(text)))
