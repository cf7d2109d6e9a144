"""Secret scans through nested encodings.

A worklist holds layers of text. The first layer is the text itself. Each layer is searched for
secrets, and every encoded stretch in it (percent escapes, Unicode and hex escapes, character
references, base64, base64 or hex of compressed data) becomes a further layer, until nothing new turns up. A
layer already seen at the same place is not opened again, so cycles end. Every decoded character
knows the stretch of the original text it comes from, so a hit at any depth is reported as a span
of the original text.

Escapes decode in place: the layer is the whole text with its escapes resolved, characters beside
them keep their places. base64 and hex runs decode to a layer of their own; each of its characters
stands for the whole run. A run is also tried over its line breaks and from where a payload glued to a path or
name may begin: the first beginning at each place modulo four (it decodes all that follows) and each that
shows a packed one, of which only as much is decoded as unpacks. All members of a packed stream are read. What a run decodes to is read, at any size, as UTF-8 and (where it holds a NUL)
as UTF-16 with stray bytes replaced, and unpacked where it begins as gzip, zlib or bzip2. A reading with
stray or control characters is a layer only if it holds a secret or an encoded stretch, so hashes and keys
give no further layers.

Defined results: NULL text is the empty text (no spans); NULL ids stay NULL; repeated rows repeat;
an empty table gives an empty table; other columns are ignored; texts are searched whole. A packed
layer that unfolds to more than ``max_layer`` bytes is read in overlapping windows as it unfolds; each
window is a layer like others, and a packed layer within is unpacked as a stream; ``n_streamed`` counts those.
A window repeats the last ``TAIL`` bytes and the unfinished run before it (escapes, runs and lines of runs with their
indents, as the decoders read them), of which at most ``max_layer`` bytes: only packed data in one longer run
within such a layer is not unpacked whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import re
import urllib.parse
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.common import id_and_text, map_rows

KINDS = ("assign", "access", "hex")
#: The base patterns (fixed values). Letters of the names count in either case, ASCII only.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as filtering all runs by length
_NAMES = ("passw", "secret", "token", "apikey", "api_key")

_ESCAPES = re.compile(
    r"((?:%[0-9A-Fa-f]{2})+)|(\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+)"
    r"|(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});)"
)
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
#: Lines of one run; a line with further words belongs to none.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t>]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]++(?![\x20\t]+[^\s=]))+={0,2}")
_LINE = re.compile(r"[^\x20\t>\r\n]+")
_MARK = re.compile("[+/_-]")
_HEXRUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){12,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){12,}(?![0-9A-Za-z])")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f�]")
#: What the decoders may still be in the middle of, from the end backwards: escapes and runs, also over indented lines.
_UNFINISHED = re.compile(rb"[\x20\t>\r\0]*+(?:[A-Za-z0-9+/_=%\\&#;{}\0-]++|[\x20\t>\0]*+\n[\r\0]*+[\x20\t>\0]*+)*+")
MAX_LAYER = 1 << 24
TAIL = 8192


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one layer: leftmost and non-overlapping per kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


class Layer:
    """A text whose character i comes from [starts[i], ends[i]) of the original."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of_run(cls, text: str, a: int, b: int) -> Layer:
        """All characters stand for one stretch; its places take no memory."""
        return cls(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))

    @property
    def one_run(self) -> bool:
        return self.starts.strides == (0,)

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())


def _escape(m: re.Match) -> str | None:
    s = m[0]
    try:
        if m[1]:
            return urllib.parse.unquote_to_bytes(s).decode("utf-8")
        if m[2]:
            if s.startswith("\\u{"):
                return chr(int(s[3:-1], 16))
            if s.startswith("\\x"):
                return bytes.fromhex(s.replace("\\x", "")).decode("utf-8")
            if s.startswith("\\U"):
                return chr(int(s[2:], 16))
            units = b"".join(int(x, 16).to_bytes(2, "big") for x in s.split("\\u")[1:])
            return units.decode("utf-16-be")
        out = html.unescape(s)
        return None if out == s else out
    except (UnicodeDecodeError, ValueError, OverflowError):
        return None


def unescaped(layer: Layer) -> Layer | None:
    """The layer with its escapes resolved in place, or None if it has none."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&" not in text:
        return None
    parts, starts, ends, at = [], [], [], 0
    for m in _ESCAPES.finditer(text):
        new = _escape(m)
        if new is None or any(0xD800 <= ord(c) < 0xE000 for c in new):
            continue
        a, b = m.span()
        parts += [text[at:a], new]
        if layer.one_run:
            at = b
            continue
        starts += [layer.starts[at:a], np.full(len(new), layer.starts[a])]
        ends += [layer.ends[at:a], np.full(len(new), layer.ends[b - 1])]
        at = b
        if m[1] and len(new) == (b - a) // 3:  # one escape a character: keep single places
            starts[-1], ends[-1] = layer.starts[a:b:3], layer.ends[a + 2 : b : 3]
    if not parts:
        return None
    if layer.one_run:
        return Layer.of_run("".join([*parts, text[at:]]), int(layer.starts[0]), int(layer.ends[0]))
    return Layer(
        "".join([*parts, text[at:]]),
        np.concatenate([*starts, layer.starts[at:]]),
        np.concatenate([*ends, layer.ends[at:]]),
    )


def _may_decode(text: str) -> bool:
    return bool(("%" in text or "\\" in text or "&" in text) and _ESCAPES.search(text) or _B64.search(text))


def _readings(data: bytes) -> Iterator[str]:
    """The texts that bytes may be; those with odd characters only if there is something in them."""
    text = data.decode("utf-8", "replace")
    if not _CONTROL.search(text) or find(text) or _may_decode(text):
        yield text
    if b"\0" in data:
        for code in ("utf-16-le", "utf-16-be"):
            for at in (0, 1):  # a stray byte or a window's start may shift the pairs
                text = data[at:].decode(code, "replace")
                if find(text) or _may_decode(text):
                    yield text


def _unpackers(data: bytes):
    if data[:2] == b"\x1f\x8b":
        yield lambda: zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0:
        yield zlib.decompressobj
    if data[:3] == b"BZh":
        yield bz2.BZ2Decompressor


def _begun(data: bytes):
    for make in _unpackers(data):
        try:
            make().decompress(data[:4096], 1)
            return make()
        except (zlib.error, OSError, EOFError, ValueError):
            continue
    return None


def _inflated(make: Callable, pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    d, rest = make(), b""
    for piece in pieces:
        rest += piece
        while True:
            if d is None:  # the next member, behind padding
                rest = rest.lstrip(b"\0")
                if len(rest) < 4:
                    break
                d = _begun(rest)
                if d is None:
                    return
            try:
                out = d.decompress(rest, most)
            except (zlib.error, OSError, EOFError, ValueError):
                return
            rest = getattr(d, "unconsumed_tail", b"")
            if out:
                yield out
            if d.eof:
                d, rest = None, d.unused_data
            elif not out:
                break


def unpacked(make: Callable, pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    """What compressed pieces hold, up to where they are sound, in pieces of ``most`` bytes or little more; only the last is shorter."""
    held, size = [], 0
    for out in _inflated(make, pieces, most):
        held.append(out)
        size += len(out)
        if size >= most:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]  # a single character more holds no byte
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _payloads(run: str) -> Iterator[bytes]:
    if _HEXRUN.fullmatch(run):
        yield bytes.fromhex(run)
    data = _base64(run)
    if data is not None:
        yield data


def _pieces(run: str, k: int) -> Iterator[bytes]:
    """The payload of a base64 run from character ``k`` on, decoded only as far as it is asked for."""
    size = 1024
    while k < len(run):
        yield _base64(run[k : k + size]) or b""
        k, size = k + size, 1 << 16


def _beginnings(run: str, starts: list[int]) -> Iterator[tuple[int, bool]]:
    """Where else a payload in a run may begin: the first of ``starts`` at each place modulo four (True), and packed ones (False)."""
    known = {0}
    for k in starts:
        if len(run) - k < 16:
            break
        if k % 4 not in known:
            known.add(k % 4)
            yield k, True
        elif any(_unpackers(_base64(run[k : k + 4]) or b"")):
            yield k, False


class Scanner:
    """Scans texts; ``max_layer`` bounds the bytes of one unpacked layer held at once."""

    def __init__(self, max_layer: int = MAX_LAYER):
        self.max_layer = max_layer

    def scan(self, text: str) -> tuple[list, list, int, int]:
        """Base spans, all spans, number of decoded layers, number of layers read as a stream."""
        base = find(text)
        if not _may_decode(text):
            return base, base, 0, 0
        places = np.arange(len(text), dtype=np.int64)
        spans, seen, layers = set(base), set(), 0
        self.streamed = 0
        work = [iter([Layer(text, places, places + 1)])]
        while work:  # depth first, so that of a streamed layer one window is held
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
                continue
            if not layer.text:
                continue
            key = (int(layer.starts[0]), int(layer.ends[-1]), len(layer.text), hash(layer.text))
            if key in seen:
                continue
            seen.add(key)
            if layers:
                spans.update((k, *layer.span(a, b)) for k, a, b in find(layer.text))
            layers += 1
            work.append(self._decoded(layer))
        return base, ordered(spans), layers - 1, self.streamed

    def _decoded(self, layer: Layer) -> Iterator[Layer]:
        plain = unescaped(layer)
        if plain is not None:
            yield plain
        for m in _B64.finditer(layer.text):
            for i, j in self._stretches(m):
                a, b = layer.span(i, j)
                for text in self._open(layer.text[i:j]):
                    yield Layer.of_run(text, a, b)
            for k, whole in _beginnings(m[0], [x.end() for x in _MARK.finditer(m[0])]):
                a, b = layer.span(m.start() + k, m.end())
                for text in self._open(m[0][k:]) if whole else self._packed(m[0], k):
                    yield Layer.of_run(text, a, b)
        for m in _WRAPPED.finditer(layer.text):
            for i, run, k, whole in self._unwrapped(m):
                a, b = layer.span(i, m.end())
                for text in self._open(run[k:]) if whole else self._packed(run, k):
                    yield Layer.of_run(text, a, b)

    @staticmethod
    def _stretches(m: re.Match) -> Iterator[tuple[int, int]]:
        """The run, and its parts between the marks that also stand in paths and names."""
        yield m.span()
        for part in _PART.finditer(m[0]):
            if len(part[0]) < len(m[0]):
                yield m.start() + part.start(), m.start() + part.end()

    @staticmethod
    def _unwrapped(m: re.Match) -> Iterator[tuple[int, str, int, bool]]:
        """Lines joined to one run, and what begins with a line or behind a mark: place in the text, run, place in it, as a whole."""
        lines, starts, at = [x.span() for x in _LINE.finditer(m[0])], [], 0
        for a, b in lines:
            starts.append(at)
            at += b - a
        run = "".join(m[0][a:b] for a, b in lines)
        yield m.start(), run, 0, True
        for k, whole in _beginnings(run, sorted({*starts[1:], *(x.end() for x in _MARK.finditer(run))})):
            line = bisect_right(starts, k) - 1
            yield m.start() + lines[line][0] + k - starts[line], run, k, whole

    def _open(self, run: str) -> Iterator[str]:
        """The texts in an encoded run, a large one by windows."""
        seen: set[bytes] = set()
        for data in _payloads(run):
            yield from self._texts(lambda data=data: iter((data,)), seen)

    def _packed(self, run: str, k: int) -> Iterator[str]:
        """The texts packed in a run from ``k`` on; as plain text an earlier beginning has read them."""
        for make in _unpackers(next(_pieces(run, k), b"")):
            yield from self._texts(lambda make=make: unpacked(make, _pieces(run, k), self.max_layer), set())

    def _texts(self, source: Callable[[], Iterator[bytes]], seen: set[bytes]) -> Iterator[str]:
        pieces = source()
        first, second = next(pieces, b""), next(pieces, None)
        mark = hashlib.sha256(first)
        if second is None:
            if not first or mark.digest() in seen:
                return
            yield from _readings(first)
        else:
            self.streamed += 1
            window = first
            yield from _readings(window)
            for piece in chain((second,), pieces):
                mark.update(piece)
                window = self._tail(window) + piece
                yield from _readings(window)
            if mark.digest() in seen:
                return
        seen.add(mark.digest())
        for make in _unpackers(first):
            yield from self._texts(lambda make=make: unpacked(make, source(), self.max_layer), seen)

    def _tail(self, window: bytes) -> bytes:
        """What the next window repeats; a run too long for it is cut at a multiple of four characters."""
        run = _UNFINISHED.match(window[::-1]).end()
        if run > max(TAIL, self.max_layer):
            most = max(TAIL, self.max_layer)
            run = most - (most - run) % 4
            return window[len(window) - run :]
        return window[-max(TAIL, run) :]


def secret_scans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER
) -> DataFrame:
    """Per document the counts and digest of base spans and all spans, nested layers included.

    One pass, no shuffle. Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans, n_layers, n_streamed.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_layers", "n_streamed"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3

    def make():
        scanner = Scanner(max_layer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans, layers, streamed = scanner.scan(text)
                n = [sum(s[0] == k for s in base) for k in KINDS]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc, *n, digest, written(spans), len(spans), layers, streamed))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        return each

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_spans long, n_layers long, n_streamed long"
    )
    return map_rows(id_and_text(docs, id_col, text_col), schema, make)


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[{}]", max_layer: int = MAX_LAYER
) -> DataFrame:
    """All columns of ``docs`` with every span of a secret replaced by its kind in brackets.

    Overlapping spans are replaced as one, named after the first. Documents without a secret keep their
    text as it is (a NULL stays NULL); ``length_col`` is set anew where the text changed.
    """
    at = docs.columns.index(text_col)
    long_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def make():
        scanner = Scanner(max_layer)

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            spans = scanner.scan(text)[1]
            if not spans:
                return text
            merged: list[list] = []
            for k, a, b in ordered(spans):
                if merged and a < merged[-1][2]:
                    merged[-1][2] = max(merged[-1][2], b)
                else:
                    merged.append([k, a, b])
            out, pos = [], 0
            for k, a, b in merged:
                out += [text[pos:a], mark.format(k)]
                pos = b
            return "".join([*out, text[pos:]])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            before = batch.column(at).to_pylist()
            after = [clean(t) for t in before]
            cols = list(batch.columns)
            cols[at] = pa.array(after, batch.schema.field(at).type)
            if long_at is not None:
                old = batch.column(long_at).to_pylist()
                new = [o if x == y else len(y) for o, x, y in zip(old, before, after, strict=True)]
                cols[long_at] = pa.array(new, batch.schema.field(long_at).type)
            return pa.record_batch(cols, schema=batch.schema)

        return each

    return map_rows(docs, docs.schema, make)
