"""Operator 4: secrets in texts and in what is encoded inside them.

A worklist holds layers of text. Each is searched for secrets and for encoded runs: percent escapes, Unicode and character escapes, base64, and
compressed bytes below base64. What a run decodes to is a new layer, until no new layer appears; layers seen before (in any order of
decodings) aren't done again, which ends cycles. Each layer knows where in the layer above each of its pieces comes from, and so down to the original text, so
that a secret found at any depth has a span there: that of the encoded characters that hold it, or of the whole run below compression.

A layer of escapes is its whole text with all escapes of a kind replaced. Base64 is decoded at all four alignments, as other text may stand right before it,
and over line ends with indentation, as it is often wrapped. Its bytes needn't all be text: they are searched one character a byte,
and as UTF-16 where every other byte is zero. Compressed streams are found anywhere in the bytes, those without a header (deflate) at their start.

Compressed runs are inflated whole, all members of them, and scanned in chunks that end where no secret and no encoded run goes on; a stretch without
such a place is held in memory as a whole, as is every text, however long. No size bounds what is searched.

Null and empty texts hold no secrets; an empty table gives an empty one. The same secret found in two ways at the same span counts once. Repeated rows give
repeated rows. Other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

KINDS = ("assign", "access", "hex")
#: Characters of a base64 run that is tried.
MIN_BASE64 = 16
#: Characters of inflated text that are scanned together if white space lets them end there, bytes inflated at a time, and compressed bytes given to zstandard at a time.
CHUNK, PIECE, ZSTD_INPUT = 1 << 22, 1 << 20, 256
#: The longest window that a frame of zstandard can have; the library's own default takes those beyond 2^27 for errors.
ZSTD_WINDOW = 1 << 31

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]{14,}")
_hex = re.compile(r"[0-9a-f]{16,}")
_percent = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_space = re.compile(r"\s")
_escape = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\u[0-9A-Fa-f]{4})+|(?:%u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_base64 = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")
#: Runs that go on over line ends, written as such or as escapes.
_wrapped = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_line_end = re.compile(r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+")
_run_char = re.compile(r"[A-Za-z0-9+/=_\\-]")
_plain64 = str.maketrans("-_", "+/")
#: Where compressed streams may begin.
_magic = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_little, _big = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){8,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets that stand in a text as it is, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _access.finditer(text)]
    out += [(*m.span(), "hex") for m in _hex.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


class Layer:
    """A text; the layer above and ``where``, which gives the span there that a span here comes from. ``fixed`` is the original's span of all of it, below compression."""

    def __init__(self, text: str, above: Layer | None = None, where: Callable[[int, int], tuple[int, int]] | None = None, fixed: tuple[int, int] | None = None):
        self.text, self.above, self.where, self.fixed = text, above, where, fixed

    def span(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.fixed is None and layer.above is not None:
            a, b = layer.where(a, b)
            layer = layer.above
        return layer.fixed or (a, b)


def _bytes_text(raw: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 of printable characters and white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and _space.sub("", text).isprintable() else None


def _offsets(text: str) -> list[int]:
    """For each character of a text, where its UTF-8 begins, and then the length of all."""
    out, n = [], 0
    for x in text:
        out.append(n)
        n += len(x.encode("utf-8", "surrogatepass"))
    return [*out, n]


def _code(digits: str, base: int) -> str:
    n = int(digits, base)
    return chr(n) if n < 0xD800 or 0xDFFF < n < 0x110000 else ""


def _unescaped(run: str) -> list[tuple[int, int, str]]:
    """(start, end, text) for the pieces of a run of one kind of escape."""
    if run.startswith("\\x"):
        raw = bytes.fromhex(run.replace("\\x", ""))
        text = _bytes_text(raw)
        if text is None:
            return [(4 * i, 4 * i + 4, chr(x)) for i, x in enumerate(raw)]
        at = _offsets(text)
        return [(4 * at[i], 4 * at[i + 1], x) for i, x in enumerate(text)]
    if run.startswith(("\\u", "%u")) and not run.startswith("\\u{"):
        raw = bytes.fromhex(run.replace("%u", "").replace("\\u", ""))
        text, out, i = raw.decode("utf-16-be", "replace"), [], 0
        for x in text:
            n = 2 if x > "\uffff" else 1
            out.append((6 * i, 6 * (i + n), x))
            i += n
        return out
    if run.startswith("&#"):
        return [(0, len(run), _code(run[3:-1], 16) if run[2] in "xX" else _code(run[2:-1], 10))]
    return [(0, len(run), _code(run.strip("\\uU{}"), 16))]


def _replaced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """A layer with pieces of it replaced: (start, end, text) in its own positions, in order."""
    text, old, here, ends, at, size = [], [], [], [], 0, 0  # of each piece: where it is in the layer, and where its text begins and ends in the new one
    for a, b, x in pieces:
        text += [layer.text[at:a], x]
        size += a - at
        old.append((a, b))
        here.append(size)
        size += len(x)
        ends.append(size)
        at = b
    text.append(layer.text[at:])

    def start(p: int) -> int:
        k = bisect_right(here, p) - 1
        while k >= 0 and here[k] == ends[k]:  # pieces that leave nothing
            k -= 1
        if k >= 0 and p < ends[k]:
            return old[k][0]
        k = bisect_right(here, p) - 1
        return p - ends[k] + old[k][1] if k >= 0 else p

    def where(a: int, b: int) -> tuple[int, int]:
        k = bisect_left(here, b) - 1  # the last piece that begins before the end
        return start(a), (old[k][1] if k >= 0 and b <= ends[k] else b - ends[k] + old[k][1] if k >= 0 else b)

    return Layer("".join(text), layer, where)


def _pieces(raw: bytes, plain: bool = False, members: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(member, piece, bytes left after the member at its end, else -1) of what compressed bytes hold: all members one after another, in pieces of bounded size; nothing if they aren't compressed. ``plain`` is for a first member without a header; with ``members`` what comes after so many isn't looked at."""
    member = 0
    while raw and member != members:
        if plain and not member or raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] << 8 | raw[1]) % 31 == 0:
            d, data = zlib.decompressobj(-15 if plain and not member else 31 if raw[:1] == b"\x1f" else 15), raw
            while not d.eof:
                piece = d.decompress(data, PIECE)
                data = d.unconsumed_tail
                if not piece and not data:
                    break
                yield member, piece, -1
            raw = d.unused_data
        elif raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\x00":
            d, data = bz2.BZ2Decompressor() if raw[:1] == b"B" else lzma.LZMADecompressor(), raw
            while not d.eof:
                piece, data = d.decompress(data, PIECE), b""
                if not piece and d.needs_input:
                    break
                yield member, piece, -1
            raw = d.unused_data
        elif raw[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            d, at = zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).decompressobj(), 0
            while not d.eof and at < len(raw):
                try:
                    piece = d.decompress(raw[at : at + ZSTD_INPUT])
                except zstandard.ZstdError as e:  # it has no common base with the others' errors
                    raise ValueError(str(e)) from e
                yield member, piece, -1
                at += ZSTD_INPUT
            raw = d.unused_data + raw[at:] if d.eof else b""
        else:
            return
        yield member, b"", len(raw)
        member += 1
        raw = raw.lstrip(b"\0")  # padding between members


def _members(raw: bytes, plain: bool = False) -> tuple[int, int]:
    """How many members compressed bytes have, and where the last ends; those from the first that can't be inflated on don't count.

    Only what the decoders say of bytes is caught: without the library for a member the job fails, rather than passing over the member.
    """
    count, end = 0, 0
    try:
        for member, _, left in _pieces(raw, plain):
            if left >= 0:
                count, end = member + 1, len(raw) - left
    except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
        pass
    return count, end


def _edge(text: str) -> tuple[int, int]:
    """Where a chunk of a text may end, and where the next begins, so that no secret or encoded run is cut; (0, 0) if nowhere."""
    at = len(text)
    while (at := text.rfind("\n", 0, at)) > 0:  # after a line whose end, or before one whose begin, is in no run
        before = text[:at].rstrip(" \t\r")[-1:] if text[at - 1] in " \t\r" else text[at - 1]
        if not _run_char.match(before):
            return at + 1, at + 1
    stop = len(text)
    while (stop := text.rfind(" ", 0, stop)) > 0:  # within a line
        if not text[stop - 1].isspace() and text[stop + 1 : stop + 2].strip():
            break
    stop = again = max(0, stop + 1)
    for _ in range(4):  # a name, its sign and what may be written around them
        again = len(text[:again].rstrip(" "))
        again = text.rfind(" ", 0, max(0, min(again, stop - 256))) + 1
    return (stop, again) if again else (0, 0)


def _inflated(raw: bytes, members: int, plain: bool = False) -> Iterator[str]:
    """What the members hold, one character a byte, in chunks; members next to each other are one text."""
    parts, size, due = [], 0, CHUNK
    for _, piece, _ in _pieces(raw, plain, members):
        parts.append(piece.decode("latin-1"))
        size += len(piece)
        if size >= due:
            held = "".join(parts)
            stop, again = _edge(held)
            if stop:
                yield held[:stop]
                held = held[again:]
            parts, size, due = [held], len(held), max(CHUNK, 2 * len(held))
    if parts:
        yield "".join(parts)


def _unquoted(run: str) -> list[tuple[int, int, str]]:
    """As ``_unescaped``, for a run of percent escapes."""
    raw = bytes.fromhex(run.replace("%", ""))
    text = _bytes_text(raw)
    if text is None:
        return [(3 * i, 3 * i + 3, chr(x)) for i, x in enumerate(raw)]
    at = _offsets(text)
    return [(3 * at[i], 3 * at[i + 1], x) for i, x in enumerate(text)]


def _runs(text: str) -> Iterator[tuple[str, Callable[[int], int]]]:
    """The base64 runs of a text without their line ends, and a function that gives the place in the text of a place in the run."""
    for m in _base64.finditer(text):
        yield m[0], m.start().__add__
    if "\n" not in text and "\\n" not in text:
        return
    for m in _wrapped.finditer(text):
        at, begins, places, parts = m.start(), [], [], []
        size = 0
        for gap in [*_line_end.finditer(text, m.start(), m.end()), None]:
            stop = gap.start() if gap else m.end()
            begins.append(size)
            places.append(at)
            parts.append(text[at:stop])
            size += stop - at
            at = gap.end() if gap else stop
        if size >= MIN_BASE64:

            def place(p: int, begins: list[int] = begins, places: list[int] = places) -> int:
                k = bisect_right(begins, p) - 1
                return places[k] + p - begins[k]

            yield "".join(parts), place


def _below(layer: Layer, run: str, place: Callable[[int], int]) -> Iterator[Layer]:
    """The layers that a base64 run decodes to."""
    long, run = len(run), run.rstrip("=").translate(_plain64)
    for skip in range(4):
        body = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))

        def where(a: int, b: int, skip: int = skip, size: int = len(body), first: int = 0, step: int = 1) -> tuple[int, int]:
            a, b = first + a * step, first + b * step
            return place(skip + a * 4 // 3), place(min(skip + size, skip - (-b * 4 // 3)) - 1) + 1

        yield Layer(raw.decode("latin-1"), layer, where)
        for pattern, at in ((_little, 0), (_big, 1)):
            for m in pattern.finditer(raw):
                yield Layer(m[0][at::2].decode("latin-1"), layer, lambda a, b, first=m.start(), where=where: where(a, b, first=first, step=2))

        def stream(a: int, b: int, size: int = len(raw), where: Callable = where) -> tuple[int, int]:
            first, last = where(a, b)
            return layer.span(first, place(long - 1) + 1 if b == size else last)

        done = 0  # members of a stream that was found aren't streams of their own
        for m in _magic.finditer(raw):
            if m.start() >= done:
                rest = raw[m.start() :]
                members, end = _members(rest)
                if members:
                    done = m.start() + end
                    for x in _inflated(rest, members):
                        yield Layer(x, fixed=stream(m.start(), done))
        if raw and not done and _texty(raw):
            members, end = _members(raw, True)
            for x in _inflated(raw, members, True):
                yield Layer(x, fixed=stream(0, end))


def _texty(raw: bytes) -> bool:
    """Whether bytes are a whole deflate stream, without a header, of text: other bytes can begin as if they were one."""
    d = zlib.decompressobj(-15)
    utf8 = codecs.getincrementaldecoder("utf-8")()
    try:
        data = raw
        while not d.eof:
            piece = d.decompress(data, PIECE)
            data = d.unconsumed_tail
            if not piece and not data:
                break
            if not _space.sub("", utf8.decode(piece)).isprintable():
                return False
    except (zlib.error, UnicodeDecodeError):
        return False
    return d.eof


def decoded(layer: Layer) -> Iterator[Layer]:
    """The layers one step below a layer."""
    text = layer.text
    for mark, pattern, plain in (("%", _percent, _unquoted), (("\\", "&#", "%u"), _escape, _unescaped)):
        if any(x in text for x in mark) and (pieces := [(m.start() + a, m.start() + b, x) for m in pattern.finditer(text) for a, b, x in plain(m[0])]):
            yield _replaced(layer, pieces)
    for run, place in _runs(text):
        if not run.rstrip("=").isdigit():  # digits never decode to text
            yield from _below(layer, run, place)


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans of a text, and these with those of all layers below it."""
    text = text or ""
    base = base_spans(text)
    every, seen, work = set(base), {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}, [(text, decoded(Layer(text)))]
    while work:  # depth first, so that of a compressed run one chunk is held
        above, layers = work[-1]
        below = next(layers, None)
        if below is None:
            work.pop()
            continue
        if not below.text or below.text == above:
            continue
        mark = hashlib.blake2b(below.text.encode("utf-8", "surrogatepass") + b"%d:%d" % below.span(0, len(below.text)), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        every.update((*below.span(a, b), kind) for a, b, kind in base_spans(below.text))
        work.append((below.text, decoded(below)))
    return base, sorted(every, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, the base spans of each kind, ``base_sha256`` and ``spans`` of all layers; repeated rows give repeated rows."""

    def make():
        def rows(texts):
            out = []
            for t in texts:
                base, every = find(t)
                counts = [sum(x[2] == k for x in base) for k in KINDS]
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            return out

        return rows

    return map_texts(df, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", key, text)


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``key`` and the text with every span, overlapping ones as one, replaced by ``mask``; null stays null."""

    def masked(t):
        if t is None:
            return None
        out, at = [], 0
        for a, b, _ in find(t)[1]:
            if b > at:
                out += [t[at : max(a, at)], mask if a >= at else ""]
                at = b
        return "".join(out) + t[at:]

    return map_texts(df, lambda: lambda texts: [(masked(t),) for t in texts], f"`{text}` string", key, text)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
