"""Operator 10: byte-level BPE encoding and decoding of whole texts by tree concatenation.

A long text is cut into leaves, at any character that isn't within a long unsplit stretch, and these are encoded in parallel; neighbours are put together level by level. Around each join a window
of tokens of both sides is encoded anew and grows until both sides agree with it exactly: until in the window, on either side of the join, the
tokens up to (or from) a place where no piece of the pre-tokenizer can go on, white space after a visible character, are the half's own tokens there.
What lies beyond such a place doesn't depend on what lies before it, so the halves' other tokens stay.

A long piece that the pre-tokenizer leaves unsplit has no such place. It is cut into leaves of bytes and joined in the same way, but for the
agreement: the window's first token must equal the left half's there and its last the right half's. Every pair of neighbours in the result then is one
that the merges leave apart, in which case they leave the whole row of tokens as it is.

Null texts count as empty (no ids); an empty table gives an empty one. Texts of any length are encoded whole. The special string of the vocabulary inside
a text is its special id, as the library has it by default. Repeated rows give repeated rows; other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table, tokenizer_path

MODEL = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary's special string and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters of a text, or bytes of an unsplit piece, up to which it is a leaf of the tree.
LEAF = 4096
#: Leaves of a text from which they are encoded in parallel.
MANY = 16
#: Where no piece goes on after the first of two characters, whatever stands around them.
_places = re.compile(r"[!-~][ \t\n\r]")


class Encoder:
    """Encodes and decodes; one for each Python worker."""

    def __init__(self, ranks_file: str, leaf: int = LEAF, threads: int = 2):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})._core_bpe
        self._plain, self._piece, self.bytes = core.encode_ordinary, core.encode_single_piece, core.decode_bytes
        self._pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.leaf = leaf
        self._pool, self._texts = ThreadPoolExecutor(threads), ThreadPoolExecutor(threads)  # a leaf of a text may wait for those of a piece

    def _unsplit(self, text: str) -> bool:
        """True if a run of ``leaf`` characters may be all white space or all without: of any such run this looks at a half that has one word at most."""
        half = max(1, self.leaf // 2)
        return any(len(text[i : i + half].split(None, 1)) < 2 for i in range(0, len(text) - half + 1, half))

    def plain(self, text: str) -> list[int]:
        """The ids of a text in which no string is special: leaves in parallel, then joins by levels."""
        if len(text) <= self.leaf:
            return self.leaf_ids(text)
        cuts = [0, *self._cuts(text), len(text)]
        run = self._texts.map if len(cuts) > MANY else map  # threads pay for many leaves only
        rows = list(run(self.leaf_ids, [text[a:b] for a, b in zip(cuts, cuts[1:])]))
        while len(rows) > 1:
            rows = [self.join_texts(rows[i], rows[i + 1]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        return rows[0]

    def _cuts(self, text: str) -> list[int]:
        """Where leaves end: every ``leaf`` characters if there is a place on both sides nearby where no piece goes on, else at the next such place."""
        out, at, near = [], self.leaf, max(2, self.leaf // 2)
        while at < len(text):
            if not (_places.search(text, max(0, at - near), at) and _places.search(text, at, at + near)):
                m = _places.search(text, at)
                if not m:
                    break
                at = m.start() + 1
            out.append(at)
            at += self.leaf
        return [x for x in out if x < len(text)]

    def join_texts(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of the texts that ``a`` and ``b`` are the ids of, put together."""
        if not a or not b or _apart(self.bytes(a[-1:]), self.bytes(b[:1])):
            return a + b
        i = j = 4
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            raw = self.bytes(a[len(a) - i :]), self.bytes(b[:j])
            try:
                text = (raw[0] + raw[1]).decode()
            except UnicodeDecodeError:  # an end of the window lies within a character
                i, j = 2 * i, 2 * j
                continue
            mid = self.leaf_ids(text)
            left = 0 if i == len(a) else self._agreed(a[len(a) - i :], mid, len(raw[0]), 1)
            right = 0 if j == len(b) else self._agreed(b[:j], mid, len(raw[1]), -1)
            if left is not None and right is not None:
                return a[: len(a) - i + left] + mid[left : len(mid) - right] + b[j - right :]
            i, j = i * (2 if left is None else 1), j * (2 if right is None else 1)

    def _agreed(self, half: list[int], mid: list[int], size: int, way: int) -> int | None:
        """How many tokens ``half`` and ``mid`` share from their start (or, ``way`` -1, their end) up to the farthest place within ``size`` bytes where no piece can go on; None if there is none."""
        found, at, before = None, 0, b""
        for k, (x, y) in enumerate(zip(half[::way], mid[::way])):
            raw = self.bytes([x])
            if k and at <= size and _apart(*((before, raw) if way > 0 else (raw, before))):
                found = k
            if x != y:
                break
            at += len(raw)
            before = raw
        return found

    def leaf_ids(self, text: str) -> list[int]:
        """The ids of a text by the library, but for long unsplit pieces."""
        if not self._unsplit(text):
            return self._plain(text)
        out: list[int] = []
        for piece in self._pieces(text):
            raw = piece.encode()
            out += self.tree(raw) if len(raw) > self.leaf else self._piece(raw)
        return out

    def tree(self, raw: bytes) -> list[int]:
        """The ids of an unsplit piece: leaves in parallel, then joins by levels."""
        rows = list(self._pool.map(self._piece, [raw[i : i + self.leaf] for i in range(0, len(raw), self.leaf)]))
        while len(rows) > 1:
            rows = [self.join(rows[i], rows[i + 1]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        return rows[0]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of what ``a`` and ``b`` stand for together."""
        i = j = 2
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            mid = self._piece(self.bytes(a[len(a) - i :] + b[:j]))
            left = i == len(a) or mid[0] == a[len(a) - i]
            right = j == len(b) or mid[-1] == b[j - 1]
            if left and right:
                return a[: len(a) - i] + mid + b[j:]
            i, j = i * (1 if left else 2), j * (1 if right else 2)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if SPECIAL not in text:
            return self.plain(text)
        first, *rest = text.split(SPECIAL)
        out = self.plain(first)
        for x in rest:
            out += [SPECIAL_ID, *self.plain(x)]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.bytes(ids).decode("utf-8", "replace")


def _apart(a: bytes, b: bytes) -> bool:
    """Whether between tokens ``a`` and ``b`` no piece can go on: white space after a visible character begins one, whatever stands around."""
    return 0x20 < a[-1] < 0x7F and b[0] in b" \t\n\r"


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks_file: str, leaf: int = LEAF) -> Encoder:
    """This worker's encoder; later tasks in the same worker find it and what it remembers."""
    if (ranks_file, leaf) not in _encoders:
        _encoders[ranks_file, leaf] = Encoder(ranks_file, leaf)
    return _encoders[ranks_file, leaf]


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array of int) for each row."""
    path = ranks_file or tokenizer_path(RANKS)
    return map_texts(df, lambda: lambda texts: [(encoder(path).encode(t),) for t in texts], "ids array<int>", key, text)


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_file: str | None = None) -> DataFrame:
    """``key`` and ``text`` for each row of ids; null ids give an empty text."""
    path = ranks_file or tokenizer_path(RANKS)
    return map_texts(df, lambda: lambda rows: [(encoder(path).decode(x or []),) for x in rows], "text string", key, ids)


def encode_digests(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the text that the ids decode to).

    Empty and null texts have no ids: both digests are those of no bytes. Repeated rows give repeated rows.
    """
    path = ranks_file or tokenizer_path(RANKS)

    def make():
        e = encoder(path)
        names = [str(i) for i in range(SPECIAL_ID + 1)]

        def digests(texts):
            out = []
            for t in texts:
                ids = e.encode(t)
                joined = ",".join(map(names.__getitem__, ids)).encode()
                out.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()))
            return out

        return digests

    return map_texts(df, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", key, text)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
