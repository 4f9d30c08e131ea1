"""Word shingles of texts as sorted 64-bit hashes, computed over many texts at once.

Words are what lies between ASCII white space, with A-Z in lower case. A word's hash is a polynomial in its bytes, a shingle's a mixed sum of
its words' hashes, each with a factor of its place. Working memory is some tens of bytes for each byte of the texts taken at once, about 1 MB or one text.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x100000001B3 * 0x9E3779B97F4A7C15 % 2**64 | 1
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """Powers of the base, for the ``n`` bytes of the longest word; those of common lengths are kept."""
    global _powers
    if len(_powers) >= n:
        return _powers
    with np.errstate(over="ignore"):
        out = np.cumprod(np.full(max(256, n), _BASE, np.uint64))
    if n <= 4096:
        _powers = out
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and for each text where its words end in them."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        terms = (data[~space].astype(np.uint64) + np.uint64(1)) * _power(int(sizes.max()))[place]
        words = mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    return words, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its distinct shingles, in order of their hashes; a text with fewer words is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # about 1 MB of text at once, whole texts
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < 1 << 20):
            size += len(texts[stop] or "")
            stop += 1
        words, ends = word_hashes(texts[at:stop])
        with np.errstate(over="ignore"):
            n = max(0, len(words) - WORDS + 1)
            total = np.zeros(n, np.uint64)
            for k in range(WORDS):
                total += words[k : k + n] * _PLACE[k]
            total = mix(total)
            begin = 0
            for end in ends.tolist():
                if end - begin >= WORDS:
                    out.append(np.unique(total[begin : end - WORDS + 1]))
                elif end > begin:
                    short = (words[begin:end] * _PLACE[: end - begin]).sum(dtype=np.uint64) + np.uint64(end - begin)
                    out.append(mix(np.array([short], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
                begin = end
        at = stop
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        a = shingles.sum(dtype=np.uint64) + n
        b = mix(shingles * _PLACE[1] + np.uint64(1)).sum(dtype=np.uint64) ^ n
        return tuple(int(x) for x in mix(np.array([a, b], np.uint64)).view(np.int64))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
