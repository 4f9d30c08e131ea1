"""Perceptual hash of images: 63 bits of a discrete cosine transform."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIDE, KEEP = 32, 8
# Channels by a PNG's colour type, and the weights of red, green and blue in grey.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GREY = np.array([0.299, 0.587, 0.114])


def _cosines(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(keep)[:, None])


def hash_matrix(pixels: np.ndarray) -> str:
    """16 hex digits for a square matrix of grey values: the low frequencies but the first, each a bit if over their mean."""
    c = _cosines(pixels.shape[0], KEEP)
    low = (c @ pixels @ c.T).ravel()[1:]
    bits = low > low.mean()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


@F.pandas_udf(StringType())
def phash_matrix(pixels: pd.Series) -> pd.Series:
    """Of square matrices given row after row; null for null, and for sizes that aren't square or hold nulls."""

    def one(v):
        if v is None:
            return None
        a = np.asarray(v, float)
        n = int(round(len(a) ** 0.5))
        return hash_matrix(a.reshape(n, n)) if n >= KEEP and n * n == len(a) and np.isfinite(a).all() else None

    return pixels.map(one)


def png_grey(raw: bytes) -> np.ndarray | None:
    """Grey values of a PNG of 8 bits a channel that isn't interlaced; None for others."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, palette = 8, [], None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        chunk, at = raw[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or interlaced or colour not in CHANNELS or not width or not height:
                return None
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3).astype(float)
        elif kind == b"IDAT":
            data.append(chunk)
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, (width + 1) * n), np.uint8)  # a row above and a pixel to the left of zeros
    for y, line in enumerate(lines):
        now, above = out[y + 1], out[y]
        rest = line[1:]
        if line[0] in (0, 2):
            now[n:] = rest + (above[n:] if line[0] else 0)
            continue
        if line[0] == 1:
            now[n:] = np.cumsum(rest.reshape(width, n), 0, dtype=np.uint8).ravel()
            continue
        for k, v in enumerate(rest.tolist()):
            a, b, c = int(now[k]), int(above[k + n]), int(above[k])
            if line[0] == 3:
                guess = (a + b) // 2
            else:
                guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            now[k + n] = (v + guess) & 255
    pixels = out[1:, n:].reshape(height, width, n)
    if colour == 3:
        return None if palette is None else palette[pixels[:, :, 0]] @ GREY
    return pixels[:, :, :3].astype(float) @ GREY if n >= 3 else pixels[:, :, 0].astype(float)


def shrunk(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means over ``side`` x ``side`` areas of about the same size."""
    for _ in range(2):
        edges = np.linspace(0, len(pixels), side + 1)
        sums = np.vstack([np.zeros(pixels.shape[1]), np.cumsum(pixels, 0)])
        part = np.minimum(edges.astype(int), len(pixels) - 1)
        at = sums[part] + (edges - part)[:, None] * pixels[part]
        pixels = (np.diff(at, axis=0) / np.diff(edges)[:, None]).T
    return pixels


def _library_grey(raw: bytes) -> np.ndarray | None:
    """By an imaging library, of whatever it reads; None without one."""
    try:
        from PIL import Image
    except ImportError:
        return None
    return np.asarray(Image.open(io.BytesIO(raw)).convert("L"), float)


@F.pandas_udf(StringType())
def phash_image(content: pd.Series) -> pd.Series:
    """Of image files' bytes, by an imaging library; PNG is decoded here without one, other formats give null then, as do null and broken files."""

    def one(raw):
        if raw is None:
            return None
        try:
            pixels = _library_grey(raw)
            pixels = png_grey(raw) if pixels is None else pixels
            return None if pixels is None else hash_matrix(shrunk(pixels))
        except (OSError, ValueError, TypeError, zlib.error, struct.error, IndexError, UnboundLocalError):  # not an image after all
            return None

    return content.map(one)
