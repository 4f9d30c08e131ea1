"""Predicates of listings and searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Filters of a listing. Falsy values mean none, but for sizes, where only None does."""

    file_type: str | None = None
    extension: str | None = None
    root: str | int | None = None
    min_size: int | None = None
    max_size: int | None = None
    since_ts: int | None = None
    until_ts: int | None = None
    folder_path: str | None = None

    def column(self, time: Column | None = None) -> Column:
        t = F.col("best_time_ts") if time is None else time
        out = F.col("is_deleted") == 0
        for name, value in (("file_type_group", self.file_type), ("extension", self.extension), ("root", self.root)):
            if value:
                out = out & (F.col(name) == value)
        if self.min_size is not None:
            out = out & (F.col("size_bytes") >= self.min_size)
        if self.max_size is not None:
            out = out & (F.col("size_bytes") <= self.max_size)
        if self.since_ts:
            out = out & (t >= self.since_ts)
        if self.until_ts:
            out = out & (t <= self.until_ts)
        if self.folder_path:
            out = out & like(F.col("full_path"), like_pattern(self.folder_path))
        return out


def has_wildcard(q: str) -> bool:
    return "*" in q or "?" in q


def like_pattern(q: str) -> str:
    """A LIKE pattern: ``*`` and ``?`` become its own wildcards; text without them is looked for anywhere. ``%`` and ``_`` stay wildcards."""
    return q.replace("*", "%").replace("?", "_") if has_wildcard(q) else f"%{q}%"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(value: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(value, _UPPER, _LOWER)


def like(value: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z only; a backslash is an ordinary character."""
    return fold(value).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def glob_regex(pattern: str) -> str:
    """A regular expression for a case-sensitive GLOB over the whole value: ``*``, ``?`` and ``[sets]``, ``[^sets]`` included."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            begin = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end = pattern.find("]", begin + 1)
            if end < 0:
                return "(?!)"
            body = pattern[begin:end].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&").replace("^", "\\^")
            out += f"[{'^' if begin > i + 1 else ''}{body}]"
            i = end
        else:
            out += "\\" + c if c in r"\.^$|()+{}]" else c
        i += 1
    return rf"(?s)\A{out}\z"


def glob(value: Column, pattern: str) -> Column:
    return F.coalesce(value, F.lit("")).rlike(glob_regex(pattern))
