"""File names, types and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of files by suffix.
TYPES = {
    "text": ".txt .md .markdown .log .csv .rst .toml .ini .cfg",
    "code": ".py .js .ts .jsx .tsx .java .c .cpp .h .cs .go .rs .rb .php .swift .kt .sh .bat .ps1 .html .css .scss .sql .xml .yaml .yml .json",
    "pdf": ".pdf",
    "office": ".docx .doc .xlsx .xls .xlsm .pptx .ppt .odt .ods",
    "image": ".jpg .jpeg .png .gif .bmp .tiff .tif .webp .heic .heif .raw .cr2 .nef .svg .ico",
    "audio": ".mp3 .flac .ogg .m4a .aac .wav .wma .opus",
    "video": ".mp4 .mkv .avi .mov .wmv .flv .webm .m4v",
    "archive": ".zip .tar .gz .bz2 .xz .7z .rar",
}
# Folders and suffixes that a scan passes over.
IGNORED_FOLDERS = [".git", ".svn", ".hg", "node_modules", "__pycache__", ".mypy_cache", ".tox", "venv", ".venv", "env", "$RECYCLE.BIN", "System Volume Information"]
IGNORED_SUFFIXES = [".tmp", ".lock", ".DS_Store", ".Thumbs.db"]
# Media types of files that are shown as they are.
MEDIA = {".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".css": "text/css", ".csv": "text/csv", ".json": "application/json", ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg", ".mp4": "video/mp4", ".webm": "video/webm"}
#: 1990-01-01; earlier times of files are taken for wrong ones.
EARLIEST = 631152000


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def suffix(path: Column) -> Column:
    """From the last dot of the name, which isn't its first or last character, in lower case; else empty."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def type_group(ext: Column) -> Column:
    out = None
    for group, names in TYPES.items():
        out = (F.when if out is None else out.when)(F.lower(ext).isin(names.split()), group)
    return out.otherwise("other")


def media_type(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(known[F.lower(ext)], F.lit("application/octet-stream"))


def best_time(created: Column, modified: Column) -> tuple[Column, Column]:
    """The earliest of both times after 1990 and which it is, else the time of modification."""
    c, m = F.when(created > EARLIEST, created), F.when(modified > EARLIEST, modified)
    return F.coalesce(F.least(c, m), modified), F.when(c.isNotNull() & (m.isNull() | (c <= m)), "ctime").otherwise("mtime")


def override_time(time: Column, source: Column, taken: Column) -> tuple[Column, Column, Column]:
    """Time, source and confidence, with a time from metadata before those of the file system."""
    ok = F.coalesce(taken > EARLIEST, F.lit(False))
    return F.when(ok, taken).otherwise(time), F.when(ok, "exif").otherwise(source), F.when(ok, 0.95).otherwise(0.7)


def ignored(path: Column, folders: list[str] = IGNORED_FOLDERS, suffixes: list[str] = IGNORED_SUFFIXES) -> Column:
    """True for paths, relative to their root, that a scan passes over: hidden names but ``*.md`` and ``*.env``, and the suffixes and folders given."""
    name = file_name(path)
    written = F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1)
    ext = F.lower(written)
    hidden = name.startswith(".") & ~written.isin(".md", ".env")
    parts = F.split(path, r"[/\\]")
    return hidden | ext.isin(suffixes) | name.isin([s for s in suffixes if s.count(".") > 1 or s[1:2].isupper()]) | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in folders]))


def change_token(size: Column, modified: Column) -> Column:
    return F.concat_ws(":", size.cast("bigint"), modified.cast("bigint"))


def epoch_of_exif(text: Column) -> Column:
    """Seconds of ``YYYY:MM:DD HH:MM:SS`` in the session's time zone, null if it isn't that."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def degrees(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    return F.round((deg + minutes / 60 + seconds / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1), 7)
