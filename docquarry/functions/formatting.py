"""How values are shown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"


def size(n: Column) -> Column:
    """Bytes with units of 1024 up to TB, one decimal beyond bytes."""
    out = F.when(n.isNull() | (n == 0), "0 B").when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / float(1024**k)))
    return out.otherwise(F.format_string("%.1f TB", n / float(1024**4)))


def date(ts: Column) -> Column:
    return F.when(ts.isNull() | (ts == 0), NONE).otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"))


def date_time(ts: Column) -> Column:
    return F.when(ts.isNull() | (ts == 0), NONE).otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"))


def duration(start: Column, end: Column) -> Column:
    s = (end - start).cast("bigint")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(end.isNull() | (end == 0), "running")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
    )


def clock(seconds: Column) -> Column:
    """``m:ss``, from an hour ``h:mm:ss``."""
    s = seconds.cast("bigint")
    short = F.concat_ws(":", F.floor(s / 60).cast("string"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(s < 3600, short).otherwise(F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad(F.floor((s % 3600) / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0")))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    return F.when(part.isNull() | whole.isNull() | (whole == 0), 0.0).otherwise(F.least(F.lit(100.0), F.round(part * 100.0 / F.nullif(whole, F.lit(0)))))


def bucket_label(bucket: Column, zoom: str) -> Column:
    d = F.to_date(F.rpad(bucket, 10, "0000-01-01") if zoom == "day" else F.concat(bucket, F.lit("-01" if zoom == "month" else "-01-01")))
    return bucket if zoom == "year" else F.upper(F.date_format(d, "MMM yyyy")) if zoom == "month" else F.date_format(d, "dd/MM/yyyy")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\f")), r"\s+", " ")


def preview(text: Column, n: int = 400) -> Column:
    return F.btrim(F.substring(text, 1, n), F.lit(" \t\n\r"))


def preview_text(text: Column, n: int = 20_000) -> Column:
    """What a preview of text shows."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def preview_kind(ext: Column, has_text: Column) -> Column:
    """How a file is previewed, by suffix, else by whether it has text."""
    from .files import type_group

    g = type_group(ext)
    return F.when(g.isin("pdf", "image", "audio", "video", "office"), g).when(g.isin("text", "code"), "text").when(has_text, "fallback-text").otherwise("unsupported")


def grid(text: Column, lines: int = 120, cells: int = 8) -> Column:
    """Spreadsheet text as rows of cells: the first lines that aren't empty; a line that names a sheet is one cell."""
    rows = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, lines)
    return F.transform(rows, lambda x: F.when(x.startswith("[Sheet"), F.array(x)).otherwise(F.slice(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), 1, cells)))
