"""Files as a source: scans, and readers of text from their contents.

A reader is a pandas function from contents to a struct of text, metadata and warnings, chosen by suffix from a registry. Text files are decoded by
built-in functions. Readers of other formats use the standard library where that is enough (docx, xlsx) and optional libraries otherwise.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions import files as names
from ..functions.formatting import clock, preview
from ..functions.phash import phash_image
from ..operators.filters import glob_regex
from .tree import empty_files

MAX_BYTES, PDF_PAGES, SHEETS, SHEET_ROWS = 50 * 1024 * 1024, 50, 10, 501
#: Roots within a root that are told by a predicate each; more by a join.
FEW_ROOTS = 8
RESULT = StructType([StructField("text", StringType()), StructField("metadata", MapType(StringType(), StringType())), StructField("warnings", ArrayType(StringType()))])
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified"}


def scan(spark: SparkSession, root: str, nested: list[str] | DataFrame = (), pattern: str | None = None, empty: bool = False) -> DataFrame:
    """Files below ``root`` with their contents, without ignored ones and those of nested roots. Spark's reader passes over empty files; with ``empty`` they are listed too."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    found = r.load(root)
    if empty:
        none = empty_files(spark, root)
        if pattern:
            none = none.where(names.file_name(F.col("path")).rlike(glob_regex(pattern)))
        found = found.unionByName(none)
    return described(found, root, nested)


def described(binary: DataFrame, root: str, nested: list[str] | DataFrame = ()) -> DataFrame:
    """As ``scan``, of rows that the binaryFile source gives, in batches or streams. Nested roots may be a table (root_path) of any size."""
    base = re.sub(r"^\w+:(//)?", "", root).rstrip("/") + "/"
    path = F.regexp_replace("path", r"^\w+:(//)?", "")
    x = binary.select(path.alias("full_path"), F.substring(path, F.lit(len(base) + 1), F.length(path)).alias("relative"), F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("modified_ts"), "content")
    x = x.where(~names.ignored(F.col("relative")))
    few = nested if isinstance(nested, list | tuple) and len(nested) <= FEW_ROOTS else ()
    for other in few:
        n = re.sub(r"^\w+:(//)?", "", other).rstrip("/") + "/"
        if n != base and n.startswith(base):
            x = x.where(~F.col("full_path").startswith(n))
    if isinstance(nested, DataFrame) or len(nested) > len(few):
        roots = nested if isinstance(nested, DataFrame) else x.sparkSession.createDataFrame([(n,) for n in nested], "root_path string")
        x = outside(x, roots, base)
    ext = names.suffix(F.col("full_path"))
    return x.select("full_path", "relative", names.parent_path(F.col("full_path")).alias("parent_path"), names.file_name(F.col("full_path")).alias("file_name"), ext.alias("extension"), names.type_group(ext).alias("file_type_group"), "size_bytes", "modified_ts", names.change_token(F.col("size_bytes"), F.col("modified_ts")).alias("change_token"), "content")


def outside(files: DataFrame, roots: DataFrame, base: str) -> DataFrame:
    """The files (full_path) that lie in none of the roots (root_path) below ``base``, by one plan for any number of roots.

    Each folder that holds files meets the roots by its ancestors, itself among them, in an equi-join; files then drop out by their folder.
    """
    base = base.rstrip("/") + "/"
    root = F.concat(F.rtrim(F.regexp_replace("root_path", r"^\w+:(//)?", ""), F.lit("/")), F.lit("/"))
    inner = roots.select(root.alias("above")).where(F.col("above").startswith(base) & (F.col("above") != base)).distinct()
    folder = F.regexp_replace("full_path", "[^/]*$", "")
    parts = F.split(F.col("folder"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    inside = files.select(folder.alias("folder")).distinct().select("folder", F.explode(above).alias("above")).join(inner, "above", "left_semi").select("folder").distinct()
    return files.join(inside, folder == F.col("folder"), "left_anti")


def docx_text(raw: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        meta = {}
        if "docProps/core.xml" in z.namelist():
            core = ElementTree.fromstring(z.read("docProps/core.xml"))
            meta = {k: e.text for k, tag in _CORE.items() if (e := core.find(tag)) is not None and e.text}
    lines = ["".join(t.text or "" for t in p.iter(_WORD + "t")) for p in body.iter(_WORD + "p")]
    return "\n".join(x for x in lines if x.strip()), meta


def xlsx_text(raw: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        there = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(_CELL + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in there else []
        sheets = [*ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_CELL + "sheet")]
        titles = [s.get("name") for s in sheets]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in there else {}
        out = []
        for i, sheet in enumerate(sheets[:SHEETS], 1):
            out.append(f"[Sheet: {sheet.get('name')}]")
            target = links.get(sheet.get(_LINK)) or f"worksheets/sheet{i}.xml"
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
            if part not in there:
                continue
            for k, row in enumerate(ElementTree.fromstring(z.read(part)).iter(_CELL + "row")):
                if k >= SHEET_ROWS:
                    break
                cells = []
                for c in row.iter(_CELL + "c"):
                    v = c.find(_CELL + "v")
                    value = "".join(t.text or "" for t in c.iter(_CELL + "t")) if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    if value:
                        cells.append(value)
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out), {"sheets": ",".join(titles)}


def pdf_text(raw: bytes) -> tuple[str, dict]:
    from pypdf import PdfReader

    pdf = PdfReader(io.BytesIO(raw))
    pages = [p.extract_text() or "" for p in pdf.pages[:PDF_PAGES]]
    info = pdf.metadata or {}
    return "\n".join(pages), {k: str(v) for k, v in (("title", info.get("/Title")), ("author", info.get("/Author")), ("pages", sum(bool(p.strip()) for p in pages))) if v}


def image_text(raw: bytes) -> tuple[str, dict]:
    from PIL import ExifTags, Image

    with Image.open(io.BytesIO(raw)) as im:
        meta = {"width": str(im.width), "height": str(im.height), "mode": im.mode, "format": str(im.format)}
        exif = im.getexif()
        tags = {ExifTags.TAGS.get(k, str(k)): v for k, v in [*exif.items(), *exif.get_ifd(0x8769).items()]}
        gps = exif.get_ifd(0x8825)
    meta |= {k: str(v) for k, v in tags.items() if isinstance(v, str | int | float)}
    for name, ref, value in (("gps_lat", gps.get(1), gps.get(2)), ("gps_lon", gps.get(3), gps.get(4))):
        try:
            if ref and value:
                d, m, s = map(float, value)
                meta[name] = str(round((d + m / 60 + s / 3600) * (-1 if ref in "SW" else 1), 7))
        except (TypeError, ValueError, ZeroDivisionError):  # a place that can't be read takes nothing else with it
            continue
    return f"Image {meta['format']} {meta['width']}x{meta['height']}" + (f" {tags['Model']}" if tags.get("Model") else ""), meta


# Tags of audio files that are kept.
AUDIO_TAGS = ("title", "artist", "album", "albumartist", "date", "genre", "tracknumber", "discnumber", "comment")


def audio_text(raw: bytes) -> tuple[str, dict]:
    from mutagen import File

    audio = File(io.BytesIO(raw), easy=True)
    if audio is None:
        return "", {}
    tags = {k: v for k, v in audio.items() if k in AUDIO_TAGS and v}
    meta = {k: str(v[0] if isinstance(v, list) else v) for k, v in tags.items()}
    if audio.info is not None:
        meta |= {"duration_seconds": str(round(audio.info.length, 2)), **{k: str(getattr(audio.info, k, "")) for k in ("bitrate", "sample_rate")}}
    return "", meta


def audio_line(metadata: Column) -> Column:
    """Title, artist, album and length, those that there are."""
    get = lambda k: F.try_element_at(metadata, F.lit(k))
    return F.nullif(F.concat_ws(" — ", *[F.nullif(get(k), F.lit("")) for k in ("title", "artist", "album")], F.when(get("duration_seconds").try_cast("double").isNotNull(), clock(get("duration_seconds").try_cast("double")))), F.lit(""))


#: Readers by suffix; more can be added.
READERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {".docx": docx_text, ".xlsx": xlsx_text, ".xlsm": xlsx_text, ".pdf": pdf_text}
READERS |= dict.fromkeys([".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp"], image_text) | dict.fromkeys([".mp3", ".flac", ".ogg", ".m4a", ".wav"], audio_text)


@F.pandas_udf(RESULT)
def _binary(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for e, raw in zip(ext, content):
        if raw is None:  # of a file that another reader takes
            rows.append((None, {}, []))
            continue
        try:
            text, meta = READERS[e](raw)
            rows.append((text, meta, []))
        except ImportError as x:
            rows.append((None, {}, [f"no library for {e}: {x.name}"]))
        except Exception as x:  # a broken file of any kind is reported with its row, and doesn't end the job
            rows.append((None, {}, [f"{type(x).__name__}: {x}"]))
    return pd.DataFrame(rows, columns=["text", "metadata", "warnings"])


@F.pandas_udf(StringType())
def _tolerant(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: raw.decode("utf-8", "replace"))


def _decoded(content: Column) -> Column:
    """UTF-8 as text; the rare contents that aren't valid go through a decoder that puts U+FFFD for what is wrong."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_tolerant(content))


def extracted(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` with text, preview, content_length, metadata, warnings, sha256 and, of images, phash instead of content."""
    ext, group = F.col("extension"), F.col("file_type_group")
    none = F.create_map().cast("map<string,string>")
    plain = group.isin("text", "code")
    large = (F.col("size_bytes") > max_bytes) & ~group.isin("image", "audio")
    text = _decoded(F.col("content"))
    basic = lambda t, w: F.struct(t.cast("string").alias("text"), none.alias("metadata"), w.cast("array<string>").alias("warnings"))
    read = ~plain & ~large & ext.isin(list(READERS))
    image = (group == "image") & ~large
    both = files.withColumns({"x": _binary(ext, F.when(read, F.col("content"))), "phash": phash_image(F.when(image, F.col("content")))})  # one scan; contents go to Python only where they are read there
    both = both.withColumn("x", F.when(read, F.col("x")).when(large, basic(F.lit(None), F.array(F.lit("File too large")))).when(plain, basic(text, F.array())).otherwise(basic(F.lit(None), F.array())))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    meta = F.when((F.col("file_type_group") == "audio") & F.try_element_at("x.metadata", F.lit("title")).isNull(), F.map_concat(F.coalesce("x.metadata", none), F.create_map(F.lit("title"), stem))).otherwise(F.col("x.metadata"))
    both = both.withColumn("x", F.struct(F.col("x.text").alias("text"), meta.alias("metadata"), F.col("x.warnings").alias("warnings")))
    t: Column = F.when(F.col("file_type_group") == "audio", F.coalesce(audio_line(F.col("x.metadata")), stem)).otherwise(F.col("x.text"))
    return both.select(*[c for c in files.columns if c != "content"], t.alias("text"), preview(t).alias("content_preview"), F.char_length(t).alias("content_length"), F.col("x.metadata").alias("metadata"), F.col("x.warnings").alias("warnings"), F.sha2("content", 256).alias("sha256"), "phash")


def thumbnail_key(item_id: Column, token: Column, size: int = 240) -> Column:
    """The name under which an item's thumbnail of ``size`` pixels, 64 to 1024, is kept; another token gives another."""
    if not 64 <= size <= 1024:
        raise ValueError("size must be 64 to 1024")
    return F.sha1(F.concat_ws(":", item_id.cast("string"), token, F.lit(str(size))).cast("binary"))


# Suffixes of files that are shown as text where nothing was extracted.
TEXT_SUFFIXES = [
    ".txt", ".md", ".markdown", ".py", ".js", ".ts", ".tsx", ".jsx", ".json",
    ".yaml", ".yml", ".xml", ".html", ".css", ".scss", ".sql", ".csv", ".log",
    ".ini", ".cfg", ".toml", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs",
    ".php", ".rb", ".sh", ".bat", ".ps1",
]


def text_page(text: Column, max_chars: int = 50_000, content: Column | None = None, ext: Column | None = None) -> Column:
    """The start of an item's text, or, where there is none, of its content if its suffix is that of text; else null."""
    if not 500 <= max_chars <= 200_000:
        raise ValueError("max_chars must be 500 to 200000")
    some = F.nullif(text, F.lit(""))
    if content is not None and ext is not None:
        some = F.coalesce(some, F.when(F.lower(ext).isin(TEXT_SUFFIXES), _decoded(content)))
    return F.substring(some, 1, max_chars)
