"""Queries over the supplied tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import files, formatting
from .functions.phash import phash_matrix
from .functions.text import ACCENTED, PLAIN, hamming_similarity, hash_bits, once, simhash
from .functions.text import search_tokens as text_tokens
from .operators import dedup, folders, index, listing, near_index, search, stats, timeline
from .operators.filters import Filters, glob, like, like_pattern
from .plans import dashboard, rag, settings
from .sources import files as file_source
from .sources.catalog import ITEMS_SQL, items, table
from .sources.versions import kept, scratch
from .streaming import ingest
from .streaming.store import Store, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PHRASE, TWO = "the of", "in the"
_ITEMS = f"with items as ({ITEMS_SQL}) "
ITEMS_SQL_AS = f"i as ({ITEMS_SQL})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Time buckets

_EVENTS = "with t as (select event_id as item_id, cast(floor(epoch(ts)) as bigint) as best_time_ts, cast(floor(value) as bigint) as size_bytes from events) "
_ORDERS = "with t as (select o_orderkey as item_id, cast(floor(epoch(o_orderdate)) as bigint) as best_time_ts, cast(floor(o_totalprice) as bigint) as size_bytes from orders) "
_BUCKET = "strftime(to_timestamp(best_time_ts) at time zone 'UTC', '{}')"


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("best_time_ts"), F.floor("value").alias("size_bytes"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("best_time_ts"), F.floor("o_totalprice").alias("size_bytes"))


def _timeline_sql(source: str, fmt: str) -> str:
    return source + f"select {_BUCKET.format(fmt)} as bucket, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_size, min(best_time_ts) as min_ts, max(best_time_ts) as max_ts from t group by 1"


@query(_timeline_sql(_ORDERS, "%Y"))
def timeline_year(spark, d):
    return timeline.buckets(_orders(spark, d), "year")


@query(_timeline_sql(_ORDERS, "%Y-%m"))
def timeline_month(spark, d):
    return timeline.buckets(_orders(spark, d), "month")


@query(_timeline_sql(_EVENTS, "%Y-%m-%d"))
def timeline_day(spark, d):
    return timeline.buckets(_events(spark, d), "day")


@query(_ORDERS + " union all ".join(f"select '{z}' as zoom, {_BUCKET.format(f)} as bucket, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_size from t group by 2" for z, f in (("year", "%Y"), ("month", "%Y-%m"), ("day", "%Y-%m-%d"))))
def timeline_rollup(spark, d):
    return timeline.rollup(_orders(spark, d))


@query(_EVENTS + f"select item_id, best_time_ts from t where {_BUCKET.format('%Y-%m-%d')} = '2024-01-15' order by best_time_ts desc, item_id limit 200")
def timeline_bucket_items(spark, d):
    return timeline.bucket_items(_events(spark, d), "2024-01-15").select("item_id", "best_time_ts")


@query(_ORDERS + f", b as (select {_BUCKET.format('%Y')} as bucket, count(*) as item_count from t group by 1) select bucket, bucket as label, item_count, greatest(4.0::double, 100.0::double * item_count / max(item_count) over ()) as bar from b")
def timeline_bars(spark, d):
    b = timeline.buckets(_orders(spark, d), "year").select("bucket", formatting.bucket_label(F.col("bucket"), "year").alias("label"), "item_count")
    return timeline.with_bar(b)


# Totals


@query(_ITEMS + "select count(*) as total_items, cast(coalesce(sum(size_bytes), 0) as bigint) as total_size from items where is_deleted = 0")
def stats_totals(spark, d):
    return stats.totals(items(spark, d))


@query(_ITEMS + "select file_type_group, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_size from items where is_deleted = 0 group by 1")
def stats_by_type(spark, d):
    return stats.by_type(items(spark, d))


@query(_ITEMS + "select file_type_group, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_size from items where is_deleted = 0 group by 1 order by 2 desc, 1 limit 6")
def stats_top_types(spark, d):
    return stats.by_type(items(spark, d)).orderBy(F.desc("item_count"), "file_type_group").limit(6)


@query(_ITEMS + ", roots as (select distinct root from items union all select 'empty root') select r.root, count(i.item_id) as item_count from roots r left join (select * from items where is_deleted = 0) i on i.root = r.root group by 1")
def files_per_root(spark, d):
    x = items(spark, d)
    roots = x.select("root").distinct().unionByName(spark.createDataFrame([("empty root",)], "root string"))
    return stats.files_per_root(roots, x)


@query(_ITEMS + "select count(*) as item_count, cast(coalesce(sum(size_bytes), 0) as bigint) as total_size from items where item_id % 5 = 0")
def selection_total(spark, d):
    x = items(spark, d)
    return stats.selection_size(x, x.where("item_id % 5 = 0").select("item_id"))


@query("select user_id % 5 as job_id, count(*) as total_count, count(*) filter (event_type = 'purchase') as indexed_count, count(*) filter (event_type = 'view') as skipped_count, count(*) filter (event_type = 'error') as error_count, count(*) filter (event_type not in ('purchase', 'view', 'error')) as pending_count, round(100.0::double * count(*) filter (event_type in ('purchase', 'view', 'error')) / count(*), 1) as percent from events group by 1")
def job_progress(spark, d):
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "indexed").when(kind == "view", "skipped").when(kind == "error", "error").otherwise("pending")
    return stats.job_progress(table(spark, d, "events").select((F.col("user_id") % 5).alias("job_id"), outcome.alias("outcome")))


# Listings and filters


@query(_ITEMS + "select item_id, file_name, size_bytes, modified_ts from items where is_deleted = 0 and file_type_group = 'code' and size_bytes between 500 and 5000 and best_time_ts >= 700000000 order by size_bytes desc, item_id desc limit 100")
def list_filtered(spark, d):
    f = Filters(file_type="code", min_size=500, max_size=5000, since_ts=700000000, until_ts=0)
    return listing.list_items(items(spark, d), f, "size_bytes DESC").select("item_id", "file_name", "size_bytes", "modified_ts")


@query(_ITEMS + "select item_id, file_name, full_path, extension, file_type_group, size_bytes, modified_ts, best_time_ts, case when item_id % 3 <> 1 then substr(text, 1, 40) end as content_preview from items where is_deleted = 0 and file_type_group = 'text' order by modified_ts desc, item_id desc limit 20 offset 5")
def list_with_previews(spark, d):
    content = items(spark, d).where("item_id % 3 <> 1").select("item_id", F.substring("text", 1, 40).alias("content_preview"))
    return listing.list_items(items(spark, d), Filters(file_type="text"), limit=20, offset=5, content=content)


@query(_ITEMS + "select item_id, modified_ts from items where is_deleted = 0 order by modified_ts desc, item_id limit 15")
def recent_items(spark, d):
    return listing.recent_items(items(spark, d)).select("item_id", "modified_ts")


@query(_ITEMS + "select item_id, full_path from items where is_deleted = 0 and full_path ilike '/src1%/en%'")
def folder_filter(spark, d):
    return items(spark, d).where(Filters(folder_path="/src1*/en*").column()).select("item_id", "full_path")


@query(_ITEMS + "select item_id from items where is_deleted = 0 and file_name ilike '%OC_1_.%'")
def like_search(spark, d):
    return items(spark, d).where(F.col("is_deleted") == 0).where(like(F.col("file_name"), like_pattern("OC_1_."))).select("item_id")


@query(_ITEMS + "select item_id from items where is_deleted = 0 and file_name glob 'doc_[1-4]?*[!a-c].?[td]*'")
def glob_search(spark, d):
    return items(spark, d).where("is_deleted = 0").where(glob(F.col("file_name"), "doc_[1-4]?*[^a-c].?[td]*")).select("item_id")


@query(_ITEMS + "select distinct item_id, modified_ts from items where is_deleted = 0 and file_type_group in ('audio', 'video') order by modified_ts desc, item_id limit 200")
def media_union(spark, d):
    return listing.media_items(items(spark, d)).select("item_id", "modified_ts")


_IMAGES = """, meta as (select event_id as item_id, case when event_id % 3 = 0 then 650000000 + event_id * 1000 end as taken_ts, event_type as title, cast(null as varchar) as camera_model,
 case when event_id % 4 = 2 then '{"gps_lat": 1.5, "gps_lon": 2.5}' when event_id % 4 = 1 then '{"gps_lat": 1.5}' else '{}' end as meta_json from events) """


def _meta(spark, d):
    e = F.col("event_id")
    json = F.when(e % 4 == 2, '{"gps_lat": 1.5, "gps_lon": 2.5}').when(e % 4 == 1, '{"gps_lat": 1.5}').otherwise("{}")
    return table(spark, d, "events").select(e.alias("item_id"), F.when(e % 3 == 0, 650000000 + e * 1000).alias("taken_ts"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("camera_model"), json.alias("meta_json"))


@query(_ITEMS + _IMAGES + "select item_id, coalesce(taken_ts, best_time_ts, modified_ts) as sort_time_ts from items left join meta using (item_id) where file_type_group = 'image' and is_deleted = 0 and meta_json like '%\"gps_lat\"%' and meta_json like '%\"gps_lon\"%' and coalesce(taken_ts, best_time_ts, modified_ts) >= 640000000 order by 2 desc, 1 desc limit 100")
def images_with_gps(spark, d):
    return listing.list_images(items(spark, d), _meta(spark, d), filters=Filters(since_ts=640000000), has_gps=1).select("item_id", "sort_time_ts")


_DETAIL = """, c as (select item_id, substr(text, 1, 40) as content_preview from items where item_id % 3 <> 1),
 m as (select event_id as item_id, event_type as title, case when event_id % 5 = 0 then '' when event_id % 5 = 1 then 'Direct' end as camera_model,
  case event_id % 4 when 0 then '{"gps_lat": "1.25", "gps_lon": "-2.5", "model": "Inner"}' when 1 then 'not json' when 2 then '{"date_original": "2001:02:03 04:05:06", "camera_model": "Outer"}' end as meta_json from events where event_id % 2 = 0) """


def _detail(spark, d):
    e = F.col("event_id")
    json = F.when(e % 4 == 0, '{"gps_lat": "1.25", "gps_lon": "-2.5", "model": "Inner"}').when(e % 4 == 1, "not json").when(e % 4 == 2, '{"date_original": "2001:02:03 04:05:06", "camera_model": "Outer"}')
    meta = table(spark, d, "events").where(e % 2 == 0).select(e.alias("item_id"), F.col("event_type").alias("title"), F.when(e % 5 == 0, "").when(e % 5 == 1, "Direct").alias("camera_model"), json.alias("meta_json"))
    return items(spark, d), items(spark, d).where("item_id % 3 <> 1").select("item_id", F.substring("text", 1, 40).alias("content_preview")), meta


@query(_ITEMS + _DETAIL + """select i.item_id, c.content_preview, m.title, try_cast(case when json_valid(meta_json) then meta_json ->> '$.gps_lat' end as double) as gps_lat, try_cast(case when json_valid(meta_json) then meta_json ->> '$.gps_lon' end as double) as gps_lon,
 case when json_valid(meta_json) then meta_json ->> '$.date_original' end as date_original, coalesce(nullif(camera_model, ''), case when json_valid(meta_json) then nullif(meta_json ->> '$.camera_model', '') end, case when json_valid(meta_json) then nullif(meta_json ->> '$.model', '') end) as camera from items i left join c using (item_id) left join m using (item_id)""")
def item_detail(spark, d):
    return listing.item_detail(*_detail(spark, d)).select("item_id", "content_preview", "title", "gps_lat", "gps_lon", "date_original", "camera")


@query(_ITEMS + _IMAGES + "select item_id, title, coalesce(taken_ts, best_time_ts, modified_ts) as sort_time_ts from items left join meta using (item_id) where file_type_group = 'image' and is_deleted = 0 and (coalesce(file_name, '') ilike '%ick%' or coalesce(full_path, '') ilike '%ick%' or coalesce(title, '') ilike '%ick%' or coalesce(camera_model, '') ilike '%ick%' or coalesce(meta_json, '') ilike '%ick%') order by 3 desc, 1 desc limit 100")
def image_keyword(spark, d):
    return listing.list_images(items(spark, d), _meta(spark, d), q="ICK").select("item_id", "title", "sort_time_ts")


@query(_ITEMS + ", t as (select * from items where is_deleted = 0 and best_time_ts is not null) select " + _BUCKET.format("%Y") + " as bucket, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_size, min(best_time_ts) as min_ts, max(best_time_ts) as max_ts from t group by 1")
def timeline_live(spark, d):
    return timeline.buckets(items(spark, d), "year")


@query(_ITEMS + ", t as (select * from items where is_deleted = 0) select item_id, best_time_ts from t where " + _BUCKET.format("%Y") + " = '1995' order by best_time_ts desc, item_id limit 200")
def timeline_live_items(spark, d):
    return timeline.bucket_items(items(spark, d), "1995").select("item_id", "best_time_ts")


@query(_ITEMS + "select file_type_group, string_agg(item_id, ',' order by item_id) as ids from items group by 1")
def grouped_by_type(spark, d):
    return stats.grouped_by_type(items(spark, d)).select("file_type_group", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("select event_id, props ->> '$.k' as k, json_extract_string(props, '$.nothing') as nothing from events")
def json_meta(spark, d):
    m = listing.json_map(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("nothing")).alias("nothing"))


# File names, times and formats


@query(_ITEMS + "select item_id, extension as ext, file_type_group as kind from items")
def classify_ext(spark, d):
    ext = files.suffix(F.col("full_path"))
    return items(spark, d).select("item_id", ext.alias("ext"), files.type_group(ext).alias("kind"))


@query(r"select page_id, regexp_replace(url, '/[^/]*$', '') as parent, regexp_extract(url, '([^/]*)$', 1) as name from pages")
def path_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", files.parent_path(u).alias("parent"), files.file_name(u).alias("name"))


_VALID = "case when created_ts > 631152000 then created_ts end as c, case when modified_ts > 631152000 then modified_ts end as m"


@query(_ITEMS + f", v as (select *, {_VALID}, case when item_id % 7 = 0 then 640000000 + item_id when item_id % 7 = 1 then 5 end as taken from items) select item_id, case when taken > 631152000 then taken else coalesce(least(c, m), modified_ts) end as time, case when taken > 631152000 then 'exif' when c is not null and (m is null or c <= m) then 'ctime' else 'mtime' end as source, case when taken > 631152000 then 0.95::double else 0.7::double end as confidence from v")
def best_time(spark, d):
    i = F.col("item_id")
    taken = F.when(i % 7 == 0, 640000000 + i).when(i % 7 == 1, F.lit(5))
    t, s, c = files.override_time(*files.best_time(F.col("created_ts"), F.col("modified_ts")), taken)
    return items(spark, d).select("item_id", t.alias("time"), s.alias("source"), c.alias("confidence"))


@query("with p as (select page_id, case page_id % 6 when 0 then 'a/node_modules/x.js' when 1 then '.hidden' when 2 then '.notes.md' when 3 then 'b/y.tmp' when 4 then 'env/z.py' else 'ok/dir/file.txt' end as path from pages) select page_id, page_id % 6 <> 5 and page_id % 6 <> 2 as skip from p")
def scan_ignore(spark, d):
    p = F.col("page_id") % 6
    path = F.when(p == 0, "a/node_modules/x.js").when(p == 1, ".hidden").when(p == 2, ".notes.md").when(p == 3, "b/y.tmp").when(p == 4, "env/z.py").otherwise("ok/dir/file.txt")
    return table(spark, d, "pages").select("page_id", files.ignored(path).alias("skip"))


@query(_ITEMS + "select concat('/data', full_path) as full_path, substr(full_path, 2) as relative, concat('/data', parent_path) as parent_path, file_name, extension, file_type_group, size_bytes from items where full_path not like '/src1/en/%'")
def nested_root_exclusion(spark, d):
    """The paths as the file source gives them, below /data and without the root /data/src1/en in it; a sibling whose name begins alike stays."""
    x = items(spark, d).select(F.concat(F.lit("file:/data"), "full_path").alias("path"), F.col("size_bytes").alias("length"), F.timestamp_seconds("modified_ts").alias("modificationTime"), F.lit(b"").alias("content"))
    return file_source.described(x, "file:///data", ["file:///data/src1/en", "/data/src", "/other"]).select("full_path", "relative", "parent_path", "file_name", "extension", "file_type_group", "size_bytes")


_EXIF = "with t as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y:%m:%d %H:%M:%S') when 1 then '2001:13:45 00:00:00' when 2 then 'x' end as v, ts from events) "


@query(_EXIF + "select event_id, case event_id % 4 when 0 then cast(floor(epoch(ts)) as bigint) end as taken, round((event_id % 90 + 1 + (event_id % 60) / 60.0::double + (event_id % 37) / 3600.0::double) * case when event_id % 3 = 0 then -1 else 1 end, 7) as degrees from t")
def exif_values(spark, d):
    e = F.col("event_id")
    v = F.when(e % 4 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(e % 4 == 1, "2001:13:45 00:00:00").when(e % 4 == 2, "x")
    return table(spark, d, "events").select("event_id", files.epoch_of_exif(v).alias("taken"), files.degrees(e % 90 + 1, e % 60, e % 37, F.when(e % 3 == 0, "S").otherwise("N")).alias("degrees"))


@query(_ITEMS + "select item_id, sha1(concat(item_id, ':', size_bytes, ':', modified_ts, ':', 256)) as thumbnail, case extension when '.txt' then 'text/plain' when '.md' then 'text/markdown' when '.html' then 'text/html' when '.pdf' then 'application/pdf' when '.jpg' then 'image/jpeg' when '.png' then 'image/png' when '.mp3' then 'audio/mpeg' when '.mp4' then 'video/mp4' else 'application/octet-stream' end as media, case when file_type_group in ('pdf', 'image', 'audio', 'video', 'office') then file_type_group when file_type_group in ('text', 'code') then 'text' when text <> '' then 'fallback-text' else 'unsupported' end as kind, case when text <> '' then substr(text, 1, 500) end as page, substr(text, 1, 20000) as shown, trim(substr(text, 1, 400), concat(' ', chr(9), chr(10), chr(13))) as preview from items")
def previews(spark, d):
    x = items(spark, d)
    token = files.change_token(F.col("size_bytes"), F.col("modified_ts"))
    return x.select("item_id", file_source.thumbnail_key(F.col("item_id"), token, 256).alias("thumbnail"), files.media_type(F.col("extension")).alias("media"), formatting.preview_kind(F.col("extension"), F.col("text") != "").alias("kind"), file_source.text_page(F.col("text"), 500).alias("page"), formatting.preview_text(F.col("text")).alias("shown"), formatting.preview(F.col("text")).alias("preview"))


@query(_ITEMS + "select item_id, case when best_time_ts = 0 then '—' else strftime(to_timestamp(best_time_ts) at time zone 'UTC', '%Y-%m-%d') end as day, case when best_time_ts = 0 then '—' else strftime(to_timestamp(best_time_ts) at time zone 'UTC', '%Y-%m-%d %H:%M') end as minute from items")
def format_dates(spark, d):
    return items(spark, d).select("item_id", formatting.date(F.col("best_time_ts")).alias("day"), formatting.date_time(F.col("best_time_ts")).alias("minute"))


@query(f"""with g as (select doc_id, concat('[Sheet: ', source, ']', chr(10), lang, ' | ', doc_id, '| ', n_chars, chr(10), chr(10), ' ', chr(10), 'x') as t from documents) select doc_id, cast(len(string_split(t, chr(10))) - 2 as integer) as lines, trim(string_split(string_split(t, chr(10))[2], '|')[3]) as third from g""")
def preview_grid(spark, d):
    t = F.concat(F.lit("[Sheet: "), "source", F.lit("]\n"), "lang", F.lit(" | "), F.col("doc_id").cast("string"), F.lit("| "), F.col("n_chars").cast("string"), F.lit("\n\n \nx"))
    x = table(spark, d, "documents").select("doc_id", formatting.grid(t).alias("g"))
    return x.select("doc_id", F.size("g").alias("lines"), F.col("g")[1][2].alias("third"))


@query("select doc_id, case when n_chars is null or n_chars = 0 then '0 B' when n_chars < 1024 then printf('%d B', n_chars) when n_chars < 1048576 then printf('%.1f KB', floor(n_chars / 1024.0::double * 10 + 0.5) / 10) else printf('%.1f MB', floor(n_chars / 1048576.0::double * 10 + 0.5) / 10) end as size from documents")
def format_size(spark, d):
    return table(spark, d, "documents").select("doc_id", formatting.size(F.col("n_chars")).alias("size"))


@query("with x as (select event_id, cast(event_id * 37 % 20000 as bigint) as s from events) select event_id, case when s = 0 then 'running' when s < 60 then concat(s, 's') when s < 3600 then concat(s // 60, 'm ', s % 60, 's') else concat(s // 3600, 'h ', s % 3600 // 60, 'm') end as took, case when s < 3600 then concat(s // 60, ':', lpad(cast(s % 60 as varchar), 2, '0')) else concat(s // 3600, ':', lpad(cast(s % 3600 // 60 as varchar), 2, '0'), ':', lpad(cast(s % 60 as varchar), 2, '0')) end as clock from x")
def format_duration(spark, d):
    s = F.col("event_id") * 37 % 20000
    return table(spark, d, "events").select("event_id", formatting.duration(F.lit(0), s).alias("took"), formatting.clock(s).alias("clock"))


@query("select doc_id, case when length(text) > 60 then concat(substr(text, 1, 60), '…') else text end as short, least(100.0::double, round(n_chars * 100.0::double / 4000)) as part from documents")
def format_text(spark, d):
    return table(spark, d, "documents").select("doc_id", formatting.truncated(F.col("text"), 60).alias("short"), formatting.percent(F.col("n_chars"), F.lit(4000)).alias("part"))


@query("with s as (select event_id, case event_id % 6 when 0 then ' Yes ' when 1 then 'off' when 2 then '12' when 3 then 'x1' when 4 then '' end as v from events) select event_id, coalesce(lower(trim(v)) in ('1', 'true', 'yes', 'on'), false) as flag, coalesce(try_cast(trim(v) as bigint), 7) as number from s")
def settings_coerce(spark, d):
    e = F.col("event_id") % 6
    v = F.when(e == 0, " Yes ").when(e == 1, "off").when(e == 2, "12").when(e == 3, "x1").when(e == 4, "")
    return table(spark, d, "events").select("event_id", settings.as_bool(v).alias("flag"), settings.as_number(v, "bigint", 7).alias("number"))


# Ranked search


def _bm25_sql(words: list[str]) -> str:
    m = len(words)
    hit = " and ".join(f"toks[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"""with t as (select doc_id, regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+') as toks from documents),
    c as (select doc_id, cast(len(toks) as double) as dl, cast(len(list_filter(range(1, greatest(len(toks) - {m - 2}, 1)), lambda i: {hit})) as integer) as tf from t),
    s as (select cast(count(*) as double) as n, cast(count(*) filter (tf > 0) as double) as df, avg(dl) as avgdl from c),
    r as (select doc_id, tf, -(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) as score from c, s where tf > 0)
    """


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("doc_id", "tf", F.round("score", 9).alias("score"))


@query(_bm25_sql(["the", "and"]) + "select doc_id, tf, round(score, 9) as score from r")
def fts_bm25(spark, d):
    return _rounded(search.bm25(table(spark, d, "documents"), "The and", ["text"], "doc_id"))


@query(_bm25_sql(["the", "of"]) + "select doc_id, tf, round(score, 9) as score from r order by r.score, doc_id limit 20")
def fts_topk(spark, d):
    return _rounded(search.bm25(table(spark, d, "documents"), "the of", ["text"], "doc_id").orderBy("score", "doc_id").limit(20))


@query(_ITEMS + "select item_id from items where is_deleted = 0 and (file_name ilike '%oc_11%' or full_path ilike '%oc_11%' or parent_path ilike '%oc_11%' or extension ilike '%oc_11%' or text ilike '%oc_11%') order by modified_ts desc, item_id limit 50")
def fts_fallback(spark, d):
    return search.search(items(spark, d), search.SearchRequest(q="oc_11")).select("item_id")


@query(_ITEMS + "select item_id from items where is_deleted = 0 and file_type_group = 'text' and (file_name glob 'doc_1*' or full_path glob 'doc_1*' or parent_path glob 'doc_1*' or extension glob 'doc_1*') order by modified_ts desc, item_id limit 50")
def search_wildcard(spark, d):
    return search.search(items(spark, d), search.SearchRequest(q="doc_1*", filters=Filters(file_type="text"), search_content=False)).select("item_id")


@query(_bm25_sql(["in", "the"]).replace("from documents)", "from documents)", 1) + ", " + ITEMS_SQL_AS + " select r.doc_id as item_id, round(r.score, 9) as score from r join i on i.item_id = r.doc_id where i.is_deleted = 0 and i.file_type_group = 'text' order by r.score, r.doc_id limit 50")
def search_ranked(spark, d):
    x = search.search(items(spark, d), search.SearchRequest(q="In THE", filters=Filters(file_type="text")), columns=["text"])
    return x.select("item_id", F.round("score", 9).alias("score"))


@query(_bm25_sql(["in", "the"]) + ", " + ITEMS_SQL_AS + " select r.doc_id as item_id, i.size_bytes from r join i on i.item_id = r.doc_id where i.is_deleted = 0 order by i.size_bytes desc, r.doc_id limit 30 offset 10")
def search_ranked_by_size(spark, d):
    return search.search(items(spark, d), search.SearchRequest(q="in the", order_by="size_bytes", limit=30, offset=10), columns=["text"]).select("item_id", "size_bytes")


def _index(spark, d, docs):
    folder = index.scratch(spark)
    return index.TextIndex(spark, folder, ["text"], "doc_id").build(docs)


@query(_bm25_sql(["the", "and"]) + "select doc_id, tf, round(score, 9) as score from r")
def index_bm25(spark, d):
    """As ``fts_bm25``, from a persisted index."""
    return _rounded(_index(spark, d, table(spark, d, "documents")).bm25("The and"))


@query(_bm25_sql(["the", "of"]).replace("from documents)", "from (select doc_id, case when doc_id % 7 = 0 then concat(text, ' the of') else text end as text from documents where doc_id % 5 <> 0))", 1) + "select doc_id, tf, round(score, 9) as score from r")
def index_update(spark, d):
    """The index after some texts have changed and others are gone."""
    docs = table(spark, d, "documents")
    x = _index(spark, d, docs)
    x.update(docs.where("doc_id % 7 = 0 and doc_id % 5 <> 0").withColumn("text", F.concat("text", F.lit(" the of"))), docs.where("doc_id % 5 = 0"))
    return _rounded(x.bm25("the of"))


#: Documents after three updates: some texts changed, some gone, and some of those back again.
_CHANGED = "changed as (select doc_id, case when doc_id % 11 = 3 then 'in the in the' when doc_id % 7 = 1 then concat('in the ', lang) when doc_id % 7 = 0 then concat(text, ' in the') else text end as text, lang, source, n_chars from documents where doc_id % 5 <> 0 or doc_id % 11 = 3)"


def _changed(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 11 == 3, "in the in the").when(i % 7 == 1, F.concat(F.lit("in the "), "lang")).when(i % 7 == 0, F.concat("text", F.lit(" in the"))).otherwise(F.col("text"))
    return docs.where((i % 5 != 0) | (i % 11 == 3)).withColumn("text", text)


def _updated(x: index.TextIndex, docs: DataFrame) -> index.TextIndex:
    """An index of ``docs`` (item_id, text, lang) brought to what ``_changed`` gives by three updates."""
    x.update(docs.where("item_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" in the"))))
    x.update(docs.where("item_id % 7 = 1").withColumn("text", F.concat(F.lit("in the "), "lang")), docs.where("item_id % 5 = 0 and item_id % 7 <> 1"))
    # items that are changed and gone in one update stay; those go with the next
    return x.update(docs.where("item_id % 11 = 3").withColumn("text", F.lit("in the in the")), docs.where("item_id % 5 = 0 and item_id % 7 = 1 and item_id % 11 <> 3"))


@query("with " + _CHANGED + ", " + _bm25_sql(["in", "the"]).replace("with t as", "t as", 1).replace("from documents)", "from changed)", 1) + ", i as (" + ITEMS_SQL.replace("from documents", "from changed") + ") select r.doc_id as item_id, round(r.score, 9) as score from r join i on i.item_id = r.doc_id where i.is_deleted = 0 and i.file_type_group = 'text' order by r.score, r.doc_id limit 50")
def search_indexed(spark, d):
    """As ``search_ranked``, through an index that has seen three updates and a merge."""
    docs = table(spark, d, "documents")
    mine = docs.withColumnRenamed("doc_id", "item_id")
    x = _updated(index.TextIndex(spark, index.scratch(spark), ["text"]).build(mine), mine).merge()
    after = spark.sql(ITEMS_SQL.replace("from documents", "from {changed}"), changed=_changed(docs))
    found = search.search(after, search.SearchRequest(q="In THE", filters=Filters(file_type="text")), index=x)
    return found.select("item_id", F.round("score", 9).alias("score"))


def _grams(spark, x: DataFrame, columns: list[str]):
    return index.GramIndex(spark, index.scratch(spark), columns).build(x)


@query(_ITEMS + "select item_id from items where is_deleted = 0 and (file_name glob 'doc_[1-4]?*[!a-c].?[td]*' or full_path glob 'doc_[1-4]?*[!a-c].?[td]*' or parent_path glob 'doc_[1-4]?*[!a-c].?[td]*' or extension glob 'doc_[1-4]?*[!a-c].?[td]*')")
def glob_indexed(spark, d):
    """GLOB over names by runs of three characters."""
    x = items(spark, d)
    grams = _grams(spark, x, ["file_name", "full_path", "parent_path", "extension"])
    return search.glob_search(x.where("is_deleted = 0"), "doc_[1-4]?*[^a-c].?[td]*", False, grams).select("item_id")


@query(_ITEMS + "select item_id from items where is_deleted = 0 and (file_name ilike '%s of th%' or full_path ilike '%s of th%' or parent_path ilike '%s of th%' or extension ilike '%s of th%' or text ilike '%s of th%')")
def like_indexed(spark, d):
    """Substrings of names and texts by runs of three characters."""
    x = items(spark, d)
    grams = _grams(spark, x, ["file_name", "full_path", "parent_path", "extension", "text"])
    return search.like_search(x.where("is_deleted = 0"), "S OF TH", True, grams).select("item_id")


@query(f"with t as (select doc_id, regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+') as toks from documents) select doc_id, cast(len(toks) as integer) as n, list_aggregate(toks, 'string_agg', ' ') as folded from t where len(toks) > 0")
def search_tokens(spark, d):
    x = once(table(spark, d, "documents"), [F.col("doc_id")], toks=text_tokens(F.col("text")))
    return x.where("size(toks) > 0").select("doc_id", F.size("toks").alias("n"), F.array_join("toks", " ").alias("folded"))


@query(_ITEMS + "select item_id from items where is_deleted = 0 order by modified_ts desc, item_id limit 50")
def search_blank(spark, d):
    return search.search(items(spark, d), search.SearchRequest(q="  ")).select("item_id")


@query(_bm25_sql(["in", "the"]) + f""", w as (select doc_id, string_split(regexp_replace(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '[\\s\\x0B]+', ' ', 'g'), ' ') as words from documents join r using (doc_id)),
    k as (select doc_id, words, flatten(list_transform(words, lambda w, i: list_transform(regexp_extract_all(translate(lower(w), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+'), lambda t: {{'t': t, 'i': i}}))) as toks from w),
    p as (select doc_id, words, list_transform(list_filter(range(1, len(toks)), lambda i: toks[i].t = 'in' and toks[i + 1].t = 'the'), lambda i: {{'a': toks[i].i, 'b': toks[i + 1].i}}) as places from k),
    q as (select *, greatest(1, places[1].a - 4) as start from p),
    v as (select *, list_transform(words[start : start + 19], lambda w, i: concat(case when len(list_filter(places, lambda x: x.a = i + start - 1)) > 0 then '<em>' else '' end, w, case when len(list_filter(places, lambda x: x.b = i + start - 1)) > 0 then '</em>' else '' end)) as shown from q)
    select doc_id, concat(case when start > 1 then '...' else '' end, array_to_string(shown, ' '), case when len(words) > start + 19 then '...' else '' end) as snippet from v""")
def snippet(spark, d):
    x = search.bm25(table(spark, d, "documents"), TWO, ["text"], "doc_id").join(table(spark, d, "documents"), "doc_id")
    return search.snippets(x, "text", TWO.split()).select("doc_id", "snippet")


@query(f"""with w as (select doc_id, string_split(regexp_replace(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '[\\s\\x0B]+', ' ', 'g'), ' ') as words from documents where text is not null),
    u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from w),
    k as (select doc_id, i, regexp_extract_all(translate(lower(word), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+') as toks from u),
    t as (select doc_id, i, unnest(toks) as tok, generate_subscripts(toks, 1) as j from k),
    x as (select doc_id, tok, i as o, lead(tok) over z as next, lead(i) over z as c from t window z as (partition by doc_id order by i, j)),
    p as (select doc_id, o, c from x where tok = 'in' and next = 'the'),
    s as (select distinct doc_id, greatest(0, c - 19) as start from p),
    n as (select s.doc_id, start, count(*) as matches from s join p on p.doc_id = s.doc_id and p.o >= start and p.c <= start + 19 group by 1, 2),
    b as (select *, row_number() over (partition by doc_id order by matches desc, start) as rank from n)
    select d.doc_id, cast(coalesce(b.start, 0) as integer) as start, coalesce(b.matches, 0) as matches from documents d left join b on b.doc_id = d.doc_id and b.rank = 1""")
def best_window(spark, d):
    return search.best_windows(table(spark, d, "documents"), "text", TWO.split(), "doc_id")


# Duplicates


def _hashed(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes"))


@query("select sha256(text) as group_key, count(*) as item_count, cast(sum(n_chars) as bigint) as total_size, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_dups(spark, d):
    return dedup.exact_groups(_hashed(spark, d)).select("group_key", "item_count", "total_size", F.col("members")[0].alias("first_id"))


@query("with g as (select sha256(text) as k from documents group by 1 having count(*) > 1) select sha256(text) as group_key, doc_id as item_id from documents where sha256(text) in (select k from g)")
def dup_members(spark, d):
    return dedup.exact_members(_hashed(spark, d))


_DUP = "with g as (select sha256(text) as k, sum(n_chars) as total, max(n_chars) as most from documents group by 1 having count(*) > 1) "


@query(_DUP + "select count(*) as groups, cast(coalesce(sum(total), 0) as bigint) as wasted_bytes, cast(coalesce(sum(total - most), 0) as bigint) as reclaimable from g")
def dup_stats(spark, d):
    x = _hashed(spark, d)
    return dedup.dup_stats(dedup.group_sizes(dedup.exact_members(x), x))


@query(_DUP + "select 'warning' as type, printf('%d duplicate groups found — %.1f GB reclaimable', count(*), sum(total) / 1073741824.0) as text from g having count(*) > 0 union all select 'error', printf('%d files failed to index', count(distinct user_id)) from events where event_type = 'error' having count(*) > 0")
def dashboard_insights(spark, d):
    failed = stats.failed_files(table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("full_path")))
    return stats.insights(dup_stats(spark, d), failed)


_SIMHASH = r"""with tok as (select doc_id, length(text) >= 20 as ok, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
 sh as (select doc_id, unnest(case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from tok where ok),
 h as (select doc_id, ('0x' || substr(md5(s), 17, 16))::ubigint as v from sh),
 b as (select doc_id, i, sum(case when (v >> i) & 1 = 1 then 1 else -1 end) as vote from h, range(64) r(i) group by 1, 2),
 o as (select doc_id, bit_or(case when vote > 0 then 1::ubigint << i::ubigint else 0::ubigint end) as v from b group by 1),
 sim as (select t.doc_id, case when ok then coalesce(o.v, 0::ubigint) end as v from tok t left join o using (doc_id)) """


def _simhash(spark, d):
    return simhash(table(spark, d, "documents"), "doc_id", "text")


@query(_SIMHASH + "select doc_id, printf('%016x', v) as simhash64 from sim")
def simhash_documents(spark, d):
    return _simhash(spark, d)


@query(_SIMHASH + "select a.doc_id as a, b.doc_id as b, 1 - bit_count(xor(a.v, b.v)) / 64.0::double as similarity from sim a join sim b on a.doc_id < b.doc_id where bit_count(xor(a.v, b.v)) <= 6")
def near_dup_pairs(spark, d):
    h = _simhash(spark, d).where("simhash64 is not null").select(F.col("doc_id").alias("id"), hash_bits(F.col("simhash64")).alias("h"))
    return dedup.all_near_pairs(kept(h, "hashes"))


@query("with recursive " + _SIMHASH.removeprefix("with ") + """, n as (select doc_id, v, row_number() over (order by doc_id) as k from sim where v is not null),
 step as (select 0::bigint as k, null::bigint as id, null::bigint as seed, []::struct(s bigint, v ubigint)[] as seeds
   union all
   select k + 1, id, seed, case when seed = id then list_append(seeds, {'s': id, 'v': v}) else seeds end from (
     select p.k, n.doc_id as id, n.v, coalesce(list_filter(p.seeds, lambda x: bit_count(xor(x.v, n.v)) <= 6)[1].s, n.doc_id) as seed, p.seeds from step p join n on n.k = p.k + 1)),
 m as (select id, seed from step where id is not null), big as (select seed from m group by 1 having count(*) > 1)
 select concat('simhash_', seed) as group_key, m.id as item_id, 1 - bit_count(xor(a.v, b.v)) / 64.0::double as similarity from m join big using (seed) join sim a on a.doc_id = m.id join sim b on b.doc_id = m.seed""")
def near_dup_groups(spark, d):
    h = _simhash(spark, d).where("simhash64 is not null").select(F.col("doc_id").alias("item_id"), hash_bits(F.col("simhash64")).alias("h"))
    return dedup.near_groups(h)


@query("with v as (select vec_id, list_reduce(list_transform(range(1, 64), lambda i: case when embedding[i] > 0 then 1::bigint << (i - 1) else 0::bigint end), lambda x, y: x | y) as h from embeddings) select a.vec_id, 1 - bit_count(xor(a.h, b.h)) / 64.0::double as similarity from v a join v b on b.vec_id = a.vec_id + 1")
def hamming(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("bigint"), lambda a, i: F.when(F.get("embedding", i) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(a)).alias("h"))
    return v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", hamming_similarity(F.col("a.h"), F.col("b.h")).alias("similarity"))


_PHASH = """with px as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as p from embeddings),
 f as (select vec_id, u * 8 + w as k, sum(v * cos(pi() / 8 * (p // 8 + 0.5) * u) * cos(pi() / 8 * (p % 8 + 0.5) * w)) as f from px, range(8) a(u), range(8) b(w) where u * 8 + w > 0 group by all),
 means as (select *, avg(f) over (partition by vec_id) as mean from f),
 hashed as (select vec_id, printf('%016x', cast(sum(case when f > mean then 1::ubigint << (63 - k)::ubigint else 0::ubigint end) as ubigint)) as phash from means group by 1) """


@query(_PHASH + "select vec_id, phash from hashed")
def phash_from_matrix(spark, d):
    return table(spark, d, "embeddings").select("vec_id", phash_matrix(F.col("embedding").cast("array<double>")).alias("phash"))


def _images(spark, d):
    """Each matrix twice as images, the second with one bit of its hash changed, some deleted."""
    x = phash_from_matrix(spark, d)
    last = F.substring("phash", 16, 1)
    other = F.concat(F.substring("phash", 1, 15), F.lower(F.hex(F.conv(last, 16, 10).cast("int").bitwiseXOR(1))))
    both = x.select(F.col("vec_id").alias("item_id"), "phash").unionByName(x.select((F.col("vec_id") + 1_000_000).alias("item_id"), other.alias("phash")))
    return both.withColumns({"file_type_group": F.lit("image"), "is_deleted": (F.col("item_id") % 9 == 0).cast("int")})


@query(_PHASH + """, n as (select vec_id as item_id, ('0x' || phash)::ubigint as v from hashed union all select vec_id + 1000000, xor(('0x' || phash)::ubigint, 1::ubigint) from hashed),
 live as (select * from n where item_id % 9 <> 0), near as (select a.item_id as a, b.item_id as b, 1 - bit_count(xor(a.v, b.v)) / 64.0::double as similarity from live a join live b on a.item_id < b.item_id and bit_count(xor(a.v, b.v)) <= 6)
 select a, b, similarity from near""")
def near_images(spark, d):
    x = _images(spark, d).where("is_deleted = 0").select(F.col("item_id").alias("id"), hash_bits(F.col("phash")).alias("h"))
    return dedup.all_near_pairs(kept(x, "hashes"))


@query("""with recursive """ + _PHASH.removeprefix("with ") + """, n0 as (select vec_id as item_id, ('0x' || phash)::ubigint as v from hashed union all select vec_id + 1000000, xor(('0x' || phash)::ubigint, 1::ubigint) from hashed),
 n as (select item_id, v, row_number() over (order by item_id) as k from n0 where item_id % 9 <> 0),
 step as (select 0::bigint as k, null::bigint as id, null::bigint as seed, []::struct(s bigint, v ubigint)[] as seeds
   union all
   select k + 1, id, seed, case when seed = id then list_append(seeds, {'s': id, 'v': v}) else seeds end from (
     select p.k, n.item_id as id, n.v, coalesce(list_filter(p.seeds, lambda x: bit_count(xor(x.v, n.v)) <= 6)[1].s, n.item_id) as seed, p.seeds from step p join n on n.k = p.k + 1)),
 m as (select id, seed from step where id is not null), big as (select seed from m group by 1 having count(*) > 1)
 select concat('phash_', seed) as group_key, id as item_id from m join big using (seed)""")
def near_image_groups(spark, d):
    return dedup.image_groups(_images(spark, d)).select("group_key", "item_id")


_AFTER = _SIMHASH + ", n0 as (select doc_id, case when doc_id % 13 = 2 then xor(v, 1::ubigint) else v end as v from sim where v is not null and doc_id % 9 <> 0)"


@query("with recursive " + _AFTER.removeprefix("with ") + """, n as (select doc_id, v, row_number() over (order by doc_id) as k from n0),
 step as (select 0::bigint as k, null::bigint as id, null::bigint as seed, []::struct(s bigint, v ubigint)[] as seeds
   union all
   select k + 1, id, seed, case when seed = id then list_append(seeds, {'s': id, 'v': v}) else seeds end from (
     select p.k, n.doc_id as id, n.v, coalesce(list_filter(p.seeds, lambda x: bit_count(xor(x.v, n.v)) <= 6)[1].s, n.doc_id) as seed, p.seeds from step p join n on n.k = p.k + 1)),
 m as (select id, seed from step where id is not null), big as (select seed from m group by 1 having count(*) > 1)
 select concat('simhash_', seed) as group_key, m.id as item_id, 1 - bit_count(xor(a.v, b.v)) / 64.0::double as similarity from m join big using (seed) join n a on a.doc_id = m.id join n b on b.doc_id = m.seed""")
def near_dup_updated(spark, d):
    """As ``near_dup_groups``, of an index that has seen documents come, change and go."""
    h = _simhash(spark, d).where("simhash64 is not null").select(F.col("doc_id").alias("item_id"), hash_bits(F.col("simhash64")).alias("h"))
    h = kept(h, "hashes")
    x = near_index.new_index(spark, h.where("item_id % 4 <> 1"))
    other = h.withColumn("h", F.when(F.col("item_id") % 13 == 2, F.col("h").bitwiseXOR(1)).otherwise(F.col("h")))
    x.update(other.where("item_id % 9 <> 0 and (item_id % 4 = 1 or item_id % 13 = 2)"), h.where("item_id % 9 = 0"))
    return x.groups()


_GROUPS = _ITEMS + ", g as (select sha256(text) as group_key, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_size, min(item_id) as primary_id, list_sort(list(item_id)) as members from items group by 1 having count(*) > 1) "


def _exact(spark, d):
    x = items(spark, d).withColumn("sha256", F.sha2("text", 256))
    return dedup.exact_members(x).withColumn("similarity", F.lit(1.0)), x


@query(_GROUPS + "select group_key, item_count, total_size, primary_id, array_to_string(members, ',') as members from g order by total_size desc, group_key limit 50 offset 5")
def duplicate_listing(spark, d):
    x = dedup.listing(*_exact(spark, d), limit=50, offset=5)
    return x.select("group_key", "item_count", "total_size", "primary_id", F.array_join(F.transform("members", lambda m: m["item_id"].cast("string")), ",").alias("members"))


@query(_GROUPS + ", m as (select group_key, unnest(members) as item_id from g), p as (select *, row_number() over (partition by group_key order by item_id) as rank from m) select g.group_key, g.item_count, coalesce(string_agg(p.item_id, ',' order by p.item_id), '') as members from g left join p on p.group_key = g.group_key and p.rank between 2 and 4 group by 1, 2")
def duplicate_pages(spark, d):
    """The second page of three members, after a first of one, of each group."""
    x = dedup.listing(*_exact(spark, d), page=3, start=1)
    return x.select("group_key", "item_count", F.array_join(F.transform("members", lambda m: m["item_id"].cast("string")), ",").alias("members"))


@query(_ITEMS + "select file_type_group, rank, item_id from (select file_type_group, cast(row_number() over (partition by file_type_group order by item_id) as integer) as rank, item_id from items) where rank between 4 and 13")
def grouped_pages(spark, d):
    return stats.grouped_page(items(spark, d), 10, 3)


@query(_GROUPS + "select group_key, item_count, total_size from g order by item_count desc, group_key limit 20")
def similar_listing(spark, d):
    return dedup.listing(*_exact(spark, d), similar=True, limit=20).select("group_key", "item_count", "total_size")


@query(_GROUPS + ", m as (select group_key, unnest(members) as item_id from g), o as (select 'exact' as group_type, group_key, item_id from m where item_id % 3 <> 0 union all select 'exact', concat('gone_', item_id), item_id from m where item_id % 10 = 0) select * from o where group_key not in (select group_key from m) union all select 'exact', group_key, item_id from m")
def groups_replaced(spark, d):
    members, _ = _exact(spark, d)
    new = dedup.typed_groups({"exact": members})
    old = new.where("item_id % 3 <> 0").unionByName(new.where("item_id % 10 = 0").withColumn("group_key", F.concat(F.lit("gone_"), F.col("item_id").cast("string"))))
    return dedup.replaced(old, new).select("group_type", "group_key", "item_id")


@query(_GROUPS + ", m as (select group_key, unnest(members) as item_id from g) select group_key, item_id, case when item_id = (select min(item_id) from m) then 'keep' else 'pending' end as review_status from m where group_key = (select group_key from m order by item_id limit 1)")
def review_status(spark, d):
    members, x = _exact(spark, d)
    first = members.orderBy("item_id").limit(1).select("group_key", "item_id", F.lit("keep").alias("review_status"))
    one = dedup.listing(members.join(F.broadcast(first.select("group_key")), "group_key"), x, first).select("group_key", F.explode("members").alias("m"))
    return one.select("group_key", "m.item_id", "m.review_status")


@query(_GROUPS + "select group_key, 1.0::double as similarity from g where list_contains(members, (select min(primary_id) from g))")
def item_groups(spark, d):
    members, _ = _exact(spark, d)
    least = members.agg(F.min("item_id").alias("item_id"))
    return members.join(F.broadcast(least), "item_id").select("group_key", "similarity")


# Folders

_TREE = """with recursive f as (select r_regionkey + 1 as vf_id, cast(null as integer) as parent_vf_id, r_name as name from region union all select n_nationkey + 100, n_regionkey + 1, n_name from nation),
 t as (select vf_id, cast(0 as bigint) as depth, name as path from f where parent_vf_id is null union all select f.vf_id, t.depth + 1, t.path || '/' || f.name from t join f on f.parent_vf_id = t.vf_id) """


def _folders(spark, d):
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("vf_id"), F.lit(None).cast("int").alias("parent_vf_id"), F.col("r_name").alias("name"))
    return r.unionByName(table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("vf_id"), (F.col("n_regionkey") + 1).alias("parent_vf_id"), F.col("n_name").alias("name")))


def _members(spark, d):
    return table(spark, d, "customer").select((F.col("c_nationkey") + 100).alias("vf_id"), F.col("c_custkey").alias("item_id"), F.lit(0).alias("added_ts"))


@query(_TREE + "select vf_id, depth, path from t")
def folder_tree(spark, d):
    return folders.tree(_folders(spark, d))


@query(_TREE + "select f.vf_id, f.name, count(c_custkey) as item_count from f left join customer on c_nationkey + 100 = f.vf_id group by 1, 2")
def folder_counts(spark, d):
    return folders.counts(_folders(spark, d), _members(spark, d)).select("vf_id", "name", "item_count")


@query("select c_custkey as item_id from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2")
def subtree_items(spark, d):
    below = folders.subtree(_folders(spark, d), 3)
    return _members(spark, d).join(F.broadcast(below), "vf_id", "left_semi").select("item_id")


@query(_TREE.replace("t as (select vf_id, cast(0 as bigint) as depth, name as path", "t as (select vf_id, [vf_id::bigint] as ids").replace("select f.vf_id, t.depth + 1, t.path || '/' || f.name", "select f.vf_id, list_append(t.ids, f.vf_id::bigint)") + ", n as (select vf_id, ids, row_number() over (order by ids) as first from t) select n.vf_id, n.first, n.first + count(*) - 1 as last, cast(len(n.ids) - 1 as integer) as depth from n join t on list_contains(t.ids, n.vf_id) group by n.vf_id, n.first, n.ids")
def folder_ranges(spark, d):
    return folders.numbered(_folders(spark, d)).select("vf_id", "first", "last", "depth")


@query("select c_custkey as item_id from customer join nation on c_nationkey = n_nationkey where n_regionkey in (2, 4)")
def subtree_by_range(spark, d):
    """Members below a folder after another has been moved into it."""
    moved = folders.update(_folders(spark, d), 5, parent=3)
    below = folders.subtree_by_range(folders.numbered(moved), 3)
    return _members(spark, d).join(F.broadcast(below), "vf_id", "left_semi").select("item_id")


@query("select n_nationkey + 100 as vf_id, n_name as name from nation where n_regionkey <> 2 union all select r_regionkey + 1, r_name from region where r_regionkey <> 2")
def folder_delete(spark, d):
    return folders.delete(_folders(spark, d), _members(spark, d), 3)[0].select("vf_id", "name")


_FOLDERS = "with f as (select r_regionkey + 1 as vf_id, cast(null as integer) as parent_vf_id, r_name as name from region union all select n_nationkey + 100, n_regionkey + 1, n_name from nation), m as (select c_nationkey + 100 as vf_id, c_custkey as item_id, 0 as added_ts from customer) "


@query(_FOLDERS + "select vf_id, case when vf_id = 103 then null when vf_id = 2 then 3 else parent_vf_id end as parent_vf_id, case when vf_id = 104 then 'new name' else name end as name from f")
def folder_update(spark, d):
    f = folders.update(folders.update(_folders(spark, d), 104, name="new name"), 103, parent=None)
    try:
        folders.update(f, 3, parent=103 - 1)
        folders.update(f, 2, parent=2)
        raise AssertionError("a folder was moved below itself")
    except ValueError:
        return folders.update(f, 2, parent=3)


@query(_FOLDERS + "select vf_id, parent_vf_id, name from f union all select 500, 3, 'made'")
def folder_create(spark, d):
    return folders.create(_folders(spark, d), 500, "made", 3)


@query(_FOLDERS + "select vf_id, item_id, added_ts from m where not (vf_id = 105 and item_id = (select min(item_id) from m where vf_id = 105)) union all select distinct 1, item_id, 7 from m where item_id % 10 = 0")
def folder_members(spark, d):
    m = _members(spark, d)
    new = m.where("item_id % 10 = 0").select(F.lit(1).alias("vf_id"), "item_id", F.lit(7).alias("added_ts"))
    out = folders.add(folders.add(m, new.unionByName(new)), m.withColumn("added_ts", F.lit(9)))  # those there already keep their time
    least = m.where("vf_id = 105").groupBy("vf_id").agg(F.min("item_id").alias("item_id"))
    return out.join(F.broadcast(least), ["vf_id", "item_id"], "left_anti")


@query(_ITEMS + "select item_id, file_name, item_id % 4 as added_ts from items where is_deleted = 0 and item_id % 6 = 1 order by added_ts desc, item_id")
def folder_items(spark, d):
    x = items(spark, d)
    m = x.select((F.col("item_id") % 6).cast("int").alias("vf_id"), "item_id", (F.col("item_id") % 4).alias("added_ts"))
    return folders.items_in(m, x, 1).select("item_id", "file_name", "added_ts")


@query(_FOLDERS + "select f.vf_id, f.name from f join m using (vf_id) where m.item_id = 17 union all select vf_id, name from f where vf_id = 2")
def folders_of_item(spark, d):
    m = _members(spark, d).unionByName(spark.createDataFrame([(2, 17, 0)], "vf_id int, item_id bigint, added_ts int"))
    return folders.folders_of(m, _folders(spark, d), 17).select("vf_id", "name")


# Ingestion

_SPLIT = _ITEMS + """, o as (select full_path, size_bytes, created_ts, modified_ts from items where item_id % 3 <> 0), n as (select full_path, size_bytes + item_id % 2 as size_bytes, created_ts + 1 as created_ts, modified_ts from items where item_id % 5 <> 0) """


def _old(spark, d):
    return items(spark, d).where("item_id % 3 <> 0").select("full_path", "size_bytes", "created_ts", "modified_ts")


def _new(spark, d):
    return items(spark, d).where("item_id % 5 <> 0").select("full_path", (F.col("size_bytes") + F.col("item_id") % 2).alias("size_bytes"), (F.col("created_ts") + 1).alias("created_ts"), "modified_ts")


@query(_SPLIT + "select n.full_path from n where not exists (select 1 from o where o.full_path = n.full_path and o.size_bytes = n.size_bytes and o.modified_ts = n.modified_ts)")
def change_anti_join(spark, d):
    token = files.change_token(F.col("size_bytes"), F.col("modified_ts"))
    return ingest.changed(_new(spark, d).withColumn("change_token", token), _old(spark, d).withColumn("change_token", token)).select("full_path")


@query(_SPLIT + "select coalesce(o.full_path, n.full_path) as full_path, coalesce(n.size_bytes, o.size_bytes) as size_bytes, coalesce(o.created_ts, n.created_ts) as created_ts, coalesce(n.modified_ts, o.modified_ts) as modified_ts from o full join n on o.full_path = n.full_path")
def upsert_merge(spark, d):
    return ingest.upsert(_old(spark, d), _new(spark, d))


@query(SQL["upsert_merge"])
def upsert_log(spark, d):
    """As ``upsert_merge``, through the log: the new rows in two batches, each applied twice, the first compacted."""
    store = Store(spark, scratch(spark, "store"), buckets=8, ratio=0.6)
    store.put(_old(spark, d), "old", 0)
    for n, part in enumerate((F.col("size_bytes") % 2 == 0, F.col("size_bytes") % 2 != 0)):
        for _ in range(2):
            store.put(_new(spark, d).where(part), "new", n)
        if not n:
            store.compact()
    return store.current()


_LEDGER = "with e as (select user_id, event_id, event_type, event_id % 3 as batch from events), l as (select *, row_number() over (partition by user_id, batch order by event_id desc) as r from e), "


@query(_LEDGER + "now as (select concat('/u', user_id) as full_path, arg_max(event_id, batch) as size, arg_min(event_id, batch) as created_ts from l where r = 1 group by 1), errors as (select batch, count(*) as n, count(*) filter (event_type = 'error') as bad from l where r = 1 group by 1) select 'item' as kind, full_path as key, size as a, created_ts as b from now union all select 'job', cast(batch as varchar), n - bad, bad from errors union all select 'progress', 'stream', sum(n - bad)::bigint, sum(bad)::bigint from errors")
def ledger_batches(spark, d):
    """Each user's latest event as an item, by three batches that are applied twice each: items, job rows and the job's counters as if once."""
    e, store = table(spark, d, "events"), Store(spark, scratch(spark, "store"), buckets=8)
    bad = lambda x: x.where("event_type = 'error'").select("full_path", F.lit("extract").alias("stage"), "event_type")
    for n in range(3):
        rows = latest(e.where(F.col("event_id") % 3 == n), "user_id", [F.desc("event_id")])
        rows = rows.select(F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("full_path"), F.col("event_id").alias("size"), F.col("event_id").alias("created_ts"), "event_type")
        for _ in range(2):
            store.put(rows, "stream", n, errors=bad)
    done = store.progress("stream")
    counts = spark.range(1).select(F.lit("progress").alias("kind"), F.lit("stream").alias("key"), F.lit(done["indexed"]).cast("bigint").alias("a"), F.lit(done["errors"]).cast("bigint").alias("b"))
    out = store.current().select(F.lit("item").alias("kind"), F.col("full_path").alias("key"), F.col("size").alias("a"), F.col("created_ts").alias("b"))
    jobs = store.table("jobs").select(F.lit("job").alias("kind"), F.col("batch_id").cast("string").alias("key"), F.col("indexed_count").alias("a"), F.col("error_count").alias("b"))
    return out.unionByName(jobs).unionByName(counts)


@query(_ITEMS + ", r as (select distinct concat('/data', full_path, '/') as root from items where item_id % 10 = 0 union select distinct concat('/data', parent_path, '/') from items where item_id % 97 = 0) select concat('/data', full_path, '/x.txt') as full_path from items where not exists (select 1 from r where starts_with(concat('/data', full_path, '/x.txt'), root))")
def nested_roots_many(spark, d):
    """As ``nested_root_exclusion``, with many roots from a table: some items taken as folders, and folders of others."""
    x = items(spark, d)
    roots = x.where("item_id % 10 = 0").select(F.concat(F.lit("file:///data"), "full_path").alias("root_path")).unionByName(x.where("item_id % 97 = 0").select(F.concat(F.lit("/data"), "parent_path", F.lit("/")).alias("root_path")))
    return file_source.outside(x.select(F.concat(F.lit("/data"), "full_path", F.lit("/x.txt")).alias("full_path")), roots, "/data")


@query(_SPLIT + "select o.full_path, n.size_bytes as size_bytes, o.created_ts, coalesce(n.m2, o.modified_ts) as modified_ts from o left join (select full_path, size_bytes, case when size_bytes % 2 = 0 then modified_ts + 5 end as m2 from n) n using (full_path) where n.size_bytes is not null union all select o.full_path, o.size_bytes, o.created_ts, o.modified_ts from o where full_path not in (select full_path from n)")
def fill_nulls(spark, d):
    new = _new(spark, d).select("full_path", "size_bytes", F.when(F.col("size_bytes") % 2 == 0, F.col("modified_ts") + 5).alias("modified_ts"))
    return ingest.fill(_old(spark, d), new, "full_path", ["size_bytes", "modified_ts"])


@query(_ITEMS + "select item_id, case when is_deleted = 1 or item_id % 4 = 0 or full_path like '/src1/%' then 1 else 0 end as is_deleted from items")
def soft_deleted(spark, d):
    x = items(spark, d)
    return ingest.soft_delete_root(ingest.soft_delete(x, x.where("item_id % 4 = 0")), "/src1").select("item_id", "is_deleted")


@query(_ITEMS + ", o as (select * from items where item_id % 3 <> 0) select full_path from o where is_deleted = 0 and full_path not in (select full_path from items where item_id % 5 <> 0)")
def vanished_items(spark, d):
    return ingest.vanished(items(spark, d).where("item_id % 3 <> 0"), items(spark, d).where("item_id % 5 <> 0")).select("full_path")


_JOBS = "with j as (select event_id as job_id, user_id as root_id, case event_type when 'click' then 'running' when 'view' then 'pending' when 'signup' then 'finalizing' else 'done' end as status, cast(floor(epoch(ts)) as bigint) as started_ts from events), r as (select distinct user_id as root_id, concat('/r', user_id) as root_path from events where user_id % 2 = 0) "


def _jobs(spark, d):
    t = F.col("event_type")
    status = F.when(t == "click", "running").when(t == "view", "pending").when(t == "signup", "finalizing").otherwise("done")
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("root_id"), status.alias("status"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("started_ts"))


@query(_JOBS + "select job_id, root_path, status, started_ts from j left join r using (root_id) where status <> 'done' order by started_ts desc, job_id desc")
def active_jobs(spark, d):
    roots = table(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("root_id"), F.concat(F.lit("/r"), F.col("user_id").cast("string")).alias("root_path")).distinct()
    return dashboard.active_jobs(_jobs(spark, d), roots).select("job_id", "root_path", "status", "started_ts")


@query(_JOBS + "select job_id, status from j where status <> 'done' order by job_id")
def resumable_jobs(spark, d):
    return dashboard.resumable_jobs(_jobs(spark, d)).select("job_id", "status")


@query("select event_id as job_id, case when event_id = 40 then 'running' when event_type = 'click' then 'running' else 'done' end as status, case when event_id = 40 then event_id % 50 else event_id % 70 end as queued_count, event_id % 50 as indexed_count, case when event_id = 40 then 0 else event_id % 3 end as pending_count, case when event_id <> 40 then cast(floor(epoch(ts)) as bigint) end as finished_ts from events")
def job_resumed(spark, d):
    e = F.col("event_id")
    jobs = table(spark, d, "events").select(e.alias("job_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), (e % 70).alias("queued_count"), (e % 50).alias("indexed_count"), (e % 3).alias("pending_count"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("finished_ts"))
    return dashboard.prepare_resume(jobs, 40, 1)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, d):
    return ingest.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


# Retrieval context

_RAG = """with t as (select *, row_number() over (order by conv_id, turn) as n from conversations where role = 'user' qualify n <= 8),
 b as (select n, concat('[', n, '] item_id=', conv_id, chr(10), 'file_name: ', role, chr(10), 'full_path: ', chr(10), 'extension: ', chr(10), 'file_type_group: ', chr(10), 'size_bytes: 0', chr(10), 'best_time_ts: 0', chr(10), 'preview: ', regexp_replace(trim(text, concat(' ', chr(9), chr(10), chr(13), chr(12))), '\\s+', ' ', 'g'), chr(10)) as block from t),
 r as (select n, block, coalesce(sum(length(block)) over (order by n rows between unbounded preceding and 1 preceding), 0) as before from b),
 c as (select n, substr(block, 1, cast(greatest(0, 1500 - before) as bigint)) as block from r)
 select string_agg(block, chr(10) order by n) as context from c where block <> ''"""


@query(_RAG)
def rag_context(spark, d):
    x = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("item_id"), "turn", F.col("role").alias("file_name"), F.col("text").alias("snippet"))
    return rag.context(x, [F.asc("item_id"), F.asc("turn")], 8, 1500)
