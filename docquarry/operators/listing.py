"""Listings of items, images and media, and one item in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Filters, like



def _orders(names: dict[str, str], default: str):
    def pick(order_by: str | None, time: Column | None = None) -> list[Column]:
        column, _, way = (order_by if order_by in names else default).partition(" ")
        c = time if column == "best_time_ts" and time is not None else F.col(column)
        return [c.desc() if way == "DESC" else c.asc(), F.col("item_id").desc() if way == "DESC" else F.col("item_id").asc()]

    return pick


_both = lambda *names: {f"{n} {w}": n for n in names for w in ("DESC", "ASC")}
item_order = _orders(_both("modified_ts", "size_bytes") | {"file_name ASC": "", "best_time_ts DESC": ""}, "modified_ts DESC")
image_order = _orders(_both("best_time_ts", "modified_ts", "size_bytes", "file_name"), "best_time_ts DESC")


# The columns of listings, and those that searches add.
SHOWN = ("item_id", "file_name", "full_path", "extension", "file_type_group", "size_bytes", "modified_ts", "best_time_ts", "sha256", "content_preview")
FOUND = ("title", "artist", "album", "camera_model", "snippet", "score")


def list_items(items: DataFrame, filters: Filters | None = None, order_by: str | None = None, limit: int = 100, offset: int = 0, content: DataFrame | None = None) -> DataFrame:
    """Live items by filters. With ``content`` (item_id, content_preview) the page's rows get their preview; only they are joined."""
    page = items.where((filters or Filters()).column()).orderBy(*item_order(order_by)).offset(offset).limit(limit)
    return page if content is None else shown(page.join(content.select("item_id", "content_preview"), "item_id", "left")).orderBy(*item_order(order_by))


def shown(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The columns of listings, those that there are."""
    return rows.select(*[c for c in (*SHOWN, *also) if c in rows.columns])


def recent_items(items: DataFrame, limit: int = 15, latest: str = "modified_ts") -> DataFrame:
    return items.where("is_deleted = 0").orderBy(F.desc(latest), "item_id").limit(limit)


def image_time() -> Column:
    return F.coalesce("taken_ts", "best_time_ts", "modified_ts")


def list_images(items: DataFrame, metadata: DataFrame, q: str = "", filters: Filters | None = None, has_gps: int | None = None, order_by: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Images with their metadata (item_id, taken_ts, title, camera_model, meta_json): by keyword, filters, and coordinates."""
    if not 0 < limit <= 300 or offset < 0:
        raise ValueError("limit must be 1 to 300, offset 0 or more")
    x = items.where("file_type_group = 'image'").join(metadata, "item_id", "left").where((filters or Filters()).column(image_time()))
    if q:
        hit = F.lit(False)
        for c in ("file_name", "full_path", "title", "camera_model", "meta_json"):
            hit = hit | like(F.coalesce(F.col(c), F.lit("")), f"%{q}%")
        x = x.where(hit)
    if has_gps == 1:
        x = x.where(F.get_json_object("meta_json", "$.gps_lat").isNotNull() & F.get_json_object("meta_json", "$.gps_lon").isNotNull())
    return x.withColumn("sort_time_ts", image_time()).orderBy(*image_order(order_by, F.col("sort_time_ts"))).offset(offset).limit(limit)


def item_detail(items: DataFrame, content: DataFrame, metadata: DataFrame) -> DataFrame:
    """Items with content and metadata; coordinates and the original date are lifted from the JSON, bad JSON counts as empty."""
    x = items.join(content, "item_id", "left").join(metadata, "item_id", "left")
    get = lambda name: F.get_json_object("meta_json", f"$.{name}")
    some = lambda c: F.nullif(c, F.lit(""))
    return x.withColumns(
        {"gps_lat": get("gps_lat").try_cast("double"), "gps_lon": get("gps_lon").try_cast("double"), "date_original": get("date_original"), "camera": F.coalesce(some(F.col("camera_model")), some(get("camera_model")), some(get("model")))}
    )


def json_map(text: Column) -> Column:
    """JSON as a map of strings; bad, null and empty JSON give an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def media_items(items: DataFrame, q: str = "", limit: int = 200) -> DataFrame:
    """Audio and video as one list without repeats, latest first."""
    x = items.where("is_deleted = 0")
    if q:
        x = x.where(like(F.col("file_name"), f"%{q}%") | like(F.col("full_path"), f"%{q}%"))
    both = x.where("file_type_group = 'audio'").unionByName(x.where("file_type_group = 'video'")).dropDuplicates(["item_id"])
    return both.orderBy(F.coalesce(F.nullif(F.col("modified_ts"), F.lit(0)), F.col("best_time_ts"), F.lit(0)).desc(), "item_id").limit(limit)
