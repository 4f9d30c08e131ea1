"""Time buckets."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


def bucket(ts: Column, zoom: str) -> Column:
    if zoom not in FORMATS:
        raise ValueError(f"zoom is one of {', '.join(FORMATS)}")
    return F.date_format(F.timestamp_seconds(ts), FORMATS[zoom])


def _live(items: DataFrame) -> DataFrame:
    return items.where("is_deleted = 0") if "is_deleted" in items.columns else items


def buckets(items: DataFrame, zoom: str, time: str = "best_time_ts", size: str = "size_bytes") -> DataFrame:
    """Count, bytes and range of times for each bucket; deleted items and those without a time are in none."""
    x = _live(items).where(F.col(time).isNotNull()).select(bucket(F.col(time), zoom).alias("bucket"), time, size)
    return x.groupBy("bucket").agg(F.count("*").alias("item_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"), F.min(time).alias("min_ts"), F.max(time).alias("max_ts"))


def rollup(items: DataFrame, time: str = "best_time_ts", size: str = "size_bytes") -> DataFrame:
    """All zooms at once, in one pass: (zoom, bucket, item_count, total_size)."""
    x = _live(items).where(F.col(time).isNotNull()).select(size, *[bucket(F.col(time), z).alias(z) for z in FORMATS])
    g = x.groupingSets([[F.col("year")], [F.col("month")], [F.col("day")]], "year", "month", "day").agg(F.count("*").alias("item_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))
    zoom = F.when(F.col("day").isNotNull(), "day").when(F.col("month").isNotNull(), "month").otherwise("year")
    return g.select(zoom.alias("zoom"), F.coalesce("day", "month", "year").alias("bucket"), "item_count", "total_size")


def bucket_range(label: str) -> tuple[int, int]:
    """The epoch seconds [from, to) of a year, month or day, so that a bucket's items are found by a range on the stored time."""
    parts = [int(x) for x in label.split("-")]
    begin = dt.date(*(parts + [1, 1])[:3])
    days = (366 if calendar.isleap(begin.year) else 365) if len(parts) == 1 else calendar.monthrange(*parts)[1] if len(parts) == 2 else 1
    a = calendar.timegm(begin.timetuple())
    return a, a + days * 86400


def bucket_items(items: DataFrame, label: str, limit: int = 200, time: str = "best_time_ts", key: str = "item_id") -> DataFrame:
    a, b = bucket_range(label)
    return _live(items).where((F.col(time) >= a) & (F.col(time) < b)).orderBy(F.desc(time), key).limit(limit)


def with_bar(df: DataFrame, count: str = "item_count") -> DataFrame:
    """A bar's width in percent of the largest count, 4 at least."""
    most = F.broadcast(df.agg(F.max(count).alias("_most")))
    return df.crossJoin(most).withColumn("bar", F.greatest(F.lit(4.0), 100.0 * F.col(count) / F.col("_most"))).drop("_most")  # one row
