"""Totals of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(items: DataFrame) -> DataFrame:
    return items.where("is_deleted = 0").agg(F.count("*").alias("total_items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def by_type(items: DataFrame) -> DataFrame:
    g = items.where("is_deleted = 0").groupBy("file_type_group")
    return g.agg(F.count("*").alias("item_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def failed_files(errors: DataFrame) -> DataFrame:
    return errors.agg(F.countDistinct("full_path").alias("errors"))


def files_per_root(roots: DataFrame, items: DataFrame) -> DataFrame:
    """Live items of each root, those without any kept."""
    n = items.where("is_deleted = 0").groupBy("root").agg(F.count("*").alias("item_count"))
    return roots.join(n, "root", "left").select(*roots.columns, F.coalesce("item_count", F.lit(0)).alias("item_count"))


def grouped_by_type(items: DataFrame) -> DataFrame:
    """Items of each type, null as other, as a sorted list of ids."""
    return items.groupBy(F.coalesce("file_type_group", F.lit("other")).alias("file_type_group")).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))


def grouped_page(items: DataFrame, page: int = 100, start: int = 0) -> DataFrame:
    """(file_type_group, rank, item_id): of each type the items from ``start`` on by id, ``page`` at most; null is other. For types of any size."""
    x = items.select(F.coalesce("file_type_group", F.lit("other")).alias("file_type_group"), "item_id")
    rank = F.row_number().over(Window.partitionBy("file_type_group").orderBy("item_id"))
    return x.withColumn("rank", rank).where((F.col("rank") <= start + page) & (F.col("rank") > start)).select("file_type_group", "rank", "item_id")


def selection_size(items: DataFrame, chosen: DataFrame) -> DataFrame:
    return items.join(chosen.select("item_id").distinct(), "item_id", "left_semi").agg(F.count("*").alias("item_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def insights(groups: DataFrame, errors: DataFrame) -> DataFrame:
    """Warnings on duplicates (from ``dedup.dup_stats``) and failed files, where there are any."""
    a = groups.where("groups > 0").select(F.lit("warning").alias("type"), F.format_string("%d duplicate groups found — %.1f GB reclaimable", "groups", F.col("wasted_bytes") / float(1024**3)).alias("text"))
    b = errors.where("errors > 0").select(F.lit("error").alias("type"), F.format_string("%d files failed to index", "errors").alias("text"))
    return a.unionByName(b)


def job_progress(outcomes: DataFrame) -> DataFrame:
    """Counters of each job from rows (job_id, outcome), outcome one of indexed, skipped, error, pending."""
    n = {x: F.count_if(F.col("outcome") == x).alias(f"{x}_count") for x in ("indexed", "skipped", "error", "pending")}
    g = outcomes.groupBy("job_id").agg(F.count("*").alias("total_count"), *n.values())
    done = F.col("total_count") - F.col("pending_count")
    return g.withColumn("percent", F.coalesce(F.round(100.0 * done / F.nullif(F.col("total_count"), F.lit(0)), 1), F.lit(0.0)))
