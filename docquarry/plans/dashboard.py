"""Composite reads: what the pages of an application over the catalogue show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, listing, stats

ACTIVE = ("running", "pending", "finalizing")


def active_jobs(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Jobs (job_id, root_id, status, started_ts) that aren't over, with their root's path, the latest first."""
    small_roots = roots.select("root_id", F.col("root_path"))
    return jobs.where(F.col("status").isin(*ACTIVE)).join(small_roots, "root_id", "left").orderBy(F.desc("started_ts"), F.desc("job_id"))


def resumable_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that were cut off, in the order in which they go on."""
    return jobs.where(F.col("status").isin(*ACTIVE)).orderBy("job_id")


def prepare_resume(jobs: DataFrame, job_id: int, now: int) -> DataFrame:
    """Jobs after one that was cut off starts again: what was queued restarts at what is indexed, and nothing is pending or scanned to its end."""
    here = F.col("job_id") == job_id
    new = {"status": F.lit("running"), "finished_ts": F.lit(None), "pending_count": F.lit(0), "scan_complete": F.lit(0), "queued_count": F.col("indexed_count"), "current_file": F.lit(""), "updated_ts": F.lit(now)}
    return jobs.select(*[F.when(here, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else f.name for f in jobs.schema])


def add_root(roots: DataFrame, path: str, label: str, now: int) -> DataFrame:
    """Roots (root_id, root_path, label, is_enabled, created_ts) with one more; one that is there stays as it is."""
    new = roots.sparkSession.createDataFrame([(path, label, 1, now)], "root_path string, label string, is_enabled int, created_ts bigint")
    new = new.select(F.xxhash64("root_path").alias("root_id"), "*").join(roots.select("root_path"), "root_path", "left_anti")
    return roots.unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in roots.schema]))


def set_enabled(roots: DataFrame, root_id: int, enabled: bool) -> DataFrame:
    return roots.withColumn("is_enabled", F.when(F.col("root_id") == root_id, F.lit(int(enabled))).otherwise(F.col("is_enabled")))


def dashboard(items: DataFrame, members: DataFrame, errors: DataFrame, jobs: DataFrame, roots: DataFrame) -> dict[str, DataFrame]:
    """Totals, types, duplicates, failures, latest items, active jobs, files per root and insights; each is planned by itself and read when needed."""
    groups = dedup.dup_stats(dedup.group_sizes(members, items))
    failed = stats.failed_files(errors)
    return {
        "totals": stats.totals(items),
        "by_type": stats.by_type(items).orderBy(F.desc("item_count"), "file_type_group"),
        "duplicates": groups,
        "errors": failed,
        "recent": listing.recent_items(items, 15),
        "active_jobs": active_jobs(jobs, roots),
        "roots": stats.files_per_root(roots.withColumnRenamed("root_path", "root"), items).orderBy(F.desc("created_ts"), "root"),
        "insights": stats.insights(groups, failed),
    }
