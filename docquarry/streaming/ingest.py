"""Incremental ingestion: changed files only, upserts into snapshots, errors aside; in batches or as a file stream."""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import files as names
from ..functions.text import hash_bits, simhash
from ..operators import dedup
from ..sources.files import described, extracted, scan
from ..sources.tree import empty_files
from ..sources.versions import Versions
from .store import BROADCAST, KEEP
from .store import Store as LogStore


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that aren't known with the same token."""
    return files.join(known.select("full_path", "change_token"), ["full_path", "change_token"], "left_anti")


def vanished(known: DataFrame, files: DataFrame) -> DataFrame:
    """Known live items that a full scan didn't find."""
    return known.where("is_deleted = 0").join(files.select("full_path"), "full_path", "left_anti")


def with_id(df: DataFrame) -> DataFrame:
    """A stable id from the path."""
    return df.withColumn("item_id", F.xxhash64("full_path"))


def upsert(old: DataFrame, new: DataFrame, key: str = "full_path", keep: tuple[str, ...] = KEEP) -> DataFrame:
    """Old rows with new ones put over them by key: all columns of the new row count, but for those in ``keep`` that the old one has. The latest of several new rows counts."""
    order = [F.desc(c) for c in ("last_indexed_ts", "modified_ts") if c in new.columns] or [F.lit(1)]
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    o, n = old.alias("o"), latest.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        out.append((F.coalesce(a, b) if c == key or c in keep or c not in new.columns else F.when(F.col("n._new"), b).otherwise(a)).alias(c))
    return both.select(*out)


def fill(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the given columns filled where the new row has a value; a null never overwrites."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = old.join(n, key, "left")
    return x.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in old.columns])


def soft_delete(items: DataFrame, gone: DataFrame, key: str = "full_path") -> DataFrame:
    mark = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return items.join(mark, key, "left").withColumn("is_deleted", F.when(F.col("_gone"), F.lit(1)).otherwise(F.col("is_deleted"))).drop("_gone").select(*items.columns)


def rows_of(files: DataFrame, now: int) -> DataFrame:
    """Rows of the items table for files with content, but for hashes of text: text, times, digests; a row with warnings and no text is an error."""
    x = with_id(extracted(files))
    taken = names.epoch_of_exif(F.coalesce(F.col("metadata")["DateTimeOriginal"], F.col("metadata")["DateTime"]))
    time_, source = names.best_time(F.lit(None).cast("bigint"), F.col("modified_ts"))
    best, best_source, confidence = names.override_time(time_, source, taken)
    at = F.lit(now).cast("bigint")
    return x.withColumns({"best_time_ts": best, "best_time_source": best_source, "best_time_confidence": confidence, "is_deleted": F.lit(0), "first_seen_ts": at, "last_indexed_ts": at})


def indexed(files: DataFrame, now: int | None = None) -> DataFrame:
    """Rows of the items table for files with content, with the hashes of their texts."""
    x = rows_of(files, int(time.time()) if now is None else now)
    return x.join(simhash(x, "item_id", "text"), "item_id", "left")


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("size(warnings) > 0").select("full_path", F.lit("extract").alias("stage"), F.col("warnings")[0].alias("error_message"))


def difference(files: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """The files that aren't known with the same token, and how many files there are. Only names and tokens are compared and shuffled, no contents."""
    same = files.select("full_path", "change_token").join(known.select("full_path", "change_token", F.lit(True).alias("_same")), ["full_path", "change_token"], "left")
    all_, new = same.agg(F.count("*"), F.count_if(F.col("_same").isNull())).first()
    keys = same.where("_same is null").select("full_path")
    return files.join(F.broadcast(keys) if new <= BROADCAST else keys, "full_path", "left_semi").select(*files.columns), all_


class Snapshots:
    """Whole tables in numbered folders; the highest complete one is current, and none is written while it is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, folder)

    def current(self) -> DataFrame | None:
        version, now = self.versions.current()
        return self.spark.read.parquet(f"{self.folder}/{now['name']}") if version else None

    def commit(self, df: DataFrame) -> None:
        version, _ = self.versions.current()
        name = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{name}")
        self.versions.commit(version, {"name": name})


class Store(LogStore):
    """The items table, its error log, jobs and duplicate groups."""

    def merge(self, files: DataFrame, full_scan: bool = False, rescan: bool = False, now: int | None = None, job_id: str = "", batch_id: int | None = None, root: str = "") -> dict:
        """Ingests files with content; counts of what was found. With ``full_scan`` items not among the files are deleted, those below ``root`` only if that is given.

        Files that can't be read go to the table ``errors`` and the counts to ``jobs``, both with ``job_id``. A batch that is in already, by its ``batch_id``,
        only gives its counts again.
        """
        if (counts := self._done(self.versions.current()[1], job_id, batch_id)) is not None:
            return counts
        old = self.current()
        new, seen = (files, None) if old is None or rescan else difference(files, old)
        gone = None
        if full_scan and old is not None:
            below = re.sub(r"^\w+:(//)?", "", root).rstrip("/") + "/"
            gone = vanished(old.where(F.col("full_path").startswith(below)), files)
        at = int(time.time()) if now is None else now
        return self.put(rows_of(new, at), job_id, batch_id, gone, lambda x: simhash(x, "full_path", "text"), errors, seen, "full_scan" if full_scan else "incremental", at)

    def reindex(self, root: str, nested: list[str] = (), job_id: str = "") -> dict:
        """Reads all files below one root again, changed or not, and deletes its items that are gone."""
        self.begin(job_id)
        counts = self.merge(scan(self.spark, root, nested, empty=True), full_scan=True, rescan=True, job_id=job_id, root=root)
        self.mark(job_id, "done")
        return counts

    def finish(self) -> DataFrame:
        """Duplicate groups of all live items, equal files, similar texts and similar images, put over those found before; once a job is complete."""
        live = self.current().where("is_deleted = 0")
        exact = dedup.exact_members(live).select("group_key", "item_id", F.lit(1.0).alias("similarity"))
        near = dedup.near_groups(live.where("simhash64 is not null").select("item_id", hash_bits(F.col("simhash64")).alias("h")))
        found = dedup.typed_groups({"exact": exact, "similar_text": near, "similar_image": dedup.image_groups(live)})
        kept = Snapshots(self.spark, f"{self.folder}/groups")
        old = kept.current()
        kept.commit(found if old is None else dedup.replaced(old, found))
        return kept.current()


def stream(spark: SparkSession, root: str, store: Store, checkpoint: str, per_trigger: int = 10_000, after: Callable[[DataFrame], None] | None = None, nested: list[str] = (), job_id: str | None = None, empty: bool = False):
    """A query that ingests what is new below ``root`` and then ends; started again with the same checkpoint it resumes. ``after`` gets the items once a batch is in.

    A batch that is applied again, as after a failure between its commit and the checkpoint's, changes nothing: the store's ledger has its id.
    With ``empty`` files without bytes come from a source of their own, once they have rested for two seconds.
    """
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    if empty:
        source = source.unionByName(empty_files(spark, root, stream=True))
    job = job_id or job_of(checkpoint)
    store.begin(job)

    def batch(df: DataFrame, batch_id: int) -> None:
        store.merge(described(df, root, nested), job_id=job, batch_id=batch_id)
        if after:
            after(store.current())

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", os.fspath(checkpoint)).trigger(availableNow=True).start()


def job_of(checkpoint: str) -> str:
    """A stream's job: as long as it keeps its checkpoint it is one."""
    return f"stream {os.fspath(checkpoint)}"


def ingest(spark: SparkSession, root: str, store: Store, checkpoint: str, per_trigger: int = 10_000, nested: list[str] = (), empty: bool = False) -> DataFrame:
    """Streams in what is new below ``root``, and finds duplicates once nothing is pending; the groups."""
    stream(spark, root, store, checkpoint, per_trigger, nested=nested, empty=empty).awaitTermination()
    store.mark(job_of(checkpoint), "finalizing")
    try:
        groups = store.finish()
    except Exception:
        store.mark(job_of(checkpoint), "error")
        raise
    store.mark(job_of(checkpoint), "done")
    return groups


def soft_delete_root(items: DataFrame, root: str) -> DataFrame:
    """Marks all items at or below a folder as deleted."""
    below = root.rstrip("/") + "/"
    return items.withColumn("is_deleted", F.when(F.col("full_path").startswith(below), F.lit(1)).otherwise(F.col("is_deleted")))


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind in tumbling windows with a watermark, for batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
