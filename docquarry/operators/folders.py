"""Virtual folders: a forest of (vf_id, parent_vf_id, name) and memberships (vf_id, item_id, added_ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import dropped, kept

KEEP = -1


def tree(folders: DataFrame) -> DataFrame:
    """Folders with depth and path; a folder whose parent is missing is a root. One join a level."""
    spark = folders.sparkSession
    return spark.sql(
        """
        with recursive up as (
          select f.vf_id, f.name, case when p.vf_id is null then null else f.parent_vf_id end as parent from {f} f left join {f} p on f.parent_vf_id = p.vf_id
        ), t as (
          select vf_id, parent, cast(0 as bigint) as depth, cast(name as string) as path from up where parent is null
          union all
          select u.vf_id, u.parent, t.depth + 1, concat(t.path, '/', u.name) from t join up u on u.parent = t.vf_id
        ) select vf_id, depth, path from t
        """,
        f=folders,
    )


def subtree(folders: DataFrame, vf_id: int) -> DataFrame:
    """Ids of a folder and of all below it."""
    return folders.sparkSession.sql("with recursive t as (select vf_id from {f} where vf_id = {v} union all select c.vf_id from t join {f} c on c.parent_vf_id = t.vf_id) select vf_id from t", f=folders, v=vf_id)


def numbered(folders: DataFrame) -> DataFrame:
    """(vf_id, first, last, depth): folders numbered so that the numbers of a folder and of all below it are the range from ``first`` to ``last``; a written table.

    Folders come in the order of their paths of ids, each before what is below it. They are dealt over tasks by ranges of paths and numbered in each, after the
    sizes of the ranges before; a folder is counted once for each above it.
    """
    spark = folders.sparkSession
    paths = spark.sql(
        """
        with recursive up as (
          select f.vf_id, case when p.vf_id is null then null else f.parent_vf_id end as parent from {f} f left join {f} p on f.parent_vf_id = p.vf_id
        ), t as (
          select vf_id, array(cast(vf_id as bigint)) as ids from up where parent is null
          union all
          select u.vf_id, concat(t.ids, array(cast(u.vf_id as bigint))) from t join up u on u.parent = t.vf_id
        ) select vf_id, ids from t
        """,
        f=folders,
    )
    x = kept(paths.repartitionByRange("ids").withColumn("part", F.spark_partition_id()), "folders")
    sizes = x.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # one row a task
    below = x.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    first = x.join(F.broadcast(before), "part").withColumn("first", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("ids")))
    out = first.join(below, F.col("vf_id") == F.col("id")).select("vf_id", "first", (F.col("first") + F.col("n") - 1).alias("last"), (F.size("ids") - 1).alias("depth"))
    done = kept(out, "folder-numbers")
    dropped(x)
    return done


def subtree_by_range(numbers: DataFrame, vf_id: int) -> DataFrame:
    """Ids of a folder and of all below it: one range, not a join for each level."""
    one = numbers.where(F.col("vf_id") == vf_id).select(F.col("first").alias("low"), F.col("last").alias("high"))
    return numbers.join(F.broadcast(one), F.col("first").between(F.col("low"), F.col("high"))).select("vf_id")  # one row


def counts(folders: DataFrame, membership: DataFrame) -> DataFrame:
    """Folders with the number of their members, empty ones included, roots first and then by name."""
    n = membership.groupBy("vf_id").agg(F.count("item_id").alias("item_count"))
    return folders.join(n, "vf_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0))).orderBy(F.asc_nulls_first("parent_vf_id"), "name", "vf_id")


def create(folders: DataFrame, vf_id: int, name: str, parent: int | None = None, **others: object) -> DataFrame:
    row = {"vf_id": vf_id, "parent_vf_id": parent, "name": name, **others}
    return folders.unionByName(folders.sparkSession.createDataFrame([tuple(row.get(f.name) for f in folders.schema)], folders.schema))


def update(folders: DataFrame, vf_id: int, name: str | None = None, parent: int | None = KEEP, **others: object) -> DataFrame:
    """Renames or moves a folder, or changes other columns (``color``, ``icon``); ``KEEP`` leaves its parent, None makes it a root. It can't go below itself."""
    if parent not in (KEEP, None) and not subtree(folders, vf_id).where(F.col("vf_id") == parent).isEmpty():
        raise ValueError("a folder can't be moved below itself")
    here = F.col("vf_id") == vf_id
    out = folders.withColumn("name", F.when(here & F.lit(name is not None), F.lit(name)).otherwise(F.col("name")))
    for c, value in others.items():
        out = out.withColumn(c, F.when(here & F.lit(value is not None), F.lit(value)).otherwise(F.col(c)).cast(folders.schema[c].dataType))
    return out if parent == KEEP else out.withColumn("parent_vf_id", F.when(here, F.lit(parent)).otherwise(F.col("parent_vf_id")))


def delete(folders: DataFrame, membership: DataFrame, vf_id: int) -> tuple[DataFrame, DataFrame]:
    """Folders and memberships without a folder and all below it."""
    gone = subtree(folders, vf_id)
    return folders.join(gone, "vf_id", "left_anti"), membership.join(gone, "vf_id", "left_anti")


def add(membership: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds members; those there already keep the time at which they were added."""
    new = rows.join(membership, ["vf_id", "item_id"], "left_anti").groupBy("vf_id", "item_id").agg(F.min("added_ts").alias("added_ts"))
    return membership.unionByName(new)


def take_out(membership: DataFrame, vf_id: int, item_id: int) -> DataFrame:
    return membership.where(~((F.col("vf_id") == vf_id) & (F.col("item_id") == item_id)))


def items_in(membership: DataFrame, items: DataFrame, vf_id: int, content: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Live direct members, the last added first; with ``content`` (item_id, content_preview) and their preview."""
    m = membership.where(F.col("vf_id") == vf_id).select("item_id", "added_ts")
    x = items.where("is_deleted = 0").join(m, "item_id")
    if content is not None:
        x = x.join(content.select("item_id", "content_preview"), "item_id", "left")
    x = x.orderBy(F.desc("added_ts"), "item_id")
    return x if limit is None else x.offset(offset).limit(limit)


def folders_of(membership: DataFrame, folders: DataFrame, item_id: int) -> DataFrame:
    return folders.join(membership.where(F.col("item_id") == item_id).select("vf_id"), "vf_id").orderBy("name", "vf_id")
