"""Near-duplicate groups that are kept up to date: bands, pairs and seeds are stored, and a change repairs what hangs on it.

The greedy groups of ``dedup.near_groups`` follow from the pairs of near hashes and the order of items: a hash, with its smallest item, is a seed if
no near hash with a smaller item is one. After a change only these can differ: hashes whose smallest item has changed, come or gone, and, going up in
order, those beside a hash that has become or ceased to be a seed. New hashes meet others in the buckets of their own bands; no text, and no
other band, is read. Stored tables are merge-on-read, so what is written follows the change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hamming_similarity
from ..sources.versions import Versions, dropped, kept, scratch
from ..streaming.store import Store
from . import dedup

#: Buckets of bands; those of the other tables are ``parts``.
BUCKETS = 256


class NearIndex:
    """In ``folder``: items (item_id, h), vertices (h, id, seed), pairs of near hashes both ways, and bands in buckets."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "simhash", buckets: int = BUCKETS, parts: int = 16):
        self.spark, self.folder, self.prefix, self.buckets, self.parts = spark, folder.rstrip("/"), prefix, buckets, parts
        self.versions = Versions(spark, self.folder)

    def _tables(self, name: str) -> dict[str, Store]:
        return {k: Store(self.spark, f"{self.folder}/{name}/{k}", key, (), self.parts, 0.5) for k, key in (("items", "item_id"), ("vertices", "h"), ("pairs", "pair"))}

    def _write_bands(self, hashes: DataFrame, name: str, blocks: int) -> None:
        """In order of buckets, so that a reader of some passes over the files of the others. Buckets are even, so ranges of them need no sample."""
        files = min(self.buckets, 2 * self.spark.sparkContext.defaultParallelism)
        x = dedup.banded(hashes.select("h"), blocks).withColumn("bucket", F.pmod(F.xxhash64("i", "v"), F.lit(self.buckets)).cast("int"))
        x.repartitionById(files, F.expr(f"bucket * {files} div {self.buckets}").cast("int")).sortWithinPartitions("bucket").write.parquet(f"{self.folder}/bands/{name}")

    def _bands(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("h bigint, i int, v bigint, bucket int").parquet(*[f"{self.folder}/bands/{name}" for name in names])

    def build(self, hashes: DataFrame) -> NearIndex:
        """An index of these items (item_id, h) alone, grouped in full."""
        version, _ = self.versions.current()
        name = uuid.uuid4().hex[:8]
        t = self._tables(name)
        items = kept(hashes.where("h is not null").select("item_id", "h"), "near-items")
        first = kept(items.groupBy("h").agg(F.min("item_id").alias("id")), "near-first")
        pairs = kept(dedup.near_pairs(first), "near-pairs")
        others = dedup.not_seeds(pairs)
        t["items"].fill(items)
        t["vertices"].fill(first.join(others.withColumn("_not", F.lit(True)), "id", "left").select("h", "id", F.col("_not").isNull().alias("seed")))
        both = pairs.join(first.toDF("g", "a"), "a").join(first.toDF("h", "b"), "b")
        t["pairs"].fill(self._both(both.select("g", "h", "similarity")))
        blocks = dedup.blocks_for(4 * first.count())  # room to grow; with more they stay complete, and meet more
        self._write_bands(first, name, blocks)
        dropped(items, first, pairs, others)
        self.versions.commit(version, {"tables": name, "blocks": blocks, "bands": [name]})
        return self

    @staticmethod
    def _both(pairs: DataFrame) -> DataFrame:
        """Pairs (g, h, similarity) in both ways, with a key."""
        x = pairs.unionByName(pairs.select(F.col("h").alias("g"), F.col("g").alias("h"), "similarity"))
        return x.select(F.concat_ws(":", "g", "h").alias("pair"), "g", "h", "similarity")

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> NearIndex:
        """Takes the hashes of changed items (item_id, h) instead of theirs so far, and drops items in ``gone`` (item_id) and those whose hash is null.

        An update that breaks off leaves tables that don't fit each other: ``build`` makes them anew.
        """
        version, now = self.versions.current()
        if not version:
            return self.build(changed)
        t = self._tables(now["tables"])
        new = kept(changed.where("h is not null").select("item_id", "h"), "near-new")
        out = changed.where("h is null").select("item_id")
        out = out if gone is None else out.unionByName(gone.select("item_id")).distinct().join(changed.where("h is not null").select("item_id"), "item_id", "left_anti")
        out = kept(out.distinct(), "near-out")
        items = t["items"].current()
        touched = kept(items.join(new.select("item_id").unionByName(out), "item_id", "left_semi").select("h").unionByName(new.select("h")).distinct(), "near-touched")
        t["items"].put(new, gone=out, mode=None)
        # hashes whose smallest item isn't what it was
        least = t["items"].current().join(touched, "h", "left_semi").groupBy("h").agg(F.min("item_id").alias("new_id"))
        before = t["vertices"].current()
        moved = touched.join(least, "h", "left").join(before.join(touched, "h", "left_semi"), "h", "left").where("not new_id <=> id")
        moved = kept(moved.select("h", F.col("id").alias("old_id"), "new_id", F.col("seed").alias("old_seed")), "near-moved")
        fresh, lost = moved.where("old_id is null").select("h"), moved.where("new_id is null").select("h")
        # pairs of new hashes come, those of lost ones go
        name = uuid.uuid4().hex[:8]
        self._write_bands(fresh, name, now["blocks"])
        bands = [*now["bands"], name]
        mine = self._bands([name])
        buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # of ``self.buckets``
        theirs = self._bands(bands).where(F.col("bucket").isin(buckets))
        pairs = t["pairs"].current()
        ended = pairs.join(lost, "h", "left_semi").select("g", "h")
        ended = ended.unionByName(ended.select(F.col("h").alias("g"), F.col("g").alias("h"))).select(F.concat_ws(":", "g", "h").alias("pair"))
        # a hash that comes back after it was lost is beside those that it was beside
        beside_old = kept(pairs.join(lost, "h", "left_semi").select(F.col("g").alias("h")), "near-beside")
        live = before.select("h").unionByName(fresh).join(lost, "h", "left_anti").select(F.col("h").alias("g"))
        # a hash that has come back has its bands more than once: its pairs are told apart below, which is less than all bands
        close = mine.hint("merge").join(theirs.select(F.col("h").alias("g"), "i", "v").hint("merge"), ["i", "v"]).where((F.col("g") != F.col("h")) & (F.bit_count(F.col("g").bitwiseXOR(F.col("h"))) <= dedup.DISTANCE))
        close = close.where(dedup.first_meeting(F.col("g"), F.col("h"), F.col("i"), now["blocks"])).select("g", "h", hamming_similarity(F.col("g"), F.col("h")).alias("similarity")).join(live, "g", "left_semi")
        t["pairs"].put(self._both(close).dropDuplicates(["pair"]), gone=ended, mode=None)
        told = self._repair(t, moved, beside_old)
        t["vertices"].put(told, gone=lost, mode=None)
        dropped(new, out, touched, moved, beside_old, told)
        self.versions.commit(version, now | {"bands": bands})
        return self

    def _repair(self, t: dict[str, Store], moved: DataFrame, beside_old: DataFrame) -> DataFrame:
        """(h, id, seed) of the hashes that may differ: a hash is told once no smaller one beside it is still to be told, or one that isn't is a seed. A written table.

        So rounds are not as many as a group's members. Should that seed cease to be one later, those that it took are told again.
        """
        pairs = t["pairs"].current()
        changed = moved.where("new_id is not null").select("h", F.col("new_id").alias("id"), F.lit(None).cast("boolean").alias("seed"))
        stored = t["vertices"].current().join(moved.select("h"), "h", "left_anti").unionByName(changed)
        near = pairs.join(moved.select("h"), "h", "left_semi").select(F.col("g").alias("h"))
        todo = kept(stored.join(moved.select("h").unionByName(near).unionByName(beside_old).distinct(), "h", "left_semi").select("h", "id"), "near-todo")
        told = kept(changed.where("false"), "near-told")
        while not todo.isEmpty():
            vertices = stored.join(told.select("h"), "h", "left_anti").unionByName(told)
            open_ = todo.select(F.col("h").alias("g"), F.lit(True).alias("g_open"))
            beside = pairs.join(todo, "h").join(vertices.toDF("g", "g_id", "g_seed"), "g").where("g_id < id").join(open_, "g", "left")
            wait, seed = F.coalesce("g_open", F.lit(False)), F.coalesce("g_seed", F.lit(False))
            waits, taken = F.bool_or(wait), F.bool_or(seed & ~wait)
            state = todo.join(beside.groupBy("h").agg(waits.alias("waits"), taken.alias("taken")), "h", "left").where("taken or not coalesce(waits, false)")
            now = kept(state.select("h", "id", (~F.coalesce("taken", F.lit(False))).alias("seed")), "near-now")
            differ = now.alias("n").join(vertices.alias("v"), "h").where("not n.seed <=> v.seed").select(F.col("h").alias("g"), F.col("n.id").alias("g_id"), F.col("n.seed").alias("g_seed"), F.coalesce("v.seed", F.lit(False)).alias("g_was"))
            new = kept(told.join(now.select("h"), "h", "left_anti").unionByName(now), "near-told")
            # a new seed matters to seeds above it, one that was a seed to what it may have taken; others stay told, so that none waits for them
            after = stored.join(new.select("h"), "h", "left_anti").unionByName(new)
            up = pairs.join(differ, "g").join(after, "h").where("id > g_id and (g_seed and seed or g_was and not g_seed and not seed)").select("h", "id")
            left = kept(todo.join(now.select("h"), "h", "left_anti").unionByName(up).distinct(), "near-todo")
            dropped(todo, told, now)
            todo, told = left, new
        dropped(todo)
        return told

    def groups(self) -> DataFrame:
        """(group_key, item_id, similarity) as ``dedup.near_groups`` gives them over the items that are in; from stored pairs and seeds."""
        version, now = self.versions.current()
        if not version:
            return self.spark.createDataFrame([], "group_key string, item_id bigint, similarity double")
        t = self._tables(now["tables"])
        vertices = t["vertices"].current()
        seeds = vertices.where("seed").select(F.col("h").alias("g"), F.col("id").alias("seed"))
        others = vertices.where("not seed").select("h", "id")
        beside = t["pairs"].current().join(seeds, "g").join(others, "h").groupBy("id").agg(F.min(F.struct("seed", "similarity")).alias("m"))
        away = beside.select("id", F.col("m.seed").alias("seed"), F.col("m.similarity").alias("similarity"))
        return dedup.grouped(t["items"].current(), vertices.select("h", "id"), away, self.prefix)


def new_index(spark: SparkSession, hashes: DataFrame, prefix: str = "simhash") -> NearIndex:
    """An index in a new folder of the shared store."""
    return NearIndex(spark, scratch(spark, "near-index"), prefix).build(hashes)
