"""What goes to the driver or is made twice, by plans."""

from pyspark.sql import functions as F

from docquarry.operators import dedup, index, near_index
from docquarry.sources import versions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hashes(spark, n=3000):
    return spark.range(n).select("id", F.xxhash64("id").alias("h"))


def test_bands_are_not_broadcast(spark):
    assert "Broadcast" not in plan(dedup.near_pairs(versions.kept(hashes(spark), "hashes")))


def test_bands_are_dealt_over_cores_and_once(spark, tmp_path):
    """However few files the hashes are in; both sides of the join read the same exchange, and stored bands need no sample of them."""
    few = versions.kept(hashes(spark).coalesce(1), "hashes")
    cores = spark.sparkContext.defaultParallelism
    assert dedup.banded(few, 8).select(F.spark_partition_id()).distinct().count() >= cores
    pairs = dedup.near_pairs(few)
    pairs.collect()
    assert "ReusedExchange" in plan(pairs)
    index = near_index.NearIndex(spark, f"file://{tmp_path}/n", buckets=16).build(few.toDF("item_id", "h"))
    name = index.versions.current()[1]["bands"][0]
    files = spark.read.parquet(f"{tmp_path}/n/bands/{name}").groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.count("*").alias("n")).collect()
    assert len(files) >= cores and sum(x.n for x in files) == 3000 * len(dedup.choices(8)) and sum(x.b - x.a + 1 for x in files) == 16  # each of a range of its own


def test_kept_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    x = hashes(spark)
    assert "BroadcastHashJoin" in plan(x.join(versions.kept(x, "few"), "id"))
    monkeypatch.setattr(versions, "BROADCAST", 2999)
    many = versions.kept(x, "many")
    assert "Broadcast" not in plan(x.join(many, "id")) and "Broadcast" not in plan(x.join(many.select("id").distinct(), "id", "left_anti"))
    assert many.count() == 3000 and versions.kept(x.where("false"), "none").isEmpty()
    versions.dropped(many)


def test_postings_are_made_within_rows(spark):
    texts = spark.createDataFrame([(1, "b a b", "c"), (2, None, "a"), (3, "", " ")], "item_id bigint, text string, title string").repartition(8, "item_id")
    found = index.postings(versions.kept(texts, "texts").repartition(8), ["text", "title"])
    assert plan(found).count("Exchange") == 1  # that of the line above
    assert sorted(map(tuple, found.collect())) == [("a", 1, 0, [1], 4), ("a", 2, 1, [0], 1), ("b", 1, 0, [0, 2], 4), ("c", 1, 1, [0], 4)]
