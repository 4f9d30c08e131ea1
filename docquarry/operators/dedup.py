"""Exact and near-duplicate groups of items."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hamming_similarity, hash_bits
from ..sources.versions import dropped, kept

#: Bits by which near duplicates may differ: similarity of at least 0.9 of 64 bits.
DISTANCE = 6


#: Members that a group has nested at most; further ones come with the next page.
PAGE = 200


def paged(members: DataFrame, group: str, order: list, page: int = PAGE, start: int = 0) -> DataFrame:
    """Of each group the rows from ``start`` on in order, ``page`` at most. The rank's limit goes before the shuffle, so a group of any size sends few rows."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return members.withColumn("_rank", n).where((F.col("_rank") <= start + page) & (F.col("_rank") > start))


def exact_groups(items: DataFrame, fingerprint: str = "sha256", key: str = "item_id", size: str = "size_bytes", page: int = PAGE) -> DataFrame:
    """(group_key, item_count, total_size, members) for fingerprints that two or more items share; ``members`` are the smallest keys, ``page`` at most."""
    x = items.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("group_key"), F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).alias("_size"))
    sizes = x.groupBy("group_key").agg(F.count("*").alias("item_count"), F.sum("_size").alias("total_size")).where("item_count > 1")
    first = paged(x, "group_key", [F.col("_key")], page).groupBy("group_key").agg(F.sort_array(F.collect_list("_key")).alias("members"))
    return sizes.join(first, "group_key")


def exact_members(items: DataFrame, fingerprint: str = "sha256", key: str = "item_id") -> DataFrame:
    """(group_key, item_id), a row for each member of a group that ``exact_groups`` gives, however many there are."""
    x = items.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("group_key"), F.col(key).alias("item_id"))
    many = x.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return x.join(many, "group_key", "left_semi")


def cuts(blocks: int) -> list[int]:
    """Masks of ``blocks`` blocks of 64 bits, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choices(blocks: int) -> list[tuple[int, ...]]:
    """All choices of ``blocks - DISTANCE`` blocks: numbers that differ in at most ``DISTANCE`` bits agree in one."""
    return [*combinations(range(blocks), blocks - DISTANCE)]


def bands(h: str, blocks: int) -> list:
    """The bits of a hash in each of the ``choices``, as (i, v)."""
    masks, out = cuts(blocks), []
    for i, choice in enumerate(choices(blocks)):
        whole = sum(masks[k] for k in choice) & (2**64 - 1)
        out.append(F.struct(F.lit(i).alias("i"), F.col(h).bitwiseAND(F.lit(whole - (1 << 64) if whole >> 63 else whole)).alias("v")))
    return out


def banded(hashes: DataFrame, blocks: int) -> DataFrame:
    """The rows with each of their bands. Few bytes become many rows, so hashes are dealt over all cores before, however few files they are in."""
    dealt = hashes.repartition(2 * hashes.sparkSession.sparkContext.defaultParallelism, "h")
    return dealt.select("*", F.inline(F.array(*bands("h", blocks))))


def first_meeting(a: Column, b: Column, i: Column, blocks: int) -> Column:
    """Whether two hashes that agree in choice ``i`` agree in no block that comes before its last and isn't in it: of the choices in which they agree it is the first."""
    x, agree = a.bitwiseXOR(b), F.lit(0)
    for k, m in enumerate(cuts(blocks)):
        agree = agree + F.when(x.bitwiseAND(F.lit(m)) == 0, 1 << k).otherwise(0)
    before = F.array(*[F.lit(sum(1 << k for k in range(c[-1]) if k not in c)) for c in choices(blocks)])
    return agree.bitwiseAND(F.get(before, i)) == 0


def blocks_for(n: int) -> int:
    """Bands get wider with the number of hashes, 9 to 25 bits, so that few hashes meet that aren't close. A row dealt and sorted costs as much as some thirty that only meet."""
    return next((b for b, most in ((7, 1 << 13), (8, 1 << 21), (9, 1 << 24)) if n <= most), 10)


def near_pairs(hashes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b, similarity) with a < b for hashes (h, id), one id each, that differ in at most ``distance`` (6 or fewer) bits; by an equi-join on bands.

    A pair comes from the first band in which it agrees, so once. Bands are never broadcast: the planner takes their size for that of the hashes, of which there
    are up to 210 times fewer.
    """
    if distance > DISTANCE:
        raise ValueError(f"bands are complete up to {DISTANCE} bits")
    blocks = blocks_for(hashes.count())
    x = banded(hashes.select("id", "h"), blocks)
    a, b = x.toDF("a", "ha", "i", "v"), x.toDF("b", "hb", "i", "v")  # one exchange for both
    close = a.hint("merge").join(b.hint("merge"), ["i", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= distance))
    return close.where(first_meeting(F.col("ha"), F.col("hb"), F.col("i"), blocks)).select("a", "b", hamming_similarity(F.col("ha"), F.col("hb")).alias("similarity"))


def near_links(hashes: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """For hashes (id, h): the near pairs (a, b, similarity) of different hashes, each by its smallest id, and membership (id, first)."""
    first = hashes.groupBy("h").agg(F.min("id").alias("first"))
    return near_pairs(first.select(F.col("first").alias("id"), "h"), distance), hashes.join(first, "h").select("id", "first")


def all_near_pairs(hashes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b, similarity) of all near ids, equal hashes among them: as many rows as there are pairs, so for groups of copies better ``near_links``."""
    pairs, membership = near_links(hashes, distance)
    same = membership.select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    x = pairs.unionByName(same).join(membership.toDF("x", "a"), "a").join(membership.toDF("y", "b"), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def not_seeds(pairs: DataFrame) -> DataFrame:
    """Of the vertices of pairs (a, b), a < b, those (id) that aren't seeds: a seed is one without a smaller seed beside it.

    In rounds over what is still open: vertices without a smaller one beside them are seeds, those beside them aren't, and pairs of the latter are done. A
    written table.
    """
    open_, out = pairs.select("a", "b"), []
    while True:
        firsts = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        out.append(kept(open_.join(firsts, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "not-seeds"))
        left = kept(open_.join(out[-1].withColumnRenamed("id", "a"), "a", "left_anti").join(out[-1].withColumnRenamed("id", "b"), "b", "left_anti").join(firsts, "a", "left_anti"), "open")
        if len(out) > 1:
            dropped(open_)
        if left.isEmpty():
            whole = kept(reduce(DataFrame.unionByName, out), "not-seeds")
            dropped(left, *out)
            return whole
        open_ = left


def homes(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """(id, seed, similarity) of the vertices that aren't seeds: the smallest seed beside each."""
    to_seed = pairs.join(others.withColumnRenamed("id", "a"), "a", "left_anti").join(others.withColumnRenamed("id", "b"), "b", "left_semi")
    return to_seed.groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("m")).select(F.col("b").alias("id"), F.col("m.a").alias("seed"), F.col("m.similarity").alias("similarity"))


def grouped(hashes: DataFrame, first: DataFrame, away: DataFrame, prefix: str) -> DataFrame:
    """(group_key, item_id, similarity) of groups of two or more: hashes (item_id, h), their smallest items (h, id), and the homes of those that are no seeds."""
    home = first.join(away, "id", "left").select("h", F.coalesce("seed", "id").alias("seed"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    members = hashes.where("h is not null").join(home, "h").select("item_id", "seed", "similarity")
    many = members.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    return members.join(many, "seed", "left_semi").select(F.concat(F.lit(prefix + "_"), F.col("seed").cast("string")).alias("group_key"), "item_id", "similarity")


def near_groups(hashes: DataFrame, distance: int = DISTANCE, prefix: str = "simhash") -> DataFrame:
    """(group_key, item_id, similarity) of greedy groups over hashes (item_id, h) in order of item_id.

    An item not yet in a group becomes a seed and takes every later item similar to it. So seeds are the items without a smaller similar seed, found in
    rounds over the pairs that are still open. Equal hashes go with their smallest item throughout: they have the same neighbours.
    """
    hashes = kept(hashes.select("item_id", "h"), "all-hashes")
    first = hashes.where("h is not null").groupBy("h").agg(F.min("item_id").alias("id"))
    pairs = kept(near_pairs(first, distance), "pairs")
    others = not_seeds(pairs)
    out = kept(grouped(hashes, first, homes(pairs, others), prefix), "groups")
    dropped(hashes, pairs, others)
    return out


def group_sizes(members: DataFrame, items: DataFrame) -> DataFrame:
    """Count, bytes and reclaimable bytes of groups given as (group_key, item_id)."""
    x = members.join(items.select("item_id", "size_bytes"), "item_id").groupBy("group_key")
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    return x.agg(F.count("*").alias("item_count"), F.sum(size).alias("total_size"), (F.sum(size) - F.max(size)).alias("reclaimable"))


def dup_stats(sizes: DataFrame) -> DataFrame:
    """Groups of two or more, the bytes of all their members, and those that keeping the largest would free."""
    x = sizes.where("item_count > 1")
    zero = F.lit(0)
    return x.agg(F.count("*").alias("groups"), F.coalesce(F.sum("total_size"), zero).alias("wasted_bytes"), F.coalesce(F.sum("reclaimable"), zero).alias("reclaimable"))


def typed_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """Members (group_key, item_id, similarity) of several types of groups as one table with ``group_type``."""
    out = None
    for kind, members in groups.items():
        x = members.select(F.lit(kind).alias("group_type"), "group_key", "item_id", F.col("similarity").cast("double").alias("similarity"))
        out = x if out is None else out.unionByName(x)
    return out


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored members (group_type, group_key, item_id, similarity) after new groups: a group found again takes its new members, one not found stays."""
    key = ["group_type", "group_key"]
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def image_groups(items: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Near duplicates among live images by ``phash``, as ``near_groups`` gives them."""
    x = items.where("is_deleted = 0 and file_type_group = 'image' and phash is not null").select("item_id", hash_bits(F.col("phash")).alias("h"))
    return near_groups(x, distance, "phash")


def listing(members: DataFrame, items: DataFrame, review: DataFrame | None = None, similar: bool = False, limit: int | None = None, offset: int = 0, page: int = PAGE, start: int = 0) -> DataFrame:
    """One row a group with its members nested, best first; the smallest id is the primary candidate. ``review`` is (group_key, item_id, review_status).

    Groups of equal files come by total size, ``similar`` ones by their number of members. At most ``page`` members are nested, from ``start`` on by similarity
    and id; only the groups of the listing's own page are joined with names and reviews.
    """
    sized = members.join(items.select("item_id", "size_bytes"), "item_id")
    g = sized.groupBy("group_key").agg(F.count("*").alias("item_count"), F.sum("size_bytes").alias("total_size"), F.min("item_id").alias("primary_id"))
    order = [F.desc("item_count" if similar else "total_size"), F.asc("group_key")]
    if limit is not None:
        g = g.orderBy(*order).offset(offset).limit(limit)
        sized = sized.join(F.broadcast(g.select("group_key")), "group_key", "left_semi")  # ``limit`` rows
    x = paged(sized.drop("size_bytes"), "group_key", [F.desc("similarity"), F.asc("item_id")], page, start).drop("_rank")
    x = x.join(items.select("item_id", "file_name", "full_path", "size_bytes"), "item_id")
    x = x.join(review, ["group_key", "item_id"], "left") if review is not None else x.withColumn("review_status", F.lit(None).cast("string"))
    m = F.struct((-F.col("similarity")).alias("order"), "item_id", "file_name", "full_path", "size_bytes", F.coalesce("review_status", F.lit("pending")).alias("review_status"))
    nested = x.groupBy("group_key").agg(F.sort_array(F.collect_list(m)).alias("members"))
    return g.join(nested, "group_key", "left").select("group_key", "item_count", "total_size", "primary_id", F.coalesce("members", F.array().cast(nested.schema["members"].dataType)).alias("members")).orderBy(*order)


def set_review(review: DataFrame, group_key: str, item_id: int, status: str) -> DataFrame:
    other = review.where(~((F.col("group_key") == group_key) & (F.col("item_id") == item_id)))
    return other.unionByName(review.sparkSession.createDataFrame([(group_key, item_id, status)], review.schema))


def memberships(members: DataFrame, item_id: int) -> DataFrame:
    return members.where(F.col("item_id") == item_id).select("group_key", "similarity").orderBy("group_key")
