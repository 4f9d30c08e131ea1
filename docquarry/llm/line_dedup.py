"""Operator 9: line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared trimmed and in lower case, as words between spaces; blank lines stay as they are. Two lines of ``MIN_WORDS`` words or more match if
one word inserted, deleted or replaced turns one into the other (edit distance over words at most 1), shorter ones only if equal. A line is dropped
if an earlier line of the corpus matches it, and so kept if it is the earliest of all that match it. Earlier means a smaller (doc_id, hash of the text, line number).

Equal lines are first brought down to one class, with its earliest place. Two lines at distance 1 share their first or their last half of words,
so classes that share neither with another can't match and emit nothing. Of the others each emits hashed keys of the line and of all its variants with one word
deleted. Keys add up hashes of each word with its place, so that lines of the same words in another order, or with words repeated, have keys of their own;
the variants' keys are running sums. Equal keys meet: lines that delete to
the same words at the same place differ by a replacement, and a line whose variant equals a whole line by an insertion. As keys depend on
all words in order, lines that meet match. So from each group only its earliest lines are taken as partners, never all pairs. The edit distance of a line and
its earliest partner is verified on their words; should a line fail that, its hashes met others by chance, and all its partners are verified.

Null texts stay null and empty ones empty; an empty table gives an empty one. Texts and lines of any length are compared whole. Rows with the same
doc_id and text count as one document and all stay; other rows with that id are further documents; a null doc_id comes first. Extra columns of
the input stay in the result of ``dedup_lines``, those named like its own too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST, free, join_unique, own, scratch, small, table, written

#: Words from which the edit bound is 1; below, one word is too large a part of a line, and the bound is 0.
MIN_WORDS = 8
#: Bytes of a table of candidates or of repeated lines up to which it is broadcast; a larger one is joined by a shuffle.
LIMIT = BROADCAST

_EARLY = ["doc_id", "mark", "line_no"]


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: its place, a 128-bit hash, its number of words and the keys of its halves."""
    lines = own(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    x = lines.select("doc_id", "mark", "line_no", _normal(F.col("line")).alias("s")).where("s <> ''")
    x = x.withColumn("n", F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) + 1)
    half = "case when n >= {m} then array_distinct(array({a})) end".format(
        m=MIN_WORDS, a=", ".join(f"xxhash64('{side}', {p}, substring_index(s, ' ', {sign}({p})))" for side, sign in (("first", ""), ("last", "-")) for p in ("(n - 1) div 2", "n div 2"))
    )
    return x.select(F.struct(*_EARLY).alias("at"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), F.expr(half).alias("halves"))


def candidates(classes: DataFrame) -> DataFrame:
    """The places of classes that share a half with another class (or half of their hash with one that does, which only adds to them)."""
    halves = classes.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    sizes = written(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"), "halves")
    total = classes.agg(F.coalesce(F.sum(F.size("halves")), F.lit(0))).first()[0]
    shared = written(join_unique(halves, sizes.select("half"), "half", sizes, total, "inner", limit=LIMIT).select("h1").distinct(), "shared")
    return classes.join(small(shared, LIMIT), "h1", "left_semi").select("first")


def with_words(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(first, w): the places in ``lines`` with the words of the lines there."""
    wanted = lines.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark")).agg(F.collect_list("first.line_no").alias("numbers"))
    wanted = small(written(wanted, "wanted"), LIMIT)
    texts = own(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text")).alias("t")
    on = (F.col("t.mark") == F.col("l.mark")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))
    found = texts.join(wanted.alias("l"), on).select("t.doc_id", "t.mark", F.split("t.text", "\n", -1).alias("all"), F.explode("numbers").alias("line_no"))
    found = found.select(F.struct(*_EARLY).alias("first"), F.split(_normal(F.get("all", F.col("line_no"))), " ", -1).alias("w"))
    return found.dropDuplicates(["first"])


def variants(lines: DataFrame) -> DataFrame:
    """(first, key, n, place) of each line and of it without each of its words; place is null for the line itself."""
    x = lines.select("first", "w", F.size("w").alias("n"))
    # steps[0]: the line without word 0; steps[i]: word i - 1 comes to place i - 1, and word i, which stood there, goes
    x = x.withColumn("start", F.expr("aggregate(sequence(0, n - 1), 0L, (a, i) -> if(i = 0, a, a ^ xxhash64(w[i], i - 1)))"))
    x = x.withColumn("steps", F.expr("transform(w, (v, i) -> if(i = 0, start, xxhash64(w[greatest(i - 1, 0)], i - 1) ^ xxhash64(v, i - 1)))"))
    # sums of all steps up to each, by doubling
    x = x.withColumn("cuts", F.expr("aggregate(sequence(0, cast(ceil(log2(n)) as int)), steps, (c, k) -> transform(c, (v, i) -> v ^ coalesce(get(c, i - shiftleft(1, k)), 0L)))"))
    x = x.select("first", "n", "cuts", F.expr("cuts[n - 1] ^ xxhash64(w[n - 1], n - 1)").alias("whole"))
    cut = F.expr("transform(cuts, (v, i) -> struct(v as key, n - 1 as n, i as place))")
    every = F.concat(F.array(F.struct(F.col("whole").alias("key"), F.col("n"), F.lit(None).cast("int").alias("place"))), cut)
    return x.select("first", F.explode(every).alias("v")).select("first", F.xxhash64("v.key", "v.n").alias("key"), F.col("v.place").alias("place"))


def meetings(lines: DataFrame) -> DataFrame:
    """The variants whose key another one has too."""
    every = written(variants(lines), "variants")
    repeated = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    return written(join_unique(every, repeated.select("key"), "key", repeated, every.count(), "inner", limit=LIMIT), "meetings")


def partners(met: DataFrame) -> DataFrame:
    """(first, partner): each line with the earliest line before it of those that its keys meet."""
    total = met.count()
    groups = written(met.groupBy("key", "place").agg(F.min("first").alias("early"), F.count("*").alias("n")), "groups")
    by_key = groups.groupBy("key").agg(
        F.min(F.when(F.col("place").isNull(), F.col("early"))).alias("whole"), F.min(F.when(F.col("place").isNotNull(), F.col("early"))).alias("cut"), F.sum("n").alias("n")
    )
    by_key = written(by_key.where("whole is not null and cut is not null"), "by_key")
    a = join_unique(met, by_key.drop("n"), "key", by_key.select("key", "n"), total, "inner", limit=LIMIT)
    a = a.select("first", F.when(F.col("place").isNull(), F.col("cut")).otherwise(F.col("whole")).alias("partner"))
    placed = written(groups.where("n > 1 and place is not null").select(F.xxhash64("key", "place").alias("spot"), "early", "n"), "placed")
    b = join_unique(met.where("place is not null").select("first", F.xxhash64("key", "place").alias("spot")), placed.drop("n"), "spot", placed.select("spot", "n"), total, "inner", limit=LIMIT)
    b = b.select("first", F.col("early").alias("partner"))
    return a.unionByName(b).where("partner < first").groupBy("first").agg(F.min("partner").alias("partner"))


def within_one_edit(a: str, b: str) -> Column:
    """True if the arrays of words in columns ``a`` and ``b`` are at edit distance 1 or less."""
    return F.expr(
        f"""case
        when size({a}) = size({b}) then size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> not e)) <= 1
        when abs(size({a}) - size({b})) <> 1 then false
        else exists(array(case when size({a}) > size({b}) then struct({a} as long, {b} as short) else struct({b} as long, {a} as short) end),
            p -> exists(array(cast(array_position(zip_with(slice(p.long, 1, size(p.short)), p.short, (x, y) -> x = y), false) as int)),
                k -> k = 0 or slice(p.long, k + 1, size(p.long)) = slice(p.short, k, size(p.short))))
        end"""
    )


def verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, ok) for each of the pairs (first, partner): whether they are one edit apart. Many lines may have one partner."""
    pairs = written(pairs, "pairs")
    sizes = written(pairs.groupBy("partner").agg(F.count("*").alias("n")), "partners")
    named = join_unique(pairs, lines.select(F.col("first").alias("partner"), F.col("w").alias("b")), "partner", sizes, pairs.count(), "inner", limit=LIMIT)
    return named.join(lines.select("first", F.col("w").alias("a")), "first").select("first", within_one_edit("a", "b").alias("ok"))


def near_dropped(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The places of classes for which an earlier class is one edit away."""
    lines = written(with_words(docs, written(candidates(classes), "candidates")), "lines")
    met = meetings(lines)
    found = written(verified(lines, partners(met)), "verified")
    chance = found.where("not ok").select("first")
    near = found.where("ok").select("first")
    if chance.isEmpty():
        return near
    other = met.select(F.col("first").alias("partner"), F.col("place").alias("at"), "key")
    every = met.join(chance, "first", "left_semi").join(other, "key").where("partner < first and (place = at or place is null or at is null)")
    return near.unionByName(verified(lines, every.select("first", "partner").distinct()).where("ok").select("first").distinct())


def dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, gone): the numbers of the lines that go, for documents that lose any."""
    seen = written(occurrences(docs), "occurrences")
    classes = seen.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.any_value("halves").alias("halves"))
    classes = written(classes, "classes")
    near = small(written(near_dropped(docs, classes), "near"), LIMIT).withColumn("near", F.lit(True))
    some = classes.select("h1", "h2", "first", "n").join(near, "first", "left").where("n > 1 or near").select(F.struct("h1", "h2").alias("line"), "first", "n", "near")
    some = written(some, "repeated")
    hit = join_unique(seen.select(F.struct("h1", "h2").alias("line"), "at"), some.drop("n"), "line", some.select("line", "n"), seen.count(), "inner", limit=LIMIT)
    gone = hit.where("near or at <> first")
    return gone.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark")).agg(F.collect_set("at.line_no").alias("gone"))


def dedup_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and two more columns by these names: lines before, and those dropped.

    A name that ``docs`` has already gets an underscore added, here and for the columns of the join.
    """
    mark, key, other, gone, n_lines, n_dropped = (free(x, docs.columns) for x in ("_mark", "_key", "_other", "_gone", n_lines, n_dropped))
    with scratch() as keep:
        lost = small(keep(written(dropped(docs), "dropped")), LIMIT).toDF(key, other, gone)
    both = docs.withColumn(mark, F.xxhash64("text")).join(lost, F.expr(f"`{mark}` = `{other}` and doc_id <=> `{key}`"), "left")
    split = "split(text, '\\n', -1)"
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(f"array_join(filter({split}, (x, i) -> not array_contains(`{gone}`, i)), '\\n')"))
    out = [kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*out, F.coalesce(F.size(F.expr(split)), F.lit(0)).cast("bigint").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(n_dropped))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(own(table(spark, sf_dir, "documents"), "doc_id", "text"))
