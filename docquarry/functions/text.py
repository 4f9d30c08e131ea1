"""Tokens, simhash and Hamming similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics and the letters below them; then combining marks, which have none and go."""
    pairs = {}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(n).lower()
        below = unicodedata.normalize("NFD", c)[0]
        if len(c) == 1 and below != c and "a" <= below <= "z":
            pairs[c] = below
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


#: Accented letters and what they are folded to for search; what is beyond the second string's end is left out.
ACCENTED, PLAIN = _folding()


#: Bits of a count of shingles, 15 at most; four of them, 16 bits apart, fit in a number.
LANE = 15


def word_runs(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case without accents."""
    return F.regexp_extract_all(plain(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ascii_only(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def plain(text: Column) -> Column:
    """In lower case without accents; texts of ASCII have none to look for."""
    return F.when(ascii_only(text), F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, PLAIN))


def spaced(text: Column) -> Column:
    """``plain`` with spaces for what is beyond ASCII and neither letter nor digit: ``search_tokens`` are the runs of letters and digits of ASCII and of anything beyond it."""
    return F.when(ascii_only(text), F.lower(text)).otherwise(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\x00-\x7F\p{L}\p{N}]+", " "))


def once(df: DataFrame, keep: list[Column], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each computed once a row however often what follows refers to it.

    Rows pass through a generator, into which Catalyst neither merges later expressions nor pushes filters: else an array of tokens that
    a lambda reads would be made anew for each element.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer input partitions than cores (one file of one row group, say) dealt over all cores; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shingles(tokens: Column, n: int = 3) -> Column:
    """Runs of ``n`` tokens joined by spaces, with repeats; fewer tokens stand alone. ``tokens`` should be a column computed ``once``."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) < n, tokens).otherwise(runs)


def simhash(df: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """(key, simhash64): 64 votes of the shingles' md5 as 16 hex digits; null for texts that are null or shorter than ``least``.

    Votes are sums in one partial aggregation, four bits' counts in one number, so what is shuffled is a row for each 2^14 shingles of a document. Shingles are
    places in the array of words until they are hashed: no array of them is made.
    """
    x = once(spread(df.select(key, F.when(F.length(text) >= least, F.col(text)).alias("t"))), [F.col(key)], w=word_runs(F.col("t")))
    n = F.size("w")
    places = F.when(n > 0, F.sequence(F.lit(0), F.when(n < 3, n - 1).otherwise(n - 3)))
    x = x.select(key, "w", F.explode_outer(places).alias("pos"))
    shingle = F.when(F.size("w") < 3, F.get("w", F.col("pos"))).otherwise(F.concat_ws(" ", *[F.get("w", F.col("pos") + k) for k in range(3)]))
    x = x.select(key, F.col("w").isNotNull().alias("ok"), "pos", F.when(F.col("pos").isNotNull(), shingle).alias("s"))
    x = x.select(key, "ok", F.shiftright("pos", LANE - 1).alias("part"), F.conv(F.substring(F.md5("s"), 17, 16), 16, -10).cast("bigint").alias("h"))  # the low half, as a signed number
    lanes = [F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x0001000100010001)) for k in range(16)]
    parts = x.groupBy(key, "part").agg(F.max("ok").alias("ok"), F.count("h").alias("n"), *[F.sum(v).alias(f"v{k}") for k, v in enumerate(lanes)])
    ones = [F.sum(F.shiftright(f"v{b % 16}", b // 16 * 16).bitwiseAND(0xFFFF)).alias(f"b{b}") for b in range(64)]
    total = parts.groupBy(key).agg(F.max("ok").alias("ok"), F.sum("n").alias("n"), *ones)
    out = F.lit(0).cast("bigint")
    for b in range(64):
        out = out.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)).cast("bigint"))
    return total.select(key, F.when(F.col("ok"), F.lpad(F.lower(F.hex(out)), 16, "0")).alias("simhash64"))


def hash_bits(hex16: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    hi = F.conv(F.substring(hex16, 1, 8), 16, 10).cast("bigint")
    return F.shiftleft(hi, 32).bitwiseOR(F.conv(F.substring(hex16, 9, 8), 16, 10).cast("bigint"))


def hamming_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 64 of two numbers; 0 if one is missing."""
    return F.coalesce(1 - F.bit_count(a.bitwiseXOR(b)) / 64.0, F.lit(0.0))
