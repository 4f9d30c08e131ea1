"""Ranked phrase search, wildcard and substring search, and their dispatch."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, plain, search_tokens, spread
from . import listing
from .filters import Filters, glob, has_wildcard, like

K1, B = 1.2, 0.75
NAMES = ("file_name", "full_path", "parent_path", "extension", "title", "camera_model")
ORDERS = {"modified_ts": F.desc, "size_bytes": F.desc, "file_name": F.asc}


@dataclass(frozen=True)
class SearchRequest:
    q: str = ""
    filters: Filters = field(default_factory=Filters)
    search_content: bool = True
    order_by: str | None = None
    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        if not 0 < self.limit <= 200 or self.offset < 0:
            raise ValueError("limit must be 1 to 200, offset 0 or more")


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase follow each other; overlapping ones count each. ``tokens`` should be a column computed ``once``."""
    follow = lambda t, i: t == phrase[0] if len(phrase) == 1 else _all([t == phrase[0], *[F.get(tokens, i + k) == w for k, w in enumerate(phrase[1:], 1)]])
    return F.size(F.filter(tokens, lambda t, i: follow(t, i)))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out & F.coalesce(x, F.lit(False))
    return out


def phrase_tokens(df: DataFrame, q: str) -> list[str]:
    """A query's tokens, by the same expression as the documents'."""
    return df.sparkSession.range(1).select(search_tokens(F.lit(q)).alias("t")).first().t


def bm25(df: DataFrame, q: str, columns: list[str], key: str = "item_id") -> DataFrame:
    """(key, tf, score) of the rows that hold the phrase; the smaller the score the better.

    A phrase counts as one term and lies within one column. Statistics are over all rows of ``df``: one aggregation to a single row, no shuffle of texts.
    """
    words = phrase_tokens(df, q)
    if not words:
        return df.select(F.col(key), F.lit(0).alias("tf"), F.lit(0.0).alias("score")).where("false")
    tokens = once(spread(df.select(key, *columns)), [F.col(key)], **{f"t{i}": search_tokens(F.coalesce(F.col(c), F.lit(""))) for i, c in enumerate(columns)})
    tf, size = F.lit(0), F.lit(0)
    for i in range(len(columns)):
        tf, size = tf + occurrences(F.col(f"t{i}"), words), size + F.size(f"t{i}")
    counted = once(tokens, [F.col(key)], tf=tf, dl=size)
    stats = counted.agg(F.count("*").alias("n"), F.count_if(F.col("tf") > 0).alias("df"), F.avg("dl").alias("avgdl"))
    return scored(counted.where("tf > 0"), stats, key)


def scored(counted: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(key, tf, score) from rows (key, tf, dl) that hold a phrase and the one row (n, df, avgdl) of a corpus."""
    score = scored_by(*[F.col(c) for c in ("n", "df", "tf", "dl", "avgdl")])
    return counted.crossJoin(F.broadcast(stats)).select(key, "tf", score.alias("score"))  # stats is one row


def scored_by(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return -F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def _placed(df: DataFrame, text: str, phrase: list[str], keep: list) -> DataFrame:
    """``keep``, the words of ``text`` as ``_words``, and the words in which runs of places of a phrase open and close as ``_opens`` and ``_closes``; ``_all`` has each place's own first and last word."""
    n = max(1, len(phrase))
    x = once(df, keep, _words=F.split(F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " "))
    tokens = F.flatten(F.transform("_words", lambda w, i: F.transform(search_tokens(w), lambda t: F.struct(t.alias("t"), i.alias("i")))))
    x = once(x, [*keep, F.col("_words")], _tokens=tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_tokens") - n, F.lit(0)))
    there = lambda p: _all([F.lit(bool(phrase)), *[F.get("_tokens", p + k)["t"] == w for k, w in enumerate(phrase)]])
    x = once(x, [*keep, F.col("_words"), F.col("_tokens")], _places=F.filter(starts, there))
    opens = F.filter("_places", lambda p: ~F.exists("_places", lambda q: (q < p) & (p < q + n)))
    closes = F.filter("_places", lambda p: ~F.exists("_places", lambda q: (p < q) & (q < p + n)))
    word = lambda p: F.get("_tokens", p)["i"]
    each = F.transform("_places", lambda p: F.struct(word(p).alias("o"), word(p + (n - 1)).alias("c")))
    return once(x, [*keep, F.col("_words")], _opens=F.transform(opens, lambda p: word(p)), _closes=F.transform(closes, lambda p: word(p + (n - 1))), _all=each)


def _shown_from(begin: Column, width: int) -> Column:
    """``width`` words from one on, places marked."""
    mark = lambda at, i, s: F.when(F.array_contains(at, i + begin), s).otherwise("")
    shown = F.transform(F.slice("_words", begin + 1, F.lit(width)), lambda w, i: F.concat(mark("_opens", i, "<em>"), w, mark("_closes", i, "</em>")))
    return F.concat(F.when(begin > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(F.size("_words") > begin + width, "...").otherwise(""))


def snippets(df: DataFrame, text: str, phrase: list[str], width: int = 20, name: str = "snippet") -> DataFrame:
    """``df`` with a window of ``width`` words of ``text`` as column ``name``.

    It begins four words before the first place where the phrase's tokens follow each other, and there every such place is marked as a
    whole, those that overlap as one; without any it is the text's start. Words lie between white space; one holds no, one or several tokens.
    """
    keep = [F.col(c) for c in df.columns if c != name]
    x = _placed(df, text, phrase, keep)
    begin = F.greatest(F.lit(0), F.coalesce(F.get("_opens", F.lit(0)), F.lit(0)) - 4)
    return x.select(*keep, _shown_from(begin, width).alias(name))


def _places(df: DataFrame, text: str, phrase: list[str], keep: list) -> DataFrame:
    """``keep`` and ``_all``, the first and last word of each place of a phrase as in ``_placed``.

    The text is cut before each place, and words are counted by the spaces between them: only what a place holds is looked at word by word.
    """
    if not phrase:
        return df.select(*keep, F.array().cast("array<struct<o: int, c: int>>").alias("_all"))
    n, gap, end = len(phrase), r"[^\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"
    place = gap.join(re.escape(w) for w in phrase) + end
    x = once(df, keep, _text=F.when(plain(F.col(text)).rlike(place), F.col(text)))  # most texts have none
    x = once(x, keep, _parts=F.split(plain(F.btrim(F.regexp_replace("_text", r"\s+", " "))), rf"(?={place})(?<![\p{{L}}\p{{N}}])"))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" ")))
    x = once(x, [*keep, F.col("_parts")], _ends=F.aggregate(F.transform("_parts", spaces), F.array(F.lit(0)), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + k))))
    whole = lambda i: F.regexp_extract(F.array_join(F.slice("_parts", i + 1, n), ""), f"^{place}", 0)  # noqa: E731  # a place reaches over as many parts as it has tokens, if others begin within it
    each = F.transform("_parts", lambda p, i: F.struct(F.get("_ends", i).alias("o"), F.when(p.rlike(f"^{re.escape(phrase[0])}"), whole(i)).alias("s")))
    held = F.filter(each, lambda e: F.length(e["s"]) > 0)
    return x.select(*keep, F.transform(held, lambda e: F.struct(e["o"].alias("o"), (e["o"] + spaces(e["s"])).alias("c"))).alias("_all")).withColumn("_all", F.coalesce("_all", F.array()))


def best_windows(df: DataFrame, text: str, phrase: list[str], key: str = "item_id", width: int = 20) -> DataFrame:
    """(key, start, matches): the first window of ``width`` words with the most whole places of the phrase; 0 and 0 without any. Keys are unique.

    Places come in order, so those in the window that ends with one's last word are those that close up to there less those that open before the window:
    two running counts over words, as a window function over the words in which something opens or closes.
    """
    x = _places(spread(df.select(key, text)), text, phrase, [F.col(key)])
    w = Window.partitionBy(key).orderBy("w", F.desc("open"))
    place = x.select(key, F.explode("_all").alias("p")).where(F.col("p.c") - F.col("p.o") < width)
    start = F.greatest(F.lit(0), F.col("p.c") - (width - 1))
    closes = place.groupBy(key, F.greatest(F.col("p.c"), F.lit(width - 1)).alias("w")).agg(F.count("*").alias("n"), F.min(start).alias("start"))  # a window that ends with word w
    opens = place.groupBy(key, (F.col("p.o") + width).alias("w")).agg(F.count("*").alias("n"))  # no window that ends with word w or later holds these
    both = closes.select(key, "w", "n", F.lit(0).alias("open"), "start").unionByName(opens.select(key, "w", "n", F.lit(1).alias("open"), F.lit(None).cast("int").alias("start")))
    held = F.sum(F.when(F.col("open") == 1, -F.col("n")).otherwise(F.col("n"))).over(w)
    best = both.withColumn("held", held).where("open = 0").groupBy(key).agg(F.max(F.struct(F.col("held"), (-F.col("start")).alias("back"))).alias("m"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce(-F.col("m.back"), F.lit(0)).alias("start"), F.coalesce("m.held", F.lit(0)).alias("matches"))


def best_snippets(df: DataFrame, text: str, phrase: list[str], key: str = "item_id", width: int = 20, name: str = "snippet") -> DataFrame:
    """As ``snippets``, with the window that ``best_windows`` gives."""
    keep = [F.col(c) for c in df.columns if c != name]
    x = _placed(df, text, phrase, keep).join(best_windows(df, text, phrase, key, width).select(key, "start"), key)
    return x.select(*keep, _shown_from(F.col("start"), width).alias(name))


def _any(df: DataFrame, content: bool, test) -> Column:
    names = [c for c in NAMES if c in df.columns] + (["text"] if content else [])
    out = F.lit(False)
    for c in names:
        out = out | test(F.coalesce(F.col(c), F.lit("")))
    return out


def glob_search(items: DataFrame, q: str, content: bool = True, index=None) -> DataFrame:
    """Items of which a value matches as a whole; with an ``index.GramIndex`` over these columns only its candidates are compared."""
    some = items if index is None else index.narrowed(items, q, True)
    return some.where(_any(items, content, lambda c: glob(c, q if has_wildcard(q) else f"*{q}*")))


def like_search(items: DataFrame, q: str, content: bool = True, index=None) -> DataFrame:
    """Items of which a value holds ``q``; ``index`` as for ``glob_search``."""
    some = items if index is None else index.narrowed(items, q, False)
    return some.where(_any(items, content, lambda c: like(c, f"%{q}%")))


def _page(df: DataFrame, r: SearchRequest, default: list[Column]) -> DataFrame:
    order = [ORDERS[r.order_by](r.order_by), F.asc("item_id")] if r.order_by in ORDERS else default
    return df.orderBy(*order).offset(r.offset).limit(r.limit)


def _shown(found: DataFrame) -> DataFrame:
    """The columns of listings and those that searches add; the preview is the text's begin where there is none."""
    if "text" in found.columns and "content_preview" not in found.columns:
        found = found.withColumn("content_preview", F.substring("text", 1, 400))
    return listing.shown(found, listing.FOUND)


def search(items: DataFrame, r: SearchRequest, columns: list[str] | None = None, index=None, grams=None) -> DataFrame:
    """Dispatch by the query: blank gives the latest items, wildcards GLOB, else ranked phrases, and substrings if no phrase is found.

    With ``index``, an ``index.TextIndex`` over the items, ranks come from its postings and no text is read but that of the page's rows; with ``grams``, an
    ``index.GramIndex``, wildcards and substrings are compared with its candidates only. A page has ``limit`` rows, which the driver holds between the
    ranking and the rest, so that the ranking runs once. Rows have the columns of listings and those that searches add.
    """
    latest = "last_indexed_ts" if "last_indexed_ts" in items.columns else "modified_ts"
    recent = [F.desc(latest), F.asc("item_id")]
    live = r.filters.column()
    if not r.q.strip():
        return _shown(_page(items.where(live), r, recent))
    if has_wildcard(r.q):
        return _shown(_page(glob_search(items.where(live), r.q, r.search_content, grams), r, recent))
    indexed = columns or [c for c in ("file_name", "full_path", "text", "title") if c in items.columns]
    ranks = bm25(items, r.q, indexed) if index is None else index.bm25(r.q)  # statistics are over all items, deleted ones too
    order = [F.asc("score"), F.asc("item_id")]
    rows = _page(items.where(live).join(ranks, "item_id"), r, order).select("item_id", "score").collect()  # at most ``limit``
    if rows:
        page = items.sparkSession.createDataFrame(rows, f"item_id {items.schema['item_id'].dataType.simpleString()}, score double")
        found = items.where(F.col("item_id").isin([x.item_id for x in rows])).join(F.broadcast(page), "item_id")
        if "text" in items.columns:
            found = snippets(found, "text", phrase_tokens(items, r.q))
        return _shown(found.orderBy(*([ORDERS[r.order_by](r.order_by), F.asc("item_id")] if r.order_by in ORDERS else order)))
    return _shown(_page(like_search(items.where(live), r.q, r.search_content, grams), r, recent))
