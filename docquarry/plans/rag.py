"""Context for question answering from search results, and answers by an injected client."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import collapsed
from ..operators.search import SearchRequest, search


def context(results: DataFrame, order: list, max_items: int = 8, max_chars: int = 24_000) -> DataFrame:
    """One row (context): numbered blocks of the first results, cut to a budget of characters that doesn't count the newlines between blocks.

    Only ``max_items`` rows, found by a top-k sort, come to the window.
    """
    text = lambda c, none="": F.coalesce(F.col(c).cast("string"), F.lit(none)) if c in results.columns else F.lit(none)
    pick = [F.nullif(F.trim(text(c)), F.lit("")) for c in ("snippet", "content_preview")]
    top = results.orderBy(*order).limit(max_items)
    rank = F.row_number().over(Window.orderBy(*order))
    block = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] item_id="), text("item_id"), F.lit("\nfile_name: "), text("file_name"), F.lit("\nfull_path: "), text("full_path"),
        F.lit("\nextension: "), text("extension"), F.lit("\nfile_type_group: "), text("file_type_group"), F.lit("\nsize_bytes: "), text("size_bytes", "0"),
        F.lit("\nbest_time_ts: "), F.coalesce(F.nullif(F.nullif(text("best_time_ts"), F.lit("0")), F.lit("")), F.nullif(text("modified_ts"), F.lit("")), F.lit("0")), F.lit("\npreview: "), collapsed(F.coalesce(*pick, F.lit(""))), F.lit("\n"),
    )
    x = top.withColumn("n", rank).withColumn("block", block)
    before = F.coalesce(F.sum(F.length("block")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("block", F.substring("block", F.lit(1), F.greatest(F.lit(0), F.lit(max_chars) - before).cast("int")))
    return x.where("block <> ''").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]), "\n").alias("context"))


def ask(items: DataFrame, question: str, settings: dict, client: Callable[[str, str], str] | None = None, limit: int = 12) -> dict:
    """Searches and, where answers are enabled, has the client answer from what was found. ``client(system, user)`` returns the answer."""
    results = search(items, SearchRequest(q=question, limit=min(limit or 20, 50)))
    found = [r.asDict() for r in results.collect()]  # at most 50 rows
    out: dict = {"results": found, "llm": None}
    if not settings.get("llm_enabled") or settings.get("llm_search_mode") == "fts_only" or client is None:
        return out
    order = [F.asc("score"), F.asc("item_id")] if "score" in results.columns else [F.asc("item_id")]
    n, budget = max(1, int(settings.get("llm_top_n_results", 8))), max(2000, int(settings.get("llm_max_context_chars", 24_000)))
    text = context(results, order, n, budget).first().context
    if not (text or "").strip():
        return out
    answer = client(settings.get("llm_system_prompt", ""), f"Question: {question}\n\nSearch results:\n{text}")
    out["llm"] = {"answer": answer, "context_chars": len(text), "used_results": min(n, len(found))}
    return out
