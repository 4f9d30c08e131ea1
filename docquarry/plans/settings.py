"""Settings as typed values over stored strings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Settings and their defaults.
DEFAULTS = {
    "theme": "dark", "language": "en", "ocr_enabled": "0", "max_extract_size_mb": "50", "ignored_extensions": ".tmp,.log,.lock,.DS_Store",
    "ignored_paths": ".git,.svn,node_modules,__pycache__", "auto_rescan_minutes": "60", "port": "7878", "llm_enabled": "0", "llm_provider": "ollama",
    "llm_base_url": "http://127.0.0.1:11434", "llm_model": "gemma3:4b", "llm_api_key": "", "llm_temperature": "0.2", "llm_top_k": "8", "llm_top_n_results": "8",
    "llm_max_context_chars": "24000", "llm_search_mode": "fts_plus_llm", "llm_auto_summarize": "0",
}
PROMPT = "Answer from the supplied search results only, and say so where they don't suffice."
DEFAULTS["llm_system_prompt"] = PROMPT
# Addresses where none is given, of the one provider and of the others.
ADDRESS = {"ollama": "http://127.0.0.1:11434"}
OTHER_ADDRESS = "http://127.0.0.1:1234"
_KINDS = {"llm_enabled": "bool", "llm_auto_summarize": "bool", "ocr_enabled": "bool", "llm_temperature": "double", **dict.fromkeys(("max_extract_size_mb", "auto_rescan_minutes", "port", "llm_top_k", "llm_top_n_results", "llm_max_context_chars"), "bigint")}


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def as_number(value: Column, kind: str, default: float) -> Column:
    return F.coalesce(F.trim(value).try_cast(kind), F.lit(default).cast(kind))


def typed(stored: Mapping[str, str], changes: Mapping[str, object] | None = None) -> dict:
    """Defaults, what is stored, and changes, the last first; numbers that don't parse take the default."""
    out: dict = {}
    for name, default in DEFAULTS.items():
        value = (changes or {}).get(name)
        value = stored.get(name, default) if value is None else value
        kind = _KINDS.get(name)
        if kind == "bool":
            out[name] = str(value).strip().lower() in ("1", "true", "yes", "on")
        elif kind:
            number = float if kind == "double" else int
            try:
                out[name] = number(value)
            except (TypeError, ValueError):
                out[name] = number(default)
        else:
            out[name] = str(value)
    return out


def stored(values: Mapping[str, object]) -> dict[str, str]:
    """Values as they are stored."""
    return {k: ("1" if v else "0") if isinstance(v, bool) else str(v) for k, v in values.items() if k in DEFAULTS}


def normalised(values: Mapping[str, object]) -> dict:
    """Typed values with the provider's and mode's names in lower case, texts without white space around them, and a complete address without a slash at its end."""
    out = dict(values)
    for name in ("llm_provider", "llm_search_mode"):
        out[name] = (str(out.get(name) or "") or DEFAULTS[name]).strip().lower()
    out["llm_base_url"] = str(out.get("llm_base_url") or "").strip().rstrip("/") or ADDRESS.get(out["llm_provider"], OTHER_ADDRESS)
    out["llm_model"] = str(out.get("llm_model") or "").strip()
    out["llm_system_prompt"] = (str(out.get("llm_system_prompt") or "") or PROMPT).strip()
    return out


class SettingsTable:
    """Settings as rows (name, value) in numbered folders, the last complete one current; ``put`` replaces those it gets and keeps the others."""

    def __init__(self, spark, folder: str):
        from ..streaming.ingest import Snapshots

        self.spark, self.store = spark, Snapshots(spark, folder)

    def all(self) -> dict[str, str]:
        now = self.store.current()
        return {} if now is None else dict(now.select("name", "value").collect())  # a few dozen rows

    def get(self, name: str) -> str | None:
        return self.all().get(name, DEFAULTS.get(name))

    def put(self, changes: Mapping[str, object]) -> dict:
        """Stores changes over what is there, and gives all as typed values."""
        values = normalised(typed(self.all(), changes))
        self.store.commit(self.spark.createDataFrame(sorted(stored(values).items()), "name string, value string").coalesce(1))
        return values
