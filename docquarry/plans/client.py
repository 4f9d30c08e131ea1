"""Clients of language-model servers over HTTP, for ``rag.ask``; they run on the driver and send nothing unless they are called."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

LIST_TIMEOUT, CHAT_TIMEOUT = 20, 90


def _request(url: str, body: dict | None, key: str, timeout: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    data = None if body is None else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, head), timeout=timeout) as r:
            return json.loads(r.read() or b"{}")
    except (urllib.error.URLError, ValueError, OSError) as e:
        raise RuntimeError(f"{url}: {e}") from e


class Client:
    """Of a provider: ``ollama`` has its own protocol, ``openai`` and ``lmstudio`` share one."""

    def __init__(self, settings: dict, send: Callable[[str, dict | None, str, float], dict] = _request):
        self.provider, self.base = settings["llm_provider"], settings["llm_base_url"].rstrip("/")
        if self.provider not in ("ollama", "openai", "lmstudio"):
            raise ValueError(f"unknown provider {self.provider}")
        self.model, self.key, self.temperature, self.send = settings["llm_model"], settings.get("llm_api_key", ""), settings["llm_temperature"], send
        if self.provider != "ollama" and not self.base.endswith("/v1"):
            self.base += "/v1"

    def models(self) -> list[str]:
        if self.provider == "ollama":
            return [m["name"] for m in self.send(f"{self.base}/api/tags", None, self.key, LIST_TIMEOUT).get("models", [])]
        return [m["id"] for m in self.send(f"{self.base}/models", None, self.key, LIST_TIMEOUT).get("data", [])]

    def test(self) -> dict:
        """Whether the server answers and has the model."""
        try:
            names = self.models()
        except RuntimeError as e:
            return {"ok": False, "models": [], "message": str(e)}
        return {"ok": True, "models": names, "message": "model found" if self.model in names else "model not listed"}

    def __call__(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        if self.provider == "ollama":
            out = self.send(f"{self.base}/api/chat", {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": self.temperature}}, self.key, CHAT_TIMEOUT)
            return out.get("message", {}).get("content", "")
        out = self.send(f"{self.base}/chat/completions", {"model": self.model, "messages": messages, "temperature": self.temperature}, self.key, CHAT_TIMEOUT)
        choices = out.get("choices") or [{}]
        return choices[0].get("message", {}).get("content", "")
