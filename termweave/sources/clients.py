"""Language models behind HTTP or a local binding. A client is picklable and maps a prompt to text."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib import error, request

SYSTEM = "You rank medical terms. Answer with the JSON that is asked for and nothing else."
RANKING = {"type": "object", "properties": {"concept_ids": {"type": "array", "items": {"type": "integer"}}}, "required": ["concept_ids"], "additionalProperties": False}
#: Fixed values. Where answers hold their text: directly, or further down.
_TEXT_KEYS = ("response", "text", "output_text", "delta", "content", "value")
_NESTED_KEYS = ("messages", "output", "result", "choices")


def messages(prompt: str, system: str = SYSTEM) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": prompt}]


def found_text(payload: Any) -> str | None:
    """The first text of an answer: text keys before nested ones, those before any others, each depth first."""
    if isinstance(payload, str):
        return payload.strip() or None
    if isinstance(payload, list):
        return next((t for x in payload if (t := found_text(x))), None)
    if isinstance(payload, dict):
        other = [k for k in payload if k not in (*_TEXT_KEYS, *_NESTED_KEYS, "type")]
        keys = [k for k in (*_TEXT_KEYS, *_NESTED_KEYS) if k in payload] + other
        return next((t for k in keys if (t := found_text(payload[k]))), None)
    return None


def cut(text: str, stop: Sequence[str] | None) -> str:
    for token in stop or ():
        if token and token in text:
            return text.split(token, 1)[0].rstrip()
    return text


def post(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float | None = None) -> tuple[str, str]:
    """Body and content type."""
    req = request.Request(url, data=json.dumps(payload).encode(), headers={"Content-Type": "application/json"} | (headers or {}), method="POST")
    try:
        with request.urlopen(req, timeout=timeout) as r:
            return r.read().decode("utf-8"), r.headers.get("content-type", "")
    except error.HTTPError as e:
        raise RuntimeError(f"{url} answered {e.code}: {e.read().decode('utf-8', 'ignore') or e.reason}") from e
    except error.URLError as e:
        raise RuntimeError(f"{url} cannot be reached: {e.reason}") from e


def _json(body: str) -> Any:
    try:
        return json.loads(body) if body else {}
    except json.JSONDecodeError as e:
        raise RuntimeError(f"no JSON: {body}") from e


def _secret(given: str | None, name: str) -> str:
    if not (value := given or os.getenv(name)):
        raise ValueError(f"{name} is not set")
    return value


@dataclass
class Client:
    """What all clients share: the sampling options and stop texts."""

    max_tokens: int = 512
    temperature: float = 0.0
    stop: tuple[str, ...] = ()

    def __call__(self, prompt: str) -> str:
        if not prompt:
            raise ValueError("an empty prompt")
        return cut(self.answer(prompt).strip(), self.stop)

    def answer(self, prompt: str) -> str:
        raise NotImplementedError


@dataclass
class Cloudflare(Client):
    model: str = "@cf/openai/gpt-oss-20b"
    account_id: str | None = None
    api_token: str | None = None
    base_url: str = "https://api.cloudflare.com/client/v4"
    use_responses: bool = True
    reasoning: dict[str, str] = field(default_factory=dict)

    def request(self, prompt: str) -> tuple[str, dict]:
        root = f"{self.base_url.rstrip('/')}/accounts/{_secret(self.account_id, 'CLOUDFLARE_ACCOUNT_ID')}/ai"
        model = self.model if self.model.startswith("@cf/") else f"@cf/{self.model}"
        if self.use_responses and not model.lower().startswith("@cf/meta/"):
            return f"{root}/v1/responses", {"model": model, "input": messages(prompt)} | ({"reasoning": self.reasoning} if self.reasoning else {})
        return f"{root}/run/{model}", {"messages": messages(prompt)}

    def answer(self, prompt: str) -> str:
        url, payload = self.request(prompt)
        body, kind = post(url, payload, {"Authorization": f"Bearer {_secret(self.api_token, 'CLOUDFLARE_API_TOKEN')}"})
        if kind.startswith("text/event-stream"):
            events = [x[5:].strip() for x in body.splitlines() if x.startswith("data:")]
            parts = []
            for e in events:
                try:
                    parts.append(found_text(json.loads(e)) or "")
                except json.JSONDecodeError:
                    continue
            return "".join(parts)
        if (text := found_text(_json(body))) is None:
            raise RuntimeError(f"no text in {body}")
        return text


@dataclass
class OpenRouter(Client):
    model: str = "openrouter/polaris-alpha"
    api_key: str | None = None
    base_url: str = "https://openrouter.ai/api/v1"

    def request(self, prompt: str) -> tuple[str, dict]:
        form = {"type": "json_schema", "json_schema": {"name": "ranking", "strict": True, "schema": RANKING}}
        return f"{self.base_url.rstrip('/')}/chat/completions", {"model": self.model, "messages": messages(prompt), "temperature": self.temperature, "response_format": form}

    def answer(self, prompt: str) -> str:
        url, payload = self.request(prompt)
        got = _json(post(url, payload, {"Authorization": f"Bearer {_secret(self.api_key, 'OPENROUTER_API_KEY')}"})[0])
        try:
            content = got["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise RuntimeError(f"no message in {got}") from e
        return content if isinstance(content, str) else found_text(content) or ""


@dataclass
class Ollama(Client):
    model: str = "openai/gpt-oss-20b"
    base_url: str = "http://localhost:11434"
    timeout: float = 240
    keep_alive: str | None = None

    def request(self, prompt: str) -> tuple[str, dict]:
        options = {"temperature": self.temperature, "num_predict": self.max_tokens} | ({"stop": list(self.stop)} if self.stop else {})
        return f"{self.base_url.rstrip('/')}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "format": RANKING, "options": options} | ({"keep_alive": self.keep_alive} if self.keep_alive else {})

    def answer(self, prompt: str) -> str:
        url, payload = self.request(prompt)
        return str(_json(post(url, payload, timeout=self.timeout)[0]).get("response") or "")


@dataclass
class LlamaServer(Client):
    base_url: str = "http://127.0.0.1:8080"
    timeout: float = 240

    def request(self, prompt: str) -> tuple[str, dict]:
        return f"{self.base_url.rstrip('/')}/completion", {"prompt": prompt, "stream": False, "n_predict": self.max_tokens, "temperature": self.temperature, "json_schema": RANKING} | ({"stop": list(self.stop)} if self.stop else {})

    def answer(self, prompt: str) -> str:
        url, payload = self.request(prompt)
        got = _json(post(url, payload, timeout=self.timeout)[0])
        return str(got.get("content") or found_text(got) or "")


@dataclass
class LlamaLocal(Client):
    """A model file through llama-cpp-python, which has to be installed; loaded once in each worker."""

    model_path: str = ""
    n_ctx: int = 8192
    n_gpu_layers: int = -1
    n_threads: int | None = None
    chat_format: str | None = None
    system: str | None = None

    def answer(self, prompt: str) -> str:
        try:
            from llama_cpp import Llama
        except ImportError as e:
            raise ImportError("this client needs llama-cpp-python") from e
        if "_model" not in self.__dict__:
            self._model = Llama(model_path=self.model_path, n_ctx=self.n_ctx, n_gpu_layers=self.n_gpu_layers, n_threads=self.n_threads, chat_format=self.chat_format)
        if self.chat_format:
            said = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
            return self._model.create_chat_completion(messages=said, max_tokens=self.max_tokens, temperature=self.temperature)["choices"][0]["message"]["content"]
        return self._model(prompt, max_tokens=self.max_tokens, temperature=self.temperature)["choices"][0]["text"]


PROVIDERS = {"cloudflare": Cloudflare, "openrouter": OpenRouter, "ollama": Ollama, "llamacpp": LlamaServer, "llamacpp-local": LlamaLocal}


def client(provider: str, **options) -> Client:
    if provider.lower() not in PROVIDERS:
        raise ValueError(f"no provider {provider}; there are {', '.join(PROVIDERS)}")
    return PROVIDERS[provider.lower()](**{k: v for k, v in options.items() if v is not None})
