"""Text encoders. An encoder is picklable and maps a list of texts to a matrix of float32 rows of unit length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass
class HashedNgrams:
    """Character n-grams hashed into a vector: needs no model, tells spellings apart, the same everywhere."""

    dim: int = 256
    sizes: tuple[int, ...] = (3, 4)
    model_id: str = "hashed-ngrams"
    pooling: str = "sum"
    max_length: int | None = None

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            t = f" {(t or '')[: self.max_length]} "
            h = np.array([zlib.crc32(t[a : a + n].encode()) for n in self.sizes for a in range(len(t) - n + 1)] or [0], np.int64)
            np.add.at(out[i], h % self.dim, np.where(h >> 16 & 1, 1.0, -1.0))
        return unit_rows(out)


def resolved_device(device: str | None = None) -> str:
    """The device asked for; `auto` or nothing: the first of cuda, mps and cpu that there is."""
    if device and device != "auto":
        return device
    try:
        import torch
    except ImportError:
        return "cpu"
    mps = getattr(torch.backends, "mps", None)
    return "cuda" if torch.cuda.is_available() else "mps" if mps is not None and mps.is_available() else "cpu"


def resolved_model(model_id: str) -> str:
    """A model's local folder as an absolute path, anything else as it is."""
    return os.path.abspath(os.path.expanduser(model_id)) if os.path.exists(os.path.expanduser(model_id)) else model_id


@dataclass
class TokenModel:
    """Token vectors of a transformers model, which has to be installed with torch; loaded once in each worker."""

    model_id: str
    max_length: int = 128
    trust_remote_code: bool = False
    device: str | None = "cpu"

    def hidden(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, tokens, width) vectors and (texts, tokens) mask; without texts no rows, but the model's width."""
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as e:
            raise ImportError("this model needs torch and transformers") from e
        if "_model" not in self.__dict__:
            name, device = resolved_model(self.model_id), resolved_device(self.device)
            self._tokenizer = AutoTokenizer.from_pretrained(name, trust_remote_code=self.trust_remote_code)
            self._model = AutoModel.from_pretrained(name, trust_remote_code=self.trust_remote_code).to(device).eval()
            self._at = device
        if not texts:
            return np.zeros((0, 0, self._model.config.hidden_size), np.float32), np.zeros((0, 0), bool)
        with torch.no_grad():
            batch = self._tokenizer(texts, padding=True, truncation=True, max_length=self.max_length, return_tensors="pt").to(self._at)
            return self._model(**batch).last_hidden_state.float().cpu().numpy(), batch["attention_mask"].cpu().numpy().astype(bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def pooled(hidden: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """A vector a text: that of its first token (cls), or the mean of its tokens (mean)."""
    if pooling not in ("cls", "mean"):
        raise ValueError(f"no pooling {pooling}")
    if not len(hidden):
        return np.zeros((0, hidden.shape[-1]), np.float32)
    if pooling == "cls":
        return hidden[:, 0]
    return (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)


@dataclass
class Transformer(TokenModel):
    """A sentence encoder: unit vectors, pooled."""

    pooling: str = "cls"

    def __call__(self, texts: list[str]) -> np.ndarray:
        return unit_rows(pooled(*self.hidden([t or "" for t in texts]), self.pooling))


@dataclass
class LateInteraction(TokenModel):
    """A reranker's encoder: the token vectors of each text, without padding."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        vectors, mask = self.hidden([t or "" for t in texts])
        return [v[m] for v, m in zip(vectors, mask, strict=True)]


def encoder(model_id: str | None, pooling: str = "cls", max_length: int = 128, trust_remote_code: bool = False, device: str | None = "cpu") -> Callable[[list[str]], np.ndarray]:
    return HashedNgrams() if not model_id or model_id == HashedNgrams.model_id else Transformer(model_id, max_length, trust_remote_code, device, pooling)


def encoded(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], out: str = "vector", batch_size: int = 256) -> DataFrame:
    """df with a vector of each text, in batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch_size):
                rows.extend(encode([t or "" for t in texts.iloc[at : at + batch_size]]))
            yield pd.Series(rows)

    return df.withColumn(out, run(text))
