"""Embedders: the protocol, a registry by model name, and the Arrow UDF that runs one on the workers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from inkwell.config import MODELS


class Embedder(Protocol):
    """Texts to unit vectors; notes and queries go through the same call."""

    space: str
    dim: int
    model_id: str

    def embed(self, inputs: list[str]) -> list[list[float]]: ...


def known_dim(model: str) -> int:
    if model not in MODELS and not model.startswith("onnx:"):
        raise ValueError(f"unknown text model {model!r}; choose one of {', '.join(MODELS)}")
    return MODELS.get(model, 0)


class HashingEmbedder:
    """Stand-in that needs no model files: signed hashed words and word pairs, unit length. Its scores mean word overlap, not meaning."""

    space = "text"

    def __init__(self, model: str):
        self.dim, self.model_id = known_dim(model), model

    def embed(self, inputs: list[str]) -> list[list[float]]:
        out = []
        for text in inputs:
            v = np.zeros(self.dim)
            words = re.findall(r"\w+", text.lower()) or [""]
            for feature in (*words, *map(" ".join, zip(words, words[1:]))):
                h = int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            if not n:
                v[0] = n = 1.0
            out.append((v / n).astype(np.float32).tolist())
        return out


class OnnxEmbedder:
    """A sentence encoder in a folder with model.onnx and tokenizer.json: `onnx:<folder>`. First-token pooling, unit length."""

    space = "text"

    def __init__(self, model: str):
        import onnxruntime
        from tokenizers import Tokenizer

        folder = Path(model.removeprefix("onnx:"))
        self.model_id = model
        self.tokenizer = Tokenizer.from_file(str(folder / "tokenizer.json"))
        self.tokenizer.enable_truncation(512)
        self.tokenizer.enable_padding()
        self.session = onnxruntime.InferenceSession(str(folder / "model.onnx"))
        self.dim = int(self.session.get_outputs()[0].shape[-1])

    def embed(self, inputs: list[str]) -> list[list[float]]:
        if not inputs:
            return []
        encoded = self.tokenizer.encode_batch(inputs)
        feed = {"input_ids": np.array([e.ids for e in encoded]), "attention_mask": np.array([e.attention_mask for e in encoded]), "token_type_ids": np.array([e.type_ids for e in encoded])}
        out = self.session.run(None, {i.name: feed[i.name] for i in self.session.get_inputs()})[0][:, 0]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32).tolist()


@lru_cache(maxsize=2)
def embedder(model: str) -> Embedder:
    """One instance for each model and process."""
    return OnnxEmbedder(model) if model.startswith("onnx:") else HashingEmbedder(model)


def embedded(text: Column, model: str) -> Column:
    """Vector of each text; batches cross files, and a worker loads its model once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = embedder(model)
        for texts in batches:
            yield pd.Series(own.embed(["" if t is None else t for t in texts]), dtype=object)

    return run(text)
