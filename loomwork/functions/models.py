"""Plug points for models: embedders, generators and judges, with offline stand-ins.

The stand-ins need no network: the embedder is lexical and the generator repeats the best chunk. Neither is a
language model; a remote one can be put in their place by implementing the same method.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import SLICE, term_counts


class Embedder(Protocol):
    def embed(self, texts: list[str | None]) -> np.ndarray:
        """(texts, dimensions) vectors; called in tasks, a batch at a time."""


class Generator(Protocol):
    def generate(self, prompts: list[str], contexts: list[list[str]]) -> list[str]:
        """An answer to each prompt; contexts are the chunks that the prompt quotes, best first."""


class TermEmbedder:
    """Unit vectors of hashed term counts; a text without a term is the zero vector."""

    def embed(self, texts: list[str | None]) -> np.ndarray:
        counts = np.array([term_counts(t) for t in texts], float).reshape(len(texts), -1)
        counts /= np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1)  # a norm of counts is 0, or 1 at least
        return counts


class ExtractiveGenerator:
    """Answers with the best chunk."""

    def generate(self, prompts: list[str], contexts: list[list[str]]) -> list[str]:
        return [c[0] if len(c) else "" for c in contexts]


def embed_column(text: Column, embedder: Embedder) -> Column:
    """The vectors of texts, SLICE of them embedded at once; what a worker holds of a batch are its vectors alone."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE)]
        made = [embedder.embed(part).astype(np.float32) for part in parts]
        ends = np.cumsum([0, *(m.shape[1] for m in made for _ in range(len(m)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.float32), *(m.ravel() for m in made)])))

    return vectors(text)


def generate_column(prompt: Column, context: Column, generator: Generator) -> Column:
    @F.pandas_udf("string")
    def answers(prompts: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series(generator.generate(prompts.tolist(), [list(c) for c in contexts]), dtype=object)

    return answers(prompt, context)
