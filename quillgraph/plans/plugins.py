"""Interfaces for what runs outside Spark, each with an offline stand-in that always answers alike.

A plug-in is a function of pandas Series, called in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Generator(Protocol):
    def __call__(self, questions: pd.Series, contexts: pd.Series) -> pd.Series: ...


class Scorer(Protocol):
    def __call__(self, questions: pd.Series, texts: pd.Series) -> pd.Series: ...


class HashEmbedder:
    """Signed hashes of words, L2-normalised."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: pd.Series) -> pd.Series:
        def one(text):
            v = [0.0] * self.size
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = max(sum(x * x for x in v) ** 0.5, 1e-12)
            return [x / norm for x in v]

        return texts.map(one, na_action=None)


class FirstLineGenerator:
    """Answers with the first evidence and cites it."""

    def __call__(self, questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return contexts.fillna("").map(lambda c: f"【答案】{c.splitlines()[0][:200]} [1]" if c else "【答案】unable to answer")


class OverlapScorer:
    """Share of a question's words that the text holds."""

    def __call__(self, questions: pd.Series, texts: pd.Series) -> pd.Series:
        def one(q, t):
            words = set((q or "").lower().split())
            return len(words & set((t or "").lower().split())) / max(1, len(words))

        return questions.combine(texts, one)


def embed(embedder: Embedder, text: Column) -> Column:
    return F.pandas_udf(lambda s: embedder(s), T.ArrayType(T.DoubleType()), F.PandasUDFType.SCALAR)(text)


def score(scorer: Scorer, question: Column, text: Column) -> Column:
    return F.pandas_udf(lambda q, t: scorer(q, t), T.DoubleType(), F.PandasUDFType.SCALAR)(question, text)


def generate(generator: Generator, question: Column, context: Column) -> Column:
    return F.pandas_udf(lambda q, c: generator(q, c), T.StringType(), F.PandasUDFType.SCALAR)(question, context)
