"""Sentence vectors: a model that each worker loads once, and vectors kept by model and text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ledger import Ledger
from ..shared import discard, written
from .enrich import text_hash

# Fixed value of the batches.
BATCH = 32
VECTOR = T.ArrayType(T.FloatType())
VECTORS = T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("embedding", VECTOR)])

Encode = Callable[[list[str]], np.ndarray]
#: The models that this process has loaded, by key.
_LOADED: dict[str, Encode] = {}


class Encoder(Protocol):
    """``key`` names the model with its version, ``load`` makes a function from texts to a row of floats each; it runs in workers."""

    key: str

    def load(self) -> Encode: ...


@dataclass(frozen=True)
class HashedEncoder:
    """An offline stand-in for a sentence model: counts of words by their MD5, of unit length; no words give zeros."""

    size: int = 256

    @property
    def key(self) -> str:
        return f"hashed-words-{self.size}"

    def load(self) -> Encode:
        places: dict[str, int] = {}

        def place(word: str) -> int:
            if (at := places.get(word)) is None:
                if len(places) >= 1_000_000:
                    places.clear()
                at = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.size
            return at

        def counts(text: str) -> np.ndarray:
            return np.bincount(np.array([place(w) for w in re.findall("[a-z0-9]+", text.lower())], np.int64), minlength=self.size)

        def encode(texts: list[str]) -> np.ndarray:
            found = np.stack([counts(t) for t in texts]).astype(float)
            return found / np.maximum(np.sqrt((found**2).sum(axis=1, keepdims=True)), 1e-12)

        return encode


def loaded(encoder: Encoder) -> Encode:
    """The model of this process, loaded by the first call with its key."""
    if encoder.key not in _LOADED:
        _LOADED[encoder.key] = encoder.load()
    return _LOADED[encoder.key]


def embed(df: DataFrame, text: str, encoder: Encoder, batch_size: int = BATCH) -> DataFrame:
    """``df`` with ``embedding`` (floats) of its column ``text``; a null counts as the empty text. An embedding that was there is replaced."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        encode = loaded(encoder)
        return lambda texts: np.asarray(encode([t or "" for t in texts]), np.float32)

    vector = predict_batch_udf(make, return_type=VECTOR, batch_size=batch_size)
    return df.withColumn("embedding", vector(F.coalesce(text, F.lit(""))))


def vector_ledger(df: DataFrame, encoder: Encoder, path: str) -> Ledger:
    """The ledger below ``path`` of one model's vectors, a row for each text."""
    return Ledger(df.sparkSession, f"{path.rstrip('/')}/{hashlib.sha256(encoder.key.encode()).hexdigest()[:16]}", VECTORS, "text_hash")


def embed_resumable(df: DataFrame, text: str, encoder: Encoder, path: str, every: int = 1_000_000, batch_size: int = BATCH) -> DataFrame:
    """``embed`` by way of a ledger below ``path``: only texts that this model has not encoded yet pass through it.

    Waiting texts, each once, are dealt by their hash into parts of about ``every`` and each is committed once written,
    so a run that was killed repeats no committed part. Another ``key`` has a ledger of its own.
    """
    ledger = vector_ledger(df, encoder, path)
    hashed = df.withColumn("_text_hash", text_hash(f"`{text}`"))
    waiting = hashed.select(F.col("_text_hash").alias("text_hash"), F.col(f"`{text}`").alias("text")).dropDuplicates(["text_hash"])
    waiting = written(ledger.pending(waiting), "unencoded")
    rounds = -(-waiting.count() // every)
    for k in range(rounds):
        ledger.append(embed(waiting.filter(F.pmod(F.xxhash64("text_hash"), F.lit(rounds)) == k), "text", encoder, batch_size))
    discard(waiting)
    found = ledger.latest().select(F.col("text_hash").alias("_text_hash"), "embedding")
    return hashed.drop("embedding").join(found, "_text_hash", "left").drop("_text_hash")
