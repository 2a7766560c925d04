"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by what can be counted in it (shares of
character classes, how words repeat, how long they are); gated attention weighs the passages, and a
logistic function scores the weighted sum of their hidden representations. Labels are the documents';
which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample

#: Words of a passage, and passages of a document that are encoded at a time.
PASSAGE_WORDS = 120
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY, SEED = 150, 0.02, 1e-4, 7
THRESHOLD = 0.7
#: Classes of UTF-8 bytes: lower, upper, digit, white space, sentence marks, !, ?, |, other marks, brackets and quotes, beyond ASCII, control.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:", "!", "?", "|", "#$%&*+=<>@^_~/\\`", "()[]{}'\"-")
FEATURES = len(GROUPS) + 2 + 8


def _table() -> np.ndarray:
    table = np.full(256, len(GROUPS) + 1, np.uint8)
    table[128:] = len(GROUPS)
    for k, group in enumerate(GROUPS):
        table[[ord(c) for c in group]] = k
    return table


TABLE = _table()


def encode(text: str | None) -> np.ndarray:
    """A row of FEATURES for each passage; a text without words is one passage of zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES))
    classes = TABLE[np.frombuffer(data, np.uint8)]
    inside = classes != 3
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    firsts = starts[::PASSAGE_WORDS]
    if len(firsts) > 1 and len(words) - (len(firsts) - 1) * PASSAGE_WORDS < PASSAGE_WORDS // 4:
        firsts = firsts[:-1]  # a short rest belongs to the passage before
    bounds = np.concatenate([[0], firsts[1:], [len(data)]])
    n = len(firsts)
    passage = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(passage * (len(GROUPS) + 2) + classes, minlength=n * (len(GROUPS) + 2)).reshape(n, -1)
    out = np.empty((n, FEATURES))
    out[:, : len(GROUPS) + 2] = counts / counts.sum(axis=1, keepdims=True)
    for k in range(n):
        own = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS if k + 1 < n else len(words)]
        size, distinct = len(own), set(own)
        lengths = np.fromiter(map(len, own), np.int64, size)
        same = sum(a == b for a, b in zip(own, own[1:], strict=False))
        pairs = len(set(zip(own, own[1:], strict=False)))
        out[k, len(GROUPS) + 2 :] = (len(distinct) / size, pairs / max(1, size - 1), same / size, lengths.mean() / 10, lengths.std() / 10, (lengths <= 3).mean(), data.count(b"\n", bounds[k], bounds[k + 1]) / size, np.log(size) / 5)
    return out


@dataclass
class Model:
    """mean, scale: of the features; the rest: weights of the hidden layer, attention, gate and output."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # FEATURES + 1, HIDDEN
    v: np.ndarray  # HIDDEN + 1, GATE
    u: np.ndarray  # HIDDEN + 1, GATE
    a: np.ndarray  # GATE
    c: np.ndarray  # HIDDEN + 1

    def forward(self, bags: np.ndarray, of: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """bags: passages of all documents; of: each passage's document, ascending; n: documents."""
        x = np.column_stack([(bags - self.mean) / self.scale, np.ones(len(bags))])
        h = np.column_stack([np.tanh(x @ self.w), np.ones(len(bags))])
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.a
        firsts = np.searchsorted(of, np.arange(n))  # each document has a passage
        e = np.exp(e - np.maximum.reduceat(e, firsts)[of])
        att = e / np.bincount(of, e, n)[of]
        z = np.add.reduceat(att[:, None] * h, firsts)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c, -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "att": att, "z": z, "p": p}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        bags = [encode(t) for t in texts]
        return self.forward(np.concatenate(bags), np.repeat(np.arange(len(bags)), list(map(len, bags))), len(bags))["p"]


def gradients(model: Model, bags: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy, by the names of the weights."""
    n = len(y)
    f = model.forward(bags, of, n)
    d = (f["p"] - y) / n
    dz = d[:, None] * model.c
    dh = f["att"][:, None] * dz[of]
    datt = (dz[of] * f["h"]).sum(axis=1)
    de = f["att"] * (datt - np.bincount(of, f["att"] * datt, n)[of])
    dt = de[:, None] * model.a * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * model.a * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ model.v.T + ds @ model.u.T
    return {
        "c": f["z"].T @ d, "a": (f["t"] * f["s"]).T @ de, "v": f["h"].T @ dt, "u": f["h"].T @ ds,
        "w": f["x"].T @ (dh[:, :-1] * (1 - f["h"][:, :-1] ** 2)),
    }


def train(bags: np.ndarray, of: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the cross-entropy."""
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Model(bags.mean(axis=0), bags.std(axis=0) + 1e-3, draw(FEATURES + 1, HIDDEN), draw(HIDDEN + 1, GATE), draw(HIDDEN + 1, GATE), draw(GATE), draw(HIDDEN + 1) * 0.1)
    names = ("w", "v", "u", "a", "c")
    first, second = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    for epoch in range(1, EPOCHS + 1):
        grads = gradients(model, bags, of, y)
        for k in names:
            now = getattr(model, k)
            g = grads[k] + DECAY * now
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            setattr(model, k, now - RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8))
    return model


#: Documents that a model is fitted on, at most, each with all its passages.
FITTED_DOCUMENTS = 6_000
#: Documents whose passages are scored at a time.
SCORED_AT_ONCE = 1_000


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = FITTED_DOCUMENTS) -> Model | None:
    """Fit on at most ``limit`` labelled documents that are not held out; None without labels of both kinds.

    Executors encode; the driver gets FEATURES numbers for each passage of the sample, about 1 % of its
    text's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(encode(text).astype("<f4").tobytes(), int(y)) for text, y in zip(batch["text"], batch["y"], strict=True)]
            yield pd.DataFrame(rows, columns=["bag", "y"])

    got = labelled_sample(docs, labels, "quality", limit).mapInPandas(run, "bag binary, y int").collect()
    got = sorted((bytes(r.bag), r.y) for r in got)  # one order, however the tasks ran
    if len({y for _, y in got}) < 2:
        return None
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES).astype(float) for b, _ in got]
    return train(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([y for _, y in got], float))


def score_quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted (columns of those names are replaced).

    Null and empty texts are one passage of zeros. Without a model every score is 0.5. Rows are scored
    one by one, so repeated rows score alike; an empty table gives no rows; other columns pass through.
    """
    added = ("held_out", "score", "predicted")
    kept = [f for f in docs.schema.fields if f.name not in added]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.scores(list(texts.iloc[at : at + SCORED_AT_ONCE])) for at in range(0, len(texts), SCORED_AT_ONCE)] if model else [np.full(len(texts), 0.5)]
            yield pd.Series(np.concatenate([*parts, np.empty(0)]), dtype=float)

    score = F.pandas_udf(run, "double")
    out = docs.select(*(F.col(f"`{f.name}`") for f in kept)).withColumn("score", score(F.col("text").cast("string")))
    return out.select(*(f"`{f.name}`" for f in kept), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
