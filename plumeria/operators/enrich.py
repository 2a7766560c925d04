"""External models: classifiers and text extractors, called in batches from tasks."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_ws
from ..functions.values import usable_text
from ..ledger import Ledger
from ..schemas import STANCES
from ..shared import discard, written
from .clusters import batches
from .quality import ConfigurationError


class Classifier(Protocol):
    """Gives stance, key_quote, rationale and themes (a list) of a text; may raise."""

    def __call__(self, text: str) -> dict: ...


Extractor = Callable[[bytes, str], str]


@dataclass(frozen=True)
class EnrichConfig:
    batch_size: int = 5
    retries: int = 3
    first_delay: float = 5.0
    timeout: float = 30.0
    truncate: int = 1003

    def __post_init__(self):
        if self.batch_size < 1 or self.retries < 0 or self.timeout <= 0:
            raise ConfigurationError("batch_size, retries and timeout must be positive")


@dataclass
class KeywordClassifier:
    """An offline stand-in: counts words for and against."""

    words_for: frozenset[str] = frozenset("support favor favour agree approve".split())
    words_against: frozenset[str] = frozenset("oppose against disagree reject object".split())
    themes: dict[str, str] = field(default_factory=dict)

    def __call__(self, text: str) -> dict:
        found = re.findall(r"\w+", text.lower())
        score = sum(w in self.words_for for w in found) - sum(w in self.words_against for w in found)
        stance = STANCES[0] if score > 0 else STANCES[1] if score < 0 else STANCES[2]
        return {"stance": stance, "key_quote": text.split(".")[0][:200], "rationale": f"score {score}", "themes": [t for w, t in self.themes.items() if w in found]}


def delays(retries: int, first: float, most: float = 60.0, jitter: float = 0.0) -> Iterator[float]:
    return (min(first * 2**k + random.uniform(0, jitter), most) for k in range(retries))


def attempt(call: Callable[[], dict], retries: int, first_delay: float, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The first result; after all attempts the last error is raised."""
    waits = list(delays(retries, first_delay))
    for k in range(retries + 1):
        try:
            return call()
        except Exception:
            if k == retries:
                raise
            sleep(waits[k])
    raise AssertionError


def within(call: Callable[[], dict], seconds: float) -> dict:
    """The call's result, or TimeoutError after so long; the call itself goes on in its thread until it ends."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout=seconds)
    finally:
        pool.shutdown(wait=False)


def classify_text(classifier: Classifier, text: str | None, config: EnrichConfig, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An analysis row: failures have stance '' and a rationale that starts with ``Error:``."""
    if not (text or "").strip():
        return {"stance": "", "key_quote": "", "rationale": "Error: no text", "themes": ""}
    try:
        found = attempt(lambda: within(lambda: classifier(text), config.timeout), config.retries, config.first_delay, sleep)
        return {k: found[k] for k in ("stance", "key_quote", "rationale")} | {"themes": ", ".join(found["themes"])}
    except Exception as e:
        return {"stance": "", "key_quote": "", "rationale": f"Error: {e}", "themes": ""}


def analyse(lookup: DataFrame, classifier: Classifier, config: EnrichConfig = EnrichConfig(), concurrency: int | None = None) -> DataFrame:
    """Rows without a stance get the classifier's; the others pass."""
    names = ("stance", "key_quote", "rationale", "themes")
    waiting = lookup.filter("stance is null").select("lookup_id", "truncated_text")

    def few(arrived: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in arrived:  # texts become Python's a few at a time
            for at in range(0, batch.num_rows, config.batch_size):
                yield batch.slice(at, config.batch_size).to_pandas()

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(few(arrived), config.batch_size):
            rows = [{"lookup_id": i} | classify_text(classifier, t, config) for i, t in zip(part["lookup_id"], part["truncated_text"], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string()) for n in ("lookup_id", *names)]))

    waiting = waiting.repartition(concurrency) if concurrency else waiting
    found = waiting.mapInArrow(run, "lookup_id string, " + ", ".join(f"{n} string" for n in names))
    found = found.select("lookup_id", *(F.col(n).alias(f"_{n}") for n in names))
    return lookup.join(found, "lookup_id", "left").withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))


NAMES = ("stance", "key_quote", "rationale", "themes")
ANALYSES = T.StructType([T.StructField(n, T.StringType()) for n in ("text_hash", "lookup_id", *NAMES)])


def analysis_ledger(spark: SparkSession, path: str) -> Ledger:
    """The ledger of analyses below ``path``, a row for each text analysed: what a text was found to say holds whatever number it has later."""
    return Ledger(spark, path, ANALYSES, "text_hash")


def text_hash(text: str = "truncated_text") -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def analyse_resumable(lookup: DataFrame, classifier: Classifier, path: str, config: EnrichConfig = EnrichConfig(), every: int = 50_000, concurrency: int | None = None, again: bool = False) -> DataFrame:
    """``lookup`` with the analyses of the ledger below ``path``, to which those it lacks are added first.

    Rows without a stance whose text no commit has are waiting, whenever they came; so a table that grows is
    taken up where the last run ended, and a run that was killed repeats no committed row. Waiting rows are
    dealt by their text's hash into parts of about ``every`` rows, and each is committed once written. With
    ``again``, rows whose last analysis failed are waiting too.
    """
    ledger = analysis_ledger(lookup.sparkSession, path)
    done = ledger.latest().filter(~F.startswith("rationale", F.lit("Error:"))) if again else ledger.read()
    waiting = lookup.filter("stance is null").withColumn("text_hash", text_hash()).join(done.select("text_hash"), "text_hash", "left_anti")
    waiting = written(waiting.select("text_hash", "lookup_id", "truncated_text", *(F.lit(None).cast("string").alias(n) for n in NAMES)).dropDuplicates(["text_hash"]), "waiting")
    rounds = -(-waiting.count() // every)
    for k in range(rounds):
        part = waiting.filter(F.pmod(F.xxhash64("text_hash"), F.lit(rounds)) == k)
        ledger.append(analyse(part, classifier, config, concurrency))
    discard(waiting)
    found = ledger.latest().select("text_hash", *(F.col(n).alias(f"_{n}") for n in NAMES))
    out = lookup.withColumn("text_hash", text_hash()).join(found, "text_hash", "left").drop("text_hash")
    return out.withColumns({n: F.coalesce(n, f"_{n}") for n in NAMES}).drop(*(f"_{n}" for n in NAMES))


def extract(files: DataFrame, extractor: Extractor, most_bytes: int = 10_000_000) -> DataFrame:
    """``files`` (path, content) with the extractor's text; too large and failing files get a bracketed message."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts.append(extractor(content, path) if len(content) <= most_bytes else "[file too large]")
                except Exception as e:
                    texts.append(f"[extraction failed: {e}]")
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def plain_extractor(content: bytes, path: str) -> str:
    """Text files; other kinds say that they are not supported."""
    ext = path.rsplit(".", 1)[-1].lower()
    return content.decode("utf-8", "replace") if ext in ("txt", "csv", "log", "md") else f"[{ext} is not supported here]"


def best_text(basic: Column, remote: Column, least: int = 50) -> Column:
    """The basic text if usable, else the remote one if it is no message and longer; null if too short to save."""
    b, r = F.coalesce(basic, F.lit("")), F.coalesce(remote, F.lit(""))
    text = F.when(usable_text(b), b).when(~r.startswith("[") & (F.length(r) > F.length(b)), r).otherwise(b)
    return F.when(F.length(trim_ws(text)) > least, text)


def recommend(stats: DataFrame) -> DataFrame:
    """(position, max_tokens, dimensions) of models that suit a corpus, from the tokens' row of length statistics."""
    short, long = F.col("median") <= 256, F.col("max") > 512
    rules = ((short, 256, 384), (short, 384, 768), (F.col("p95") <= 512, 512, 384), (long, 512, 768), (long & (F.col("max") > 1000), 512, 768), (F.lit(True), 8192, 1536))
    found = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(n).alias("max_tokens"), F.lit(d).alias("dimensions"))) for rule, n, d in rules)))
    return stats.filter("metric = 'tokens'").select(F.posexplode(found).alias("at", "m")).select((F.col("at") + 1).alias("position"), "m.*")
