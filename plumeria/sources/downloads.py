"""Attachments from elsewhere: a connector that lists and gets, retries, a Spark data source over it, and downloads that can be repeated.

Names follow from the URL alone, so a repeated task writes the same file, and one that is there is not fetched again.
"""

from __future__ import annotations

import hashlib
import importlib
import os
import posixpath
import random
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..shared import filesystem

# Fixed values of the retries.
ATTEMPTS, FIRST_DELAY, MOST_DELAY, JITTER = 10, 1.0, 60.0, 1.0
SIDECAR = ".extracted.txt"


class Connector(Protocol):
    """Reaches a store; both calls may raise, and are tried again."""

    def urls(self) -> Iterable[str]: ...

    def get(self, url: str) -> bytes: ...


@dataclass(frozen=True)
class FolderConnector:
    """An offline stand-in: a folder whose files' paths are the URLs."""

    root: str

    def urls(self) -> Iterable[str]:
        return sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names)

    def get(self, url: str) -> bytes:
        with open(url, "rb") as f:
            return f.read()


def waits(attempts: int, first: float = FIRST_DELAY, most: float = MOST_DELAY, jitter: float = JITTER) -> Iterator[float]:
    """Seconds before each further attempt."""
    return (min(first * 2**k + random.uniform(0, jitter), most) for k in range(attempts - 1))


def persistent(call: Callable[[], object], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int, str | None]:
    """(result, attempts made, last error): the first result, or None once all attempts failed."""
    error, pause = None, list(waits(attempts))
    for k in range(attempts):
        try:
            return call(), k + 1, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                sleep(pause[k])
    return None, attempts, error


def file_name(url: str) -> str:
    """The URL's last part with a digest of the whole URL; ``.txt`` without an extension."""
    stem, ext = posixpath.splitext(posixpath.basename(unquote(urlparse(url).path)) or "attachment")
    return f"{stem}_{hashlib.sha256(url.encode()).hexdigest()[:12]}{ext or '.txt'}"


class Slice(InputPartition):
    """One of so many parts of the URLs, by their CRC-32."""

    def __init__(self, number: int, of: int):
        self.number, self.of = number, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._connector = options.get("connector", f"{__name__}:FolderConnector")
        self._path = options["path"]
        self._slices, self._attempts, self._first = int(options.get("slices", 8)), int(options.get("attempts", ATTEMPTS)), float(options.get("firstdelay", FIRST_DELAY))

    def partitions(self) -> list[InputPartition]:
        return [Slice(k, self._slices) for k in range(self._slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        module, _, name = self._connector.partition(":")
        connector = getattr(importlib.import_module(module), name)(self._path)
        sleep = lambda s: time.sleep(s * self._first / FIRST_DELAY)
        listed, _, error = persistent(lambda: [u for u in connector.urls() if zlib.crc32(u.encode()) % partition.of == partition.number], self._attempts, sleep)
        if listed is None:
            raise RuntimeError(f"{self._path} can't be listed: {error}")
        for url in listed:
            content, made, error = persistent(lambda url=url: connector.get(url), self._attempts, sleep)
            yield url, file_name(url), content, made, error


class AttachmentSource(DataSource):
    """``spark.read.format("attachments").load(root)``: (url, name, content, attempts, error) of what a connector lists.

    Options: ``connector`` (``module:Class``, made from the path; a folder by default), ``slices`` (partitions; each lists
    for itself, so no list passes through the driver), ``attempts``, ``firstDelay``. A URL that fails to the end is a row
    with its error and without content.
    """

    @classmethod
    def name(cls) -> str:
        return "attachments"

    def schema(self) -> str:
        return "url string, name string, content binary, attempts int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def download(attachments: DataFrame, connector: Connector, folder: str, attempts: int = ATTEMPTS, concurrency: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, url, path, attempts, error) of each different (id, url): its file ``folder/<id>/<name>``, fetched unless it is there.

    A file gets its name once it is whole. ``folder`` must be shared by executors; ``concurrency`` tasks fetch at a
    time. Null URLs are left out; a failure to the end has its error and a null path.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        for frame in frames:
            rows = []
            for key, url in zip(frame["id"], frame["url"], strict=True):
                to = f"{base}/{key}/{file_name(url)}"
                if fs.get_file_info(to).is_file:
                    rows.append((key, url, f"{folder.rstrip('/')}/{key}/{file_name(url)}", 0, None))
                    continue
                content, made, error = persistent(lambda url=url: connector.get(url), attempts, sleep)
                if error is None:
                    _put(fs, to, content)
                rows.append((key, url, None if error else f"{folder.rstrip('/')}/{key}/{file_name(url)}", made, error))
            yield pd.DataFrame(rows, columns=["id", "url", "path", "attempts", "error"])

    wanted = attachments.select(F.col("id").cast("string").alias("id"), "url").filter("id is not null and url is not null").distinct()
    wanted = wanted.repartition(concurrency) if concurrency else wanted
    return wanted.mapInPandas(run, "id string, url string, path string, attempts int, error string")


def _put(fs, path: str, content: bytes) -> None:
    fs.create_dir(posixpath.dirname(path), recursive=True)
    begun = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(begun) as out:
        out.write(content)
    fs.move(begun, path)


def with_texts(files: DataFrame, extractor: Callable[[bytes, str], str], most_bytes: int = 10_000_000) -> DataFrame:
    """``download``'s rows with their text: that of the file's sidecar if there is one, else the extractor's, which is then kept beside the file.

    Too large and failing files get a bracketed message and no sidecar, so they are tried again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for path in frame["path"]:
                if path is None:
                    texts.append(None)
                    continue
                fs, at = filesystem(path)
                if fs.get_file_info(at + SIDECAR).is_file:
                    with fs.open_input_stream(at + SIDECAR) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                    continue
                if fs.get_file_info(at).size > most_bytes:
                    texts.append("[file too large]")
                    continue
                with fs.open_input_stream(at) as f:
                    content = f.read()
                try:
                    texts.append(extractor(content, path))
                    _put(fs, at + SIDECAR, texts[-1].encode())
                except Exception as e:
                    texts.append(f"[extraction failed: {e}]")
            yield frame.assign(text=texts)

    return files.mapInPandas(run, "id string, url string, path string, attempts int, error string, text string")


def fetch_texts(comments: DataFrame, connector: Connector, folder: str, extractor: Callable[[bytes, str], str], **options) -> DataFrame:
    """All attachments of nested ``comments`` (id, attributes.attachments) downloaded and read: (id, attachment_texts), in the order of the attachments. Comments without any are left out."""
    listed = comments.select("id", F.posexplode("attributes.attachments").alias("at", "a")).select("id", "at", F.col("a.fileUrl").alias("url"))
    read = with_texts(download(listed, connector, folder, **options), extractor).select("id", "url", "path", "text")
    rows = listed.join(read, ["id", "url"])
    item = F.struct("at", F.struct(F.col("url").alias("id"), F.element_at(F.split("url", "/"), -1).alias("title"), F.col("text").alias("text"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("mime_type")).alias("x"))
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]).alias("attachment_texts"))
