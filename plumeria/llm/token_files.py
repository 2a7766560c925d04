"""Token ids in files of independent zstandard frames.

A file holds, in ascending order of documents, one frame for each document (its ids as little-endian
unsigned 32-bit integers, the end id included); then, as skippable frames, the documents' ids and the
public seekable format's seek table: compressed size, size and checksum (the lower half of XXH64) of
each frame, and a footer. A reader takes the tables from the end of the file and decompresses only the
frames of the documents it is asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import chunk_tokenizer
from .shared import filesystem, new_path, written

#: Fixed values of the public formats.
SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: A skippable frame's size is a 32-bit number; a file goes on in a next one before it comes near.
MAX_FRAMES = 50_000_000
LEVEL = 3
SHARDS = "shard int, path string, documents long, tokens long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


class FrameWriter:
    """Appends documents to a file; ``finish`` writes the tables."""

    def __init__(self, out, level: int = LEVEL):
        self._out, self._zstd = out, zstandard.ZstdCompressor(level=level)
        self._seek, self._ids, self._null = bytearray(), bytearray(), bytearray()
        self.documents = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._zstd.compress(ids)
        self._out.write(frame)
        self._seek += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self._ids += struct.pack("<q", doc_id or 0)
        self._null.append(doc_id is None)
        self.documents += 1
        self.tokens += len(ids) // 4

    def finish(self) -> None:
        table = bytes(self._ids + self._null)
        self._out.write(struct.pack("<II", SKIPPABLE_IDS, len(table)) + table)
        footer = struct.pack("<IBI", self.documents, HAS_CHECKSUMS, SEEK_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK, len(self._seek) + len(footer)) + bytes(self._seek) + footer)


class FrameReader:
    """Random access to the documents of a file (seekable, binary)."""

    def __init__(self, file, size: int):
        self._file, self._zstd = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - 9 - SEEK.itemsize * count
        file.seek(at)
        self.seek = np.frombuffer(file.read(SEEK.itemsize * count), SEEK)
        file.seek(at - 8 - 9 * count)
        table = file.read(9 * count)
        ids, null = np.frombuffer(table[: 8 * count], "<i8"), np.frombuffer(table[8 * count :], np.uint8)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null, strict=True)]
        self.offsets = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.seek["size"] // 4, dtype=np.int64)])

    def read(self, k: int) -> bytes:
        """Ids of the k-th document; a damaged frame raises."""
        self._file.seek(int(self.offsets[k]))
        size = int(self.seek["size"][k])
        ids = self._zstd.decompress(self._file.read(int(self.seek["packed"][k])), max_output_size=size) if size else b""
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return ids

    def find(self, doc_ids: Iterable[int | None]) -> Iterator[tuple[int | None, bytes]]:
        """Only the frames of these documents are decompressed."""
        wanted = set(doc_ids)
        return ((d, self.read(k)) for k, d in enumerate(self.doc_ids) if d in wanted)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, and write a file for each range of documents.

    Returns (shard, path, documents, tokens) of each file, shards ascending by documents; a table in the
    shared folder. Order is by doc_id, null first, then by the text's hash, so repeated rows and ties
    are spread and keep one order. Null and empty texts hold only the end id; an empty table gives no
    files; other columns are ignored. Files get their name once whole, and by shard, so a repeated task
    replaces its file with the same one.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("h")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", F.asc_nulls_first("text")).drop("h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, end = TaskContext.get(), struct.pack("<I", end_id)
        files, root = filesystem(path)
        tokenizer, part, out, writer, made = chunk_tokenizer(vocabulary), 0, None, None, []

        def close():
            writer.finish()
            out.close()
            files.move(f"{root}/{name}.{task.taskAttemptId()}", f"{root}/{name}")
            made.append((task.partitionId() * 1000 + part, f"{path}/{name}", writer.documents, writer.tokens))

        for batch in batches:
            if out is None and len(batch):
                files.create_dir(root, recursive=True)
            ids = batch["doc_id"].astype("Int64")
            for doc_id, encoded in zip(ids, tokenizer.ids(batch["text"].tolist()), strict=True):
                if out is None or writer.documents >= MAX_FRAMES:
                    if out is not None:
                        close()
                        part += 1
                    name = f"tokens-{task.partitionId():06d}-{part:03d}.zst"
                    out = files.open_output_stream(f"{root}/{name}.{task.taskAttemptId()}")
                    writer = FrameWriter(out)
                writer.add(None if doc_id is pd.NA else int(doc_id), encoded + end)
        if out is not None:
            close()
        yield pd.DataFrame(made, columns=["shard", "path", "documents", "tokens"])

    return written(ordered.mapInPandas(run, SHARDS), "shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Read the files of ``write_token_files`` back: each document's place among all ids, length and CRC-32.

    A file's first id comes after those of all files before it: sums over the table of files, which has
    a row for each file. Each task then reads one file, frame by frame.
    """
    listed = sorted(shards.collect())  # a row for each file, not for each document
    firsts, at = [], 0
    for shard in listed:
        firsts.append((shard.path, at))
        at += shard.tokens
    spark = shards.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first in zip(batch["path"], batch["first"], strict=True):
                files, place = filesystem(path)
                with files.open_input_file(place) as f:
                    reader, rows = FrameReader(f, f.size()), []
                    for k, doc_id in enumerate(reader.doc_ids):
                        rows.append((doc_id, int(first + reader.starts[k]), int(reader.seek["size"][k]) // 4, zlib.crc32(reader.read(k))))
                        if len(rows) == 50_000 or k + 1 == len(reader.doc_ids):
                            out, rows = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]), []
                            yield out.astype({"doc_id": "Int64"})

    files = spark.createDataFrame(firsts, "path string, first long").repartition(max(1, len(firsts)))
    return files.mapInPandas(run, DIGESTS)


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "tokens"), vocabulary, end_id))
