"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import chunk_tokenizer

#: Production parameters: permitted sequence lengths, and the cost of a sequence besides its length.
CAPACITIES = (2048, 4096, 8192)
BIN_OVERHEAD = 64
SCHEMA = "doc_id long, piece int, piece_start long, piece_tokens int, bin_id long, bin_offset int, bin_used int, bin_capacity int"


def _fill(lengths: np.ndarray, order: np.ndarray, largest: int, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit: each item goes where the least room is left over; ``opens[length]`` is the size to open when it fits nowhere.

    Returns bin and offset of each item, and the bins' contents. The bins with a given room left are a
    stack, and the rooms that have any are the bits of one integer, so finding the best is a shift.
    """
    stacks: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms, used = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = int(opens[n]), len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = room - n
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.array(used, np.int64)


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = BIN_OVERHEAD):
    """Pack items of at most the largest capacity: (bin, offset) of each item; (contents, capacity) of each bin.

    Items come in descending length. A bin that must be opened gets the size of least cost: once by
    cost per token, and once with each permitted size preferred; the packing of least total cost wins.
    At the end each bin shrinks to the least size that holds its contents.
    """
    sizes = np.array(sorted(set(capacities)), np.int64)
    largest = int(sizes[-1])
    order = np.argsort(-lengths, kind="stable")
    fitting = np.searchsorted(sizes, np.arange(largest + 1))
    ratio = (sizes + overhead) / sizes
    rules = [np.array([sizes[f + int(np.argmin(ratio[f:]))] for f in range(len(sizes))])[fitting]]
    rules += [np.maximum(size, sizes[fitting]) for size in sizes]
    best = None
    for opens in rules:
        bins, offsets, used = _fill(lengths, order, largest, opens)
        final = sizes[np.searchsorted(sizes, used)]
        cost = int((final + overhead).sum())
        if best is None or cost < best[0]:
            best = cost, bins, offsets, used, final
    return best[1:]


def best_fit_pack(docs: DataFrame, vocabulary: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = BIN_OVERHEAD) -> DataFrame:
    """Pack the token sequences of ``docs`` (doc_id, text) into bins.

    Each document counts its tokens by ``vocabulary`` and one end token, so empty and null texts are
    one token long. A longer document than the largest capacity is cut: its full pieces fill bins of
    their own, and the rest is packed like any document. Each input partition is packed by itself from
    its list of lengths (the texts pass through), so no row is shuffled, a hot key makes no
    difference, and memory is bounded by the rows of one file split. Bin ids hold the partition's
    number in the upper 32 bits. Null ids, repeated rows and ties are packed as they come, one row per
    piece; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, ids, lengths = chunk_tokenizer(vocabulary), [], []
        for batch in batches:
            ids.append(batch["doc_id"].astype("Int64"))
            lengths.append(np.fromiter((len(x) // 4 + 1 for x in tokenizer.ids(batch["text"].tolist())), np.int64, len(batch)))
        if not ids:
            return
        doc, length, largest = pd.concat(ids, ignore_index=True), np.concatenate(lengths), max(capacities)
        pieces = -(-length // largest)
        row = np.repeat(np.arange(len(length)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.minimum(length[row] - piece * largest, largest)
        bins, offsets, used, final = pack(tokens, capacities, overhead)
        first = TaskContext.get().partitionId() << 32
        out = pd.DataFrame({"doc_id": doc.iloc[row].array, "piece": piece, "piece_start": piece * largest, "piece_tokens": tokens, "bin_id": bins + first, "bin_offset": offsets, "bin_used": used[bins], "bin_capacity": final[bins]})
        for at in range(0, len(out), 100_000):
            yield out.iloc[at : at + 100_000]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)
