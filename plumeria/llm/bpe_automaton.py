"""BPE encoding and decoding by a deterministic automaton.

It is built in two steps. The first automaton reads tokens, and accepts a sequence exactly if BPE makes
that sequence of its text. It starts as one state with a loop for each byte. Each merge (u, v) -> uv, in
order, is a gadget: the state after u is split, its copy loses the arc v, and every state that had u and
then v gets an arc uv to the state after v. So one state stands for each last token, and it is kept as
what its gadgets changed: which arc it lost, and at which merge. An arc v of the state after u exists if
neither v nor a part that v begins with was lost before it was merged on.

The second reads bytes, and is the first one's arcs spelled out and made deterministic: a state is the set
of all (last token, part of an arc's label read since), and every prefix of a word has exactly one
accepted sequence, so a state also tells that sequence's last token. Encoding a word is one table
transition for each byte; the last tokens, followed back from the word's end, are its tokens. The table's
rows are made when a word first comes to them, as all of them together would have no useful bound.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the byte-level vocabulary splits a text before its merges (fixed value of the public file format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States that a worker's table holds before it starts anew; chunks that it keeps the ids of, and the longest of these.
TABLE_STATES = 150_000
CACHED_CHUNKS = 300_000
CACHED_CHARS = 48
#: Documents that a task holds the ids of at a time.
ROWS_AT_ONCE = 500
SCHEMA = "doc_id long, ids array<int>, decoded string"
NEVER = 1 << 60
#: A state's members are numbers: (last token + 1) * PARTS + part of a label; the start has no last token and no part.
PARTS, ROOT, START = 1 << 24, 0, 0
#: Keys of a table row beside its bytes.
LAST, STATE = -1, -2
#: Marks that end a chunk: after an ASCII letter a run of them is a word of its own.
MARKS = ".,;:!?*$%&"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton over tokens, and the table over bytes that is made from it."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each id. merges: (left id, right id, merged id), in order."""
        self.labels, self._sizes = labels, list(map(len, labels))
        self._parts: dict[int, tuple[int, int]] = {}
        self._born: dict[int, int] = {}
        self._lost: dict[int, dict[int, int]] = {}
        self._spelled: list[dict[int, int]] = [{}]  # of each part of a label, the longer parts by their next byte
        self._ends: list[int] = [-1]  # the token that a part spells
        for t, label in enumerate(labels):
            if len(label) == 1:
                self._spell(t)
        for order, (u, v, uv) in enumerate(merges):
            self._gadget(order, u, v, uv)
        self._clear()

    def _gadget(self, order: int, u: int, v: int, uv: int) -> None:
        """The state after u loses arc v now; arc uv appears where u and then v could be read."""
        if self.arc(u, v):
            self._lost.setdefault(u, {})[v] = order
            self._parts[uv], self._born[uv] = (u, v), order
            self._spell(uv)

    def _spell(self, token: int) -> None:
        part = ROOT
        for byte in self.labels[token]:
            if (after := self._spelled[part].get(byte)) is None:
                after = self._spelled[part][byte] = len(self._spelled)
                self._spelled.append({})
                self._ends.append(-1)
            part = after
        self._ends[part] = token

    def arc(self, last: int, label: int) -> bool:
        """Whether the state after ``last`` has an arc ``label`` once the gadgets so far have been applied."""
        before = NEVER  # gadgets from here on no longer change the state that ``last`` leads to
        while True:
            if lost := self._lost.get(last):
                until, first = NEVER, label  # the arc ``first`` has to last until it is merged on
                while True:
                    at = lost.get(first)
                    if at is not None and at < before and at <= until:
                        return False
                    if first not in self._parts:
                        break
                    until, first = self._born[first], self._parts[first][0]
            if last not in self._parts:
                return True
            before, last = self._born[last], self._parts[last][1]

    def _clear(self) -> None:
        self._rows: dict[tuple[int, ...], dict[int, Any]] = {}
        self.start = self._row((START,))

    def _row(self, key: tuple[int, ...]) -> dict[int, Any]:
        """The table's row of a state: byte -> row after it; the last token of what was read; the state itself."""
        row = self._rows.get(key)
        if row is None:
            row = self._rows[key] = {LAST: key[-1] // PARTS - 1, STATE: key}
        return row

    def _transition(self, row: dict[int, Any], byte: int) -> dict[int, Any]:
        """Make the table's entry for a state and a byte."""
        key = row[STATE]
        if len(self._rows) >= TABLE_STATES:
            self._clear()
            row = self._row(key)
        parts, last = [], -1
        for item in key:
            before, part = item // PARTS - 1, item % PARTS
            after = self._spelled[part].get(byte)
            if after is not None:
                token = self._ends[after]
                if token >= 0 and last < 0 and (before < 0 or self.arc(before, token)):
                    last = token
                if self._spelled[after]:  # a label may go on here
                    parts.append(item - part + after)
        parts.append((last + 1) * PARTS + ROOT)
        row[byte] = after = self._row(tuple(parts))
        return after

    def path(self, word: bytes) -> list[int]:
        """Labels of the accepted path that spells ``word``."""
        row, seen, sizes = self.start, [], self._sizes
        for byte in word:
            row = row.get(byte) or self._transition(row, byte)
            seen.append(row)
        out, at = [], len(seen)
        while at:
            token = seen[at - 1][LAST]
            out.append(token)
            at -= sizes[token]
        return out[::-1]


class AutomatonTokenizer:
    """A byte-level BPE file (as the tokenizers library saves it), compiled."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            labels[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        for token, i in special.items():
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        plain = [b"" if i in set(special.values()) else x for i, x in enumerate(labels)]
        self.automaton = TokenAutomaton(plain, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.labels, self._special = labels, special
        self._cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._words = regex.compile(SPLIT).findall
        self._chunks: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}
        self._runs = regex.compile(r"\s (?:\s|\Z)").search
        self._split = regex.compile(r"\s*\S+|\s+").findall

    def _chunk(self, key: str, cache: dict[str, bytes], before: str) -> bytes:
        """Ids of ``before`` and ``key``; a core and the marks after it are looked up apart."""
        core = key.rstrip(MARKS)
        if len(core) < len(key) and core[-1:].isascii() and core[-1:].isalpha():
            marks = key[len(core) :]
            return (cache.get(core) or self._chunk(core, cache, before)) + (self._chunks.get(marks) or self._chunk(marks, self._chunks, ""))
        path = self.automaton.path
        ids = [t for word in self._words(before + key) for t in path(word.encode())]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(key) <= CACHED_CHARS:
            if len(cache) >= CACHED_CHUNKS:
                cache.clear()
            cache[key] = found
        return found

    def _plain(self, text: str, out: list[bytes]) -> None:
        """No word reaches over the end of other characters than white space; so a text is cut there, and what a chunk gave is kept.

        Cutting at each space is the same, unless one stands between white space and white space or the end.
        """
        if self._runs(text):
            get, cache = self._chunks.get, self._chunks
            for chunk in self._split(text):
                out.append(get(chunk) or self._chunk(chunk, cache, ""))
            return
        first, *rest = text.split(" ")
        if first:
            out.append(self._chunks.get(first) or self._chunk(first, self._chunks, ""))
        get, cache = self._spaced.get, self._spaced
        for key in rest:
            out.append(get(key) or self._chunk(key, cache, " "))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the strings of special tokens become their ids."""
        out: list[bytes] = []
        at = 0
        for m in self._cut.finditer(text) if self._cut and any(s in text for s in self._special) else ():
            if m.start() > at:
                self._plain(text[at : m.start()], out)
            out.append(struct.pack("<I", self._special[m.group()]))
            at = m.end()
        if at < len(text):
            self._plain(text[at:], out)
        return np.frombuffer(b"".join(out), "<u4").astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def automaton_tokenizer(vocabulary: str) -> AutomatonTokenizer:
    """The worker's automaton: compiled once, and the next task that it runs finds table and chunks filled."""
    return AutomatonTokenizer(vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of each text of ``docs`` (doc_id, text): its ids, and what they spell.

    One row for each row of the input; null and empty texts have no ids. No row meets another, so
    repeated rows, ties and hot keys make no difference; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = automaton_tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [tokenizer.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(map(tokenizer.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode`` rows: SHA-256 of the decimal ids with commas between, and of the decoded text."""
    sha: Column = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def ids_of(texts: list[str], vocabulary: str) -> list[list[int]]:
    """Ids of a few texts, without Spark."""
    tokenizer = automaton_tokenizer(vocabulary)
    return [tokenizer.encode(t).tolist() for t in texts]
