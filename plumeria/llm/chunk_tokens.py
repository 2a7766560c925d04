"""Token ids by the tokenizers library, one white-space chunk at a time.

The vocabulary ``word_bpe_49k`` ignores case and drops white space, and never joins what white space
separates, so the ids of a text are the ids of its chunks, one after another. Each worker asks the
library once for each different word that its bounded cache holds, over all tasks that it runs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: Entries of one generation of a cache; it keeps two, and forgets the older one when the newer is full.
CACHE_ENTRIES = 350_000
#: A longer chunk is encoded each time, so that the cache's bytes have a bound too.
CACHED_BYTES = 48
PUNCTUATION = b".,!?;:&*#%$"
#: Below, no normal form changes a letter that stands among letters.
LATIN_END = "\u0180"
#: The letters that stand for the bytes 80 to FF in the vocabulary.
BYTE_LETTERS = {b: chr(256 + 33 + k) for k, b in enumerate([*range(0x7F, 0xA1), 0xAD]) if b > 0x7F}


class Cache(dict):
    """``cache[key]`` is ``make(key)``, kept while the key is in use: what the older generation has moves to the newer one."""

    def __init__(self, make: Callable[[bytes], bytes]):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
            if len(key) > CACHED_BYTES:
                return value
        if len(self) >= CACHE_ENTRIES:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkTokenizer:
    """Ids as little-endian unsigned 32-bit integers.

    Cutting at the ASCII white space bytes only is safe: the library's own ``\\s`` includes them, and
    no normalization form composes across them. So is lower-casing A-Z first, except in a text that may
    spell a special token, and cutting off ``PUNCTUATION`` after an ASCII letter. A chunk of Latin letters
    alone is one word of the library's model, so it is asked at once, without the steps before it.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._cores, self._chunks = Cache(self._library), Cache(self._chunk)

    def _library(self, core: bytes) -> bytes:
        word = core.decode()
        if core.isalpha() or (word := word.lower()).isalpha() and max(word) < LATIN_END:
            letters = word.lower() if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [token.id for token in self._model.tokenize(letters)]
        else:
            ids = self._tokenizer.encode(core.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        """A chunk is a core and the punctuation after it."""
        core = chunk.rstrip(PUNCTUATION)
        if len(core) < len(chunk) and core[-1:].isalpha():
            return self._cores[core] + self._cores[chunk[len(core) :]]
        return self._cores[chunk]

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """One string of bytes for each text; null counts as empty."""
        look = self._chunks.__getitem__
        for text in texts:
            data = (text or "").encode()
            yield b"".join(map(look, (data if b"<|" in data else data.lower()).split()))


@lru_cache(maxsize=1)
def chunk_tokenizer(vocabulary: str) -> ChunkTokenizer:
    """The worker's tokenizer: the next task that it runs finds the cache filled."""
    return ChunkTokenizer(vocabulary)
