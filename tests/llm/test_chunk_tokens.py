"""Chunks of letters go to the library's model at once; all others as before, and all ids are the library's."""

import random
import struct

from plumeria.llm.chunk_tokens import ChunkTokenizer
from plumeria.llm.queries import vocabulary


def test_ids_are_the_librarys_and_words_skip_its_other_steps():
    tokenizer = ChunkTokenizer(vocabulary("word_bpe_49k.json"))
    whole = tokenizer._tokenizer
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x41, 0x180) if chr(c).isalpha()]
    odd = ["a", "é", "<|endoftext|>", "<|", "|>", ".", "!", "&&&", "$", "'s", "'", "1", "İ", "é", "Σ", "ǆ", "한"]
    texts = ["".join(letters), *letters, "words,!! andmore&&& été.%% ``x", "", None]
    texts += [" ".join("".join(rng.choices(pool, k=rng.randint(1, 7))) for _ in range(40)) for pool in (letters, odd, letters + odd) for _ in range(30)]
    for text, got in zip(texts, tokenizer.ids(texts), strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), text

    class Asked:
        def encode(self, text, **_):
            raise AssertionError(text)

    tokenizer._tokenizer = Asked()
    assert all(tokenizer.ids(["neverseenbefore añadidura éléphantesque großartigkeit"]))
