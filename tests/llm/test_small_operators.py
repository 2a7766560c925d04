"""Packing, tokenizing, token files and Merkle trees against brute force or the libraries they must equal."""

import hashlib
import io
import random
import struct
import zlib
from collections import Counter
from itertools import zip_longest

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumeria.llm import merkle, packing
from plumeria.llm.bpe_automaton import TokenAutomaton, digests, encode_decode, ids_of
from plumeria.llm.shared import new_path
from plumeria.llm.token_files import FrameReader, FrameWriter, read_token_files, token_file_round_trip, write_token_files

from .conftest import ODD, ODD_IDS

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# Packing

def slow_pack(lengths, sizes, overhead, opens):
    """Best fit by looking at every bin."""
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [b for b in bins if b[0] - sum(b[1]) >= lengths[i]]
        b = min(fit, key=lambda b: b[0] - sum(b[1]), default=None)
        if b is None:
            b = (opens(lengths[i]), [])
            bins.append(b)
        b[1].append(int(lengths[i]))
    return sum(min(s for s in sizes if s >= sum(b[1])) + overhead for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_pack_costs_what_brute_force_costs(seed):
    rng, sizes, overhead = np.random.default_rng(seed), (16, 40, 100), 3
    lengths = rng.integers(1, 101, 60)
    bins, offsets, used, final = packing.pack(lengths, sizes, overhead)
    rules = [lambda n, p=p: max(p, min(s for s in sizes if s >= n)) for p in sizes]
    rules.append(lambda n: min((s for s in sizes if s >= n), key=lambda s: (s + overhead) / s))
    assert int((final + overhead).sum()) == min(slow_pack(lengths, sizes, overhead, r) for r in rules)
    for b in range(len(used)):
        own = np.flatnonzero(bins == b)
        at = np.argsort(offsets[own])
        assert used[b] <= final[b] == min(s for s in sizes if s >= used[b])
        assert (offsets[own][at] == np.concatenate([[0], np.cumsum(lengths[own][at])[:-1]])).all() and lengths[own].sum() == used[b]


def test_packing_keeps_every_token(docs):
    got = packing.best_fit_pack(docs(ODD, ODD_IDS), WORD, (64, 256)).toPandas()
    t = Tokenizer.from_file(WORD)
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in ODD)
    assert got.piece_tokens.sum() == sum(want) and got.bin_capacity.isin([64, 256]).all()
    assert (got.groupby("bin_id").piece_tokens.sum() == got.groupby("bin_id").bin_used.first()).all()
    assert (got[got.doc_id == 4].sort_values("piece").piece_start.diff().dropna() == 256).all()
    assert packing.best_fit_pack(docs([]), WORD).count() == 0


# BPE

def test_automaton_accepts_what_bpe_makes():
    """Against merging by rank, over all short words of two letters."""
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (3, 3, 5), (1, 1, 6), (6, 0, 7), (2, 2, 8)]
    labels = [b"a", b"b", b"aa", b"ab", b"aab", b"abab", b"bb", b"bba", b"aaaa"]
    machine = TokenAutomaton(labels, merges)

    def by_rank(word):
        out = [0 if c == ord("a") else 1 for c in word]
        for u, v, uv in merges:
            k = 0
            while k + 1 < len(out):
                if out[k] == u and out[k + 1] == v:
                    out[k : k + 2] = [uv]
                k += 1
        return out

    for size in range(1, 11):
        for bits in range(1 << size):
            word = bytes(97 + (bits >> k & 1) for k in range(size))
            assert machine.path(word) == by_rank(word), word


def odd_texts():
    random.seed(3)
    return [*(x or "" for x in ODD), "a" * 999, " \n  a\n\n b  ", *("".join(chr(random.choice([32, 10, random.randint(33, 0x250), random.randint(0x2000, 0x3100)])) for _ in range(50)) for _ in range(300))]


def test_ids_equal_the_library():
    t = Tokenizer.from_file(BYTE)
    texts = odd_texts()
    assert ids_of(texts, BYTE) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_equal_the_library_around_white_space(monkeypatch):
    """Runs of white space of all kinds, words without an end, and a table that fills again and again."""
    from plumeria.llm import bpe_automaton

    t, rng = Tokenizer.from_file(BYTE), random.Random(11)
    texts = ["".join(rng.choice(["a", "b's", "\u00e9", "7", ".", " ", " ", " ", "\n", "\t", "\u00a0", "\x1c", "\x85", "\u2028", "<|endoftext|>", "\u6f22"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(5000)), "-" * 3000, " " * 700]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids_of(texts, BYTE) == want
    monkeypatch.setattr(bpe_automaton, "TABLE_STATES", 200)
    machine = bpe_automaton.AutomatonTokenizer(BYTE)
    assert [machine.encode(x).tolist() for x in texts] == want


def test_encode_decode(docs):
    t = Tokenizer.from_file(BYTE)
    got = sorted(tuple(r) for r in digests(encode_decode(docs(ODD, range(8)), BYTE)).collect())
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in ODD]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(k, len(x), sha(",".join(map(str, x))), sha(t.decode(x, skip_special_tokens=False))) for k, x in enumerate(ids)]
    assert encode_decode(docs([]), BYTE).count() == 0


# Token files

def test_token_files_round_trip(docs):
    t = Tokenizer.from_file(WORD)
    texts, ids = odd_texts(), list(range(308, -2, -1))
    got = sorted(tuple(r) for r in token_file_round_trip(docs(texts, ids), WORD).collect())
    at, want = 0, []
    for i, x in sorted(zip(ids, texts, strict=True)):
        own = [*t.encode(x, add_special_tokens=False).ids, 1]
        want.append((i, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
        at += len(own)
    assert got == want


def test_token_files_odd_rows(docs, spark):
    got = token_file_round_trip(docs(ODD, ODD_IDS), WORD).toPandas()
    assert len(got) == 8 and got.doc_id.isna().sum() == 2
    ordered = got.sort_values("start")
    assert (ordered.start.to_numpy()[1:] == ordered.n_tokens.cumsum().to_numpy()[:-1]).all() and ordered.start.iloc[0] == 0
    assert token_file_round_trip(docs([]), WORD).count() == 0


def test_reader_takes_only_what_it_is_asked_for_and_finds_damage():
    buffer = io.BytesIO()
    writer = FrameWriter(buffer)
    for k in range(5):
        writer.add(k, struct.pack("<I", k) * 100)
    writer.finish()
    data = bytearray(buffer.getvalue())
    reader = FrameReader(io.BytesIO(bytes(data)), len(data))
    assert list(reader.find([3])) == [(3, struct.pack("<I", 3) * 100)]
    data[int(reader.offsets[1]) + 8] ^= 255
    broken = FrameReader(io.BytesIO(bytes(data)), len(data))
    assert broken.read(0) == reader.read(0)
    with pytest.raises(Exception):  # noqa: B017
        broken.read(1)


def test_files_are_seekable_zstandard(docs, spark):
    import zstandard

    shards = write_token_files(docs(["a b", "c"]), new_path(spark, "t"), WORD)
    paths = [r.path for r in shards.collect()]
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p.removeprefix("file:"), "rb"), read_across_frames=True).read() for p in paths)
    assert len(whole) // 4 == read_token_files(shards).toPandas().n_tokens.sum()


# Merkle trees

def test_merkle_rows(docs):
    texts = [*(x or "" for x in ODD), *(f"Line {k}. More of it.\nAnother line {k * 7}!\n\nEnd {k}." for k in range(40))]
    got = {r.doc_id: r for r in merkle.fingerprint_edits(docs(texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        other = texts[k - 1] if k else texts[-1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        row = got[k]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == merkle.fingerprint(text) and row.edited_fingerprint == merkle.fingerprint(edited)
        assert row.near_edited == merkle.likeness(row.fingerprint, row.edited_fingerprint) and row.near_next == merkle.likeness(row.fingerprint, merkle.fingerprint(other))
        differ = [n for n, (x, y) in enumerate(zip_longest(text.split("\n"), edited.split("\n"))) if x != y]
        assert row.edited_paragraph == (differ[0] if differ else None)
        assert abs(row.near_edited - leaf_likeness(text, edited)) < 1e-12 and abs(row.near_next - leaf_likeness(text, other)) < 1e-12


def leaf_likeness(a, b):
    """From the texts alone: phrases in common, without any tree."""
    if a == b:
        return 1.0
    x, y = (Counter(p for line in t.split("\n") for p in merkle.phrases(line)) for t in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0


def test_merkle_nodes_by_hand():
    """Each node is the hash of its children's, and a fingerprint holds every branch's."""
    h = lambda mark, *parts: hashlib.blake2b(b"".join(parts), digest_size=16, person=mark).digest()
    first, empty, last = h(b"paragraph", h(b"leaf", b"One. "), h(b"leaf", b"Two.")), h(b"paragraph"), h(b"paragraph", h(b"leaf", b"End"))
    assert first[0] % merkle.SECTION_EVERY  # or the section would end there
    sections = [h(b"section", first, empty), h(b"section", last)]
    root, found = merkle.tree("One. Two.\n\nEnd")
    assert root == h(b"root", *sections).hex() and [s for s, _ in found] == [s.hex()[:16] for s in sections]
    assert [[p for p, _ in ps] for _, ps in found] == [[first.hex()[:16], empty.hex()[:16]], [last.hex()[:16]]]
    assert merkle.read_form(merkle.fingerprint("One. Two.\n\nEnd")) == (root, found)


def test_merkle_fuzz():
    """Random edits: the descent gives what comparing lines and phrases gives."""
    rng = random.Random(9)
    words = ["alpha", "beta.", "gamma!", "", "delta", "é"]
    for _ in range(300):
        lines = [" ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(rng.randrange(1, 25))]
        other = list(lines)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [" ".join(rng.choices(words, k=3))]
        a, b = "\n".join(lines), "\n".join(other)
        x, y = merkle.tree(a), merkle.tree(b)
        assert merkle.read_form(merkle.written_form(x)) == x and (x[0] == y[0]) == (a == b)
        assert abs(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) - leaf_likeness(a, b)) < 1e-12
        differ = [n for n, (p, q) in enumerate(zip_longest(lines, other)) if p != q]
        assert merkle._first_edit(x, y) == (differ[0] if differ else None)
        rebuilt, done = [], 0
        for _, (f, g), (p, q) in merkle.edits(merkle.fingerprint(a), merkle.fingerprint(b)):
            rebuilt += lines[done:f] + other[p:q]
            done = g
        assert rebuilt + lines[done:] == other


def test_merkle_edges(docs):
    assert merkle.fingerprint_edits(docs([])).count() == 0
    one = merkle.fingerprint_edits(docs(["only\none"])).first()
    assert one.near_next == 1.0
    assert merkle.fingerprint_edits(docs(ODD, ODD_IDS)).count() == 8


def test_edits_are_located():
    lines = [f"Paragraph {k} says {k * k}." for k in range(60)]
    changed = [*lines[:20], "Something else.", *lines[21:40], *lines[42:]]
    a, b = merkle.fingerprint("\n".join(lines)), merkle.fingerprint("\n".join(changed))
    found = merkle.edits(a, b)
    assert ("replace", (20, 21), (20, 21)) in found and any(kind == "delete" and old == (40, 42) for kind, old, _ in found)
    assert merkle.edits(a, a) == [] and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(merkle.fingerprint("a b c."), merkle.fingerprint("x y z.")) == 0
    assert "".join(merkle.phrases("One. Two words! " + "long " * 100)) == "One. Two words! " + "long " * 100
