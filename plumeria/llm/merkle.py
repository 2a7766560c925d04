"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

A text's lines are its paragraphs; a section is a run of paragraphs that ends at an empty line or
after one whose hash says so, so an edit moves no section's end but its own. Phrases (sentences, long
ones cut after words whose hash says so) are the leaves. Each node hashes its children's hashes, so
equal roots mean equal texts, and where roots differ the branches that differ lead to the edits:
likeness and edits pass over sections, then paragraphs, that both trees have, and look at leaves
only below paragraphs that one has and the other has not.

A fingerprint is a text: the root in 32 hex digits, a colon, and the sections, parted by semicolons.
A section is its hash in 16 digits, a slash, and its paragraphs, parted by commas; a paragraph is its
hash in 16 digits and those of its phrases in 6 each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate, zip_longest

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BRANCH_DIGITS, LEAF_DIGITS = 16, 6
PHRASE = re.compile(r"[^.!?]*[.!?]*\s*")
LONG_PHRASE, CUT_EVERY, SECTION_EVERY = 160, 8, 12
#: Both fingerprints stand in one text meanwhile, so that compression sees what they share.
ROW = "doc_id long, n_chars long, edited_sha256 string, trees string, near_edited double, near_next double, edited_paragraph long"
#: A tree: root, and sections of (hash, paragraphs of (hash, leaves)); hashes in hex digits, leaves as one text of them.
Tree = tuple[str, list[tuple[str, list[tuple[str, str]]]]]


def _hash(mark: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=mark).digest()


def phrases(paragraph: str) -> list[str]:
    """The paragraph's phrases; joined, they are the paragraph."""
    out = []
    for phrase in PHRASE.findall(paragraph):
        if len(phrase) <= LONG_PHRASE:
            if phrase:
                out.append(phrase)
            continue
        held: list[str] = []
        for word in re.findall(r"\S*\s*", phrase):
            held.append(word)
            if zlib.crc32(word.encode()) % CUT_EVERY == 0 and word:
                out.append("".join(held))
                held = []
        if rest := "".join(held):
            out.append(rest)
    return out


def tree(text: str | None) -> Tree:
    """The tree of a text; null counts as empty."""
    sections: list[list[tuple[bytes, str]]] = [[]]
    for line in (text or "").split("\n"):
        leaves = [_hash(b"leaf", p.encode()) for p in phrases(line)]
        node = _hash(b"paragraph", b"".join(leaves))
        sections[-1].append((node, "".join(x.hex()[:LEAF_DIGITS] for x in leaves)))
        if not line.strip() or node[0] % SECTION_EVERY == 0:
            sections.append([])
    if len(sections) > 1 and not sections[-1]:
        sections.pop()
    nodes = [_hash(b"section", b"".join(n for n, _ in s)) for s in sections]
    short = lambda node: node.hex()[:BRANCH_DIGITS]
    return _hash(b"root", b"".join(nodes)).hex(), [(short(n), [(short(p), leaves) for p, leaves in s]) for n, s in zip(nodes, sections, strict=True)]


def written_form(of: Tree) -> str:
    """The fingerprint that stands for a tree."""
    return of[0] + ":" + ";".join(node + "/" + ",".join(p + leaves for p, leaves in s) for node, s in of[1])


def read_form(fingerprint: str) -> Tree:
    """The tree for which a fingerprint stands."""
    root, _, rest = fingerprint.partition(":")
    parts = (s.partition("/") for s in rest.split(";"))
    return root, [(node, [(p[:BRANCH_DIGITS], p[BRANCH_DIGITS:]) for p in s.split(",")]) for node, _, s in parts]


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; null counts as empty."""
    return written_form(tree(text))


def _apart(x: list[tuple], y: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The branches of each list beyond those that both have, as often as both have them; a branch starts with its hash."""
    more = Counter(b[0] for b in x)
    more.subtract(b[0] for b in y)
    over = {k: v for k, v in more.items() if v > 0}, {k: -v for k, v in more.items() if v < 0}
    out: tuple[list[tuple], list[tuple]] = ([], [])
    for side, left, kept in zip((x, y), over, out, strict=True):
        for branch in side:
            if left.get(branch[0], 0) > 0:
                left[branch[0]] -= 1
                kept.append(branch)
    return out


def _n_leaves(sections: list[tuple]) -> int:
    return sum(len(leaves) for _, s in sections for _, leaves in s) // LEAF_DIGITS


def _likeness(a: Tree, b: Tree) -> float:
    if a[0] == b[0]:
        return 1.0
    n, m = _n_leaves(a[1]), _n_leaves(b[1])
    if not n or not m:
        return 0.0
    x, y = ([p for _, s in side for p in s] for side in _apart(a[1], b[1]))
    x, y = (Counter(leaves[k : k + LEAF_DIGITS] for _, leaves in side for k in range(0, len(leaves), LEAF_DIGITS)) for side in _apart(x, y))
    return (n + m - (x - y).total() - (y - x).total()) / (n + m)


def likeness(a: str, b: str) -> float:
    """1 for equal roots; else the share of leaves that two fingerprints have in common, of all leaves of both.

    Leaves below equal branches are common; only those of paragraphs in which the trees differ are compared.
    """
    return 1.0 if a[:32] == b[:32] else _likeness(read_form(a), read_form(b))


def _first_edit(a: Tree, b: Tree) -> int | None:
    """The number of the first paragraph in which two trees differ, by going down the first branches that differ; none for equal roots."""
    if a[0] == b[0]:
        return None
    at = 0
    for s, t in zip_longest(a[1], b[1]):
        if s and t and s[0] == t[0]:
            at += len(s[1])
            continue
        for p, q in zip_longest(s[1] if s else [], t[1] if t else []):
            if not p or not q or p[0] != q[0]:
                return at
            at += 1
    return at


def edits(a: str, b: str) -> list[tuple[str, tuple[int, int], tuple[int, int]]]:
    """Where two texts differ: (kind, paragraphs of the first, paragraphs of the second), by going down branches that differ.

    Sections that both have are passed over as wholes; within the others, paragraphs are compared.
    """
    if a[:32] == b[:32]:
        return []
    trees = [read_form(t)[1] for t in (a, b)]
    starts = [[0, *accumulate(len(ps) for _, ps in t)] for t in trees]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, *([n for n, _ in t] for t in trees), autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        x, y = ([p for _, ps in part for p, _ in ps] for part in (trees[0][i:j], trees[1][k:m]))
        at, to = starts[0][i], starts[1][k]
        out += [(kind, (at + f, at + g), (to + p, to + q)) for kind, f, g, p, q in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if kind != "equal"]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the start of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, own: Tree, following: str, following_tree: Tree) -> tuple:
    other = edited(text, following)
    other_tree = own if other == text else tree(other)
    trees = written_form(own) + "|" + written_form(other_tree)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), trees, _likeness(own, other_tree), _likeness(own, following_tree), _first_edit(own, other_tree)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of ``docs`` (doc_id, text) and its edited text, whose last half comes from the next document.

    ``edited_paragraph`` is the number of the first paragraph in which both differ, null for equal texts.

    The next document is the next by descending doc_id (nulls last, rows of one id by text), and the
    first one's after the last. Texts are shuffled once, in ranges of that order. A task compares
    each row with the one after it; its first and last rows are left for a table of a row for each task.
    There the tasks' numbers are put in order, without texts, and each task's last row meets the first row of the next.
    Null and empty texts have an empty tree; a single row is its own next; an empty table gives no rows; other columns are ignored.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(F.desc_nulls_last("doc_id"), F.desc("h")).sortWithinPartitions(*order).drop("h")
    names, whole = [f.split()[0] for f in ROW.split(", ")], {"doc_id": "Int64", "n_chars": "Int64", "edited_paragraph": "Int64"}
    edge = "task int, first_text string, last_id long, last_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = held = None
        for batch in batches:
            done = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                own = tree(text)
                if held is None:
                    first = text
                else:
                    done.append(_row(*held, text, own))
                held = (doc_id, text, own)
            out = pd.DataFrame(done, columns=names).astype(whole)
            yield out.assign(task=pd.Series([pd.NA] * len(out), dtype="Int32"), first_text=None, last_id=pd.Series([pd.NA] * len(out), dtype="Int64"), last_text=None)
        if held is not None:
            blank = dict.fromkeys(names)
            yield pd.DataFrame([blank | {"task": TaskContext.get().partitionId(), "first_text": first, "last_id": held[0], "last_text": held[1]}]).astype(whole | {"last_id": "Int64", "near_edited": float, "near_next": float})

    done = written(ranged.mapInPandas(run, f"{ROW}, {edge}"), "trees")
    tasks = done.filter("task is not null")  # a row for each task
    numbers = tasks.select("task")
    after = F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy(F.lit(0))))
    following = tasks.select(F.col("task").alias("after"), F.col("first_text").alias("following"))
    joints = tasks.select("task", F.col("last_id").alias("doc_id"), F.col("last_text").alias("text")).join(numbers.select("task", after.alias("after")), "task").join(following, "after")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_row(d, t, tree(t), f, tree(f)) for d, t, f in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["following"], strict=True)]
            yield pd.DataFrame(found, columns=names).astype(whole)

    found = done.filter("task is null").select(*names).unionByName(joints.select("doc_id", "text", "following").mapInPandas(join, ROW))
    part = lambda k: F.split_part("trees", F.lit("|"), F.lit(k))
    return found.select("doc_id", "n_chars", "edited_sha256", part(1).alias("fingerprint"), part(2).alias("edited_fingerprint"), "near_edited", "near_next", "edited_paragraph")
