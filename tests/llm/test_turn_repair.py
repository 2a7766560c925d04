"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pandas as pd
import pytest

from plumeria.llm import queries
from plumeria.llm import turn_repair as t

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # the role that can be inserted


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows):
    """(cost, audit, repaired turns): the least of all edits, by whole audits."""
    faults, n = fault_of(rows), len(rows)

    @lru_cache(None)
    def least(i, last, inserted):
        found = []
        if i == n and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            r = NEXT[last]
            c, a, out = least(i, r, inserted + 1)
            found.append((5 + c, "I" + a, ({"u": "user:", "a": "assistant:"}[r], *out)))
        if i < n:
            (role, text), fault = rows[i], faults[i]
            c, a, out = least(i + 1, last, 0)
            found.append((2 + c, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                for name, price, edit in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    first = name[:1]
                    if first == NEXT[last] or (first == "s" and last == ""):
                        c, a, out = least(i + 1, first, 0)
                        found.append((price + 5 * (fault == "truncated") + c, edit + a, (f"{name}:{text}", *out)))
        return min(found, key=lambda x: x[:2], default=(1 << 40, "", ()))

    return least(0, "", 0)


def expected(conversations):
    """The contract's rows, by plain code."""
    out = {}
    for conv, turn, role, text in conversations:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in rows if r[0] is not None}
        faults = fault_of([r[1:] for r in rows])
        initials = [r[1][:1] for r in rows]
        cost, audit, repaired = search(tuple(r[1:] for r in rows))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def run(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r[0]: tuple(r)[1:] for r in t.repair_digests(t.edits(t.damaged(df)), df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made(rng, conversations, most):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Well", " ", "", "Ok?\n", "a. b", None, "Längeres."]
    rows = []
    for c in range(conversations):
        for k in range(rng.randrange(1, most)):
            rows.append((None if c == 0 else c, rng.choice([None, k, k, k, k + 1]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(9)}."))
            if rng.random() < 0.05:
                rows += [rows[-1]] * rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_many_short_conversations(spark, seed):
    rows = made(random.Random(seed), 250, 9)
    assert run(spark, rows) == expected(rows)


def test_long_conversations_across_ranges(spark):
    """A few conversations hold all rows, so each lies in several parts."""
    rows = made(random.Random(5), 3, 260)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = t.edits(t.damaged(df))
        assert found.select("conversation", "part").distinct().count() > 8
        assert run(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(300))
def test_choices_without_spark(seed):
    """Prices and audits of the programme alone, cut into parts anywhere."""
    rng = random.Random(seed)
    rows = tuple((rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "B", "", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(rng.randrange(0, 12)))
    turns = [(t.INITIALS.get(r[:1], 0), int(f == "truncated"), f in ("blank", "duplicate")) for (r, _), f in zip(rows, fault_of(rows), strict=True)]
    picked, least = t.choices(turns)
    audit, last = "", t.START
    for option, last in t.walk(picked, t.START):
        audit += "I" * option[2] + option[3] if option else "D"
    audit += "I" * t.AFTER[last]
    cost = least[t.START] + t.DELETE * len(turns)
    assert (cost, audit) == search(rows)[:2]
    cut = rng.randrange(len(turns) + 1)
    middle = t.choices(turns[cut:])[1]
    assert t.choices(turns[:cut], middle)[1] == least


def test_nothing_left_and_empty_tables(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, times int")
    assert t.repair_digests(t.edits(t.damaged(df)), df).count() == 0


def test_operator_gives_repaired_turns(spark):
    df = spark.createDataFrame([("c", 1, "user", "Hi.", 9), ("c", 2, "user", "Again.", 9), ("c", 2, "user", "Again.", 9), ("c", 3, None, "So.", 9)], "conv_id string, turn int, role string, text string, place int")
    got = [tuple(r) for r in t.repaired(t.edits(df)).orderBy("part", "place", "step").select("role", "text").collect()]
    want = search((("user", "Hi."), ("user", "Again."), ("user", "Again."), ("", "So.")))
    assert [f"{role}:{text}" for role, text in got] == list(want[2])
    audit = "".join(r.edit * r.times for r in t.edits(df).orderBy("part", "place", "step").collect())
    assert audit == want[1]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_turn_repair(spark, sf).toPandas().set_index("conv_id")
    want = pd.DataFrame.from_dict(expected(rows), orient="index", columns=got.columns)
    assert len(got) == len(want) and (got.sort_index() == want.sort_index()).all().all()
