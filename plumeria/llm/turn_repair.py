"""Conversations with broken turn structure, repaired at least cost by a dynamic programme over the turns that stay.

A repair keeps some turns, some of them under another role, and deletes the rest. What a gap between two turns
that stay costs is a difference of two prefix sums of deletion costs, so of all earlier turns only the least
value net of that sum counts, one for each role they can end in; which roles meet decides the turns to insert
between them. The programme runs from the end, so that its choices give the repair from the front: of repairs
of one cost, a running minimum that is not improved strictly keeps the later turn, and with it the edits
that are least in ASCII order.

Turns are sorted by ranges, not dealt by conversation. A conversation that lies across ranges is put together
from a table for each of its parts: what it costs to come in under one role and go out under another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The last turn that stays: none, or one whose role begins so.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert between two that stay, by their roles (no other pair can follow), and after the last.
BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
AFTER = (0, 2, 1, 0)
END = tuple(INSERT * k for k in AFTER)
FAR = 1 << 60
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
BLANKS = " \t\n\x0b\x0c\r"
#: Code points of a text by which rows of one turn and role are dealt into ranges.
RANGE_PREFIX = 256
ROW_BITS = 33  #: of monotonically_increasing_id, that number the rows of a partition


def _options() -> list:
    """[initial][truncated][last]: (price, role, inserts, edit) of keeping a turn, in the order that ties prefer; the price is net of its deletion."""
    table = []
    for own in range(4):
        row = []
        for truncated in (0, 1):
            by = []
            for last in range(4):
                ways = [(0, own, "K")] if own else []
                ways += [(REROLE, r, "R") for r in ROLES if r != own]
                found = [(INSERT * BETWEEN[last, r] + cost + TRUNCATED * truncated - DELETE, r, BETWEEN[last, r], edit) for cost, r, edit in ways if (last, r) in BETWEEN]
                by.append(tuple(sorted(found, key=lambda w: (-w[2], w[3]))))
            row.append(by)
        table.append(row)
    return table


OPTIONS = _options()


def choices(turns: list[tuple[int, int, bool]], end: tuple[int, ...] = END) -> tuple[list, tuple[int, ...]]:
    """What to do at each turn (initial, truncated, must go) for each role last kept: None to delete it, or an option; and the least values at the start, net of all deletions."""
    least, out = tuple(end), []
    for own, truncated, gone in reversed(turns):
        if gone:
            out.append((None,) * 4)
            continue
        now, picked = [], []
        for last, options in enumerate(OPTIONS[own][truncated]):
            best, pick = least[last], None
            for option in options:
                value = option[0] + least[option[1]]
                if value < best:
                    best, pick = value, option
            now.append(best)
            picked.append(pick)
        least = tuple(now)
        out.append(tuple(picked))
    return out[::-1], least


def walk(picked: list, last: int) -> Iterator[tuple[tuple | None, int]]:
    """The option taken at each turn, and the role last kept after it."""
    for options in picked:
        option = options[last]
        last = option[1] if option else last
        yield option, last


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with a fault in some rows, decided by the CRC-32 of ``conv_id:turn`` modulo 20.

    Nulls are read as one space, but conv_id and turn themselves stay null. 0 drops the row, 1 empties its
    text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", cell("conv_id"), cell("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), cell("role").alias("role"), cell("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def conversation_key(conv_id: Column) -> Column:
    """A text for each conversation, never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


COLUMNS = ("part", "conversation", "place", "times", "fault", "initial")


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """COLUMNS of whole runs of rows with one (part, conversation), which come sorted; each row is copied once."""
    held: list[list[np.ndarray]] = []
    joined = lambda: dict(zip(COLUMNS, held[0] if len(held) == 1 else map(np.concatenate, zip(*held, strict=True)), strict=True))
    for frame in frames:
        if not len(frame):
            continue
        columns = [frame[c].to_numpy() for c in COLUMNS]
        part, conversation = columns[:2]
        starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (conversation[1:] != conversation[:-1])])).tolist()
        for s, e in zip(starts, [*starts[1:], len(frame)], strict=True):
            if held and (s or (held[0][0][0], held[0][1][0]) != (part[0], conversation[0])):
                yield joined()
                held = []
            held.append([c[s:e] for c in columns])
    if held:
        yield joined()


GONE = frozenset(("blank", "duplicate"))


def _turns(segment: dict[str, np.ndarray]) -> list[tuple[int, int, bool]]:
    return [(i, int(f == "truncated"), f in GONE) for i, f in zip(segment["initial"].tolist(), segment["fault"].tolist(), strict=True)]


def _dealt(slim: DataFrame) -> DataFrame:
    """Each part's rows in one task, in order. The number of tasks is fixed, so that rows of few bytes aren't put together in a few tasks."""
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(n, "part").sortWithinPartitions("part", "place")


def _crossing(slim: DataFrame) -> dict[tuple[int, str], tuple]:
    """By (part, conversation), of conversations in more than one part: values after it, role last kept before it, initial before it, whether it ends there.

    Each border of two ranges lies in one conversation at most, so these are at most twice as many as parts.
    """
    spread = slim.groupBy("conversation").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("conversation")
    listed = written(slim.join(F.broadcast(spread), "conversation"), "crossing")
    if not listed.limit(1).count():
        discard(listed)
        return {}
    dealt = _dealt(listed)

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for segment in _segments(frames):
            turns = _turns(segment)
            costs = [choices(turns, tuple(0 if r == out else FAR for r in range(4)))[1] for out in range(4)]
            yield pd.DataFrame({"part": [segment["part"][0]], "conversation": [segment["conversation"][0]], "costs": [np.array(costs).ravel()], "final": [segment["initial"][-1]]})

    parts: dict[str, list] = {}
    for r in dealt.mapInPandas(tables, "part long, conversation string, costs array<long>, final int").collect():
        parts.setdefault(r.conversation, []).append((r.part, np.array(r.costs).reshape(4, 4), r.final))
    ends: dict[tuple[int, str], tuple[int, ...]] = {}
    for conversation, own in parts.items():
        own.sort(key=lambda x: x[0])
        end = END
        for part, costs, _ in reversed(own):  # costs[out][in]
            ends[part, conversation] = end
            end = tuple(int(x) for x in (costs + np.array(end)[:, None]).min(axis=0))

    def leaving(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for segment in _segments(frames):
            at = segment["part"][0], segment["conversation"][0]
            picked = choices(_turns(segment), ends[at])[0]
            outs = []
            for last in range(4):
                for _, last in walk(picked, last):
                    pass
                outs.append(last)
            yield pd.DataFrame({"part": [at[0]], "conversation": [at[1]], "outs": [outs]})

    outs = {(r.part, r.conversation): r.outs for r in dealt.mapInPandas(leaving, "part long, conversation string, outs array<int>").collect()}
    discard(listed)
    found = {}
    for conversation, own in parts.items():
        last, before = START, -1
        for part, _, final in own:
            found[part, conversation] = ends[part, conversation], last, before, part == own[-1][0]
            last, before = outs[part, conversation][last], final
    return found


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``turns`` (conv_id, turn, role, text), in order: a written table.

    Turns are in order of ``turn`` (nulls first), then of role and text; equal rows are one row of that many
    ``times``. A row is (conversation, conv_id, part, place, step, edit, times, fault, turn, role, text, illegal):
    conversation is its key, which is never null; part, place, step give the order; edit is K (keep), R
    (other role), D (delete) or I (insert); role is the one after the edit; deleted rows have no text; fault is
    that of the turn's first copy; illegal counts, once for each turn, the neighbours before and among its
    copies whose initials don't fit. Null roles and texts are empty. A role without an initial of s, u or a
    can't be kept. Columns besides these four are left out; an empty table gives no rows.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(conversation_key(F.col("conv_id")).alias("conversation"), "conv_id", F.col("turn").cast("long").alias("turn"), cell("role"), cell("text"))
    rows = rows.groupBy("conversation", "conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    order = ["conversation", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.left("text", F.lit(RANGE_PREFIX))).sortWithinPartitions(*order, "text")
    at = F.monotonically_increasing_id()
    placed = written(dealt.withColumn("at", at), "turns").withColumns({"part": F.shiftright("at", ROW_BITS), "place": F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})

    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ended == "", "blank").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.coalesce(*(F.when(F.startswith("role", F.lit(k)), v) for k, v in INITIALS.items()), F.lit(0))
    same = ["conversation", "role", "hash"]
    slim = placed.select("conversation", "part", "place", "times", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), fault.alias("fault"), initial.alias("initial"))
    repeated = slim.groupBy(*same).agg(F.min(F.struct("part", "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = F.col("first").isNotNull() & (F.struct("part", "place") != F.col("first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(later, "duplicate").otherwise(F.col("fault"))
    slim = written(slim.join(repeated, same, "left").select("conversation", "part", "place", "times", fault.alias("fault"), "initial"), "faults")
    crossing = _crossing(slim)

    names = ["part", "place", "fault", "edit", "before", "role_to", "after", "illegal"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for segment in _segments(frames):
            part, conversation = segment["part"][0], segment["conversation"][0]
            end, last, before, ends = crossing.get((part, conversation), (END, START, -1, True))
            turns = _turns(segment)
            for place, fault, times, (initial, _, _), (option, last) in zip(segment["place"].tolist(), segment["fault"].tolist(), segment["times"].tolist(), turns, walk(choices(turns, end)[0], last), strict=True):
                illegal = times - 1 + (before >= 0 and (before, initial) not in LEGAL)
                rows.append((part, place, fault, option[3] if option else "D", option[2] if option else 0, option[1] if option else 0, 0, illegal))
                before = initial
            if ends:
                rows[-1] = (*rows[-1][:6], AFTER[last], rows[-1][7])
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    done = _dealt(slim).mapInPandas(run, "part long, place long, fault string, edit string, before int, role_to int, after int, illegal long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    named = F.when(F.col("role_to") == USER, ROLES[USER]).otherwise(ROLES[ASSISTANT])
    other = F.when(F.col("role_to") == USER, ROLES[ASSISTANT]).otherwise(ROLES[USER])
    kept = F.col("edit") != "D"
    first = F.coalesce(~F.col("fault").isin("blank", "duplicate"), F.lit(True))  # its copies have another fault
    row = lambda step, edit, times, role, text, fault=F.lit(None).cast("string"), illegal=none: F.struct(F.lit(step).alias("step"), edit.alias("edit"), times.alias("times"), fault.alias("fault"), role.alias("role"), text.alias("text"), illegal.alias("illegal"))
    insert = lambda step, role: row(step, F.lit("I"), one, role, F.lit(""))
    steps = F.array(
        F.when(F.col("before") > 0, insert(0, other)),
        row(1, F.col("edit"), F.when(first, one).otherwise(F.col("times")), F.when(F.col("edit") == "R", named).otherwise(F.col("role")), F.when(kept, F.col("text")), F.col("fault"), F.col("illegal")),
        F.when(first & (F.col("times") > 1), row(2, F.lit("D"), F.col("times") - 1, F.col("role"), F.lit(None).cast("string"), F.lit("duplicate"))),
        F.when(F.col("after") > 1, insert(3, F.lit(ROLES[USER]))),
        F.when(F.col("after") > 0, insert(4, F.lit(ROLES[ASSISTANT]))),
    )
    joined = placed.join(done, ["part", "place"]).select("conversation", "conv_id", "part", "place", "turn", F.explode(F.array_compact(steps)).alias("s"))
    out = written(joined.select("conversation", "conv_id", "part", "place", "s.step", "s.edit", "s.times", "s.fault", "turn", "s.role", "s.text", "s.illegal"), "edits")
    discard(placed)
    discard(slim)
    return out


def repaired(found: DataFrame) -> DataFrame:
    """(conv_id, part, place, step, role, text) of the turns that ``edits`` leaves or inserts; the middle three give the order."""
    return found.filter("edit != 'D'").select("conv_id", "part", "place", "step", "role", "text")


def repair_digests(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``: counts and costs of its ``edits``, the audit and a hash of the repaired turns.

    The counts are pre-aggregated. The audit is one cell's text, and a SHA-256 runs over a conversation's turns in
    order, so a conversation's turns pass through one task, one after another; no task holds them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, audit, digest, out = None, [], None, []

        def done() -> None:
            out.append((now, "".join(audit), digest.hexdigest()))

        for frame in frames:
            for conversation, edit, times, role, text in zip(frame["conversation"], frame["edit"], frame["times"], frame["role"], frame["text"], strict=True):
                if conversation != now:
                    if now is not None:
                        done()
                    now, audit, digest, first = conversation, [], hashlib.sha256(), True
                audit.append(edit * times)
                if edit != "D":
                    digest.update(f"{'' if first else '\n'}{role}:{text}".encode())
                    first = False
            yield pd.DataFrame(out, columns=["conversation", "audit", "repaired_sha256"])
            out.clear()
        if now is not None:
            done()
            yield pd.DataFrame(out, columns=["conversation", "audit", "repaired_sha256"])

    ordered = found.select("conversation", "part", "place", "step", "edit", "times", "role", "text").repartition("conversation").sortWithinPartitions("conversation", "part", "place", "step")
    hashed = ordered.mapInPandas(run, "conversation string, audit string, repaired_sha256 string")
    faulty = lambda kind: F.sum(F.when(F.col("fault") == kind, F.col("times")))
    price = F.when(F.col("edit") == "R", REROLE).when(F.col("edit") == "D", DELETE * F.col("times")).when(F.col("edit") == "I", INSERT).otherwise(0)
    price = price + F.when((F.col("fault") == "truncated") & F.col("edit").isin("K", "R"), TRUNCATED).otherwise(0)
    counts = {"blank": faulty("blank"), "duplicate": faulty("duplicate"), "truncated": faulty("truncated"), "illegal": F.sum("illegal"), "cost": F.sum(price)}
    by_turn = found.groupBy("conversation", "turn").agg(*(c.alias(k) for k, c in counts.items()))
    stats = by_turn.groupBy("conversation").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(k).alias(k) for k in counts))
    every = conversations.select("conv_id").distinct().withColumn("conversation", conversation_key(F.col("conv_id")))
    whole = every.join(stats, "conversation", "left").join(hashed, "conversation", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return whole.select("conv_id", zero("gaps"), *(zero(k) for k in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
