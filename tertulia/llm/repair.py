"""Conversation repair by a generalised LR parser.

What a conversation may look like is a grammar over the initials of its roles:

    D -> (empty) | P | s P        P -> u a | P u a

A parser reads the rows of a conversation from left to right. For every row it may keep the role, give
the row another role, or delete it, and before any row it may insert one with an empty text; each has a
cost. All ways are followed at once in a graph-structured stack: stacks whose tops are equal go on alike,
so of these only the cheapest stays, and of equally cheap ones the one whose edits read least. The tops
are four: nothing yet, `s`, `u` (an answer is due) and `P` (complete pairs).

Long conversations are cut by turn into parts that different tasks read. What a part does to a stack
depends on the top it starts with alone, so a task sums a part up as the cheapest way from each top to each other,
four by four; the parts' sums are put together per conversation, and then each part is parsed with the
tops it starts and ends with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tertulia.plans.staging import stage

TURNS = 1024  # turn numbers in a part
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping is free, an unfinished row that stays costs more
START, SYSTEM, USER, PAIRS = range(4)
ROLES = {"u": "user", "a": "assistant"}
#: What each top takes next: the initial of a role, and the top it leads to. `u a` behind a top is reduced to PAIRS.
TAKES = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": PAIRS},
    PAIRS: {"u": USER},
}
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)  # a row's fault
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
KEY = ("conv_id", "part", "start", "end", "final")


@lru_cache(maxsize=None)
def actions(initial: str, fault: int) -> tuple[tuple[int, int, int, str, str], ...]:
    """What may be done up to and with one row: top before, top after, cost, edits, and the roles of
    the rows that come out of it. Two inserts in a row are never cheapest: the pair could be left out."""
    out = []
    dear = TRUNCATED if fault == CUT_OFF else 0

    def with_row(before: int, top: int, cost: int, edits: str, roles: str) -> None:
        out.append((before, top, cost + DELETE, edits + "D", roles))
        if fault in (BLANK, DUPLICATE):
            return
        for role, after in TAKES[top].items():
            if role == initial:
                out.append((before, after, cost + dear, edits + "K", roles + role))
            elif role in ROLES:
                out.append((before, after, cost + RELABEL + dear, edits + "R", roles + role))

    for before, takes in TAKES.items():
        with_row(before, before, 0, "", "")
        for role, after in takes.items():
            if role in ROLES:
                with_row(before, after, INSERT, "I", role)
    return tuple(out)


class Stack:
    """The tops of the graph-structured stack after some rows.

    A top has its cost, its rank among the tops in the order of their edits, and whatever `extend` made
    of it. Edits up to the last row read never are the beginning of one another, as each way has
    spent the same rows; so their order stays what it is however they go on, and ranks stand for them.
    """

    def __init__(self, top: int, held: object, extend: Callable):
        self.tops = {top: (0, 0, held)}
        self.extend = extend

    def read(self, row: object, initial: str, fault: int) -> None:
        best: dict[int, tuple] = {}
        for before, after, cost, edits, roles in actions(initial, fault):
            if before in self.tops:
                known, rank, held = self.tops[before]
                way = (known + cost, rank, edits, roles, held)
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
        order = {top: i for i, (top, _) in enumerate(sorted(best.items(), key=lambda b: b[1][1:3]))}
        self.tops = {top: (w[0], order[top], self.extend(w[4], row, w[2], w[3])) for top, w in best.items()}

    def accepted(self) -> tuple[int, int, str]:
        """The top a conversation ends with, its cost there, and the initials of what is inserted behind it."""
        ends = {START: "", PAIRS: "", USER: "a"}
        ways = [(cost + INSERT * len(ends[top]), rank, top) for top, (cost, rank, _) in self.tops.items() if top in ends]
        cost, _, top = min(ways)
        return top, cost, ends[top]


def summed_up(rows: list[tuple[str, int]], tops: range | tuple[int, ...]) -> list[int]:
    """The cheapest ways through rows (initial, fault): start, end, cost and rank of each, in one list."""
    out = []
    for start in tops:
        stack = Stack(start, None, lambda *_: None)
        for initial, fault in rows:
            stack.read(None, initial, fault)
        for end, (cost, rank, _) in stack.tops.items():
            out += [start, end, cost, rank]
    return out


def put_together(parts: list[list[int]]) -> list[tuple[int, int]]:
    """The tops that each part of a conversation starts and ends with, from the parts' sums."""
    tops, steps = {START: (0, 0)}, []
    for sums in parts:
        best: dict[int, tuple] = {}
        for start, end, cost, rank in zip(*[iter(sums)] * 4, strict=True):
            if start in tops:
                way = (tops[start][0] + cost, tops[start][1], rank, start)
                best[end] = min(best.get(end, way), way)
        order = {top: i for i, (top, _) in enumerate(sorted(best.items(), key=lambda b: b[1][1:3]))}
        tops = {top: (w[0], order[top]) for top, w in best.items()}
        steps.append({top: w[3] for top, w in best.items()})
    last = Stack(START, None, lambda *_: None)
    last.tops = {top: (cost, rank, None) for top, (cost, rank) in tops.items()}
    end, out = last.accepted()[0], []
    for step in reversed(steps):
        out.append((step[end], end))
        end = step[end]
    return out[::-1]


def fault_of(text: str, again: bool) -> int:
    held = text.strip(BLANKS)
    return BLANK if not held else DUPLICATE if again else SOUND if held[-1] in ".!?" else CUT_OFF


class Part:
    """Rows of one part of a conversation in order, with what is counted of them."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []  # role, text
        self.faults: list[int] = []
        self.turns: list[int] = []
        self.seen: set[tuple[str, bytes]] = set()

    def add(self, turn: int | None, role: str, text: str, digest: bytes, again: bool) -> None:
        self.rows.append((role, text))
        self.faults.append(fault_of(text, again or (role, digest) in self.seen))
        self.seen.add((role, digest))
        if turn is not None:
            self.turns.append(turn)

    def classes(self) -> list[tuple[str, int]]:
        return [(role[:1], fault) for (role, _), fault in zip(self.rows, self.faults, strict=True)]

    def repaired(self, start: int, end: int | None, last: bool) -> dict:
        """The part after its edits; without `end` it is a whole conversation."""
        stack = Stack(start, None, lambda held, row, edits, roles: (held, row, edits, roles))
        for row, (initial, fault) in zip(self.rows, self.classes(), strict=True):
            stack.read(row, initial, fault)
        top, _, behind = stack.accepted() if end is None or last else (end, 0, "")
        cost, _, way = stack.tops[top if end is None else end]
        out, audit = [(ROLES[r], "", "I") for r in behind], ["I" * len(behind)]
        while way is not None:
            way, (role, text), edits, roles = way
            audit.append(edits)
            if edits[-1] != "D":
                out.append((role if edits[-1] == "K" else ROLES[roles[-1]], text, edits[-1]))
            if edits[0] == "I":
                out.append((ROLES[roles[0]], "", "I"))
        initials = [role[:1] for role, _ in self.rows]
        pairs = [a + b for a, b in zip(initials, initials[1:], strict=False)]
        return {
            "rows": [{"role": role, "text": text, "edit": edit} for role, text, edit in reversed(out)],
            "audit": "".join(reversed(audit)),
            "cost": cost + INSERT * len(behind),
            "blank": self.faults.count(BLANK),
            "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(CUT_OFF),
            "illegal": sum(pair not in LEGAL for pair in pairs),
            "first": initials[0],
            "last": initials[-1],
            "low": min(self.turns, default=None),
            "high": max(self.turns, default=None),
            "turns": len(set(self.turns)),
        }


def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Part]]:
    """Parts from sorted rows, whose first columns tell conversation and part, the start and end tops among them."""
    known, part = None, Part()
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        keys = [columns[names.index(n)] for n in KEY]
        rows = [columns[names.index(n)] for n in ("turn", "role", "text", "digest", "again")]
        for key, row in zip(zip(*keys, strict=True), zip(*rows, strict=True), strict=True):
            if key != known:
                if known is not None:
                    yield known, part
                known, part = key, Part()
            part.add(*row)
    if known is not None:
        yield known, part


def in_parts(conversations: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, text and digest, and whether an earlier part holds the same role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62)))).withColumn("digest", F.unhex(F.md5("text")))
    met = rows.groupBy("conv_id", "role", "digest").agg(F.min("part").alias("earliest"), F.max("part").alias("latest"))
    met = stage(met.where("earliest < latest").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    found = rows.join(met, same, "left").withColumn("again", F.coalesce(F.col("earliest") < F.col("part"), F.lit(False)))
    return found.drop("c", "r", "d", "earliest")


def routes(rows: DataFrame) -> DataFrame:
    """For each part of the conversations that have several: the tops it starts and ends with, and whether it is the last."""
    spread = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    spread = stage(spread.select(F.col("conv_id").alias("c"), "low"))
    several = rows.join(spread, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        *[F.lit(None).cast("int").alias(n) if n in ("start", "end") else F.lit(False).alias(n) if n == "final" else F.col(n) for n in KEY],
        "turn", "role", "text", "digest", "again",
    )

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in read_parts(batches):
            yield pa.RecordBatch.from_pylist([{"conv_id": key[0], "part": key[1], "sums": summed_up(part.classes(), range(4))}], schema=sums)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tops = put_together([p["sums"] for p in r["parts"]])
                found = [
                    {"conv_id": r["conv_id"], "part": p["part"], "start": a, "end": b, "final": k == len(tops) - 1}
                    for k, (p, (a, b)) in enumerate(zip(r["parts"], tops, strict=True))
                ]
                yield pa.RecordBatch.from_pylist(found, schema=ways)

    sums = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("sums", pa.list_(pa.int64()))])
    ways = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("final", pa.bool_())])
    summed = dealt(several).mapInArrow(sum_up, "conv_id long, part long, sums array<long>")
    of_conversation = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "sums"))).alias("parts"))
    return stage(of_conversation.mapInArrow(join, "conv_id long, part long, start int, end int, final boolean"))


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each part of each conversation: conv_id, part, whole (the conversation has no other part),
    the repaired rows (role, text, edit), audit and cost of the edits, and counts.

    Rows go by turn, missing turns first, rows of one turn by role and text. Missing roles and texts are one
    space; a missing conv_id names a conversation like any other. A row's first fault counts: blank (no
    character but white space), duplicate (role and text of an earlier row of the conversation), truncated
    (the last character that is no white space is none of `.!?`). Edits are K (keep), R (another role), D
    (delete, which blank rows and duplicates need) and I (insert); the audit has them in order, and of
    equally cheap ones the least. A role counts by its first character; one without any fits nowhere.
    No rows give no rows; other columns are ignored, texts are read whole.

    A part has the rows of 1024 turn numbers, so that a long conversation is spread over tasks; only the
    sums of parts, sixteen ways each, meet per conversation. Rows that all share one turn, or lack it, are in one part.
    """
    rows = in_parts(conversations)
    ways = routes(rows).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "start", "end", "final")
    known = rows.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    counts = ("cost", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")
    line = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("rows", pa.list_(line)), ("audit", pa.string())]
        + [("first", pa.string()), ("last", pa.string())]
        + [(c, pa.int64()) for c in counts]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for (conv_id, number, start, end, final), part in read_parts(batches):
            whole = start is None
            out = part.repaired(START if whole else start, end, whole or final)
            done.append({"conv_id": conv_id, "part": number, "whole": whole, **out})
            size += sum(len(text) for _, text in part.rows)
            if len(done) >= 500 or size > 4_000_000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    shape = "conv_id long, part long, whole boolean, rows array<struct<role:string,text:string,edit:string>>, audit string, first string, last string"
    return dealt(known).mapInArrow(parse, ", ".join([shape, *[f"{c} long" for c in counts]]))


def repaired_rows(parts: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, part, place (in the part), role, text, edit."""
    return parts.select("conv_id", "part", F.posexplode("rows").alias("place", "row")).select("conv_id", "part", "place", "row.*")


def summary(parts: DataFrame) -> DataFrame:
    """A row for each conversation: counts, cost, audit, and the SHA-256 of its repaired rows.

    A hash reads all of its text in order, so one task passes over a conversation of several parts, part by
    part; it holds one part at a time.
    """
    written = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    # The text of a whole conversation is hashed where it is, and goes no further.
    hashed = parts.select(
        *[c for c in parts.columns if c not in ("rows", "whole")],
        F.size("rows").alias("n_rows"),
        F.when(~F.col("whole"), written).alias("lines"),
        F.when(F.col("whole"), F.sha2(written, 256)).alias("sha256"),
    )

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if total is None or total.conv_id != r["conv_id"]:
                    if total is not None:
                        done.append(total.row())
                    total = Total(r["conv_id"])
                total.add(r)
            yield pa.RecordBatch.from_pylist([{k: d[k] for k in columns} for d in done], schema=schema)
        if total is not None:
            last = total.row()
            yield pa.RecordBatch.from_pylist([{k: last[k] for k in columns}], schema=schema)

    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in columns])
    shape = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in columns)
    return hashed.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(pass_over, shape)


class Total:
    """A conversation of several parts, as far as it has been read."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.hash, self.begun, self.last = conv_id, hashlib.sha256(), False, None
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.audits: list[str] = []
        self.low = self.high = self.sha256 = None

    def add(self, part: dict) -> None:
        self.sha256 = part["sha256"]
        for name in self.sums:
            self.sums[name] += part[name]
        if self.last is not None:
            self.sums["illegal"] += self.last + part["first"] not in LEGAL
        self.last = part["last"]
        self.audits.append(part["audit"])
        if part["low"] is not None:
            self.low = part["low"] if self.low is None else self.low
            self.high = part["high"]
        if part["n_rows"] and self.sha256 is None:
            self.hash.update((b"\n" if self.begun else b"") + part["lines"].encode())
            self.begun = True

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {
            **self.sums,
            "conv_id": self.conv_id,
            "gaps": gaps,
            "audit": "".join(self.audits),
            "repaired_sha256": self.sha256 or self.hash.hexdigest(),
        }
