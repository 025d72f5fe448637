"""Conversation repair by weighted finite-state composition.

Three machines are composed, lazily:

* the input acceptor, a chain with one symbol a row: its role's initial and its fault,
* the edit transducer, one state that keeps, reroles or deletes a row and inserts rows, each at a cost,
* the role grammar's acceptor.

A weight is (cost, labels): labels are the edits' initials in order, and the lesser weight costs less or has the lesser
string. Such weights may be added up in any grouping only where no string of those compared begins another. So an
insertion belongs to the row before which it stands, and the last ones to the end: then strings to one place in the
input end with an edit of the same row, and none begins another. The shortest path therefore runs along the input, and
segments of a conversation can be worked out apart: a segment gives, for each pair of grammar states, its best
weight, and segments are joined in order.

A conversation's rows are sorted by range over all tasks, as narrow rows (conversation, turn, role, a text's hash) with
equal rows counted, and cut into segments; neither a long conversation nor a repeated row fills a task. Only the
last step, which hashes the repaired text in order, passes a conversation through one task, as a stream.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeforge.llm.hashing import sliced

#: What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar (s?(ua)+)? by roles' initials; states 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Roles that are written by an edit.
ROLES = {"u": "user", "a": "assistant"}
#: Adjacent initials that are in order.
LEGAL = ("su", "ua", "au")
#: Rows of a segment.
SEGMENT = 2048
Weight = tuple[int, str]


class Row(NamedTuple):
    """An input symbol: the role's initial where the grammar knows it, and faults that matter to edits."""

    initial: str
    must_go: bool
    truncated: bool


@functools.cache
def insertions(state: int) -> dict[int, Weight]:
    """The grammar states that insertions lead to, each by its best weight."""
    best, reached = {state: (0, "")}, [state]
    while reached:
        at = reached.pop(0)
        for initial, to in GRAMMAR[at].items():
            if initial in ROLES and to not in best:
                best[to] = (best[at][0] + INSERT, best[at][1] + "I")
                reached.append(to)
    return best


@functools.cache
def arcs(state: int, row: Row) -> dict[int, Weight]:
    """The composed machine's arcs from a grammar state over one row, insertions before it included."""
    out: dict[int, Weight] = {}
    for at, (cost, labels) in insertions(state).items():
        edits = [(at, DELETE, "D")]
        if not row.must_go:
            extra = TRUNCATED * row.truncated
            edits += [(to, KEEP + extra, "K") for initial, to in GRAMMAR[at].items() if initial == row.initial]
            edits += [(to, REROLE + extra, "R") for initial, to in GRAMMAR[at].items() if initial in ROLES]
        for to, more, label in edits:
            weight = (cost + more, labels + label)
            out[to] = min(out.get(to, weight), weight)
    return out


@functools.cache
def ending(state: int) -> Weight | None:
    """From a grammar state to acceptance by insertions."""
    return min((w for to, w in insertions(state).items() if to in FINAL), default=None)


def paths(rows: list[tuple[Row, int]], starts: tuple[int, ...]) -> dict[int, dict[int, Weight]]:
    """For each start, the best weight to each state after all rows; a row stands for so many equal ones.

    Strings are kept as ranks and back pointers, so a row costs the same wherever it stands.
    """
    out = {}
    for start in starts:
        now = {start: (0, 0)}  # by state: cost, and the rank of its string among the states'
        back: list[dict[int, tuple[int, str]]] = []
        for row, copies in rows:
            for _ in range(copies):
                found: dict[int, tuple[int, int, str, int]] = {}
                for state, (cost, rank) in now.items():
                    for to, (more, labels) in arcs(state, row).items():
                        weight = (cost + more, rank, labels, state)
                        if to not in found or weight < found[to]:
                            found[to] = weight
                strings = sorted({w[1:3] for w in found.values()})
                now = {to: (w[0], strings.index(w[1:3])) for to, w in found.items()}
                back.append({to: (w[3], w[2]) for to, w in found.items()})
        best = {}
        for state, (cost, _) in now.items():
            labels, at = [], state
            for step in reversed(back):
                at, label = step[at]
                labels.append(label)
            best[state] = (cost, "".join(reversed(labels)))
        out[start] = best
    return out


def join(segments: list[dict[int, dict[int, Weight]]]) -> Weight:
    """The whole conversation's best weight: segments in order, then the end. Strings are put together once."""
    now = {0: (0, 0)}
    back: list[dict[int, tuple[int, str]]] = []
    for segment in segments:
        found: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in now.items():
            for to, (more, labels) in segment[state].items():
                weight = (cost + more, rank, labels, state)
                if to not in found or weight < found[to]:
                    found[to] = weight
        strings = sorted({w[1:3] for w in found.values()})
        now = {to: (w[0], strings.index(w[1:3])) for to, w in found.items()}
        back.append({to: (w[3], w[2]) for to, w in found.items()})
    total, _, last, state = min((cost + w[0], rank, w[1], state) for state, (cost, rank) in now.items() if (w := ending(state)))
    labels = [last]
    for step in reversed(back):
        state, label = step[state]
        labels.append(label)
    return total, "".join(reversed(labels))


# --- Damage ----------------------------------------------------------------------------------------


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and copies of each row after damage; a dropped row has 0 copies, a repeated one 2.

    Null roles and texts, and nulls in the hashed key, are one space. crc32("conv:turn") % 20 decides: 0 drops the
    row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it, 4 sets the role "user".
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown(conv_col), shown(turn_col)).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _visible(text: Column) -> Column:
    """Without blanks at the end; empty if there is nothing else."""
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


# --- Segments --------------------------------------------------------------------------------------

_SEGMENT = "conv {conv}, turn long, role string, hash string, serial long, summary string"


class _Open:
    """A segment that is being read."""

    def __init__(self, conv, first: tuple, serial: int, begins: bool):
        self.conv, self.first, self.serial, self.begins = conv, first, serial, begins
        self.rows: list[tuple[Row, int]] = []
        self.count = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.edges: list[str] = []
        self.turns: list[int] = []  # lowest, highest, how many
        self.size = 0

    def add(self, turn, role: str, blank: bool, cut: bool, first: bool, copies: int) -> None:
        initial = role[:1]
        again = copies if blank else copies - first  # of equal rows one at most is no duplicate
        if blank:
            self.blank += copies
        else:
            self.duplicate += again
            self.truncated += cut and first
        if not blank and first:
            self.rows.append((Row(initial if initial in "sua" else "", False, bool(cut)), 1))
        if again:
            self.rows.append((Row("", True, False), again))
        if self.edges:
            self.illegal += self.edges[1] + initial not in LEGAL
            self.edges[1] = initial
        else:
            self.edges = [initial, initial]
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        self.size += copies

    def close(self) -> dict:
        starts = (0,) if self.begins else (0, 1, 2, 3)
        return {"conv": self.conv, "turn": self.first[0], "role": self.first[1], "hash": self.first[2], "serial": self.serial, "summary": json.dumps({"paths": paths(self.rows, starts), "counts": [self.blank, self.duplicate, self.truncated, self.illegal], "edges": self.edges, "turns": self.turns})}


def _segments(narrow: DataFrame, conv_type: str, segment: int) -> DataFrame:
    """Sorted by range, cut into segments; a segment's place is that of its first row, and among equal rows its number."""
    by = ["conv", "turn", "role", "hash"]
    spread = narrow.repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Open | None = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*by, "blank", "cut", "first", "copies")), strict=True):
                conv, turn, role, mark, blank, cut, first, copies = row
                while copies:
                    if held is not None and (conv != held.conv or held.size >= segment):
                        out.append(held.close())
                        held = _Open(conv, (turn, role, mark), held.serial + 1, conv != held.conv)
                    held = held or _Open(conv, (turn, role, mark), 0, False)
                    part = min(copies, segment)  # the rest of the copies begins another segment
                    held.add(turn, role, blank, cut, first, part)
                    first, copies = False, copies - part
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.close()], schema=kind)

    ddl = _SEGMENT.format(conv=conv_type)
    kind = narrow.sparkSession.createDataFrame([], ddl).toArrow().schema
    return spread.mapInArrow(run, ddl)


def _combined(summaries: list[dict]) -> dict:
    """A conversation's numbers and edits from its segments, in order."""
    blank, duplicate, truncated, illegal = (sum(s["counts"][k] for s in summaries) for k in range(4))
    illegal += sum(a["edges"][1] + b["edges"][0] not in LEGAL for a, b in zip(summaries, summaries[1:], strict=False))
    turns: list[int] = []
    for s in summaries:
        low, high, count = s["turns"] or (None, None, 0)
        if count:
            turns = [turns[0], high, turns[2] + count - (turns[1] == low)] if turns else [low, high, count]
    cost, audit = join([{int(a): {int(b): tuple(w) for b, w in ends.items()} for a, ends in s["paths"].items()} for s in summaries])
    return {"gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost, "audit": audit}


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(damaged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For each conv of `damaged` (conv, turn, role, text, copies) its faults, the cheapest edits and the repaired text.

    Rows are taken by (turn, role, text's hash), nulls first. A row's first fault counts: blank (nothing but blanks),
    duplicate (role and text seen earlier), truncated (the last sign that is no blank is none of `.!?`). Edits: keep,
    costs 0; rerole to user or assistant, 3; delete, 4, for blank and duplicate rows the only one; insert an empty row
    of user or assistant anywhere, 3; a truncated row that is not deleted costs 3 more. The repaired roles' initials
    are (s?(ua)+)?. `audit` has the initials of the cheapest edits in order, the least such string.

    gaps: turns lacking between the least and the greatest; illegal: adjacent initials other than su, ua, au; cost;
    repaired_sha256: of the repaired `role:text`, by lines. A conversation of which all rows have 0 copies has zeros,
    an empty audit and the empty string's hash. Null is a conversation. An empty table gives no rows. Repeated rows
    count. Texts pass as streams, of any length.
    """
    conv_type = damaged.schema["conv"].dataType.simpleString()
    end = _visible(F.col("text"))
    narrow = damaged.where("copies > 0").select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("hash"), "copies", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    # the first of equal roles and texts is marked by a row of no copies, so equal rows are counted in one aggregation
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = narrow.groupBy("conv", "role", "hash").agg(F.min(turn).alias("at")).select("conv", F.col("at.turn").alias("turn"), "role", "hash", F.lit(0).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
    marked = narrow.withColumn("first", F.lit(False)).unionByName(first).groupBy("conv", "turn", "role", "hash")
    narrow = marked.agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))

    segments = _segments(narrow, conv_type, segment).withColumns({"text": F.lit(None).cast("string"), "copies": F.lit(0).cast("long")})
    texts = damaged.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("hash"), F.lit(0).cast("long").alias("serial"), F.lit(None).cast("string").alias("summary"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies")
    both = segments.unionByName(texts).withColumn("late", F.col("summary").isNull())
    ordered = both.repartition("conv").sortWithinPartitions("conv", "late", "turn", "role", "hash", "serial").select("conv", "role", "summary", "text", "copies")

    ddl = f"conv {conv_type}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string"
    kind = damaged.sparkSession.createDataFrame([], ddl).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Writer | None = None
        for batch in (part for whole in batches for part in sliced(whole, "text", 1 << 20)):
            done = []
            for conv, role, summary, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "summary", "text", "copies")), strict=True):
                if held is None or conv != held.conv:
                    if held is not None:
                        done.append(held.close())
                    held = _Writer(conv)
                if summary is not None:
                    held.summaries.append(json.loads(summary))
                else:
                    held.add(role, text, copies)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.close()], schema=kind)

    return ordered.mapInArrow(run, ddl)


class _Writer:
    """Applies a conversation's edits to its rows as they come, and hashes what is left."""

    def __init__(self, conv):
        self.conv, self.summaries, self.found = conv, [], None
        self.sha, self.lines, self.at, self.state = hashlib.sha256(), 0, 0, 0

    def line(self, role: str, text: str) -> None:
        self.sha.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
        self.lines += 1
        self.state = GRAMMAR[self.state][role[0]]

    def due(self) -> str:
        """The role that is written next by an edit."""
        return next(ROLES[i] for i in GRAMMAR[self.state] if i in ROLES)

    def insert(self) -> None:
        audit = self.found["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.line(self.due(), "")
            self.at += 1

    def add(self, role: str, text: str | None, copies: int) -> None:
        for _ in range(copies):
            self.found = self.found or _combined(self.summaries)
            self.insert()
            edit = self.found["audit"][self.at]
            self.at += 1
            if edit != "D":
                self.line(role if edit == "K" else self.due(), text or "")

    def close(self) -> dict:
        if self.found is None:
            self.found = dict.fromkeys(NUMBERS, 0) | {"audit": ""}
        self.insert()
        return {"conv": self.conv, **self.found, "repaired_sha256": self.sha.hexdigest()}
