"""Repair of conversation structure by secondary-sorted streaming.

Rows are partitioned by conversation and sorted by turn inside the partition, and ``mapInPandas`` walks over them once. What it
carries from one Arrow batch to the next is the state of a dynamic program over the role grammar: for each of four
states the least cost, the rank of its edits among those of the other states, and the running hash of the repaired
text. The way back is one byte for each row and state; a giant conversation writes these bytes to a file of the task
in blocks, so no conversation, whatever its length, is held in memory. Rows seen before are marked by Spark (a window
over the same partitioning that spills), not by a set in the worker.

Grammar of the repaired roles' initials: ``(s?(ua)+)?``.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPILL_ROWS = 1 << 18  # rows whose backpointers are kept in memory

START, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that may come next (or a system row at the start)
_LEGAL = {"su", "ua", "au"}
_DELETE, _KEEP, _REROLE = range(3)
_LETTERS = "DKR"
_INF = 1 << 60


def _moves() -> list[list[tuple[int, int, int, int, int]]]:
    """For each state after a row: (state before, inserts, edit, cost without truncation, rank of the edits' letters)
    of the edits that lead there, for rows with initial s, u, a and others, blank or duplicate rows last.

    Up to two inserts can be of use before a row: three and more go through a state twice.
    """
    kinds = []
    for kind in ("s", "u", "a", "", None):
        found = []
        for before in range(4):
            state, letters, cost = before, "", 0
            for inserts in range(3):
                options = [(_DELETE, state, DELETE)]
                if kind is not None:
                    then = _TURN[state]
                    if kind == _INITIAL[then]:
                        options.append((_KEEP, then, 0))
                    elif kind == "s" and state == START:
                        options.append((_KEEP, SYSTEM, 0))
                    options.append((_REROLE, then, REROLE))
                for edit, after, price in options:
                    found.append((before, inserts, edit, after, cost + price, letters + _LETTERS[edit]))
                state, letters, cost = _TURN[state], letters + "I", cost + INSERT
        order = {s: k for k, s in enumerate(sorted({f[5] for f in found}))}
        kinds.append([(b, i, e, a, c, order[s]) for b, i, e, a, c, s in found])
    return kinds


_MOVES = _moves()
_KIND = {"s": 0, "u": 1, "a": 2}
_GONE = 4


class _Way:
    """One byte for each row and state: state before, inserts and edit. Blocks beyond ``SPILL_ROWS`` rows go to a file."""

    def __init__(self, spill_rows: int):
        self.rows, self.spill_rows, self.file, self.blocks = bytearray(), spill_rows, None, 0

    def add(self, row: bytes) -> None:
        self.rows += row
        if len(self.rows) >= 4 * self.spill_rows:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="heatloom-way-")
            self.file.write(self.rows)
            self.blocks += 1
            self.rows = bytearray()

    def back(self) -> Iterator[bytes]:
        """The blocks from the last to the first."""
        yield bytes(self.rows)
        size = 4 * self.spill_rows
        for k in range(self.blocks - 1, -1, -1):
            self.file.seek(k * size)
            yield self.file.read(size)
        if self.file is not None:
            self.file.close()


class Repair:
    """The dynamic program over the rows of one conversation, in order."""

    def __init__(self, spill_rows: int = SPILL_ROWS):
        self.cost = [0, _INF, _INF, _INF]
        self.rank = [0, 1, 2, 3]
        self.hash = [hashlib.sha256() for _ in range(4)]
        self.bare = [True] * 4  # nothing written yet
        self.way = _Way(spill_rows)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None
        self.turns, self.first, self.last = 0, None, None

    def _write(self, h, bare: bool, state: int, inserts: int, line: str | None) -> tuple:
        """A copy of the hash of ``state`` with inserted lines and ``line`` added."""
        h = h.copy()
        lines = []
        for _ in range(inserts):
            state = _TURN[state]
            lines.append(f"{_NAMES[state]}:")
        if line is not None:
            lines.append(line)
        if lines:
            h.update((("" if bare else "\n") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return h, bare and not lines

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        gone = fault in ("blank", "duplicate")
        kept = TRUNCATED if fault == "truncated" else 0
        best = [None] * 4
        for before, inserts, edit, after, price, letters in _MOVES[_GONE if gone else _KIND.get(role[:1], 3)]:
            if self.cost[before] < _INF:
                total = self.cost[before] + price + (kept if edit != _DELETE else 0)
                key = (total, self.rank[before], letters)
                if best[after] is None or key < best[after][0]:
                    best[after] = (key, before, inserts, edit)
        order = sorted((b[0][1:], s) for s, b in enumerate(best) if b)
        self.rank = [0] * 4
        for k, (_, s) in enumerate(order):
            self.rank[s] = k
        way, hashes, bare = bytearray(4), list(self.hash), list(self.bare)
        for s, b in enumerate(best):
            self.cost[s] = b[0][0] if b else _INF
            if b:
                _, before, inserts, edit = b
                way[s] = before | inserts << 2 | edit << 4
                line = None if edit == _DELETE else f"{role if edit == _KEEP else _NAMES[s]}:{text}"
                hashes[s], bare[s] = self._write(self.hash[before], self.bare[before], before, inserts, line)
        self.hash, self.bare = hashes, bare
        self.way.add(way)

    def result(self) -> dict:
        ends = []
        for s, inserts in ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)):
            if self.cost[s] < _INF:
                ends.append((self.cost[s] + inserts * INSERT, self.rank[s], s, inserts))
        cost, _, state, inserts = min(ends)
        h, _ = self._write(self.hash[state], self.bare[state], state, inserts, None)
        parts, tail = [], ["I" * inserts]
        for block in self.way.back():
            for at in range(len(block) - 4, -1, -4):
                step = block[at + state]
                tail.append("I" * (step >> 2 & 3) + _LETTERS[step >> 4])
                state = step & 3
            parts.append("".join(reversed(tail)))
            tail = []
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": cost, "audit": "".join(reversed(parts)), "repaired_sha256": h.hexdigest()}


_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(spill_rows: int):
    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key, out = None, None, []
        for frame in frames:
            columns = [frame[c].tolist() for c in ("key", "alive", "at", "role", "text", "fault")]
            for k, alive, turn, role, text, fault in zip(*columns):
                if k != key:
                    if state is not None:
                        out.append({"key": key} | state.result())
                    state, key = Repair(spill_rows), k
                if alive:
                    state.add(None if turn is None else int(turn), role, text, fault)
            if len(out) >= 4096:
                yield pd.DataFrame(out)
                out = []
        if state is not None:
            out.append({"key": key} | state.result())
        if out:
            yield pd.DataFrame(out)

    return repair


def _fault(text: Column, again: Column) -> Column:
    solid = r"[^\x20\x09-\x0D]"
    whole = F.regexp_like(text, F.lit(rf"[.!?][\x20\x09-\x0D]*\z"))
    return F.when(~F.regexp_like(text, F.lit(solid)), "blank").when(again, "duplicate").when(~whole, "truncated")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           alive_col: str | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: its id, the counts ``gaps, blank, duplicate, truncated, illegal``, the least ``cost`` of a
    repair, its ``audit`` and the SHA-256 of the repaired text.

    A conversation's rows are taken by turn, null turns first; rows that share a turn by role, then text. Edits, in the
    order of the rows: K keeps a row, R gives it the role that the grammar asks for, D deletes it, I inserts an empty
    row of that role; of equally cheap repairs the one with the least audit is taken. Null roles and texts are one
    space. A null id is a conversation of its own. ``alive_col`` names a boolean column: rows where it is not true are
    not looked at, but their conversations are returned, with zeros and an empty audit where no other rows are left.
    No rows give no conversations; other columns are not read.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    alive = F.lit(True) if alive_col is None else F.coalesce(F.col(alive_col), F.lit(False))
    data = rows.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("name"), F.col(conv_col).isNull().alias("none"), F.col(turn_col).cast("decimal(38,0)").alias("turn"), one(role_col).alias("role"),
        one(text_col).alias("text"), alive.alias("alive"))
    data = data.repartition("name", "none")
    # the same partitioning serves the window: equal rows of a conversation meet in its partition
    seen = F.expr("row_number() OVER (PARTITION BY name, none, alive, role, sha2(text, 256) "
                  "ORDER BY turn ASC NULLS FIRST)")
    data = data.withColumn("again", seen > 1).withColumn("fault", _fault(F.col("text"), F.col("again")))
    data = data.sortWithinPartitions("name", "none", F.col("turn").asc_nulls_first(), "role", "text", "again")
    data = data.select(F.concat(F.when(F.col("none"), "-").otherwise("+"), "name").alias("key"), "alive",
                       F.col("turn").cast("string").alias("at"), "role", "text", "fault")
    out = data.mapInPandas(_stream(spill_rows), f"key string, {_FIELDS}")
    conv = F.when(F.col("key").startswith("+"), F.expr("substring(key, 2)")).cast(rows.schema[conv_col].dataType)
    return out.select(conv.alias(conv_col), *out.columns[1:])
