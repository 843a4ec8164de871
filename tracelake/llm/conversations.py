"""Repair of conversations: the cheapest edits that make their turns alternate, by a dynamic programme over time-major tensors.

A task sorts the turns of its conversations and puts conversations of like length into one bucket. Turn by turn, from the
last to the first, the costs that are still to come from each of four states are updated for all
conversations of the bucket in one step; they are all kept, so that the edits are traced, again for
all conversations together, from the first turn on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracelake.llm.tables import stored

#: A conversation whose turns take more bytes than this does not pass through a task's memory whole.
LONG = 32 << 20
#: Bytes that a turn takes beside its text.
TURN = 200
#: Turns, and bytes of them, that a task gathers before it repairs what is complete.
GATHER, GATHER_BYTES = 50_000, 32 << 20
#: Cells (turns times conversations) of a tensor.
CELLS = 1 << 20
#: Rows that leave a task in one Arrow batch.
ROWS = 2000

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 2, 3, 2, 1
#: First faults of a turn.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Roles by initial, as numbers.
OTHER, SYSTEM, USER, ASSISTANT = range(4)

# States: nothing yet, after system, after user, after assistant. Ends may be nothing yet and after assistant.
_START, _AFTER_SYSTEM, _AFTER_USER, _AFTER_ASSISTANT = range(4)
_FAR = 1 << 29
#: The state after the user or assistant turn that a state lacks.
_NEXT = np.array([_AFTER_USER, _AFTER_USER, _AFTER_ASSISTANT, _AFTER_USER])
#: The state after a kept turn, by state and role; -1 where that role may not follow.
_KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs from each state where turns may still be inserted before the next one; two can be."""
    for _ in range(2):
        costs = np.minimum(costs, COST_INSERT + costs[:, _NEXT])
    return costs


def _kept_costs(after: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """Costs from each state if a turn of this role is kept."""
    to = _KEPT[:, roles].T
    return np.where(to < 0, _FAR, np.take_along_axis(after, np.maximum(to, 0), 1))


def _options(after: np.ndarray, roles: np.ndarray, faults: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling one turn of every conversation, by the state before it."""
    stays = (there & (faults != BLANK) & (faults != DUPLICATE))[:, None]
    extra = np.where(faults == TRUNCATED, COST_TRUNCATED, 0)[:, None]
    delete = np.where(there[:, None], COST_DELETE + after, _FAR)
    keep = np.where(stays, extra + _kept_costs(after, roles), _FAR)
    rerole = np.where(stays, extra + COST_REROLE + after[:, _NEXT], _FAR)
    return delete, keep, rerole


def _bucket(roles: np.ndarray, faults: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Costs and edits of a bucket: arrays by turn, then conversation; a shorter conversation ends before the last turns."""
    turns, many = roles.shape
    all_of = np.arange(many)
    costs = np.empty((turns + 1, many, 4), np.int32)
    costs[turns] = _with_inserts(np.broadcast_to(np.array([0, _FAR, _FAR, 0], np.int32), (many, 4)))
    for t in range(turns - 1, -1, -1):
        there = lengths > t
        delete, keep, rerole = _options(costs[t + 1], roles[t], faults[t], there)
        best = _with_inserts(np.minimum(np.minimum(delete, keep), rerole))
        costs[t] = np.where(there[:, None], best, costs[t + 1])
    at, state = np.zeros(many, np.int64), np.zeros(many, np.int64)
    steps = []
    while True:
        here = costs[at, all_of, state]
        # no cost to come and no turn left: done
        on = (at < lengths) | (here > 0)
        if not on.any():
            break
        turn = np.minimum(at, max(turns - 1, 0))
        role, fault = (x[turn, all_of] if turns else np.zeros(many, np.int8) for x in (roles, faults))
        after = costs[np.minimum(at + 1, turns), all_of]
        delete, keep, rerole = (x[all_of, state] for x in _options(after, role, fault, at < lengths))
        insert = COST_INSERT + costs[at, all_of, _NEXT[state]]
        # the least of the initials among the cheapest edits
        edit = np.select([~on, here == delete, here == insert, here == keep], [0, ord(DELETE), ord(INSERT), ord(KEEP)], ord(REROLE))
        steps.append(edit.astype(np.uint8))
        at = at + (on & (edit != ord(INSERT)))
        state = np.select([~on | (edit == ord(DELETE)), edit == ord(KEEP)], [state, _KEPT[state, role]], _NEXT[state])
    traced = np.stack(steps, 1) if steps else np.zeros((many, 0), np.uint8)
    return costs[0, :, _START], [row.tobytes().rstrip(b"\0") for row in traced]


def edits(roles: np.ndarray, faults: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Least costs and the edits' initials of many conversations, whose turns' roles and faults follow each other.

    Of equally cheap edits those whose initials come first in ASCII. A bucket holds conversations of like
    length, and no more than CELLS turns (or one conversation).
    """
    costs, audits = np.zeros(len(lengths), np.int64), [b""] * len(lengths)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    low = 0
    while low < len(order):
        least = int(lengths[order[low]])
        high = int(np.searchsorted(lengths[order], least + least // 4 + 2, "right"))
        high = max(low + 1, min(high, low + CELLS // (least + least // 4 + 3)))
        own = order[low:high]
        turns = int(lengths[own].max())
        time = np.arange(turns)[:, None]
        place = np.where(time < lengths[own], starts[own] + time, 0)
        cost, audit = _bucket(roles[place], faults[place], lengths[own])
        costs[own] = cost
        for k, a in zip(own.tolist(), audit):
            audits[k] = a
        low = high
    return costs, audits


def _repaired(audit: bytes, turns: Iterator[tuple[int, str, str]], state: int = _START) -> Iterator[tuple[str, str | None, str | None, int]]:
    """Edit, role and text after it (null where deleted) and state, edit by edit; ``turns`` are role number, role and text."""
    for edit in audit:
        letter = chr(edit)
        number, role, text = (0, "", "") if letter == "I" else next(turns)
        if letter == "D":
            yield letter, None, None, state
        elif letter == "K":
            state = int(_KEPT[state, number])
            yield letter, role, text, state
        else:
            state = int(_NEXT[state])
            yield letter, "assistant" if state == _AFTER_ASSISTANT else "user", text, state


class _Report:
    """What is returned of one conversation, from its turns in order: counts, then the repaired turns' hash."""

    def __init__(self):
        self.n, self.counts, self.illegal, self.before = 0, [0, 0, 0, 0], 0, -1
        self.least = self.last = None
        self.distinct = 0
        self.hash, self.empty = hashlib.sha256(), True

    def turn(self, turn: int | None, role: int, fault: int) -> None:
        self.counts[fault] += 1
        self.illegal += self.before >= 0 and not _LEGAL[self.before, role]
        self.before = role
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.distinct = turn, self.distinct + 1

    def repaired(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False

    def row(self, cost: int, audit: str) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.distinct
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost, audit, self.hash.hexdigest()


_REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_TURNS = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


def _kinds(columns: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in columns)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column's value changes, with both ends."""
    if len(column) == 0:
        return np.zeros(1, np.int64)
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])


def _batches(column: pa.DataType, made: Iterator[tuple], columns: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array([r[0] for r in rows], column)] + [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns, 1)]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[n for n, _ in columns]])

    size = 0
    for row in made:
        rows.append(row)
        size += len(row[-1] or "")
        if len(rows) == ROWS or size > GATHER_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _whole(table: pa.Table, turns: bool) -> Iterator[tuple]:
    """The reports, or the turns, of conversations whose sorted rows are all here."""
    table = table.combine_chunks()
    ids = table.column("conv_id").combine_chunks() if table.num_rows else pa.array([])
    cuts = _changes(ids)
    number, fault, turn = (table.column(c).to_numpy() if c != "turn" else table.column(c).to_pylist() for c in ("number", "fault", "turn"))
    roles, texts, gone = table.column("role").to_pylist(), table.column("text").to_pylist(), table.column("dropped").to_numpy()
    fault = fault.copy()
    kept = np.flatnonzero(~gone)
    lengths = np.diff(np.searchsorted(kept, cuts))
    at = 0
    for n in lengths.tolist():
        seen = set()
        for i in kept[at : at + n].tolist():
            said = (roles[i], texts[i])
            if fault[i] != BLANK and said in seen:
                fault[i] = DUPLICATE
            seen.add(said)
        at += n
    costs, audits = edits(number[kept], fault[kept], lengths)
    at = 0
    for k, n in enumerate(lengths.tolist()):
        key, own, report = ids[int(cuts[k])].as_py(), kept[at : at + n].tolist(), _Report()
        at += n
        for i in own:
            report.turn(turn[i], int(number[i]), int(fault[i]))
        told = enumerate(_repaired(audits[k], ((int(number[i]), roles[i], texts[i]) for i in own)))
        if turns:
            yield from ((key, p, letter, role, text) for p, (letter, role, text, _) in told)
            continue
        for _, (letter, role, text, _) in told:
            if letter != "D":
                report.repaired(role, text)
        yield (key, *report.row(int(costs[k]), audits[k].decode()))


def _short(rows: DataFrame, turns: bool, kind: str) -> DataFrame:
    columns = _TURNS if turns else _REPORT

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER or sum(b.nbytes for b in held) >= GATHER_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(_changes(table.column("conv_id").combine_chunks())[-2])
                yield from _whole(table.slice(0, last), turns)
                held = table.slice(last).to_batches()
        if held:
            yield from _whole(pa.Table.from_batches(held), turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _batches(first.schema.field("conv_id").type, complete(_chain(first, batches)), columns)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, {_kinds(columns)}")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _numbered(rows: DataFrame) -> DataFrame:
    """Turns of long conversations with their position and first fault; rows that were dropped have no position."""
    own = Window.partitionBy("conv_id", "dropped")
    position = F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    # equal rows follow each other in any order, and the first of them by position is the one said before
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("position")) > 1
    told = rows.withColumn("position", position.cast("long")).withColumn("again", again)
    fault = F.when((F.col("fault") != BLANK) & F.col("again"), F.lit(DUPLICATE).cast("int")).otherwise(F.col("fault"))
    return told.withColumn("fault", fault).drop("again")


def _long(rows: DataFrame, turns: bool, kind: str) -> DataFrame:
    """The same for conversations of any length: edits from roles and faults alone, then one pass over sorted turns that holds none of them."""
    columns = _TURNS if turns else _REPORT
    told = stored(_numbered(rows), "long-conversations")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(key, numbers: list[np.ndarray], faults: list[np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            number, fault = np.concatenate(numbers), np.concatenate(faults)
            (cost,), (audit,) = edits(number, fault, np.array([len(number)]))
            ends = [i + 1 for i, e in enumerate(audit) if e != ord(INSERT)]
            pieces = [audit[a:b].decode() for a, b in zip([0, *ends], [*ends, len(audit)])]
            for low in range(0, len(pieces), ROWS):
                part = pieces[low : low + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), kind), pa.array(range(low, low + len(part)), pa.int64()), pa.array(part), pa.array([int(cost)] * len(part), pa.int64())], names=["conv_id", "position", "letters", "cost"])

        key, numbers, faults, type_ = None, [], [], None
        for batch in batches:
            type_, cuts = batch.schema.field("conv_id").type, _changes(batch.column("conv_id"))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                new = batch.column("conv_id")[a].as_py()
                if numbers and new != key:
                    yield from one(key, numbers, faults, type_)
                    numbers, faults = [], []
                key = new
                numbers.append(batch.column("number").slice(a, b - a).to_numpy())
                faults.append(batch.column("fault").slice(a, b - a).to_numpy())
        if numbers:
            yield from one(key, numbers, faults, type_)

    codes = told.where("NOT dropped").select("conv_id", "position", "number", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    found = codes.mapInArrow(letters, f"conv_id {kind}, position long, letters string, cost long")
    there = told.withColumn("position", F.when(~F.col("dropped"), F.col("position"))).alias("t")
    on = F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.position") == F.col("e.position"))
    # what is inserted after the last turn has no turn
    both = there.join(found.alias("e").hint("merge"), on, "full_outer")
    rejoined = both.select(
        F.when(F.col("t.dropped").isNull(), F.col("e.conv_id")).otherwise(F.col("t.conv_id")).alias("conv_id"),
        F.coalesce("t.position", "e.position").alias("position"), "t.turn", "t.role", "t.text", "t.number", "t.fault", "e.letters", "e.cost", F.coalesce("t.dropped", F.lit(False)).alias("dropped"),
    )

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, report, audit, cost, state, position = None, None, [], 0, _START, 0
        for batch in batches:
            for row in batch.to_pylist():
                if report is None or row["conv_id"] != key:
                    if report and not turns:
                        yield (key, *report.row(cost, "".join(audit)))
                    key, report, audit, cost, state, position = row["conv_id"], _Report(), [], 0, _START, 0
                if row["dropped"] or row["letters"] is None:
                    continue
                if row["number"] is not None:
                    report.turn(row["turn"], row["number"], row["fault"])
                audit.append(row["letters"])
                cost = row["cost"]
                for letter, role, text, state in _repaired(row["letters"].encode(), iter([(row["number"], row["role"], row["text"])]), state):
                    if turns:
                        yield key, position, letter, role, text
                    elif letter != "D":
                        report.repaired(role, text)
                    position += 1
        if report and not turns:
            yield (key, *report.row(cost, "".join(audit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _batches(first.schema.field("conv_id").type, passed(_chain(first, batches)), columns)

    dealt = rejoined.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(run, f"conv_id {kind}, {_kinds(columns)}")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with a tenth to a quarter of their turns damaged, the same ones in every run.

    conv_id, turn, role, text; nulls in role and text become one space, and stand for one in what is hashed. By the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops a turn (it stays as a row with ``dropped`` true), 1 empties its text, 2 takes
    out its ``.!?``, 3 repeats it, 4 makes its role ``user``. Other columns are not returned.
    """
    space = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    mark = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(mark.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _rows(conversations: DataFrame, dropped: str | None) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = F.lit(False) if dropped is None else F.coalesce(F.col(dropped), F.lit(False))
    initial, last = F.substring(role, 1, 1), F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    number = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("dropped"), number.cast("int").alias("number"), fault.cast("int").alias("fault"))


def _either(conversations: DataFrame, dropped: str | None, turns: bool) -> DataFrame:
    rows = _rows(conversations, dropped)
    kind = rows.schema["conv_id"].dataType.simpleString()
    size = F.sum((F.octet_length("role") + F.octet_length("text") + TURN).cast("long"))
    sizes = rows.groupBy("conv_id").agg(size.alias("bytes"))
    if (sizes.agg(F.max("bytes")).first()[0] or 0) <= LONG:
        return _short(rows, turns, kind)
    large = stored(sizes.where(F.col("bytes") > LONG).select(F.col("conv_id").alias("of")), "long-conversation-ids")
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    rest, apart = rows.join(large.hint("merge"), same, "left_anti"), rows.join(large.hint("merge"), same, "left_semi")
    return _short(rest, turns, kind).unionByName(_long(apart, turns, kind))


def repair(conversations: DataFrame, *, dropped: str | None = None) -> DataFrame:
    """What is wrong with each conversation, and the cheapest edits that mend it.

    A conversation's rows (conv_id, turn, role, text) are taken by turn, nulls first; rows of one turn by role, then text. A row is
    blank (no other character than white space), else a duplicate (role and text of an earlier row), else truncated (its last such
    character is none of ``.!?``). Keeping a row costs 0, another role (user or assistant) 2, deleting it 3, inserting an
    empty turn of either 2; blank rows and duplicates must go, and a truncated row that stays costs 1 more. In the
    end the roles' initials are ``(s?(ua)+)?``: no role at all has none of these initials.

    Returns per conv_id: gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbours whose
    initials are not su, ua or au), cost, ``audit`` (the initials of Keep, Rerole, Delete and Insert in order; the least in ASCII
    of the cheapest) and ``repaired_sha256`` of the repaired rows, as lines ``role:text``. Null roles and texts are one space,
    null ids are one conversation; repeated rows are duplicates. Rows where ``dropped`` (a column) is true only keep their
    conversation's place: one that has no others has zeros, no edits and the hash of nothing.
    An empty table has no rows; other columns are neither read nor returned.
    """
    return _either(conversations, dropped, False)


def repaired_turns(conversations: DataFrame, *, dropped: str | None = None) -> DataFrame:
    """The edits of ``repair`` with the turns that they leave: conv_id, position (from 0), edit, role, text; the last two are null where deleted."""
    return _either(conversations, dropped, True)
