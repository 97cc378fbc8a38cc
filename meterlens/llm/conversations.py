"""Structure repair of conversations by a dynamic program over runs.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Its rows are kept (cost 0),
given the other role of user and assistant (3) or deleted (4); rows without text and repeated rows
must be deleted, and a row that is not deleted though its text is cut off costs 3 more. Between the
rows, user and assistant rows without text may be inserted (3 each). The cheapest edits are found;
of equally cheap ones those whose initials (D, I, K, R) come first in ASCII order.

For the cost only a row's symbol matters: the initial of its role and its fault. Symbols act on the
four states of the pattern (nothing yet, after s, after u, after a) as min-plus matrices. Equal
symbols that follow each other form a run; a run of any length is advanced by the cached binary
powers of its matrix, from the end of the conversation to its start. The choices are then unrolled
from the start. The vectors that occur are few but for a constant, so steps are cached by them.

Rows are sorted by ranges of (conversation, turn), so a conversation of any size is spread over
tasks. Conversations that lie whole in one task are finished there. Those at the ends of a task, and
those too long to be held, go on as rows: repeats are found by the first place of each text, every
segment of rows becomes one matrix, the matrices are joined along the conversation, and each segment
is unrolled by itself for each state in which it may begin. Their texts are streamed once more
in order for the digest, which is sequential by its definition.

Order: by turn, nulls first; rows of one turn by role and then by a hash of the text. Null roles and
texts are one blank. Rows with a null conversation form a conversation. Empty tables give no rows.
Repeated rows are repeats. Other columns are left out; the four names are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import small_batches, stored

#: ASCII white space.
SPACE = " \t\n\r\x0b\x0c"
ENDS = ".!?"
INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
#: A row's faults; the first that holds counts.
SOUND, BLANK, REPEAT, TRUNCATED = range(4)
#: States: nothing yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40

#: Rows and characters of a conversation that are held at once, and rows of a segment.
HELD_ROWS, HELD_CHARS, SEGMENT_ROWS = 20_000, 8_000_000, 20_000


def _next(state: int) -> int:
    """The state after an inserted or rerolled row."""
    return ASSISTANT if state == USER else USER


def _kept(initial: str, state: int) -> int | None:
    """The state after a kept row, if it may be kept."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def symbol(initial: str, fault: int) -> int:
    """0 must go; otherwise the initial of the role and whether the text is cut off."""
    if fault in (BLANK, REPEAT):
        return 0
    return 1 + 2 * max("xsua".find(initial or "x"), 0) + (fault == TRUNCATED)


def _choices(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for a row; an insertion stays at the row. In ASCII order."""
    out = [("D", DELETE, state), ("I", INSERT, _next(state))]
    if sym:
        more = CUT_OFF * ((sym - 1) % 2)
        kept = _kept("xsua"[(sym - 1) // 2], state)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, _next(state)))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum(FAR, (a[:, :, None] + b[None, :, :]).min(axis=1))


def _matrix(sym: int) -> np.ndarray:
    """Least cost from state to state over a row, insertions before it included."""
    closed = np.full((4, 4), FAR)
    edits = np.full((4, 4), FAR)
    for state in range(4):
        at, cost = state, 0
        for _ in range(4):
            closed[state, at] = min(closed[state, at], cost)
            at, cost = _next(at), cost + INSERT
        for edit, cost, after in _choices(sym, state):
            if edit != "I":
                edits[state, after] = min(edits[state, after], cost)
    return times(closed, edits)


#: Cost of ending in each state, by insertions.
END = (0, 2 * INSERT, INSERT, 0)


class Steps:
    """Cached steps over vectors of costs to the end. A vector is known by its shape (itself less
    its least value), and shapes by numbers."""

    def __init__(self):
        self.shapes: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.powers: dict[tuple[int, int], np.ndarray] = {}
        self.done: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    def shape(self, vector) -> tuple[int, int]:
        """Number of a vector's shape, and its least value."""
        least = int(min(vector))
        key = tuple(int(v) - least for v in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.shapes)
            self.shapes.append(key)
        return self.numbers[key], least

    def power(self, sym: int, k: int) -> np.ndarray:
        """The matrix of 2 ** k rows."""
        if (sym, k) not in self.powers:
            half = self.power(sym, k - 1) if k else None
            self.powers[sym, k] = times(half, half) if k else _matrix(sym)
        return self.powers[sym, k]

    def step(self, sym: int, k: int, number: int) -> tuple[int, int]:
        """Shape before 2 ** k rows from that after them, and what is added to it."""
        key = (sym, k, number)
        if key not in self.done:
            after = np.array(self.shapes[number])
            self.done[key] = self.shape((self.power(sym, k) + after[None, :]).min(axis=1))
        return self.done[key]

    def before_run(self, sym: int, length: int, number: int) -> tuple[int, int]:
        """Shape before a run, by binary powers."""
        total, k = 0, 0
        while length:
            if length & 1:
                number, more = self.step(sym, k, number)
                total += more
            length >>= 1
            k += 1
        return number, total

    def before(self, runs: list[tuple[int, int]], number: int) -> tuple[list[int], int]:
        """Shapes behind each run and before the first, and what is added over all."""
        shapes, total = [number], 0
        for sym, length in reversed(runs):
            number, more = self.before_run(sym, length, number)
            total += more
            shapes.append(number)
        shapes.reverse()
        return shapes, total

    def matrix(self, runs: list[tuple[int, int]]) -> np.ndarray:
        """The matrix of all runs."""
        out = np.where(np.eye(4) > 0, 0, FAR)
        for sym, length in runs:
            for k in range(length.bit_length()):
                if length >> k & 1:
                    out = times(out, self.power(sym, k))
        return out

    def edit(self, sym: int, number: int, state: int) -> tuple[str, int]:
        """Edits up to and with a row, and the state behind it; ``number`` is the shape behind."""
        key = (sym, number, state)
        if key not in self.edits:
            after = self.shapes[number]
            cost = (self.power(sym, 0) + np.array(after)[None, :]).min(axis=1)
            made, at = "", state
            while not made or made[-1] == "I":
                made, at = next(
                    (made + edit, to)
                    for edit, price, to in _choices(sym, at)
                    if price + (cost[to] if edit == "I" else after[to]) == cost[at]
                )
            self.edits[key] = made, at
        return self.edits[key]

    def unroll(self, runs, shapes: list[int], state: int) -> tuple[list[str], int]:
        """Edits of each row from a state on, and the state at the end."""
        out = []
        for (sym, length), behind in zip(runs, shapes[1:], strict=True):
            inside = [behind]
            for _ in range(length - 1):
                inside.append(self.step(sym, 0, inside[-1])[0])
            for number in reversed(inside):
                made, state = self.edit(sym, number, state)
                out.append(made)
        return out, state


@lru_cache(maxsize=1)
def steps() -> Steps:
    return Steps()


def ending(state: int) -> str:
    """Insertions that end a conversation soundly."""
    return "I" * (END[state] // INSERT)


def runs_of(symbols: list[int]) -> list[tuple[int, int]]:
    return [(sym, sum(1 for _ in same)) for sym, same in groupby(symbols)]


def repair(symbols: list[int]) -> tuple[int, list[str]]:
    """Cost, and the edits of each row; those behind the last row are one entry more."""
    runs, s = runs_of(symbols), steps()
    last, base = s.shape(END)
    shapes, cost = s.before(runs, last)
    edits, state = s.unroll(runs, shapes, EMPTY)
    return cost + base + s.shapes[shapes[0]][EMPTY], [*edits, ending(state)]


class _Digest:
    """SHA-256 of ``role:text`` lines as they come."""

    def __init__(self):
        self.hash, self.begun, self.state = hashlib.sha256(), False, EMPTY

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def edit(self, made: str, role: str, text: str) -> None:
        """The row's edits, and insertions around it."""
        for e in made:
            if e == "K":
                self._line(role, text)
                self.state = _kept(role[:1], self.state)
            elif e != "D":
                self.state = _next(self.state)
                self._line(NAMES[self.state], text if e == "R" else "")

    def value(self) -> str:
        return self.hash.hexdigest()


def fault_of(text: str) -> int:
    """What a row's text alone shows."""
    bare = text.rstrip(SPACE)
    if not bare:
        return BLANK
    return SOUND if bare[-1] in ENDS else TRUNCATED


def _sound_pair(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


def _whole(held_rows: int, held_chars: int, names: list[str]):
    """Rows in order to finished conversations, and to rows of those that may go on elsewhere."""

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        out: list[dict] = []
        held: list[tuple] = []
        chars, now, opened = 0, None, True

        def as_rows() -> None:
            nonlocal at, chars
            for conv, turn, role, text, key in held:
                row = {"conv": conv, "part": part, "at": at, "turn": turn, "role": role}
                out.append(row | {"text": text, "key": key, "fault": fault_of(text)})
                at += 1
            held.clear()
            chars = 0

        def finish() -> None:
            nonlocal chars
            seen, faults = set(), []
            for _, _, _, text, key in held:
                fault = fault_of(text)
                faults.append(REPEAT if fault != BLANK and key in seen else fault)
                seen.add(key)
            initials = [r[2][:1] for r in held]
            cost, edits = repair([symbol(i, f) for i, f in zip(initials, faults, strict=True)])
            digest = _Digest()
            for (_, _, role, text, _), made in zip(held, edits, strict=False):
                digest.edit(made, role, text)
            digest.edit(edits[-1], "", "")
            turns = {r[1] for r in held} - {None}
            out.append(
                {
                    "conv": held[0][0],
                    "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    "blank": faults.count(BLANK),
                    "duplicate": faults.count(REPEAT),
                    "truncated": faults.count(TRUNCATED),
                    "illegal": sum(
                        not _sound_pair(a, b) for a, b in zip(initials, initials[1:], strict=False)
                    ),
                    "cost": cost,
                    "audit": "".join(edits),
                    "digest": digest.value(),
                }
            )
            held.clear()
            chars = 0

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r.get(n) for r in out], kind) for n, kind in kinds]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [("conv", batch.schema.field("conv").type), *_KINDS]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at + len(held) and row[0] != now:
                    if opened:
                        as_rows()
                    else:
                        finish()
                    opened = False
                elif not held and not at:
                    opened = True  # the first of a task may have begun before it
                now = row[0]
                held.append(row)
                chars += len(row[3])
                if len(held) > held_rows or chars > held_chars:
                    opened = True
                    as_rows()
            yield batch_of()
        if held:
            as_rows()
            yield batch_of()

    return conversations


_TEXT, _LONG, _INT = pa.string(), pa.int64(), pa.int32()
_KINDS = [
    ("part", _INT), ("at", _LONG), ("turn", _LONG), ("role", _TEXT), ("text", _TEXT),
    ("key", pa.binary()), ("fault", _INT), ("gaps", _LONG), ("blank", _LONG), ("duplicate", _LONG),
    ("truncated", _LONG), ("illegal", _LONG), ("cost", _LONG), ("audit", _TEXT), ("digest", _TEXT),
]
_SQL = {_TEXT: "string", _LONG: "long", _INT: "int", pa.binary(): "binary"}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments in order to one row each: runs, matrix, ends and unsound pairs."""
    key, begin, initials, symbols, conv = None, 0, [], [], None

    def row(kind) -> pa.RecordBatch:
        runs = runs_of(symbols)
        unsound = sum(not _sound_pair(a, b) for a, b in zip(initials, initials[1:], strict=False))
        matrix = steps().matrix(runs).ravel().tolist()
        values = [conv, key[0], begin, [r[0] for r in runs], [r[1] for r in runs], matrix]
        values += [initials[0], initials[-1], unsound]
        lists = pa.list_(_INT), pa.list_(_LONG), pa.list_(_LONG)
        kinds = [kind, _INT, _LONG, *lists, _TEXT, _TEXT, _LONG]
        columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
        names = ["conv", "part", "at", "symbols", "lengths", "matrix", "first", "last", "illegal"]
        return pa.RecordBatch.from_arrays(columns, names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for c, part, block, at, initial, fault in zip(
            *(x.to_pylist() for x in batch.columns), strict=True
        ):
            if (part, block, c) != key:
                if key is not None:
                    yield row(kind)
                key, begin, initials, symbols, conv = (part, block, c), at, [], [], c
            initials.append(initial)
            symbols.append(symbol(initial, fault))
    if key is not None:
        yield row(kind)


def _exits(table: pa.Table) -> pa.Table:
    """The shape behind each segment of a conversation; the matrices are joined from the end."""
    table = table.sort_by([("part", "ascending"), ("at", "ascending")])
    vector, out = np.array(END), []
    for matrix in reversed(table["matrix"].to_pylist()):
        out.append((vector - vector.min()).tolist())
        vector = (np.array(matrix).reshape(4, 4) + vector[None, :]).min(axis=1)
    cost = pa.array([int(vector[EMPTY])] * len(out), _LONG)
    out = pa.array(out[::-1], pa.list_(_LONG))
    return pa.table([table["part"], table["at"], out, cost], ["part", "at", "behind", "cost"])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's edits for each state in which it may begin, and the state behind it."""
    for batch in batches:
        pieces, ends = [], []
        for syms, lengths, behind in zip(
            *(batch[c].to_pylist() for c in ("symbols", "lengths", "behind")), strict=True
        ):
            runs = list(zip(syms, lengths, strict=True))
            shapes, _ = steps().before(runs, steps().shape(behind)[0])
            made = [steps().unroll(runs, shapes, state) for state in range(4)]
            pieces.append(["".join(m) for m, _ in made])
            ends.append([e for _, e in made])
        columns = [batch[c] for c in ("conv", "part", "at", "first", "last", "illegal", "cost")]
        columns += [pa.array(pieces, pa.list_(_TEXT)), pa.array(ends, pa.list_(_INT))]
        names = ["conv", "part", "at", "first", "last", "illegal", "cost", "pieces", "ends"]
        yield pa.RecordBatch.from_arrays(columns, names)


def _chosen(table: pa.Table) -> pa.Table:
    """The edits of each segment of a conversation, from its start on."""
    table = table.sort_by([("part", "ascending"), ("at", "ascending")])
    state, last, pieces, illegal = EMPTY, None, [], []
    for row in table.select(["first", "last", "illegal", "pieces", "ends"]).to_pylist():
        pieces.append(row["pieces"][state])
        state = row["ends"][state]
        between = last is not None and not _sound_pair(last, row["first"])
        illegal.append(row["illegal"] + between)
        last = row["last"]
    pieces[-1] += ending(state)
    columns = [table[c] for c in ("conv", "part", "at", "cost")]
    columns += [pa.array(pieces, _TEXT), pa.array(illegal, _LONG)]
    return pa.table(columns, ["conv", "part", "at", "cost", "piece", "illegal"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order to the digest of each."""
    digest, now, kind = None, None, None

    def row() -> pa.RecordBatch:
        columns = [pa.array([now], kind), pa.array([digest.value()], _TEXT)]
        return pa.RecordBatch.from_arrays(columns, ["conv", "digest"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, role, text, made in zip(
            *(batch[c].to_pylist() for c in ("conv", "role", "text", "edit")), strict=True
        ):
            if digest is None or conv != now:
                if digest is not None:
                    yield row()
                digest, now = _Digest(), conv
            digest.edit(made, role, text)
    if digest is not None:
        yield row()


class Conversations:
    """The repair of a table of conversations."""

    def __init__(
        self,
        rows: DataFrame,
        conv: str = "conv_id",
        turn: str = "turn",
        role: str = "role",
        text: str = "text",
        held_rows: int = HELD_ROWS,
        held_chars: int = HELD_CHARS,
        segment_rows: int = SEGMENT_ROWS,
    ):
        small_batches(rows.sparkSession)
        self.segment_rows = segment_rows
        whole = [F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
        key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
        order = ["conv", "turn", "role", "key"]
        # Rows that are equal in all of these are told apart by their place, to be spread as well.
        ordered = (
            rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *whole)
            .select("*", F.unhex(key).alias("key"), F.monotonically_increasing_id().alias("place"))
            .repartitionByRange(*order, "place")
            .sortWithinPartitions(*order, "place")
            .select("conv", "turn", "role", "text", "key")
        )
        self.kind = ordered.schema["conv"].dataType
        fields = [T.StructField("conv", self.kind)]
        fields += T._parse_datatype_string(", ".join(f"`{n}` {_SQL[k]}" for n, k in _KINDS)).fields
        schema = T.StructType(fields)
        step = _whole(held_rows, held_chars, schema.names)
        passed = stored(ordered.mapInArrow(step, schema), "conversations")
        self.finished = passed.where("audit IS NOT NULL").select("conv", *RESULT)
        #: Rows of conversations that go over the ends of a task, or are too long to be held.
        self.opened = passed.where("audit IS NULL").select(
            "conv", "part", "at", "turn", "role", "text", "key", "fault"
        )

    def _of(self, columns: str) -> T.StructType:
        more = T._parse_datatype_string(columns)
        return T.StructType([T.StructField("conv", self.kind), *more.fields])

    @cached_property
    def faults(self) -> DataFrame:
        """conv, part, at, turn, initial and fault of every open row, repeats told by the first place
        of each text. First places are unique, so no text is a hot key of the join."""
        first = (
            self.opened.groupBy("conv", "key")
            .agg(F.min(F.struct("part", "at")).alias("first"))
            .select("first.*", F.lit(True).alias("new"))
        )
        repeat = (F.col("fault") != BLANK) & F.col("new").isNull()
        return stored(
            self.opened.join(first, ["part", "at"], "left").select(
                "conv",
                "part",
                "at",
                "turn",
                F.substring("role", 1, 1).alias("initial"),
                F.when(repeat, REPEAT).otherwise(F.col("fault")).alias("fault"),
            ),
            "faults",
        )

    @cached_property
    def pieces(self) -> DataFrame:
        """conv, part, at (place of the first row), cost, piece (edits), illegal of every segment."""
        block = F.floor(F.col("at") / self.segment_rows).alias("block")
        order = ["part", "block", "at"]
        rows = self.faults.select("conv", "part", block, "at", "initial", "fault")
        segments = stored(
            rows.repartition("part", "block")
            .sortWithinPartitions(*order)
            .mapInArrow(
                _segments,
                self._of(
                    "part int, at long, symbols array<int>, lengths array<long>, matrix array<long>,"
                    " first string, last string, illegal long"
                ),
            ),
            "segments",
        )
        exits = segments.select("conv", "part", "at", "matrix").groupBy("conv").applyInArrow(
            _exits, "part int, at long, behind array<long>, cost long"
        )
        unrolled = segments.join(exits, ["part", "at"]).mapInArrow(
            _unrolled,
            self._of(
                "part int, at long, first string, last string, illegal long, cost long,"
                " pieces array<string>, ends array<int>"
            ),
        )
        chosen = unrolled.groupBy("conv").applyInArrow(
            _chosen, self._of("part int, at long, cost long, piece string, illegal long")
        )
        return stored(chosen, "pieces")

    def edits(self) -> DataFrame:
        """part, at and edits of every open row; insertions behind the last row go with it."""
        each = F.regexp_extract_all("piece", F.lit("I*[DKR](?:I*$)?"), F.lit(0))
        return self.pieces.select("part", F.col("at").alias("begin"), F.posexplode(each)).select(
            "part", (F.col("begin") + F.col("pos")).alias("at"), F.col("col").alias("edit")
        )

    def _long(self) -> DataFrame:
        """The result of the conversations whose rows are open."""

        def count(fault: int):
            return F.count(F.when(F.col("fault") == fault, 1))

        counts = self.faults.groupBy("conv").agg(
            count(BLANK).alias("blank"),
            count(REPEAT).alias("duplicate"),
            count(TRUNCATED).alias("truncated"),
        )
        turns = (
            self.faults.groupBy("conv", "turn")
            .agg(F.lit(1).alias("one"))
            .groupBy("conv")
            .agg(
                F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
            )
        )
        audits = self.pieces.groupBy("conv").agg(
            F.sum("illegal").alias("illegal"),
            F.max("cost").alias("cost"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("part", "at", "piece"))),
                    lambda p: p["piece"],
                ),
                "",
            ).alias("audit"),
        )
        digests = (
            self.opened.join(self.edits(), ["part", "at"])
            .select("conv", "part", "at", "role", "text", "edit")
            .repartition("conv")
            .sortWithinPartitions("conv", "part", "at")
            .mapInArrow(_digests, self._of("digest string"))
        )
        out = counts
        for more in (turns, audits, digests):
            key = more.withColumnRenamed("conv", "other")
            out = out.join(key, F.col("conv").eqNullSafe(F.col("other"))).drop("other")
        return out.select("conv", *RESULT)

    def result(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and digest (SHA-256 of the
        repaired ``role:text`` lines), one row per conversation."""
        return self.finished.unionByName(self._long())


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]


def damaged(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (with null roles and texts as one blank) damaged by a hash of their place: of 20
    remainders 0 drops a row, 1 empties its text, 2 takes its end marks, 3 gives it twice, and 4
    makes it a user's."""

    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    place = F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")
    harm = F.pmod(F.crc32(place), F.lit(20))
    copies = F.when(F.col("harm_") == 3, 2).when(F.col("harm_") == 0, 0).otherwise(1)
    whole = F.col("text_")
    return (
        rows.select(
            F.col(conv).alias("conv_"),
            F.col(turn).alias("turn_"),
            plain(role).alias("role_"),
            plain(text).alias("text_"),
            harm.alias("harm_"),
        )
        .where("harm_ <> 0")
        .select(
            F.col("conv_").alias(conv),
            F.col("turn_").alias(turn),
            F.when(F.col("harm_") == 4, "user").otherwise(F.col("role_")).alias(role),
            F.when(F.col("harm_") == 1, "")
            .when(F.col("harm_") == 2, F.translate(whole, ENDS, ""))
            .otherwise(whole)
            .alias(text),
            F.explode(F.array_repeat(F.lit(1), copies)).alias("copy_"),
        )
        .drop("copy_")
    )
