"""Repair of conversations whose turns were lost, emptied, cut, repeated or given to the wrong role.

Faults are found with DataFrame functions. Then all turns are sorted by range of (conv_id, turn), and each task
repairs the conversations that lie inside its range, row by row as they stream by. A conversation at the edge
of a range, or a long one, is handed on in pieces, one per range: the cost of crossing each piece from state
to state, an auction over one row per piece, and the edits of each piece from the state that it is entered in.
So no conversation is ever gathered in one task; only its digest is one row, hashed as the texts stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.llm.auction import ASSISTANT, CUT, DOOMED, END, FAR, SOUND, START, STATES, USER, bounds, crossing, repair, row_code, states_after, trace
from needledrop.llm.common import partitions, ship
from needledrop.sources.store import settled

# White space as the faults see it, the signs that end a text, adjacent initials that may be.
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = ("su", "ua", "au")

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_CODE = {0: SOUND, BLANK: DOOMED, DUPLICATE: DOOMED, TRUNCATED: CUT}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_LONG = 4096  # rows of a conversation that one task holds
_CHUNK = 1 << 20  # bytes of repaired text in a row

_COUNTS = "gaps blank duplicate truncated illegal cost".split()
_RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_EDGE = "part int, no long, turn long, role string, text string, fault int"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): turns after planted damage; a lost turn has no copies.

    The CRC-32 of ``conv_id:turn`` by 20 says what happens: 0 loses the turn, 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats it, 4 gives it to the user. Nulls count as one space.
    """
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(said("text"), STOPS, "")).otherwise(said("text"))
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(lot == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text) with ``copies`` and the ``fault`` of its first copy."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = settled(rows.where("copies > 0").withColumn("_text", F.md5("text")), "turns")
    # Where a text is said at several turns: the first of them. Equal rows were counted above.
    place = F.struct(F.col("turn").isNotNull().alias("late"), "turn")
    names = {"conv_id": "_conv", "role": "_role", "_text": "_said"}
    first = rows.groupBy(*names).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = settled(first.where("_n > 1").drop("_n").withColumnsRenamed(names), "first-said")
    rows = rows.join(
        first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_said")), "left"
    )
    shown = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(shown == "", BLANK)
        .when(F.col("_first") < place, DUPLICATE)
        .when(~F.substring(shown, -1, 1).isin(*STOPS), TRUNCATED)
        .otherwise(0)
    )
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


class _Digest:
    """SHA-256 of lines that come one after the other."""

    def __init__(self) -> None:
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, lines: list[str]) -> None:
        if lines:
            body = "\n".join(lines)
            self.hash.update((body if self.empty else "\n" + body).encode("utf-8", "surrogatepass"))
            self.empty = False


def repaired_lines(rows: list[tuple[str, str]], letters: str, state: int = START) -> list[str]:
    """``role:text`` of what the edits leave of (role, text) rows."""
    out, at = [], iter(rows)
    here: list[tuple[str, str]] = []

    def initials():
        for row in at:
            here[:] = [row]
            yield row[0][:1]

    for letter, state in zip(letters, states_after(letters, initials(), state)):
        if letter == "I":
            out.append(f"{_NAME[state]}:")
        elif letter == "K":
            out.append(f"{here[0][0]}:{here[0][1]}")
        elif letter == "R":
            out.append(f"{_NAME[state]}:{here[0][1]}")
    return out


class _Facts:
    """Counts of the rows of a conversation, or of a piece of it, in order."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns, which ascend
        self.turns = 0

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        self.codes.append(row_code(role, _CODE[fault]))
        self.faults[fault] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            if self.high != turn:
                self.turns += 1
            self.high = turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def counts(self) -> list[int]:
        return [self.gaps(), *self.faults[1:], self.illegal]


def _copies(batch: pa.RecordBatch):
    """(conv_id, turn, role, text, fault) of every copy."""
    columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault"))
    for conv, turn, role, text, copies, fault in zip(*columns):
        for n in range(copies):
            yield conv, turn, role, text, fault if n == 0 or fault == BLANK else DUPLICATE


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_pydict({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def _solve(conv: int | None, rows: list[tuple]) -> tuple:
    facts, digest = _Facts(), _Digest()
    for turn, role, _, fault in rows:
        facts.add(turn, role, fault)
    cost, audit = repair(bytes(facts.codes))
    digest.add(repaired_lines([(role, text) for _, role, text, _ in rows], audit))
    return conv, *facts.counts(), cost, audit, digest.hash.hexdigest()


def _inside(long_rows: int):
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema = TaskContext.get().partitionId(), f"{_RESULT}, {_EDGE}"
        conv, rows, edge, no, started = None, [], True, 0, False
        nothing = (None,) * 6

        def hand_on() -> list[tuple]:
            nonlocal no
            out = []
            for turn, role, text, fault in rows:
                out.append((conv, *(None,) * 8, part, no, turn, role, text, fault))
                no += 1
            rows.clear()
            return out

        for batch in batches:
            out = []
            for own, turn, role, text, fault in _copies(batch):
                if started and own != conv:
                    out += hand_on() if edge else [(*_solve(conv, rows), *nothing)]
                    rows, edge, no = [], False, 0
                if not started or own != conv:
                    conv, started = own, True
                rows.append((turn, role, text, fault))
                if len(rows) >= long_rows:
                    edge = True
                if edge:
                    out += hand_on()
            yield _table(out, schema)
        # The last conversation may go on in the next range.
        if rows:
            yield _table(hand_on(), schema)

    return inside


_PIECE = (
    "conv_id long, part int, codes binary, crossing array<long>, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long"
)


def _flat(layer: tuple) -> list[int]:
    out = [-1] * 16
    for s in STATES:
        for cost, _, _, to in layer[s]:
            out[4 * s + to] = cost
    return out


def _layer(flat: list[int]) -> tuple:
    return tuple(tuple((flat[4 * s + to], "", 1, to) for to in STATES if flat[4 * s + to] >= 0) for s in STATES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, facts = None, _Facts()

    def done() -> tuple:
        return (
            *key, bytes(facts.codes), _flat(crossing(facts.codes)), *facts.faults[1:], facts.illegal,
            facts.first, facts.last, facts.low, facts.high, facts.turns,
        )

    for batch in batches:
        out = []
        for conv, part, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "fault"))):
            if key is not None and key != (conv, part):
                out.append(done())
                facts = _Facts()
            key = (conv, part)
            facts.add(turn, role, fault)
        yield _table(out, _PIECE)
    if key is not None:
        yield _table([done()], _PIECE)


_PLAN = "conv_id long, part int, codes binary, before array<long>, after array<long>, " + ", ".join(f"{c} long" for c in _COUNTS)


def _far(costs) -> list[int]:
    return [-1 if c >= FAR else c for c in costs]


def _near(costs: list[int]) -> tuple[int, ...]:
    return tuple(FAR if c < 0 else c for c in costs)


def _plan(rows: pa.Table) -> pa.Table:
    """Costs to go at the bounds of a conversation's pieces, and the counts of the whole on its first piece."""
    rows = sorted(rows.to_pylist(), key=lambda r: r["part"])
    layers = [_layer(r["crossing"]) for r in rows] + [crossing(bytes([END]))]
    found = bounds(layers, [START], (0, FAR, FAR, FAR))
    whole = _Facts()
    for r in rows:
        whole.faults = [0, *(a + r[c] for a, c in zip(whole.faults[1:], _COUNTS[1:4]))]
        whole.illegal += r["illegal"] + (whole.last is not None and whole.last + r["first"] not in LEGAL)
        whole.last = r["last"]
        if r["low"] is not None:
            whole.low = r["low"] if whole.low is None else whole.low
            whole.turns += r["turns"] - (whole.high == r["low"])
            whole.high = r["high"]
    counts = [*whole.counts(), found[0][START]]
    out = [
        (r["conv_id"], r["part"], r["codes"], _far(b), _far(a), *(counts if i == 0 else [None] * len(counts)))
        for i, (r, b, a) in enumerate(zip(rows, found, found[1:]))
    ]
    return pa.Table.from_batches([_table(out, _PLAN)])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a piece by the state before it; -1 where no cheapest way enters."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            after = _near(r["after"])
            out.append((r["conv_id"], r["part"], [trace(r["codes"], s, after)[1] if r["before"][s] >= 0 else -1 for s in STATES]))
        yield _table(out, "conv_id long, part int, exits array<long>")


def _entries(rows: pa.Table) -> pa.Table:
    """The state before each piece of a conversation; the end counts as a piece after the last one."""
    out, state = [], START
    rows = sorted(rows.to_pylist(), key=lambda r: r["part"])
    for r in rows:
        out.append((r["conv_id"], r["part"], state))
        state = r["exits"][state]
    out.append((rows[-1]["conv_id"], rows[-1]["part"] + 1, state))
    return pa.Table.from_batches([_table(out, "conv_id long, part int, state int")])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["codes"] is None:
                codes, after = bytes([END]), (0, FAR, FAR, FAR)
            else:
                codes, after = r["codes"], _near(r["after"])
            out.append((r["conv_id"], r["part"], -1, str(r["state"]), trace(codes, r["state"], after)[0]))
        yield _table(out, _TEXTS)


_TEXTS = "conv_id long, part int, no long, role string, text string"
_CHUNKS = "conv_id long, part int, no long, audit string, lines string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired text in chunks. A piece is led by a row with its state and letters; an end has that row alone."""
    conv = part = None
    letters, state, at, no = "", START, 0, 0
    rows: list[tuple[str, str]] = []
    held = 0

    def flush(last: bool) -> list[tuple]:
        nonlocal state, at, no, held
        # The letters of these rows, and of the inserted turns before each of them.
        n, end = 0, at
        while end < len(letters) and n < len(rows):
            n += letters[end] != "I"
            end += 1
        if last:
            end = len(letters)
        some = letters[at:end]
        lines = repaired_lines(rows, some, state)
        for state in states_after(some, (r[:1] for r, _ in rows), state):
            pass
        found = (conv, part, no, some, "\n".join(lines) if lines else None)
        rows.clear()
        at, no, held = end, no + 1, 0
        return [found]

    for batch in batches:
        out = []
        for own, piece, row, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "no", "role", "text"))):
            if row < 0:
                if part is not None:
                    out += flush(True)
                conv, part, letters, state, at, no = own, piece, text, int(role), 0, 0
                continue
            rows.append((role, text))
            held += len(role) + len(text)
            if held >= _CHUNK:
                out += flush(False)
        yield _table(out, _CHUNKS)
    if part is not None:
        yield _table(flush(True), _CHUNKS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, started, audit, digest = None, False, [], _Digest()
    schema = "conv_id long, audit string, repaired_sha256 string"
    for batch in batches:
        out = []
        for own, letters, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines"))):
            if started and own != conv:
                out.append((conv, "".join(audit), digest.hash.hexdigest()))
                audit, digest = [], _Digest()
            conv, started = own, True
            audit.append(letters)
            if lines is not None:
                digest.add([lines])
        yield _table(out, schema)
    if started:
        yield _table([(conv, "".join(audit), digest.hash.hexdigest())], schema)


def _pieced(edges: DataFrame) -> DataFrame:
    """The conversations of edge rows, repaired piece by piece."""
    n, key = partitions(edges), ["conv_id", "part"]

    def streamed(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
        return df.repartition(n, *by).sortWithinPartitions(*by, *within)

    codes = streamed(edges.select(*key, "no", "turn", "role", "fault"), key, ["no"])
    pieces = settled(codes.mapInArrow(_pieces, _PIECE), "pieces")
    plan = settled(pieces.groupBy("conv_id").applyInArrow(_plan, _PLAN), "piece-plans")
    exits = plan.select(*key, "codes", "before", "after").mapInArrow(_exits, "conv_id long, part int, exits array<long>")
    entries = exits.groupBy("conv_id").applyInArrow(_entries, "conv_id long, part int, state int")
    known = plan.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "codes", "after")
    states = entries.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    led = states.select(*key, "state", "codes", "after").mapInArrow(_letters, _TEXTS)
    texts = streamed(edges.select(*key, "no", "role", "text").unionByName(led), key, ["no"])
    chunks = texts.mapInArrow(_lines, _CHUNKS)
    done = streamed(chunks, ["conv_id"], ["part", "no"]).mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    counts = plan.where("cost IS NOT NULL").select(F.col("conv_id").alias("_conv"), *_COUNTS)
    return done.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def repair_conversations(rows: DataFrame, long_rows: int = _LONG) -> DataFrame:
    """Faults and cheapest repair of conversations (conv_id, turn, role, text, copies), as ``damaged`` gives them.

    One row per conv_id, a null one included: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Rows are taken by turn with nulls first, and in one turn by role and text; equal rows are
    copies that follow each other. A row is blank without a visible sign, else a duplicate if role and text
    were seen earlier in the conversation, else truncated unless its last visible sign is one of ``.!?``.

    Edits: Keep costs nothing, Rerole to user or assistant 1, Delete 2 (all that blank rows and duplicates may have),
    Insert an empty user or assistant turn 5; a truncated row that stays costs 5 more. The initials of the roles
    left must be nothing, or user and assistant in turn after at most one system turn. ``audit`` are the edits'
    initials, the least string among the cheapest; the digest is of ``role:text`` lines after repair.

    A conversation of which all rows are lost has zeros, an empty audit and the digest of nothing. Other
    columns are ignored; no conversations give no rows. ``long_rows`` only bounds what a task holds.
    """
    ship(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    told = with_faults(rows).repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    out = settled(told.mapInArrow(_inside(long_rows), f"{_RESULT}, {_EDGE}"), "repaired")
    whole = out.where("part IS NULL").select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    edges = out.where("part IS NOT NULL").select("conv_id", "part", "no", "turn", "role", "text", "fault")
    lost = rows.groupBy("conv_id").agg(F.max("copies").alias("copies")).where("copies = 0").select(
        "conv_id", *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")
    )
    return whole.unionByName(_pieced(edges)).unionByName(lost)


def repaired_turns(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of one conversation's rows after the edits of its audit."""
    return [tuple(line.split(":", 1)) for line in repaired_lines(rows, audit)]
