"""Repair of broken conversations by weighted interval parsing.

A conversation should read, by the initials of its roles, ``(s?(ua)+)?``. Rows are kept (cost 0), given
the role user or assistant (3), deleted (4, and needed where a row is blank or repeats an earlier role and
text), and rows without text are inserted anywhere (3); a row that ends without ``.``, ``!`` or ``?`` costs 3 more
unless it is deleted. The repair is the cheapest sequence of edits, ties broken by the least audit, which is
the string of the edits' initials in order.

**Grammar.** A nonterminal says that an interval of rows, once edited, leads from one state of the pattern to another:
nothing yet, after the system message, after a user, after an assistant. Eleven of these
are possible, and every production is ``(p, q) -> (p, r) (r, q)`` (Chomsky normal form) or an edit of
one row, closed under insertions on both sides. A cell of the chart holds for each nonterminal the least
(cost, audit). Least parts make a least whole: audits of one interval, states and cost are never
prefixes of each other, as more insertions would cost more.

**Chart.** Blocks of ``BLOCK`` rows get a whole chart, every span by length and every split. Blocks, and then
pieces of a conversation, are put together by length too, two neighbours at a time: since nonterminals are pairs
of states, any split of a span gives the same cell, so one is enough. That makes the parse linear in the rows.

**On Spark.** Equal rows are counted first. All rows, and for each (conversation, role, text) a marker where it comes
first, are dealt out by ranges of (conversation, turn, role, text's digest) and sorted, so a marker stands before its
row, and a conversation of any size spreads over tasks. Each task cuts its rows into pieces of bounded size with their
cells. The cells of a conversation meet in one task, which names every piece's states, and pieces are edited where
they lie. What one task sees of a whole conversation is its audits, which is a value of the result anyway, and, for the digest
of a conversation in several pieces, its texts one piece at a time, since SHA-256 can only be computed in order.

Cases: a null role or text is one space. Rows are ordered by turn, nulls first, then by role and the text's MD5; equal rows are
equal wherever they stand. A null conv_id is a conversation like any other. Conversations without rows get zeros, an empty audit and the
digest of nothing. An empty table gives an empty one; only the named columns are read, so others can't clash. Long texts are held
one piece at a time, and a piece ends after ``PIECE_CHARS`` characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instructset.llm.common import materialize, prepare

# The costs of edits.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Rows of a block with a whole chart; rows and characters after which a piece ends; pieces in an Arrow batch.
BLOCK = 8
PIECE_ROWS = 2048
PIECE_CHARS = 4 << 20
_BATCH = 200

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from a state.
MOVES = {
    (NOTHING, "s"): SYSTEM,
    (NOTHING, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60
_BLANKS = " \t\n\x0b\x0c\r"

Cell = tuple[tuple[int, str], ...]


def _insertions(p: int, q: int) -> int | None:
    """How many insertions lead from one state to another."""
    n, at = 0, p
    while at != q and n < 3:
        at, n = MOVES[at, "a" if at == USER else "u"], n + 1
    return n if at == q else None


#: The nonterminals, and for each its productions as places in this list.
PAIRS = [(p, q) for p in range(4) for q in range(4) if _insertions(p, q) is not None or (p, q) == (NOTHING, SYSTEM)]
_PLACE = {pair: i for i, pair in enumerate(PAIRS)}
PRODUCTIONS = [
    [(_PLACE[p, r], _PLACE[r, q]) for r in range(4) if (p, r) in _PLACE and (r, q) in _PLACE] for p, q in PAIRS
]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for rules in PRODUCTIONS:
        best = min((left[i][0] + right[j][0], left[i][1] + right[j][1]) for i, j in rules)
        out.append(best if best[0] < _NEVER else (_NEVER, ""))
    return tuple(out)


def _cell(found: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(found.get(pair, (_NEVER, "")) for pair in PAIRS)


def deletions(n: int) -> Cell:
    """The cell of ``n`` rows that must all go; of none it is the closure under insertions."""
    found = {}
    for p, q in PAIRS:
        if (k := _insertions(p, q)) is not None:
            found[p, q] = (DELETE * n + INSERT * k, "D" * n + "I" * k)
    return _cell(found)


EMPTY = deletions(0)


@lru_cache(maxsize=64)
def leaf(initial: str, fault: str) -> Cell:
    """The cell of one row; ``fault`` is ``d`` (must go), ``t`` (truncated) or empty."""
    found = {(p, p): (DELETE, "D") for p in range(4)}
    if fault != "d":
        more = TRUNCATED if fault == "t" else 0
        for p in range(4):
            edits = [(initial, more, "K"), ("u", RE_ROLE + more, "R"), ("a", RE_ROLE + more, "R")]
            for role, cost, name in edits:
                if (p, role) in MOVES:
                    pair = p, MOVES[p, role]
                    found[pair] = min(found.get(pair, (_NEVER, "")), (cost, name))
    return joined(joined(EMPTY, _cell(found)), EMPTY)


@lru_cache(maxsize=1 << 14)
def block_cell(rows: tuple[tuple[str, str], ...]) -> Cell:
    """The top of the whole chart of a few rows."""
    n = len(rows)
    chart = {(i, i + 1): leaf(*row) for i, row in enumerate(rows)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            splits = [joined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            chart[i, i + length] = tuple(map(min, zip(*splits, strict=True)))
    return chart[0, n]


def total(cells: list[Cell]) -> Cell:
    """The cell of spans in a row, put together by length."""
    level = cells or [EMPTY]
    while len(level) > 1:
        pairs = [joined(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def piece_cell(rows: list[tuple[str, str]], copies: list[int]) -> Cell:
    """The cell of a piece; a row's further copies must go."""
    cells, at = [], 0
    while at < len(rows):
        end = min(at + BLOCK, len(rows))
        again = next((i for i in range(at, end) if copies[i] > 1), None)
        end = end if again is None else again + 1
        cells.append(block_cell(tuple(rows[at:end])))
        if again is not None:
            cells.append(deletions(copies[again] - 1))
        at = end
    return total(cells)


def choose(cells: list[Cell], p: int, q: int) -> list[tuple[int, int]]:
    """The states before and after each span in the least derivation of (p, q) over all of them."""
    if len(cells) == 1:
        return [(p, q)]
    middle = len(cells) // 2
    left, right = total(cells[:middle]), total(cells[middle:])
    ways = []
    for i, j in PRODUCTIONS[_PLACE[p, q]]:
        ways.append((left[i][0] + right[j][0], left[i][1] + right[j][1], i, j))
    _, _, i, j = min(ways)
    return choose(cells[:middle], *PAIRS[i]) + choose(cells[middle:], *PAIRS[j])


def edited(state: int, audit: str, roles: list[str], copies: list[int]) -> Iterator[tuple[str, str, int | None]]:
    """(edit, role, row) of all rows that stay, given the edits of a piece and the state before it."""
    rows = iter([i for i, n in enumerate(copies) for _ in range(n)])
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = roles[row] if edit == "K" else ROLES["a" if state == USER else "u"]
        state = MOVES[state, role[:1]]
        yield edit, role, row


_STATS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")
_PIECES = (
    "part int, piece long, conv_id long, n_rows long, blank long, duplicate long, truncated long, illegal long, "
    "turns long, first_turn long, last_turn long, first_role string, last_role string, "
    "costs array<long>, audits array<string>, row_turns array<long>, row_roles array<string>, "
    "row_texts array<string>, row_copies array<long>"
)
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@dataclass
class Piece:
    """Rows of one conversation that follow each other, and what is known of them."""

    conv_id: int | None
    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    parse: list[tuple[str, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(_STATS, 0))
    first_turn: int | None = None
    last_turn: int | None = None
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, first: bool, truncated: bool) -> None:
        n, initial = self.counts, role[:1]
        if self.roles:
            n["illegal"] += self.roles[-1][:1] + initial not in LEGAL
        n["illegal"] += copies - 1
        n["n_rows"] += copies
        if turn is not None:
            n["turns"] += turn != self.last_turn or self.first_turn is None
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        fault = "d" if blank or not first else "t" if truncated else ""
        n["blank"] += copies if blank else 0
        n["duplicate"] += 0 if blank else copies - first
        n["truncated"] += fault == "t"
        initial = initial if initial in ("s", "u", "a") else "?"
        self.parse.append((initial, fault))
        for column, value in zip((self.turns, self.roles, self.texts, self.copies), (turn, role, text, copies), strict=True):
            column.append(value)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def row(self, part: int, place: int) -> tuple:
        cell = piece_cell(self.parse, self.copies)
        ends = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        return (
            part, place, self.conv_id, *self.counts.values(), self.first_turn, self.last_turn, *ends,
            [c for c, _ in cell], [a for _, a in cell], self.turns, self.roles, self.texts, self.copies,
        )


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = _BATCH, weigh=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and little more than ``PIECE_CHARS`` of weight."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) == size or weight >= PIECE_CHARS:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of the few types that are used here."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def pieces() -> Iterator[tuple]:
        piece, marked, place = None, None, 0
        for conv_id, turn, role, digest, kind, text, copies, blank, truncated in _rows(batches):
            if piece is None or piece.conv_id != conv_id or piece.full():
                if piece is not None:
                    yield piece.row(part, place)
                    place += 1
                piece = Piece(conv_id)
            if kind == 1:
                marked = (conv_id, turn, role, digest)
            elif kind == 2:
                piece.add(turn, role, text, copies, blank, marked == (conv_id, turn, role, digest), truncated)
        if piece is not None:
            yield piece.row(part, place)

    return _batches(pieces(), _arrow(_PIECES), weigh=lambda row: sum(map(len, row[-2])) + 11 * len(row[-4]))


def trimmed(text: Column) -> Column:
    """The text without the white space at its end."""
    return F.rtrim(text, F.lit(_BLANKS))


def pieces_of(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Pieces of all conversations in ``rows`` (conv_id, turn, role, text, and copies if there is such a column),
    and an empty one for each further conv_id of ``ids``; written."""
    prepare(rows.sparkSession)
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("long").alias("copies"),
    )
    # As many equal rows as there may be become one before anything is dealt out.
    end = trimmed(F.col("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    whole = counted.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), F.lit(2).alias("kind"), "text", "copies",
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    kinds = {"text": "string", "copies": "long", "blank": "boolean", "truncated": "boolean"}
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    firsts = rows.groupBy("conv_id", "role", F.md5("text").alias("digest")).agg(
        F.when(F.count("turn") == F.count("*"), F.min("turn")).alias("turn")
    )
    firsts = firsts.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), *nothing)
    known = rows.select("conv_id") if ids is None else rows.select("conv_id").union(ids.select(F.col("conv_id").cast("long")))
    known = known.distinct().select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("digest"), F.lit(0).alias("kind"), *nothing,
    )
    place = ["conv_id", "turn", "role", "digest"]
    ordered = whole.union(firsts).union(known).repartitionByRange(*place).sortWithinPartitions(*place, "kind")
    return materialize(ordered.mapInArrow(_cut, _PIECES), "conversation-pieces")


_CHOSEN = "part int, piece long, conv_id long, n_pieces long, state int, edits string, start long, " + _SUMMARY


def chosen(pieces: DataFrame) -> DataFrame:
    """For each piece its edits, the state before it and the number of rows that stay before it; the first piece
    of a conversation also has what is told of the whole conversation."""
    narrow = pieces.select(
        "part", "piece", "conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "turns",
        "first_turn", "last_turn", "first_role", "last_role", "costs", "audits",
    )
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in _rows(batches):
                if held and held[0][2] != row[2]:
                    yield from _decide(held)
                    held = []
                held.append(row)
            if held:
                yield from _decide(held)

        return _batches(decided(), _arrow(_CHOSEN), weigh=lambda row: len(row[5]))

    return ordered.mapInArrow(run, _CHOSEN)


def _decide(rows: list[tuple]) -> Iterator[tuple]:
    """Rows of ``_CHOSEN`` for the pieces of one conversation."""
    counts = dict.fromkeys(_STATS, 0)
    low = high = last_role = None
    cells = []
    for _, _, _, *own, first_turn, last_turn, first_initial, last_initial, costs, audits in rows:
        for name, n in zip(_STATS, own, strict=True):
            counts[name] += n
        if first_turn is not None:
            counts["turns"] -= first_turn == high and low is not None
            low, high = first_turn if low is None else low, last_turn
        if first_initial is not None:
            counts["illegal"] += last_role is not None and last_role + first_initial not in LEGAL
            last_role = last_initial
        cells.append(tuple(zip(costs, audits, strict=True)))
    gaps = 0 if low is None else high - low + 1 - counts["turns"]
    top = total(cells)
    (cost, audit), end = min((top[_PLACE[NOTHING, q]], q) for q in (NOTHING, ASSISTANT))
    summary = (gaps, *(counts[name] for name in ("blank", "duplicate", "truncated", "illegal")), cost, audit)
    start = 0
    for i, (row, cell, (p, q)) in enumerate(zip(rows, cells, choose(cells, NOTHING, end), strict=True)):
        edits = cell[_PLACE[p, q]][1]
        yield (*row[:3], len(rows), p, edits, start, *(summary if i == 0 else (None,) * len(summary)))
        start += len(edits) - edits.count("D")


_JOINED = ["part", "piece", "conv_id", "n_pieces", "state", "edits", "start", "row_turns", "row_roles", "row_texts", "row_copies"]


def _with_edits(pieces: DataFrame) -> DataFrame:
    # The pair (part, piece) tells a piece, so that pieces of one conversation meet their edits in many tasks.
    own = pieces.select("part", "piece", "row_turns", "row_roles", "row_texts", "row_copies")
    return own.join(chosen(pieces), ["part", "piece"])


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), edit (K, R or I), turn (null where
    inserted), role, text."""
    schema = "conv_id long, place long, edit string, turn long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, _, conv, _, state, edits, start, turns, roles, texts, copies in _rows(batches):
                for i, (edit, role, row) in enumerate(edited(state, edits, roles, copies)):
                    yield conv, start + i, edit, None if row is None else turns[row], role, "" if row is None else texts[row]

        return _batches(rows(), _arrow(schema), 1000, lambda row: len(row[-1]))

    return _with_edits(pieces).select(*_JOINED).mapInArrow(run, schema)


def repair_report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of ``role:text`` lines)."""
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    body = "conv_id long, part int, piece long, sha string, body string, " + _SUMMARY
    report = f"conv_id long, {_SUMMARY}, repaired_sha256 string"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part, piece, conv, n, state, edits, _, _, roles, texts, copies, *summary in _rows(batches):
                kept = edited(state, edits, roles, copies)
                text = "\n".join(f"{role}:{'' if row is None else texts[row]}" for _, role, row in kept)
                # Only texts of conversations in several pieces have to meet.
                whole = n == 1
                yield conv, part, piece, hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text, *summary

        return _batches(rows(), _arrow(body), weigh=lambda row: len(row[4] or "") + len(row[-1] or ""))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            open_row = running = None
            begun = False
            for conv, _, _, sha, text, *summary in _rows(batches):
                if sha is not None:
                    yield conv, *summary, sha
                    continue
                # Costs are there on a conversation's first piece alone.
                if summary[-2] is not None:
                    if open_row:
                        yield *open_row, running.hexdigest()
                    open_row, running, begun = (conv, *summary), hashlib.sha256(), False
                if text:
                    running.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
            if open_row:
                yield *open_row, running.hexdigest()

        return _batches(rows(), _arrow(report), weigh=lambda row: len(row[-2]))

    bodies = _with_edits(pieces).select(*_JOINED, *names).mapInArrow(lines, body)
    ordered = bodies.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.mapInArrow(digest, report)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as ``crc32(conv_id:turn) % 20`` damages them: 0 drops a row, 1 empties its text, 2 removes its end marks, 3 repeats it
    (``copies`` is 2), 4 makes it the user's. Nulls count as one space."""
    conv_id, turn = (F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    chance = F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), chance.alias("chance"),
    ).where("chance <> 0")
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("chance") == 3, 2).otherwise(1).alias("copies"),
    )
