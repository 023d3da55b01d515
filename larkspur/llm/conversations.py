"""Conversation structure repair by lazy weighted determinisation.

A conversation is repaired by the cheapest edits of its rows that leave role initials
of the form ``(s?(ua)+)?``: keep a row (0), change its role to user or assistant (2),
delete it (3; blank and repeated rows must go), or insert an empty turn of the user or
the assistant (2).  A truncated row that stays costs 1 more.

The four states of that form and the edits make a weighted automaton with many paths.
It is determinised lazily: a state of the new automaton is the vector of the costs
that remain from each of the four, less their minimum, and a transition on a row's
symbol gives the next vector and the minimum.  Vectors and transitions are made when
a row first needs them and cached in a table, so a scan takes one look-up a row.  The
scan reads a conversation from its last row to its first; the audit goes back over it
and takes tight arcs only, so it meets the rows in order and settles ties at once by
the least initial.  Tight arcs are cached by vector, symbol and state as well.

Rows are sorted by range over conversation and turn, so that no conversation has to be
in one task, and cut into pieces of bounded size.  Texts that repeat in different pieces are
found by a join of their hashes.  Then one byte per row streams backwards through the
scan, piece by piece, and a piece's vector is all that the next one needs.  The pieces
and their vectors stream forwards through the audit.  Both streams of a conversation
pass through one task without being gathered there: a digest of a whole text can't be
had in parts.

Defined results for odd input: null role and text count as one space; null turns come
first; rows of equal turn are ordered by role, then by the MD5 of their texts; all rows
with a null id are one conversation; a role without one of the initials s, u and a
can't be kept; very long texts are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.workspace import join_by_hot, written

BLANKS = " \t\n\x0b\x0c\r"
#: A piece holds at most so many rows, and so many characters unless one row has more.
PIECE_ROWS = 4096
PIECE_CHARS = 1 << 14
FAR = 1 << 60
#: After nothing, after s, after u, after a: the state that an initial leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1


class Automaton:
    """Vectors of remaining costs and the transitions between them, made as needed.

    Symbols are the row's initial, upper-case if the row is truncated, or ``x`` if it
    must go.
    """

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: list[dict[str, tuple[int, int]]] = []
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}
        self.end, _ = self._number([0, FAR, FAR, 0])

    def _number(self, costs: list[int]) -> tuple[int, int]:
        """The number of a vector to which insertions are added, and its minimum."""
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[q][ADDED[q]]]) for q, c in enumerate(costs)]
        low = min(costs)
        vector = tuple(c - low for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append({})
        return self.numbers[vector], low

    def number(self, vector: list[int]) -> int:
        """The number of a vector that another task has made."""
        return self._number(list(vector))[0]

    @staticmethod
    def edits(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
        """Initial, cost and next state of each edit that uses the row up, least initial first."""
        yield "D", DELETE, state
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            if (initial := symbol.lower()) in NEXT[state]:
                yield "K", more, NEXT[state][initial]
            yield "R", REROLE + more, NEXT[state][ADDED[state]]

    def step(self, after: int, symbol: str) -> tuple[int, int]:
        """The vector before a row of ``symbol``, and what it costs more than ``after``."""
        row = self.table[after]
        if symbol not in row:
            left = self.vectors[after]
            row[symbol] = self._number([min(c + left[to] for _, c, to in self.edits(symbol, q)) for q in range(4)])
        return row[symbol]

    def scan(self, symbols: str, after: int) -> tuple[list[int], int]:
        """The vectors before each row and after the last one, and the cost that the rows add."""
        found, cost, table = [after], 0, self.table
        for symbol in reversed(symbols):
            after, low = table[after].get(symbol) or self.step(after, symbol)
            cost += low
            found.append(after)
        found.reverse()
        return found, cost

    def arc(self, after: int, symbol: str, state: int) -> tuple[str, int]:
        """The least tight edits from ``state`` that use up a row before vector ``after``, and where they lead."""
        if (after, symbol, state) not in self.arcs:
            left, (before, low) = self.vectors[after], self.step(after, symbol)
            here = [c + low for c in self.vectors[before]]
            way, at = "", state
            while True:
                tight = [(name, to) for name, c, to in self.edits(symbol, at) if c + left[to] == here[at]]
                more = NEXT[at][ADDED[at]]
                if tight and (tight[0][0] == "D" or INSERT + here[more] != here[at]):
                    way, at = way + tight[0][0], tight[0][1]
                    break
                way, at = way + "I", more
            self.arcs[after, symbol, state] = way, at
        return self.arcs[after, symbol, state]

    def trace(self, symbols: str, vectors: list[int], state: int) -> tuple[list[str], int]:
        """The edits of each row, insertions before it included, and the state after the last."""
        ways, known = [], self.arcs
        for i, symbol in enumerate(symbols):
            way, state = known.get((vectors[i + 1], symbol, state)) or self.arc(vectors[i + 1], symbol, state)
            ways.append(way)
        return ways, state

    def finish(self, state: int) -> str:
        """Insertions after the last row."""
        way = ""
        while state not in (0, 3):
            way, state = way + "I", NEXT[state][ADDED[state]]
        return way


def repaired(rows: list[tuple[str, str]], ways: list[str], state: int) -> list[tuple[str, str, str]]:
    """Role, text and edit of every turn that the edits leave, from ``state`` on."""
    out = []
    for (role, text), way in zip(rows, ways, strict=True):
        for edit in way:
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else ADDED[state]
            out.append((role if edit == "K" else ROLES[initial], "" if edit == "I" else text, edit))
            state = NEXT[state][initial]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with the faults that ``crc32(conv_id:turn) % 20`` gives them.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats
    the row, 4 makes it the user's.  Nulls count as one space.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(told[3], ".!?", "")).otherwise(told[3])
    role = F.when(fault == 4, "user").otherwise(told[2])
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(0), times)).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of sorted rows of one conversation, of bounded size."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[dict] = []
    chars = 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv"] != held[0]["conv"] or len(held) == PIECE_ROWS or chars + len(row["text"]) > PIECE_CHARS):
                yield _piece(held, part, seq)
                held, chars, seq = [], 0, seq + 1
            held.append(row)
            chars += len(row["text"])
    if held:
        yield _piece(held, part, seq)


def _piece(rows: list[dict], part: int, seq: int) -> dict:
    seen: dict[bytes, int] = {}
    symbols = []
    for i, r in enumerate(rows):
        initial = r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "o"
        again = seen.setdefault(r["key"], i) != i
        symbols.append("b" if r["blank"] else "x" if again else initial.upper() if r["truncated"] else initial)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    firsts = [i for i in seen.values() if not rows[i]["blank"]]
    return {
        "conv": rows[0]["conv"], "part": part, "seq": seq, "symbols": "".join(symbols),
        "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows],
        "first_at": firsts, "first_key": [rows[i]["key"] for i in firsts],
        "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
    }


def _schema(conv: T.DataType) -> str:
    return (
        f"conv {conv.simpleString()}, part int, seq int, symbols string, roles array<string>, texts array<string>, "
        "first_at array<int>, first_key array<binary>, low long, high long, turns int"
    )


def _batches(rows: Iterator[dict], schema: pa.Schema, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``chars`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("texts") or ())) + len(row.get("text") or "") + 200
        if size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _emit(make, shape: str):
    """A function for mapInArrow that yields the rows which ``make`` makes of batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(shape))
    return lambda batches: _batches(make(batches), schema)


def cut(rows: DataFrame) -> DataFrame:
    """Pieces of the conversations of ``rows (conv_id, turn, role, text)``, in order of ``part, seq``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    key = F.md5(F.concat_ws("\0", conv, F.char_length("role").cast("string"), "role", "text").cast("binary"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    marked = rows.select("*", F.md5(F.col("text").cast("binary")).alias("order"), F.unhex(key).alias("key"), trimmed.alias("trimmed"))
    last = F.right("trimmed", F.lit(1))
    marked = marked.select("conv", "turn", "role", "text", "order", "key", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    order = ["conv", "turn", "role", "order", "at"]
    dealt = marked.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    shape = _schema(rows.schema["conv"].dataType)
    return written(dealt.select("conv", "turn", "role", "text", "key", "blank", "truncated").mapInArrow(_emit(_pieces, shape), shape), "conversations-pieces")


def repeated(pieces: DataFrame) -> DataFrame:
    """``conv, part, seq, at`` of the rows that an earlier piece already holds."""
    keys = pieces.select("conv", "part", "seq", F.explode(F.arrays_zip("first_at", "first_key")).alias("f")).select("conv", "part", "seq", "f.first_at", "f.first_key")
    firsts = keys.groupBy("first_key").agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_by_hot(keys, written(firsts, "conversations-repeats"), ["first_key"]).where(F.struct("part", "seq") != F.col("first"))
    return later.select("conv", "part", "seq", F.col("first_at").alias("at"))


SCANNED = "conv {conv}, part int, seq int, symbols string, faults string, costs array<long>, cost long"


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces from last to first, each after the rows that say what else is repeated in it."""
    machine, more = Automaton(), []
    conv, after, begun = None, machine.end, False
    for batch in batches:
        for row in batch.to_pylist():
            if row["symbols"] is None:
                more.append(row["at"])
                continue
            if not begun or row["conv"] != conv:
                conv, after, begun = row["conv"], machine.end, True
            faults = list(row["symbols"])
            for i in more:
                faults[i] = "x"
            symbols = "".join(faults).replace("b", "x")
            vectors, cost = machine.scan(symbols, after)
            yield {"conv": conv, "part": row["part"], "seq": row["seq"], "symbols": symbols, "faults": "".join(faults), "costs": list(machine.vectors[after]), "cost": cost}
            after, more = vectors[0], []


def scanned(pieces: DataFrame) -> DataFrame:
    """Each piece's symbols, the vector of costs that remain after it, and what it adds to the cost."""
    conv = pieces.schema["conv"].dataType.simpleString()
    skinny = pieces.select("conv", "part", "seq", "symbols", F.lit(-1).alias("at"))
    again = repeated(pieces).select("conv", "part", "seq", F.lit(None).cast("string").alias("symbols"), "at")
    backwards = [F.col("conv"), F.desc("part"), F.desc("seq"), F.desc("at")]
    stream = skinny.unionByName(again).repartition("conv").sortWithinPartitions(*backwards)
    shape = SCANNED.format(conv=conv)
    return stream.mapInArrow(_emit(_scan_all, shape), shape)


class _Told:
    """What is known of a conversation while its pieces pass by."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.audit, self.cost = conv, 0, [], 0
        self.faults = {"b": 0, "x": 0, "t": 0}
        self.illegal, self.last = 0, None
        self.low, self.high, self.turns = None, None, 0
        self.hasher, self.any, self.count = hashlib.sha256(), False, 0

    def take(self, piece: dict, scan: dict, ways: list[str]) -> None:
        for symbol in scan["faults"]:
            kind = "t" if symbol.isupper() else symbol
            if kind in self.faults:
                self.faults[kind] += 1
        initials = [r[:1] for r in piece["roles"]]
        for a, b in zip(initials if self.last is None else [self.last, *initials], initials if self.last is not None else initials[1:], strict=False):
            self.illegal += a + b not in ("su", "ua", "au")
        self.last = initials[-1]
        if piece["low"] is not None:
            self.turns += piece["turns"] - (self.high == piece["low"])
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]
        self.audit += ways
        self.cost += scan["cost"]

    def digest(self, turns: list[tuple[str, str, str]]) -> None:
        for role, text, _ in turns:
            self.hasher.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv_id": self.conv, "gaps": gaps, "blank": self.faults["b"], "duplicate": self.faults["x"], "truncated": self.faults["t"],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hasher.hexdigest(),
        }


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Told, list[tuple[str, str, str]], bool]]:
    """For each piece, in order, its conversation so far and the turns that it leaves; at its end, those inserted."""
    machine, scan, now = Automaton(), None, None

    def ended(told: _Told):
        way = machine.finish(told.state)
        turns = repaired([("", "")], [way], told.state)
        told.audit.append(way)
        told.digest(turns)
        return told, turns, True

    for batch in batches:
        for row in batch.to_pylist():
            if row["costs"] is not None:
                scan = row
                continue
            after = machine.number(scan["costs"])
            vectors, _ = machine.scan(scan["symbols"], after)
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    yield ended(now)
                now = _Told(row["conv"])
                now.cost = machine.vectors[vectors[0]][0]
            ways, state = machine.trace(scan["symbols"], vectors, now.state)
            turns = repaired(list(zip(row["roles"], row["texts"], strict=True)), ways, now.state)
            now.take(row, scan, ways)
            now.state = state
            now.digest(turns)
            yield now, turns, False
    if now is not None:
        yield ended(now)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for told, _, over in _audited(batches):
        if over:
            yield told.report()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for told, turns, _ in _audited(batches):
        for role, text, edit in turns:
            yield {"conv_id": told.conv, "position": told.count, "role": role, "text": text, "edit": edit}
            told.count += 1


def _forwards(rows: DataFrame) -> DataFrame:
    """Pieces and their vectors, those first, in the order of each conversation."""
    pieces = cut(rows)
    scans = scanned(pieces)
    kept = pieces.select("conv", "part", "seq", "roles", "texts", "low", "high", "turns")
    empty = lambda df, other: df.select("*", *[F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c not in df.columns])
    both = empty(scans, kept).unionByName(empty(kept, scans))
    return both.repartition("conv").sortWithinPartitions("conv", "part", "seq", F.col("costs").isNull())


def repair_reports(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each conversation of ``rows (conv_id, turn, role, text)``."""
    shape = (
        f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, repaired_sha256 string"
    )
    return _forwards(rows).mapInArrow(_emit(_reports, shape), shape)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit``: the turns that the cheapest edits leave."""
    shape = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, role string, text string, edit string"
    return _forwards(rows).mapInArrow(_emit(_turns, shape), shape)
