"""Conversation structure repair by Four-Russians block tables (operator 12).

A conversation is sound if its role initials read ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (2), Delete
(3; required for blank rows and duplicates), Insert an empty user or assistant row (2); a truncated row that stays costs 1
more. What an edit leads to is fixed by the state reached (nothing yet, after s, after u, after a), so an audit, the
edits' initials in order, names one repair. Of the cheapest audits the ASCII-least is taken.

* The costs to go from the four states make a vector. Less its minimum it is one of a few (``Tables.vectors``), and a row
  is one of ten symbols. ``Tables`` holds, for every vector and every block of ``BLOCK`` symbols, the vector before the
  block and the cost added. A conversation is read by blocks from its end.
* Each block is then expanded backward into the vectors behind its rows, and edits are chosen forward: of those that keep
  to the cheapest cost the least letter, which makes the whole audit least.

Rows are put in order by a range partitioning of narrow rows (no texts), numbered, and cut into chunks of
2**``CHUNK_BITS`` numbers. Conversations within one chunk are solved there. Those that span several (one may hold a third of all rows) get
a summary a chunk: for every vector behind it the vector before it, and for every state before it the state behind it.
Summaries are composed by partition, then by conversation, and the vector and the state at each chunk's ends come back.
Duplicates are found by an aggregate of (conversation, role, SHA-256 of the text). Texts move once, in the last pass, which
reads each conversation in order and holds one row at a time; only its SHA-256, which can't be computed in parts, makes the
rows of one conversation pass through one task.

Defined cases: rows are read by turn, nulls first, and rows of one turn by role, then by SHA-256 of the text. Null roles and
texts count as one space. A null conv_id is a conversation of its own. A role's initial is its first character; roles of
other initials can't be kept. Repeated rows are duplicates. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import SPACES, pin

BLOCK = 4
CHUNK_BITS = 12             # a chunk is 4096 row numbers
_PART_BITS = 33             # row numbers of one partition

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an inserted or reroled row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows as symbols: b blank, d duplicate, the initials s, u, a and o (any other), in capitals if truncated, and no row.
SYMBOLS = "bdsuaoSUAO-"
_NONE = SYMBOLS.index("-")
_FAR = 1 << 20
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
FAULTS = ("blank", "duplicate", "truncated")


def _closed(costs: list[int]) -> list[int]:
    """Costs to go when rows may also be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


def _options(symbol: str, q: int, after: list[int]) -> dict[str, tuple[int, int]]:
    """What may be done with a row in state q: letter -> (cost to go, state)."""
    out = {"D": (DELETE + after[q], q)}
    if symbol not in "bd":
        extra = TRUNCATED if symbol.isupper() else 0
        kept = _KEPT.get((symbol.lower(), q))
        if kept is not None:
            out["K"] = (KEEP + extra + after[kept], kept)
        out["R"] = (REROLE + extra + after[NEXT[q]], NEXT[q])
    return out


def _before(symbol: str, after: list[int]) -> list[int]:
    return _closed([min(c for c, _ in _options(symbol, q, after).values()) for q in range(4)])


@dataclass(frozen=True)
class Tables:
    vectors: list[tuple[int, ...]]      # normalised costs to go; the first is that of an end
    step: np.ndarray                    # vector, symbol -> vector
    step_cost: np.ndarray               # and the cost added
    block: np.ndarray                   # vector, block of symbols -> vector
    block_cost: np.ndarray
    edits: list[list[list[tuple[str, int]]]]    # vector behind a row, symbol, state -> letters, state
    ends: list[str]                     # state -> letters after the last row


@lru_cache
def tables() -> Tables:
    end = tuple(_closed([0, _FAR, _FAR, 0]))
    vectors, number, steps, costs = [end], {end: 0}, [], []
    for v in vectors:                   # grows while it is read
        row = []
        for symbol in SYMBOLS[:-1]:
            w = _before(symbol, list(v))
            low = min(w)
            w = tuple(c - low for c in w)
            if w not in number:
                number[w] = len(vectors)
                vectors.append(w)
            row.append((number[w], low))
        steps.append([x for x, _ in row] + [number[v]])
        costs.append([c for _, c in row] + [0])
    step, cost = np.array(steps, dtype=np.int32), np.array(costs, dtype=np.int32)
    block, block_cost = step, cost
    for _ in range(BLOCK - 1):          # a symbol in front: the rest of the block, then that symbol
        rest, rest_cost = block, block_cost
        block = np.stack([step[rest, s] for s in range(len(SYMBOLS))], axis=1).reshape(len(vectors), -1)
        block_cost = np.stack([rest_cost + cost[rest, s] for s in range(len(SYMBOLS))], axis=1).reshape(len(vectors), -1)

    def letters(symbol: str, q: int, after: list[int]) -> tuple[str, int]:
        if symbol == "-":
            return "", q
        before, done = _before(symbol, after), ""
        while True:
            options = _options(symbol, q, after)
            options["I"] = (INSERT + before[NEXT[q]], NEXT[q])
            letter = min(x for x, (c, _) in options.items() if c == before[q])
            done, q = done + letter, options[letter][1]
            if letter != "I":
                return done, q

    edits = [[[letters(s, q, list(v)) for q in range(4)] for s in SYMBOLS] for v in vectors]
    return Tables(vectors, step, cost, block, block_cost, edits, ["I" * (c // INSERT) for c in end])


_CODE = {ord(c): i for i, c in enumerate(SYMBOLS)}


def symbols(rows: str) -> np.ndarray:
    return np.array([_CODE[b] for b in rows.encode()], dtype=np.int64)


def _blocks(rows: np.ndarray) -> np.ndarray:
    """Rows as blocks, filled up in front."""
    filled = np.concatenate([np.full(-len(rows) % BLOCK, _NONE, dtype=np.int64), rows])
    return filled.reshape(-1, BLOCK)


def _numbers(blocks: np.ndarray) -> np.ndarray:
    return reduce(lambda n, s: n * len(SYMBOLS) + s, blocks.T, np.zeros(len(blocks), dtype=np.int64))


def edit(rows: str, behind: int = 0, state: int = START, last: bool = True) -> tuple[list[str], int, int]:
    """The letters of each row (and of the end, if ``last``), their cost, and the state reached, given the vector behind
    the rows and the state before them."""
    t, blocks = tables(), _blocks(symbols(rows))
    numbers, bounds, cost = _numbers(blocks), [behind], 0
    for n in numbers[::-1]:             # vectors at the blocks' ends, by lookup
        cost += int(t.block_cost[bounds[-1], n])
        bounds.append(int(t.block[bounds[-1], n]))
    cost += t.vectors[bounds[-1]][state]
    done = []
    for i, block in enumerate(blocks):
        after = [bounds[len(blocks) - 1 - i]]
        for s in block[:0:-1]:          # the block expanded backward: the vector behind each of its rows
            after.append(int(t.step[after[-1], s]))
        for s, v in zip(block, reversed(after), strict=True):
            letters, state = t.edits[v][s][state]
            if s != _NONE:
                done.append(letters)
    cost -= t.vectors[behind][state]
    if last:
        done.append(t.ends[state])
        cost += INSERT * len(t.ends[state])
    return done, cost, state


@dataclass(frozen=True)
class Summary:
    """A run of rows as a function: of the vector behind it, the vector before it; of that and the state before it, the
    state behind it."""
    before: np.ndarray          # vector -> vector
    behind: np.ndarray          # vector, state -> state

    def then(self, later: Summary) -> Summary:
        """This run followed by another."""
        first = self.behind[later.before]
        return Summary(self.before[later.before], np.take_along_axis(later.behind, first, axis=1))

    def pack(self) -> bytes:
        return np.concatenate([self.before, self.behind.ravel()]).astype("<i4").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Summary:
        a = np.frombuffer(data, dtype="<i4")
        n = len(a) // 5
        return Summary(a[:n], a[n:].reshape(n, 4))


def summarise(rows: str) -> Summary:
    t, coded = tables(), symbols(rows)
    before = np.arange(len(t.vectors))
    for n in _numbers(_blocks(coded))[::-1]:
        before = t.block[before, n]
    after = [np.arange(len(t.vectors))]
    for s in coded[:0:-1]:
        after.append(t.step[after[-1], s])
    state = np.tile(np.arange(4), (len(t.vectors), 1))
    moves = np.array([[[q for _, q in by_state] for by_state in by_symbol] for by_symbol in t.edits])
    for s, v in zip(coded, reversed(after), strict=True):
        state = moves[v, s][np.arange(len(v))[:, None], state]
    return Summary(before, state)


# ---------------------------------------------------------------- over DataFrames

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes its end marks, 3 repeats it, 4 makes its role user. Nulls count as one space there."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


_ORDER = ("conv_id", "turn", "role", "digest")


def _ordered(conversations: DataFrame) -> DataFrame:
    """The rows with their sort key."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _chunks(rows: DataFrame) -> DataFrame:
    """(cid, n_chunks, chunk, conv_id, turn, role, digest, rows): each conversation's rows as symbols, by chunk, with the
    sort key of the first of them."""
    initial = F.left("role", F.lit(1))
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    bare = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(*_ORDER, symbol.alias("symbol"), (bare == "").alias("blank"),
                         (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    # Range bounds come from a sample: the numbered rows are written, so that every later step sees the same numbers.
    numbered = pin(narrow.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
                   .withColumn("rid", F.monotonically_increasing_id()), "turns")
    spoken = numbered.filter(~F.col("blank")).select("conv_id", F.col("role").alias("r"), F.col("digest").alias("d"), "rid")
    first = (spoken.groupBy("conv_id", "r", "d").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.col("conv_id").alias("c1"), F.col("r").alias("r1"), F.col("d").alias("d1"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("r") == F.col("r1")) & (F.col("d") == F.col("d1"))
    again = spoken.join(first, same).filter("rid > first").select("rid", F.lit(True).alias("again"))
    code = (F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), F.upper("symbol")).otherwise(F.col("symbol")))
    coded = numbered.join(again, "rid", "left").select(*_ORDER, "rid", code.alias("code"))
    chunk = F.shiftright("rid", CHUNK_BITS)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rid", "code"))), lambda x: x["code"])
    cut = pin(coded.groupBy("conv_id", chunk.alias("chunk")).agg(
        F.min(F.struct("rid", "turn", "role", "digest")).alias("head"), F.array_join(in_order, "").alias("rows")), "chunks")
    whole = cut.groupBy("conv_id").agg(F.min("head.rid").alias("cid"), F.count(F.lit(1)).alias("n_chunks")).withColumnRenamed("conv_id", "c")
    return cut.join(whole, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "cid", "n_chunks", "chunk", "conv_id", "head.turn", "head.role", "head.digest", "rows")


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [summarise(rows).pack() for rows in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["cid", "chunk", "summary"])


def _composed(table: pa.Table) -> pa.Table:
    """One summary of a group's runs (cid, part, chunk, summary), in order."""
    table = table.sort_by("chunk")
    whole = reduce(Summary.then, map(Summary.unpack, table.column("summary").to_pylist()))
    return pa.table({"cid": table.column("cid")[:1], "part": table.column("part")[:1], "summary": pa.array([whole.pack()], pa.binary())})


def _placed(table: pa.Table, by: str) -> pa.Table:
    """The vector behind each of a group's runs and the state before it, from those of the group (columns behind, state,
    last: those of its end)."""
    table = table.sort_by(by)
    runs = list(map(Summary.unpack, table.column("summary").to_pylist()))
    behind = [table.column("behind")[0].as_py()]
    for run in runs[:0:-1]:
        behind.append(int(run.before[behind[-1]]))
    behind.reverse()
    states = [table.column("state")[0].as_py()]
    for run, v in zip(runs[:-1], behind, strict=False):
        states.append(int(run.behind[v, states[-1]]))
    last = [False] * (len(runs) - 1) + [table.column("last")[0].as_py()]
    return pa.table({"cid": table.column("cid"), by: table.column(by), "behind": pa.array(behind, pa.int32()),
                     "state": pa.array(states, pa.int32()), "last": pa.array(last, pa.bool_())})


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edits, costs = [], []
        for rows, behind, state, last in zip(*(batch.column(i).to_pylist() for i in range(5, 9)), strict=True):
            letters, cost, _ = edit(rows, behind, state, last)
            edits.append(",".join(letters))
            costs.append(cost)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(edits, pa.string()), pa.array(costs, pa.int64())],
                                         names=["conv_id", "turn", "role", "digest", "chunk", "rows", "edits", "cost"])


def _edits(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, chunk, rows, edits, cost): each chunk's edits, a row's letters between commas, and the
    end's after the last row of a conversation."""
    chunks = _chunks(rows)
    ends = [F.lit(0).alias("behind"), F.lit(START).alias("state"), F.lit(True).alias("last")]
    given = ["conv_id", "turn", "role", "digest", "chunk", "rows"]
    whole = chunks.filter("n_chunks = 1").select(*given, *ends)
    spread = chunks.filter("n_chunks > 1")
    runs = spread.select("cid", "chunk", "rows").mapInArrow(_summaries, "cid long, chunk long, summary binary")
    runs = pin(runs.withColumn("part", F.shiftright("chunk", _PART_BITS - CHUNK_BITS)), "summaries")
    parts = runs.groupBy("cid", "part").applyInArrow(_composed, "cid long, part long, summary binary")
    placed = (parts.select("*", *ends).groupBy("cid")
              .applyInArrow(lambda t: _placed(t, "part"), "cid long, part long, behind int, state int, last boolean"))
    placed = (runs.join(placed, ["cid", "part"]).groupBy("cid", "part")
              .applyInArrow(lambda t: _placed(t, "chunk"), "cid long, chunk long, behind int, state int, last boolean"))
    spread = spread.join(placed, ["cid", "chunk"]).select(*given, "behind", "state", "last")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.select(given).schema)
    return whole.unionByName(spread).mapInArrow(_traced, f"{kinds}, edits string, cost long")


class _Conversation:
    """One conversation, read row by row in order."""

    def __init__(self, conv_id: object):
        self.conv_id, self.edits, self.audit, self.cost, self.made = conv_id, deque(), [], 0, 0
        self.faults, self.illegal, self.turns, self.low, self.high = dict.fromkeys("bdt", 0), 0, 0, None, None
        self.initial, self.state, self.hash = None, START, hashlib.sha256()

    def chunk(self, rows: str, edits: str, cost: int) -> None:
        self.edits.extend(edits.split(","))
        self.cost += cost
        self.faults["b"] += rows.count("b")
        self.faults["d"] += rows.count("d")
        self.faults["t"] += sum(map(rows.count, "SUAO"))

    def _add(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update((("\n" if self.made else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.made += 1
        return role, text

    def _edit(self, letters: str, role: str, text: str) -> Iterator[tuple[str, str]]:
        self.audit.append(letters)
        for letter in letters:
            if letter in "IR":
                self.state = NEXT[self.state]
                yield self._add(ROLES[self.state], text if letter == "R" else "")
            elif letter == "K":
                self.state = _KEPT[role[:1], self.state]
                yield self._add(role, text)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str]]:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        yield from self._edit(self.edits.popleft(), role, text)

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._edit(self.edits.popleft(), "", "")

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple[str, str] | None]]:
    """Every repaired row with its conversation; None at a conversation's end."""
    now = None
    for batch in batches:
        for conv_id, turn, kind, role, text, rows, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from ((now, made) for made in now.end())
                    yield now, None
                now = _Conversation(conv_id)
            if kind == 0:
                now.chunk(rows, text, cost)
            else:
                yield from ((now, made) for made in now.row(turn, role, text))
    if now is not None:
        yield from ((now, made) for made in now.end())
        yield now, None


def _in_order(conversations: DataFrame) -> DataFrame:
    """Rows and edits of a conversation together, each chunk's edits before its first row."""
    rows = _ordered(conversations)
    edits = _edits(rows)
    lines = rows.select(*_ORDER, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("chunk"), "text",
                        F.lit(None).cast("string").alias("rows"), F.lit(None).cast("long").alias("cost"))
    heads = edits.select(*_ORDER, F.lit(0).alias("kind"), "chunk", F.col("edits").alias("text"), "rows", "cost")
    return (lines.unionByName(heads).repartition("conv_id").sortWithinPartitions(*_ORDER, "kind", "chunk")
            .select("conv_id", F.col("turn").cast("long").alias("turn"), "kind", "role", "text", "rows", "cost"))


_LOT = 1000         # rows of an output batch, and
_LOT_SIZE = 4 << 20  # characters


def _batches(rows: Iterable[tuple], schema: pa.Schema, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; ``wide`` is the column of long texts."""
    lot, size = [], 0
    for row in rows:
        lot.append(row)
        size += len(row[wide])
        if len(lot) >= _LOT or size >= _LOT_SIZE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot, strict=True), schema, strict=True)], schema=schema)
            lot, size = [], 0
    if lot:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot, strict=True), schema, strict=True)], schema=schema)


def reports(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (c.report() for c, made in _read(batches) if made is None)
        yield from _batches(rows, schema, 7)

    kind, key = _kinds(conversations)
    counts = ["gaps", *FAULTS, "illegal", "cost"]
    schema = pa.schema([("conv_id", key), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _in_order(conversations).mapInArrow(
        run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), role, text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c.conv_id, c.made - 1, *made) for c, made in _read(batches) if made is not None)
        yield from _batches(rows, schema, 3)

    kind, key = _kinds(conversations)
    schema = pa.schema([("conv_id", key), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _in_order(conversations).mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def _kinds(conversations: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repair(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``reports``, with a row of zeros for each conv_id of ``every`` (a table with conv_id) that has no rows."""
    found = reports(conversations)
    if every is None:
        return found
    ids = every.select(F.col("conv_id").alias("id")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in found.columns[1:]])
