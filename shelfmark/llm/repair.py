"""Conversation structure repair: the cheapest edits that give every conversation the turn order ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first), then role, then text. Each row's first fault counts: blank,
duplicate (role and text seen earlier), truncated (its last character is no sentence end). Edits are Keep, Rerole to user or
assistant, Delete (required for blank and duplicate rows) and Insert of an empty user or assistant turn.

Run-length dynamic program: a row is one of nine symbols (initial of the role by kept fault, or "must go"), equal consecutive
symbols collapse to a run, and a run of n rows is the n-th power of the symbol's min-plus transition between the four
states of the turn order, put together from cached binary powers. Min-plus products are associative, so a conversation
of any length is cut into blocks: each block gives one 4 x 4 matrix, one pass backwards over these gives the costs behind
every block, one pass forwards its entry state, and then all blocks unroll their choices at the same time. The unrolled
choices of 2^k equal rows are cached too, by entry state and relative costs behind them.

Equal rows (same turn, role, text) are counted before they are moved, so no row, and no conversation that holds a third of
all rows, lands in one task; only what must be one value per conversation (its audit, a digest) is put together in
one stream. Ties between cheapest edits go to the audit that is least in ASCII.

Defined cases: null role and text are one space each; a null conversation id is a conversation of its own; conversations
without rows have no row in the results; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import saved

FAR = 1 << 40  # no way
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state that a user or assistant turn leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
GONE = 8  # symbols 0 to 7 are the initial (s, u, a, other) and whether the row is truncated
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def keep_state(symbol: int, state: int) -> int | None:
    """Where keeping a row leads, if it may be kept."""
    initial = symbol >> 1
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if symbol < GONE and initial in (1, 2) and NEXT[state] == initial + 1 else None


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


IDENTITY: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
INSERTED: Matrix = tuple(tuple(min(0 if i == j else FAR, INSERT if NEXT[i] == j else FAR) for j in range(4)) for i in range(4))
INSERTS = multiply(INSERTED, multiply(INSERTED, INSERTED))
END: Vector = tuple(min(INSERTS[i][START] if i == START else FAR, INSERTS[i][ASSISTANT] if i != START else FAR) for i in range(4))


@cache
def transition(symbol: int) -> Matrix:
    """One row: any inserts, then the edit of the row."""
    step = [[FAR] * 4 for _ in range(4)]
    extra = TRUNCATED if symbol < GONE and symbol & 1 else 0
    for q in range(4):
        step[q][q] = DELETE
        if symbol < GONE:
            to = keep_state(symbol, q)
            if to is not None:
                step[q][to] = min(step[q][to], KEEP + extra)
            step[q][NEXT[q]] = min(step[q][NEXT[q]], REROLE + extra)
    return multiply(INSERTS, tuple(map(tuple, step)))


@cache
def power(symbol: int, k: int) -> Matrix:
    """2^k equal rows."""
    if not k:
        return transition(symbol)
    half = power(symbol, k - 1)
    return multiply(half, half)


def bits(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def across(runs: list[tuple[int, int]]) -> Matrix:
    """The transition of a block of runs (symbol, length)."""
    out = IDENTITY
    for symbol, length in runs:
        for k in bits(length):
            out = multiply(out, power(symbol, k))
    return out


@cache
def row_choice(symbol: int, state: int, behind: Vector) -> tuple[str, int]:
    """Edits up to and with one row: the ASCII-least of the cheapest, and the state after it."""
    ahead, letters = apply(transition(symbol), behind), ""
    extra = TRUNCATED if symbol & 1 else 0
    while True:
        if DELETE + behind[state] == ahead[state]:
            return letters + "D", state
        if INSERT + ahead[NEXT[state]] == ahead[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        to = keep_state(symbol, state)
        if to is not None and KEEP + extra + behind[to] == ahead[state]:
            return letters + "K", to
        return letters + "R", NEXT[state]


class Choices:
    """Unrolled choices of 2^k equal rows, cached by entry state and the costs behind them less their minimum."""

    def __init__(self):
        self.known: dict = {}

    def of_power(self, symbol: int, k: int, state: int, behind: Vector) -> tuple[str, int]:
        least = min(behind)
        behind = tuple(min(v - least, FAR) for v in behind)
        key = (symbol, k, state, behind)
        if key not in self.known:
            if len(self.known) > 1 << 14:
                self.known.clear()
            if k == 0:
                self.known[key] = row_choice(symbol, state, behind)
            else:
                first, middle = self.of_power(symbol, k - 1, state, apply(power(symbol, k - 1), behind))
                second, last = self.of_power(symbol, k - 1, middle, behind)
                self.known[key] = (first + second, last)
        return self.known[key]

    def of_block(self, runs: list[tuple[int, int]], state: int, behind: Vector) -> tuple[list[str], int]:
        """Edits per run of a block, and the state after it."""
        pieces = [(i, symbol, k) for i, (symbol, length) in enumerate(runs) for k in bits(length)]
        costs = []
        for _, symbol, k in reversed(pieces):
            costs.append(behind)
            behind = apply(power(symbol, k), behind)
        out = [[] for _ in runs]
        for (i, symbol, k), cost in zip(pieces, reversed(costs), strict=True):
            letters, state = self.of_power(symbol, k, state, cost)
            out[i].append(letters)
        return ["".join(o) for o in out], state


def repaired(runs: list[tuple[int, int]], edits: list[str], state: int, rows: list[dict], last: bool) -> tuple[str, list[dict]]:
    """The audit of a block and its turns after the edits; ``rows`` are those that may stay, in order."""
    turns, at = [], 0
    for (symbol, _), letters in zip(runs, edits, strict=True):
        for letter in letters:
            if letter == "D":
                at += symbol != GONE
                continue
            if letter == "K":
                row, state = rows[at], keep_state(symbol, state)
            else:
                state = NEXT[state]
                row = {"role": NAMES[state], "text": rows[at]["text"] if letter == "R" else ""}
            at += letter != "I"
            turns.append({"role": row["role"], "text": row["text"]})
    audit = "".join(edits)
    while last and state not in (START, ASSISTANT):
        state = NEXT[state]
        audit += "I"
        turns.append({"role": NAMES[state], "text": ""})
    return audit, turns


def counted(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, n (equal rows), first (no equal role and text before), symbol, blank, truncated."""
    rows = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    firsts = rows.groupBy(F.col("conv").alias("_c"), said.alias("_s")).agg(F.min(place).alias("_first"))
    whole = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    # not aggregated by these keys on either side of the join, so adaptive execution may split a hot one
    whole = whole.withColumn("said", said)
    found = whole.join(firsts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s")))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    cut_off = ~end.isin(".", "!", "?")
    found = found.select("conv", "turn", "role", "text", "n", (F.col("_first") == place).alias("first"), (end == "").alias("blank"), initial.alias("initial"), (kind * 2 + cut_off.cast("int")).alias("symbol"))
    kept = F.col("first") & ~F.col("blank")
    # the text of a row that must go is not needed any more
    return found.withColumn("order_text", F.col("text")).withColumn("text", F.when(kept, F.col("text")))


STATS = ["n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns", "low", "high", "first_turn", "last_turn", "first_initial", "last_initial"]
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _lawful(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Block:
    """Rows of one conversation, next to each other in its order."""

    def __init__(self, conv):
        self.conv, self.runs, self.rows, self.count, self.size = conv, [], [], 0, 0
        self.stats = dict.fromkeys(STATS, 0)
        self.stats |= dict.fromkeys(STATS[5:])

    def add(self, symbol: int, n: int) -> None:
        if n:
            if self.runs and self.runs[-1][0] == symbol:
                self.runs[-1] = (symbol, self.runs[-1][1] + n)
            else:
                self.runs.append((symbol, n))

    def take(self, r: dict) -> None:
        s, n, turn = self.stats, r["n"], r["turn"]
        stays = r["first"] and not r["blank"]
        s["n_blank"] += n if r["blank"] else 0
        s["n_duplicate"] += 0 if r["blank"] else n - r["first"]
        s["n_truncated"] += stays and r["symbol"] & 1
        s["n_illegal"] += n - 1 + (self.count > 0 and not _lawful(s["last_initial"], r["initial"]))
        if turn is not None:
            s["n_turns"] += turn != s["last_turn"]
            s["low"] = turn if s["low"] is None else s["low"]
            s["high"] = turn
        if not self.count:
            s["first_turn"], s["first_initial"] = turn, r["initial"]
        s["last_turn"], s["last_initial"] = turn, r["initial"]
        if stays:
            self.add(r["symbol"], 1)
            self.rows.append({"role": r["role"], "text": r["text"]})
            self.size += len(r["text"])
        self.add(GONE, n - stays)
        self.count += 1

    @property
    def full(self) -> bool:
        return self.count >= BLOCK_ROWS or self.size >= BLOCK_BYTES


def _stream(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.pop("_size", 0)
        if len(held) >= most or size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, schema: T.StructType, function) -> DataFrame:
    """``function`` from an iterator of rows to one of rows, over each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches):
        yield from _batches(function(_stream(batches)), kinds)

    return df.mapInArrow(run, schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows in order, in blocks of one conversation each; part and seq order the blocks."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "order_text"]
    ordered = rows.orderBy(*order).drop("order_text")
    longs, array = T.LongType(), T.ArrayType(T.LongType())
    names = [*STATS[:9]]
    schema = T.StructType([rows.schema["conv"], T.StructField("part", longs), T.StructField("seq", longs)]
                          + [T.StructField(n, longs) for n in names] + [T.StructField(n, T.StringType()) for n in STATS[9:]]
                          + [T.StructField("symbols", array), T.StructField("lengths", array), T.StructField("matrix", array), T.StructField("rows", TURNS)])

    def blocks(stream):
        from pyspark import TaskContext

        part, seq, block = TaskContext.get().partitionId(), 0, None

        def done(b):
            symbols, lengths = (list(x) for x in zip(*b.runs, strict=True))
            matrix = [v for line in across(b.runs) for v in line]
            return {"conv": b.conv, "part": part, "seq": seq, **b.stats, "symbols": symbols, "lengths": lengths, "matrix": matrix, "rows": b.rows, "_size": b.size}

        for row in stream:
            if block is not None and (block.full or block.conv != row["conv"]):
                yield done(block)
                seq, block = seq + 1, None
            block = block or _Block(row["conv"])
            block.take(row)
        if block is not None:
            yield done(block)

    return _mapped(ordered, schema, blocks)


def _by_conversation(df: DataFrame, ascending: bool) -> DataFrame:
    return df.repartition(F.col("conv")).sortWithinPartitions(F.col("conv"), F.col("part").asc() if ascending else F.col("part").desc(), F.col("seq").asc() if ascending else F.col("seq").desc())


def _behind(blocks: DataFrame) -> DataFrame:
    """One pass backwards: the costs behind each block."""
    array = T.ArrayType(T.LongType())
    kept = [f for f in blocks.schema.fields if f.name in ("conv", "part", "seq", "first_turn", "last_turn", "first_initial", "last_initial", "symbols", "lengths")]
    schema = T.StructType([*kept, T.StructField("behind", array), T.StructField("ahead", T.LongType()), T.StructField("last", T.BooleanType())])

    def back(stream):
        conv, costs, started = None, END, False
        for row in stream:
            last = not started or row["conv"] != conv
            if last:
                conv, costs, started = row["conv"], END, True
            row["behind"], row["last"] = list(costs), last
            m = row.pop("matrix")
            costs = apply(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), costs)
            row["ahead"] = costs[START]
            yield row

    chosen = blocks.select(*[f.name for f in kept], "matrix")
    return _mapped(_by_conversation(chosen, False), schema, back)


def _entries(marked: DataFrame) -> DataFrame:
    """One pass forwards: each block's entry state, and what the border to the block before it adds."""
    longs = T.LongType()
    kept = [f for f in marked.schema.fields if f.name in ("conv", "part", "seq", "behind", "last", "ahead")]
    schema = T.StructType([*kept, *[T.StructField(n, longs) for n in ("state", "illegal_border", "same_turn")], T.StructField("opens", T.BooleanType())])

    def forth(stream):
        before, choices = None, Choices()
        for row in stream:
            opens = before is None or before["conv"] != row["conv"]
            state = START
            if not opens:
                runs = list(zip(before["symbols"], before["lengths"], strict=True))
                state = choices.of_block(runs, before["state"], tuple(before["behind"]))[1]
            row |= {"state": state, "opens": opens}
            row["illegal_border"] = 0 if opens else int(not _lawful(before["last_initial"], row["first_initial"]))
            row["same_turn"] = 0 if opens else int(row["first_turn"] is not None and row["first_turn"] == before["last_turn"])
            before = row
            yield {f.name: row[f.name] for f in schema.fields}

    return _mapped(_by_conversation(marked, True), schema, forth)


@dataclass
class Repair:
    """``summary``: conv, gaps, blank, duplicate, truncated, illegal, cost. ``parts``: conv, part, seq, whole, audit, turns: the
    edits and the repaired turns, in one or more pieces per conversation, in the order of part and seq."""

    summary: DataFrame
    parts: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    blocks = saved(_blocks(counted(rows, conv, turn, role, text)), "blocks")
    entries = saved(_entries(_behind(blocks)), "entries").withColumnRenamed("conv", "_conv")
    found = blocks.join(entries, ["part", "seq"])  # together they are one block's key
    span = F.max("high") - F.min("low") + 1 - F.sum(F.col("n_turns") - F.col("same_turn"))
    summary = found.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), F.sum("n_blank").alias("blank"), F.sum("n_duplicate").alias("duplicate"), F.sum("n_truncated").alias("truncated"),
        F.sum(F.col("n_illegal") + F.col("illegal_border")).alias("illegal"), F.sum(F.when(F.col("opens"), F.col("ahead")).otherwise(0)).alias("cost"),
    )
    schema = T.StructType([blocks.schema["conv"], T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("audit", T.StringType()), T.StructField("turns", TURNS)])

    def unroll(stream):
        choices = Choices()
        for row in stream:
            runs = list(zip(row["symbols"], row["lengths"], strict=True))
            edits, _ = choices.of_block(runs, row["state"], tuple(row["behind"]))
            audit, turns = repaired(runs, edits, row["state"], row["rows"], row["last"])
            whole = row["opens"] and row["last"]
            yield {"conv": row["conv"], "part": row["part"], "seq": row["seq"], "whole": whole, "audit": audit, "turns": turns, "_size": len(audit) + sum(len(t["text"]) for t in turns)}

    columns = ["conv", "part", "seq", "symbols", "lengths", "rows", "state", "behind", "last", "opens"]
    return Repair(summary, _mapped(found.select(*columns), schema, unroll))


def digests(parts: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256: the pieces of a conversation in order, read as one stream where there are several."""
    parts = saved(parts, "parts")
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = parts.select("conv", "part", "seq", "whole", "audit", line.alias("body"), (F.size("turns") > 0).alias("some"))
    schema = T.StructType([parts.schema["conv"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def joined(stream):
        import hashlib

        conv, audit, state, any_turns, started = None, [], None, False, False

        def done():
            return {"conv": conv, "audit": "".join(audit), "repaired_sha256": state.hexdigest(), "_size": sum(map(len, audit))}

        for row in stream:
            if not started or row["conv"] != conv:
                if started:
                    yield done()
                conv, audit, state, any_turns, started = row["conv"], [], hashlib.sha256(), False, True
            audit.append(row["audit"])
            if row["some"]:
                state.update(("\n" if any_turns else "").encode() + row["body"].encode())
                any_turns = True
        if started:
            yield done()

    single = pieces.filter("whole").select("conv", "audit", F.sha2("body", 256).alias("repaired_sha256"))
    several = pieces.filter(~F.col("whole")).drop("whole")
    return single.unionAll(_mapped(_by_conversation(several, True), schema, joined))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with known faults, for trials: by crc32 of ``conv:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    said, by = F.coalesce(F.col(text), blank), F.coalesce(F.col(role), blank)
    said = F.when(fault == 1, "").when(fault == 2, F.translate(said, ".!?", "")).otherwise(said)
    rows = rows.select(
        F.col(conv), F.col(turn), F.when(fault == 4, "user").otherwise(by).alias(role), said.alias(text), fault.alias("_fault")
    ).filter("_fault != 0")
    return rows.select(conv, turn, role, text, F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def op_columns(rows: DataFrame, found: Repair) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id), with zeros and an empty digest where nothing was left to repair."""
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    ids = rows.select("conv_id").distinct()
    both = found.summary.withColumnRenamed("conv", "_a")
    texts = digests(found.parts).withColumnRenamed("conv", "_b")
    done = ids.join(both, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_b")), "left")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    return done.select(
        "conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
