"""Conversation structure repair: the cheapest edits that give a legal order of roles, by rank-compressed dynamic programming.

A conversation is legal if the initials of its roles are (s?(ua)+)?. Edits, by their initials: Keep (0), Rerole to user or
assistant (2), Delete (3; required for blank and duplicate rows), Insert an empty user or assistant turn (2). A truncated row
that is not deleted adds 1. Of the cheapest edits those with the ASCII-least string of initials (the audit) are taken.

A layer of the programme is a row with the inserts before it, a macro edit. Its codes (I*[DKR]) are free of prefixes, so
strings of as many codes compare as their codes do, one by one. A layer therefore needs no strings, only each grammar state's
cost and the rank of its string among the layer's; the next layer compares (cost, rank, code). Costs are held relative to
the layer's least, and a state over SLACK above it is left out, as no state's future is more than 7 dearer than another's.
So there are few layers, each is made once a process, and a row costs one lookup; two bytes a row keep its parents.

Faults, the first of which counts: blank (whitespace alone), duplicate (role and text stand earlier in the conversation),
truncated (the last character but whitespace is none of .!?). Texts are compared by 128 bits of xxHash.

Plan: rows without their texts (conversation, turn, role, hashes, fault) go to their conversation's task, in order, and give
the audits; texts follow in the same order, led by their audit, and stream into the digest. The audit and the digest are
chains over a whole conversation, so one task reads each; it holds one row, and three bytes for each row, not the texts.

Order: by turn (nulls first), then role, then the text's hash; equal rows are neighbours. Defined results: a null role or text
is one space; a null conversation id is a conversation of its own; an id without rows has zeros, an empty audit and the
empty string's digest; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
CLASSES = "sua"
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. What an inserted or reroled turn leads to.
NEXT = (2, 2, 3, 2)
ROLE_AFTER = {2: "user", 3: "assistant"}
#: The inserts that end a conversation in each state.
TAILS = ("", "II", "I", "")
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
SLACK = 8
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table after the damage that the contract names, by the CRC-32 of `conv_id:turn`."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "utf-8")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    return rows.withColumns({name: F.xxhash64(F.lit(salt), "text") for name, salt in (("h1", 1), ("h2", 2))})


def _fault(text: Column, again: Column) -> Column:
    blank, cut = ~text.rlike("[^ \\t-\\r]"), ~text.rlike("[.!?][ \\t-\\r]*\\z")
    return F.when(blank, BLANK).when(again, DUPLICATE).when(cut, TRUNCATED).otherwise(0)


def _apply(state: int, code: str, role: int, fault: int) -> tuple[int, int] | None:
    """State and price after a macro edit on a row, or None if it isn't allowed."""
    price = 2 * (len(code) - 1)
    for _ in code[1:]:
        state = NEXT[state]
    if code[-1] == "D":
        return state, price + 3
    if fault in (BLANK, DUPLICATE):
        return None
    price += fault == TRUNCATED
    if code[-1] == "R":
        return NEXT[state], price + 2
    if CLASSES[role : role + 1] == "s":
        return (1, price) if state == 0 else None
    return (NEXT[state], price) if NEXT[state] == role + 1 and role < len(CLASSES) else None


class Layers:
    """The layers met so far. A layer has for each state (cost over the least, rank of its string) or None."""

    def __init__(self) -> None:
        self.known: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[int, tuple]] = []
        self.begin = self._name(((0, 0), None, None, None))

    def _name(self, layer: tuple) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.known)
            self.known.append(layer)
            self.steps.append({})
        return self.number[layer]

    def step(self, at: int, symbol: int) -> tuple:
        """(next layer, least cost added, parents: for each state the state before and the code)."""
        found = self.steps[at].get(symbol)
        if found is None:
            found = self.steps[at][symbol] = self._made(self.known[at], symbol >> 2, symbol & 3)
        return found

    def _made(self, layer: tuple, role: int, fault: int) -> tuple:
        best: dict[int, tuple] = {}
        for state, held in enumerate(layer):
            for number, code in enumerate(CODES):
                if held and (applied := _apply(state, code, role, fault)):
                    to, price = applied
                    best[to] = min(best.get(to, (float("inf"),)), (held[0] + price, held[1], number, state))
        least = min(best.values())[0]
        best = {to: b for to, b in best.items() if b[0] - least <= SLACK}
        rank = {string: i for i, string in enumerate(sorted({b[1:3] for b in best.values()}))}
        layer = tuple((best[s][0] - least, rank[best[s][1:3]]) if s in best else None for s in range(len(NEXT)))
        return self._name(layer), least, tuple((best[s][3], CODES[best[s][2]]) if s in best else None for s in range(len(NEXT)))

    def solve(self, symbols: bytearray) -> tuple[int, str]:
        """Cost and audit. symbols: 4 * class of the role + fault, a byte a row."""
        at, cost, path = self.begin, 0, array("H" if len(self.known) < 60_000 else "L")
        for symbol in symbols:
            path.append(at)
            at, added, _ = self.step(at, symbol)
            cost += added
        added, _, state = min((held[0] + 2 * len(TAILS[s]), held[1], s) for s, held in enumerate(self.known[at]) if held)
        codes = [TAILS[state]]
        for layer, symbol in zip(reversed(path), reversed(symbols)):
            state, code = self.step(layer, symbol)[2][state]
            codes.append(code)
        return cost + added, "".join(reversed(codes))


class _Conversation:
    """The figures of one conversation, row by row."""

    def __init__(self) -> None:
        self.symbols, self.faults, self.illegal = bytearray(), [0] * 4, 0
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, symbol: int) -> None:
        if self.symbols and (self.symbols[-1] >> 2, symbol >> 2) not in LEGAL_PAIRS:
            self.illegal += 1
        self.symbols.append(symbol)
        self.faults[symbol & 3] += 1
        if turn is not None and turn != self.last:  # sorted, so equal turns are neighbours
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def result(self, layers: Layers) -> tuple[list[int], str]:
        cost, audit = layers.solve(self.symbols)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return [gaps, *self.faults[1:], self.illegal, cost], audit


def _solver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layers, conv, held = Layers(), None, None
    for batch in batches:
        out: list[tuple] = []
        for name, turn, symbol in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held is None or name != conv:
                if held is not None:
                    out.append((conv, *held.result(layers)))
                conv, held = name, _Conversation()
            if symbol is not None:  # null: the row only names its conversation
                held.add(turn, symbol)
        kind = batch.schema.field(0).type
        if out:
            yield _solved(out, kind)
    if held is not None:
        yield _solved([(conv, *held.result(layers))], kind)


def _solved(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, stats, audit = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(stats, pa.list_(pa.int64())), pa.array(audit, pa.string())], ["conv", "stats", "audit"])


def audits(turns: DataFrame, conv_ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, stats (as STATS) and audit of each conversation. conv_ids: ids that are in the result even without rows."""
    rows = _ordered(turns, conv_col, turn_col, role_col, text_col)
    role = sum((F.when(F.substring("role", 1, 1) == c, i - len(CLASSES)).otherwise(0) for i, c in enumerate(CLASSES)), F.lit(len(CLASSES)))
    # All that depends on the text is made before the exchange, which texts don't pass.
    fault = _fault(F.col("text"), F.lit(False))
    rows = rows.select("conv", "turn", "role", "h1", "h2", (role * 4 + fault).cast("int").alias("symbol"))
    if conv_ids is not None:
        rows = rows.unionByName(conv_ids.select(F.col(conv_col).alias("conv")).distinct(), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("conv", "role", "h1", "h2").orderBy("turn"))
    again = F.coalesce((place > 1) & (F.col("symbol") % 4 != BLANK), F.lit(False))
    rows = rows.repartition("conv").withColumn("again", again)  # the window needs no exchange of its own
    rows = rows.withColumn("symbol", F.when(F.col("again"), F.floor(F.col("symbol") / 4) * 4 + DUPLICATE).otherwise(F.col("symbol")).cast("int"))
    rows = rows.sortWithinPartitions("conv", "turn", "role", "h1", "h2", "again").select("conv", "turn", "symbol")
    return rows.mapInArrow(_solver, f"conv {rows.schema['conv'].dataType.simpleString()}, stats array<long>, audit string")


class _Repaired:
    """The digest of a repaired conversation whose rows come one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0
        self.digest, self.any = hashlib.sha256(), False

    def _put(self, role: bytes, text: bytes) -> None:
        self.digest.update(b"\n" * self.any + role + b":")
        self.digest.update(text)
        self.any = True

    def _made(self, text: bytes = b"") -> None:
        self.state = NEXT[self.state]
        self._put(ROLE_AFTER[self.state].encode(), text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._made()
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._made(text)
        elif edit == "K":
            self.state = 1 if role[:1] == b"s" else NEXT[self.state]
            self._put(role, text)


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        out: list[tuple] = []
        conv, stats = (batch.column(i).to_pylist() for i in range(2))
        role, text = (batch.column(i).cast(pa.binary()) for i in (2, 3))
        for i, figures in enumerate(stats):
            if figures is not None:  # the audit leads its conversation's rows
                if held:
                    out.append(_finished(*held))
                held = conv[i], figures, _Repaired(text[i].as_py().decode())
            else:
                held[2].row(role[i].as_py(), text[i].as_py())
        kind = batch.schema.field(0).type
        if out:
            yield _digested(out, kind)
    if held:
        yield _digested([_finished(*held)], kind)


def _finished(conv: object, figures: list[int], repaired: _Repaired) -> tuple:
    repaired.inserts()
    return conv, *figures, repaired.audit, repaired.digest.hexdigest()


def _digested(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, *figures, audit, digest = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, kind), *(pa.array(x, pa.int64()) for x in figures), pa.array(audit, pa.string()), pa.array(digest, pa.string())],
        ["conv_id", *STATS, "audit", "repaired_sha256"],
    )


def repair(turns: DataFrame, conv_ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    names = conv_col, turn_col, role_col, text_col
    heads = audits(turns, conv_ids, *names).withColumnRenamed("audit", "text")
    rows = _ordered(turns, *names).unionByName(heads, allowMissingColumns=True)
    rows = rows.repartition("conv").sortWithinPartitions("conv", F.col("stats").isNull(), "turn", "role", "h1", "h2").select("conv", "stats", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(_digester, f"conv_id {kind}, {', '.join(f'{s} long' for s in STATS)}, audit string, repaired_sha256 string")
