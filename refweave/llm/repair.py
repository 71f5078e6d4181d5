"""Repair of conversation structure: cheapest edits that give ``system? (user assistant)+``, or nothing.

Weighted CYK interval parsing.  A span of rows derives the edits that lead an automaton of the role
order from one state to another, so the non-terminals of the repair grammar are pairs of states; in
Chomsky normal form they are ``(p, q) -> (p, r) (r, q)``, and ``(p, q) -> row`` for one edited
row with its closure under insertions on both sides.  A cell holds the minimum of (cost, audit) per
non-terminal of its span, the audit being the edits' initials.  Because such a pair says all there is to know
about what lies between, every split of a span gives the same cell; so each span is split once, and
the chart has spans of 1, 2, 4, ... rows, combined bottom-up: first within blocks of ``1 << BLOCK_BITS``
rows, then blocks of a conversation by one shuffle per power of that.  No conversation has to fit into a task: its
audit, one value of the result, is the largest thing held, eleven times.

Equal costs compare by audit.  An audit that begins another one of the same span has fewer insertions and so
costs less; hence the minimum of a whole consists of minima of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from refweave.llm.common import bounded_batches, written
from refweave.operators.joins import join_unique

BLOCK_BITS = 10
_PIECE = 1 << 20  # bytes of repaired text in one row, about
# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = "\t\n\x0b\x0c\r "

# States: nothing yet, after the system's turn, after the user's, after the assistant's; the first and last may end.
_STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
_PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {pair: n for n, pair in enumerate(_PAIRS)}
_RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in _PAIRS]

Cells = tuple  # (cost, audit) or None, in the order of _PAIRS


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def product(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out = []
    for rule in _RULES:
        best = None
        for i, j in rule:
            a, b = left[i], right[j]
            if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                best = _least(best, (a[0] + b[0], a[1] + b[1]))
        out.append(best)
    return tuple(out)


def _inserted() -> Cells:
    """Cells of an empty span: closure of the insertions."""
    cells = {(p, p): (0, "") for p in range(4)}
    cells |= {step: (INSERT, "I") for role in "ua" for step in _STEPS[role]}
    cells = tuple(cells.get(pair) for pair in _PAIRS)
    while (more := product(cells, cells)) != cells:
        cells = more
    return cells


_NONE = _inserted()


def _row_cells(kind: str) -> Cells:
    """Cells of one row.  Its ``kind``: ``x`` if it has to go, else its role's initial, in upper case if it is truncated."""
    cells = {(p, p): (DELETE, "D") for p in range(4)}
    extra = TRUNCATED if kind.isupper() else 0
    if kind != "x":
        for role, steps in _STEPS.items():
            edit = (extra, "K") if role == kind.lower() else None if role == "s" else (REROLE + extra, "R")
            for step in steps if edit else ():
                cells[step] = _least(cells.get(step), edit)
    return product(product(_NONE, tuple(cells.get(pair) for pair in _PAIRS)), _NONE)


_ROWS = {kind: _row_cells(kind) for kind in "xsuaoSUAO"}  # o: any other role


@lru_cache(1 << 14)
def _short(kinds: str) -> Cells:
    """Cells of a short span, remembered: most conversations look alike."""
    return spans([_ROWS[k] for k in kinds])


def spans(cells: list[Cells]) -> Cells:
    """Combine neighbouring spans until one is left."""
    while len(cells) > 1:
        pairs = [product(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return cells[0]


def parse(kinds: str) -> Cells:
    """Cells of a block of rows."""
    return spans([_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(c for c in (cells[_AT[0, 0]], cells[_AT[0, 3]]) if c is not None)


# -- rows ---------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Damage a fifth of ``rows(conv_id, turn, role, text)`` in five ways; null texts and roles are read as a space.

    By the CRC-32 of ``conv_id:turn`` modulo 20 (a null in it is a space): 0 drops the row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it
    the user's.  Other columns go.
    """

    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted over the cluster and numbered: ``at`` ascends within and across conversations.

    By turn (null first); of one turn by role, then by a hash of the text.
    """
    # What equal rows are told apart by: without it they could not be spread.
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_hash"), F.col("_tie")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_hash", "_tie")
    return written(placed.withColumn("at", F.monotonically_increasing_id()), "turns")


def _flagged(placed: DataFrame) -> DataFrame:
    """``(conv_id, at, turn, initial, fault)`` of every row; its first fault is ``b``, ``d``, ``t`` or none."""
    bare = F.rtrim("text", F.lit(_SPACE))
    narrow = placed.select(
        "conv_id", "at", F.col("turn").cast("bigint").alias("turn"), "role", F.sha2("text", 256).alias("digest"),
        F.substring("role", 1, 1).alias("initial"), (F.length(bare) == 0).alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    # Conversations without an id are one conversation.
    narrow = narrow.withColumn("conv", F.to_json(F.struct("conv_id")))
    first = narrow.where("not blank").groupBy("conv", "role", "digest").agg(F.min("at").alias("first"))
    found = join_unique(narrow, first, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("truncated"), "t").otherwise("")
    return found.select("conv_id", "at", "turn", "initial", fault.alias("fault"))


# -- spans over the cluster ---------------------------------------------------------------

_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
_CELL = "array<struct<cost:bigint,audit:string>>"
_SPAN = ", ".join(f"{c} bigint" for c in _COUNTS) + f", first string, last string, first_turn bigint, last_turn bigint, cells {_CELL}"
_LEGAL = {"su", "ua", "au"}


def _span_schema(conv: pa.Field) -> pa.Schema:
    cell = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema(
        [conv, ("at", pa.int64())] + [(c, pa.int64()) for c in _COUNTS]
        + [("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("cells", pa.list_(cell))]
    )


def _seam(a_last, b_first, a_turn, b_turn) -> tuple[int, int]:
    """Illegal neighbours, and turns counted twice, where two spans meet."""
    return int(a_last + b_first not in _LEGAL), int(a_turn is not None and a_turn == b_turn)


def _parsed(batches: Iterator[pa.RecordBatch], conv: pa.Field) -> Iterator[pa.RecordBatch]:
    """One span per conversation and block of rows that come in order."""
    schema = _span_schema(conv)

    def close(key, rows):
        kinds, illegal, turns = [], 0, 0
        before, turn_before = None, None
        for initial, turn, fault in rows:
            kind = initial if initial in ("s", "u", "a") else "o"
            kinds.append("x" if fault in ("b", "d") else kind.upper() if fault == "t" else kind)
            illegal += before is not None and before + initial not in _LEGAL
            turns += turn is not None and turn != turn_before
            before, turn_before = initial, turn
        faults = [fault for _, _, fault in rows]
        numbered = [turn for _, turn, _ in rows if turn is not None]
        cells = [None if c is None else {"cost": c[0], "audit": c[1]} for c in parse("".join(kinds))]
        return (
            key[0], key[2], len(rows), faults.count("b"), faults.count("d"), faults.count("t"), illegal, turns,
            rows[0][0], rows[-1][0], numbered[0] if numbered else None, numbered[-1] if numbered else None, cells,
        )

    at, first, rows = None, None, []
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "at", "initial", "turn", "fault"))
        for conv_id, place, initial, turn, fault in zip(*columns, strict=True):
            if (conv_id, place >> BLOCK_BITS) != at:
                if at is not None:
                    out.append(close((*at, first), rows))
                at, first, rows = (conv_id, place >> BLOCK_BITS), place, []
            rows.append((initial, turn, fault))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, close((*at, first), rows), strict=True))], schema=schema)


def _combined(batches: Iterator[pa.RecordBatch], conv: pa.Field, shift: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring spans of a conversation whose places agree above ``shift`` bits, as one."""
    schema = _span_schema(conv)

    def close(parts):
        out = dict(parts[0])
        for part in parts[1:]:
            illegal, twice = _seam(out["last"], part["first"], out["last_turn"], part["first_turn"])
            for c in _COUNTS:
                out[c] += part[c]
            out["illegal"] += illegal
            out["turns"] -= twice
            out["last"] = part["last"]
            if out["first_turn"] is None:
                out["first_turn"] = part["first_turn"]
            if part["last_turn"] is not None:
                out["last_turn"] = part["last_turn"]
        cells = spans([tuple(None if c is None else (c["cost"], c["audit"]) for c in p["cells"]) for p in parts])
        return out | {"cells": [None if c is None else {"cost": c[0], "audit": c[1]} for c in cells]}

    at, parts = None, []
    for batch in batches:
        out = []
        for span in batch.to_pylist():
            now = (span["conv_id"], span["at"] >> shift)
            if now != at:
                if parts:
                    out.append(close(parts))
                at, parts = now, []
            parts.append(span)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if parts:
        yield pa.RecordBatch.from_pylist([close(parts)], schema=schema)


def _roots(blocks: DataFrame, conv: pa.Field, ddl: str) -> DataFrame:
    """One span per conversation."""
    found, shift = blocks, BLOCK_BITS
    while not found.groupBy("conv_id").count().where("count > 1").isEmpty():
        shift = min(shift + BLOCK_BITS, 63)
        dealt = found.repartition("conv_id", F.shiftright("at", shift)).sortWithinPartitions("conv_id", "at")
        found = written(dealt.mapInArrow(partial(_combined, conv=conv, shift=shift), ddl), "spans")
    return found


# -- the repaired text --------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch], conv: pa.Field) -> Iterator[pa.RecordBatch]:
    """The part of its conversation's audit for each block: the audit comes first, then the blocks in order."""
    schema = pa.schema([conv, ("block", pa.int64()), ("edits", pa.string()), ("before", pa.int64()), ("system", pa.bool_()), ("alone", pa.bool_())])
    audit, done, kept, system, left, alone = "", 0, 0, False, 0, False
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "at", "n", "audit"))
        for conv_id, at, n, whole in zip(*columns, strict=True):
            if whole is not None:
                audit, done, kept, left = whole, 0, 0, n
                system, alone = (len(audit) - audit.count("D")) % 2 == 1, None
                continue
            alone = n == left if alone is None else False
            end, rows = done, 0
            left -= n
            while rows < n or (left == 0 and end < len(audit)):
                rows += audit[end] != "I"
                end += 1
            out.append((conv_id, at >> BLOCK_BITS, audit[done:end], kept, system, alone))
            kept += end - done - audit.count("D", done, end)
            done = end
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)


def _written_out(batches: Iterator[pa.RecordBatch], conv: pa.Field) -> Iterator[pa.RecordBatch]:
    """Pieces of repaired text, or its digest where a conversation has one block.

    The edits of a block come first, then its rows in order.
    """
    schema = pa.schema([conv, ("at", pa.int64()), ("piece", pa.binary()), ("digest", pa.string())])

    class Block:
        def __init__(self, conv_id, edits, before, system, alone):
            self.conv_id, self.edits, self.done, self.count, self.system = conv_id, edits, 0, before, system
            self.digest, self.piece, self.at = hashlib.sha256() if alone else None, bytearray(), None

        def role(self):
            return "assistant" if (self.count + self.system) % 2 else "user"

        def line(self, role, text):
            self.piece += (b"\n" if self.count else b"") + role.encode() + b":" + text.encode()
            self.count += 1

        def row(self, at, role, text):
            self.at = at
            self.inserts()
            edit = self.edits[self.done]
            self.done += 1
            if edit != "D":
                self.line(role if edit == "K" else self.role(), text)

        def inserts(self):
            while self.edits[self.done : self.done + 1] == "I":
                self.line(self.role(), "")
                self.done += 1

        def flush(self, out, least):
            if len(self.piece) > least:
                if self.digest:
                    self.digest.update(self.piece)
                else:
                    out.append((self.conv_id, self.at, bytes(self.piece), None))
                self.piece = bytearray()

        def close(self, out):
            self.inserts()
            self.flush(out, 0)
            if self.digest:
                out.append((self.conv_id, None, None, self.digest.hexdigest()))

    block = None
    for batch in batches:
        out = []
        names = ("conv_id", "at", "edits", "before", "system", "alone", "role", "text")
        for conv_id, at, edits, before, system, alone, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if edits is not None:
                if block:
                    block.close(out)
                block = Block(conv_id, edits, before, system, alone)
            else:
                block.row(at, role, text)
                block.flush(out, _PIECE)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
    if block:
        out = []
        block.close(out)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)


def _digested(batches: Iterator[pa.RecordBatch], conv: pa.Field) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each conversation, which come in order; one piece is held at a time."""
    schema = pa.schema([conv, ("digest", pa.string())])
    started, at, digest = False, None, None
    for batch in batches:
        out = []
        for conv_id, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece"), strict=True):
            if not started or conv_id != at:
                if started:
                    out.append({"conv_id": at, "digest": digest.hexdigest()})
                started, at, digest = True, conv_id, hashlib.sha256()
            digest.update(piece.as_buffer())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if started:
        yield pa.RecordBatch.from_pylist([{"conv_id": at, "digest": digest.hexdigest()}], schema=schema)


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each of ``conversations(conv_id)``, from ``rows(conv_id, turn, role, text)``.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.  Rows go by turn (null
    first), of one turn by role and then by a hash of the text; of equal rows the first is no duplicate.  Role
    initials are case-sensitive; null roles and texts count as one space.  A null ``conv_id`` is a conversation of its own; one without rows has zeros, an
    empty audit and the digest of nothing.  Empty tables give no rows.  ``gaps`` ends at the largest bigint.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema["conv_id"].dataType
    conv, id_ddl = pa.field("conv_id", to_arrow_type(kind)), f"conv_id {kind.simpleString()}"
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    placed = _in_order(rows)
    block = F.shiftright("at", BLOCK_BITS)
    dealt = _flagged(placed).repartition("conv_id", block).sortWithinPartitions("conv_id", "at")
    ddl = f"{id_ddl}, at bigint, {_SPAN}"
    blocks = written(dealt.mapInArrow(partial(_parsed, conv=conv), ddl), "blocks")

    ends = F.filter(
        F.array(F.col("cells")[_AT[0, 0]], F.col("cells")[_AT[0, 3]]), lambda c: c.isNotNull()
    )
    found = _roots(blocks, conv, ddl).withColumn("best", F.array_min(ends)).withColumns(
        {"cost": F.col("best.cost"), "audit": F.col("best.audit")}
    ).drop("cells", "best")

    # Down again: each block's part of the audit, then each row's edit.
    parts = found.select("conv_id", F.lit(None).cast("bigint").alias("at"), "n", "audit").unionByName(
        blocks.select("conv_id", "at", "n", F.lit(None).cast("string").alias("audit"))
    )
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").asc_nulls_first())
    cuts = parts.mapInArrow(partial(_cut, conv=conv), f"{id_ddl}, block bigint, edits string, before bigint, system boolean, alone boolean")
    stream = cuts.select("conv_id", "block", F.lit(None).cast("bigint").alias("at"), "edits", "before", "system", "alone").unionByName(
        placed.select("conv_id", block.alias("block"), "at", "role", "text"), allowMissingColumns=True
    )
    stream = stream.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("at").asc_nulls_first())
    pieces = written(stream.mapInArrow(partial(_written_out, conv=conv), f"{id_ddl}, at bigint, piece binary, digest string"), "pieces")
    long = pieces.where("piece is not null").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    digests = pieces.where("digest is not null").select("conv_id", "digest").unionByName(
        long.mapInArrow(partial(_digested, conv=conv), f"{id_ddl}, digest string")
    )

    def named(df: DataFrame) -> DataFrame:  # a null id has a name as well
        return df.withColumn("conv", F.to_json(F.struct("conv_id")))

    all_ids = named(conversations.select("conv_id").distinct())
    out = all_ids.join(named(found).drop("conv_id"), "conv", "left").join(named(digests).drop("conv_id"), "conv", "left")

    def count(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)

    reach = F.col("last_turn").cast("decimal(20,0)") - F.col("first_turn") + 1 - F.col("turns")
    return out.select(
        "conv_id", F.when(reach.isNull(), 0).otherwise(F.least(reach, F.lit(2**63 - 1))).cast("bigint").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"), count("illegal"), count("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
