"""Passages that stand in the corpus before: every string of ``WINDOW`` bytes but its first occurrence.

Equal strings have to meet without sending all of them.  Of the ``GRAM``-byte grams of a window the one with the least
hash is its anchor, which depends on the window alone; neighbouring windows mostly share it and form a site.
So sites (one for some 32 bytes) are dealt by anchor, with a hash of their context, the bytes of all their
windows.  Of sites with one context, all but the first repeat as a whole: of those in one batch only the first is dealt on.
An anchor with a single context is done.  What is left are the edges of repeated passages: there the contexts of an
anchor are compared by a suffix array (see ``suffixes``), in which windows that are equal are neighbours, and all but the
first of them repeat.  Anchors with more than ``MOST`` contexts are first dealt anew by larger pieces of them, last by whole
windows, so that no group grows with the input and no window is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from refweave.llm.common import bounded_batches, text_of, tidy, written
from refweave.llm.suffixes import suffix_arrays
from refweave.operators.joins import join_unique

WINDOW, GRAM = 100, 32
MOST = 32  # contexts of an anchor that are compared at once
_OFFSETS = WINDOW - GRAM + 1  # places of the anchor in a window
_FINER = (12, 1)  # windows to a piece, where an anchor has too many contexts
_CHUNK = 1 << 16  # windows hashed at a time, about
_POOL = 2 << 20  # bytes whose suffixes are sorted at a time, about
_INDEX = np.uint64((1 << 18) - 1)
_CODES = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)
_FACTORS = np.random.default_rng(14).integers(0, 2**64, 8, np.uint64) | np.uint64(1)
_PLACE = "d bigint, t bigint, first int, last int"


def _mixed(a: np.ndarray, b: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = a * factor
    h += b
    h ^= h >> np.uint64(29)
    return h


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from each place on."""
    h = _CODES[data]
    for k in range(5):
        h = _mixed(h[: -(1 << k)], h[1 << k :], _FACTORS[k])
    return h, _mixed(h[:-32], h[32:], _FACTORS[5])


def _least(key: np.ndarray) -> np.ndarray:
    """Minimum of ``_OFFSETS`` neighbours from each place on."""
    width = 1
    while width * 2 <= _OFFSETS:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = _OFFSETS - width
    return np.minimum(key[: len(key) - rest], key[rest:])


def _sites_of(data: bytes, starts: np.ndarray, windows: np.ndarray):
    """Sites of parts of texts that lie one after the other: their part, first and last window in it, anchor and context.

    Part ``i`` has ``windows[i]`` windows from ``starts[i]`` on.
    """
    h32, h64 = _grams(np.frombuffer(data, np.uint8))
    index = np.arange(len(h32), dtype=np.uint64)
    least = (_least(h32 & ~_INDEX | index) & _INDEX).astype(np.int64)
    part = np.repeat(np.arange(len(starts)), windows)
    at = np.arange(len(part)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    anchor = least[at]
    begin = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
    until = np.append(begin[1:], len(part)) - 1
    first, last, anchor, part = at[begin], at[until], anchor[begin], part[begin]
    end = last + WINDOW
    # Three overlapping stretches of 64 bytes cover every context.
    context = _mixed(_mixed(h64[first], h64[(first + end - 64) // 2], _FACTORS[6]), h64[end - 64], _FACTORS[7])
    context += (end - first).astype(np.uint64)
    lead = anchor - first
    return part, first - starts[part], last - starts[part], lead, h32[anchor].view(np.int64), context.view(np.int64)


_SITE = pa.schema([
    ("anchor", pa.int64()), ("context", pa.int64()), ("d", pa.int64()), ("t", pa.int64()),
    ("first", pa.int32()), ("last", pa.int32()), ("lead", pa.int16()),
])


@tidy
def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sites of ``(d, t, text)``.  Of equal sites in a batch the first stays; the others are ranges that repeat, without ``lead``."""
    for batch in batches:
        d, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "t"))
        parts, found, size = [], [], 0

        def flush():
            nonlocal parts, size
            row, offset, data = zip(*parts, strict=True)
            lengths = np.array([len(x) for x in data])
            part, first, last, *rest = _sites_of(b"".join(data), np.cumsum(lengths) - lengths, lengths - WINDOW + 1)
            offset = np.array(offset)[part]
            found.append((np.array(row)[part], first + offset, last + offset, *rest))
            parts, size = [], 0

        for row, text in enumerate(batch.column("text")):
            view = memoryview(text.as_buffer())
            for offset in range(0, len(view) - WINDOW + 1, _CHUNK):
                part = view[offset : offset + _CHUNK + WINDOW - 1]
                parts.append((row, offset, part))
                size += len(part)
                if size >= _CHUNK:
                    flush()
        if parts:
            flush()
        if not found:
            continue
        row, first, last, lead, anchor, context = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = {"anchor": anchor, "context": context, "d": d[row], "t": t[row], "first": first, "last": last, "lead": lead}
        order = np.lexsort((first, columns["t"], columns["d"], context, anchor))
        columns = {c: x[order] for c, x in columns.items()}
        again = _again(columns)
        # Repeated ranges that touch are one.  They are dealt by document.
        copies = {c: columns[c][again] for c in ("d", "t", "first", "last")}
        yield _batch({c: x[_changes(columns, ("anchor", "context"))] for c, x in columns.items()})
        if again.any():
            merged = _merged(copies)
            none = np.zeros(len(merged["d"]), np.int64)
            spread = (merged["d"].view(np.uint64) * _FACTORS[0]).view(np.int64) ^ merged["first"]
            yield _batch({"anchor": spread, "context": none, **merged, "lead": none - 1})


def _batch(columns: dict[str, np.ndarray], schema: pa.Schema = _SITE) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _changes(columns: dict[str, np.ndarray], names) -> np.ndarray:
    """Which rows differ from the one before in any of the columns; the first does."""
    out = np.zeros(len(columns["d"]), bool)
    out[:1] = True
    for name in names:
        out[1:] |= columns[name][1:] != columns[name][:-1]
    return out


def _again(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Which sites in order have the context of an earlier one; a row listed twice is no earlier one."""
    new = _changes(columns, ("anchor", "context"))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = np.ones(len(new), bool)
    for name in ("d", "t", "first"):
        same &= columns[name] == columns[name][first]
    return ~same


def _merged(ranges: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ranges of windows, sorted, those that touch joined."""
    order = np.lexsort((ranges["first"], ranges["t"], ranges["d"]))
    d, t, first, last = (ranges[c][order] for c in ("d", "t", "first", "last"))
    begin = np.ones(len(d), bool)
    begin[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (first[1:] > last[:-1] + 1)
    starts = np.flatnonzero(begin)
    return {"d": d[starts], "t": t[starts], "first": first[starts], "last": last[np.append(starts[1:], len(d)) - 1]}


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sites in the order of anchor, context and place: what repeats, and the first of each context if its anchor has several.

    Adds ``again``.  Other columns go along.  One site is carried from batch to batch.
    """
    carried = None  # the first site of the last context
    several = False  # whether its anchor has had another one

    def out(table, again):
        return table.append_column("again", pa.array(again, pa.bool_()))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        n_carried = 0
        if carried is not None:
            rows, n_carried = pa.concat_tables([carried, rows]), 1
        columns = {c: rows.column(c).to_numpy() for c in ("anchor", "context", "d", "t", "first", "lead")}
        dealt = columns["lead"] < 0  # found to repeat before
        new_anchor = _changes(columns, ("anchor",))
        again = _again(columns) | dealt
        fresh = _changes(columns, ("anchor", "context")) & ~dealt
        at = np.flatnonzero(fresh)
        leader = new_anchor[at]  # the first context of its anchor
        if n_carried and len(at):
            leader[0] = not several
        follows = np.append(~leader[1:], False)  # the next context has the same anchor
        # Contexts of a run count as several if the one before or the one after is of the run.
        multiple = ~leader | follows
        keep = np.zeros(len(fresh), bool)
        keep[at[:-1]] = multiple[:-1]
        if len(at):
            carried, several = rows.slice(int(at[-1]), 1), bool(~leader[-1])
        table = rows.filter(pa.array(keep | again))
        yield from out(table, again[keep | again]).combine_chunks().to_batches()
    if carried is not None and several:
        yield from out(carried, [False]).combine_chunks().to_batches()


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that are asked for, out of their texts."""
    schema = pa.schema([*_SITE, ("text", pa.binary())])
    for batch in batches:
        texts, rows = batch.column("text"), []
        for i, (d, t, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "t", "asked")), strict=True)):
            text = memoryview(texts[i].as_buffer())
            rows += [
                (x["anchor"], x["context"], d, t, x["first"], x["last"], x["lead"], bytes(text[x["first"] : x["last"] + WINDOW])) for x in asked
            ]
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows at ``a`` and ``b`` are equal."""
    windows, out = np.lib.stride_tricks.sliding_window_view(text, WINDOW), np.empty(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        part = slice(i, i + (1 << 14))
        out[part] = (windows[a[part]] == windows[b[part]]).all(axis=1)
    return out


def _repeated(groups: list[list[tuple]]) -> list[tuple]:
    """Ranges ``(d, t, first, last)`` of the windows in groups of contexts ``(d, t, first, text)`` that stand in their group before."""
    groups.sort(key=lambda g: sum(len(c[3]) for c in g))
    contexts = [c for g in groups for c in g]
    lengths = np.array([len(c[3]) for c in contexts])
    # A context ends with a 1, the last of its group with a 0 besides; the characters are 2 and up.
    sizes = np.cumsum([len(g) for g in groups])
    gaps = np.ones(len(contexts), np.int64)
    gaps[sizes - 1] = 2
    ends = np.cumsum(lengths + gaps)
    begins = ends - lengths - gaps
    codes = np.ones(ends[-1], np.int64)
    inside = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    codes[inside] = np.frombuffer(b"".join(c[3] for c in contexts), np.uint8).astype(np.int64) + 2
    codes[ends[sizes - 1] - 1] = 0
    order = suffix_arrays(codes, ends[sizes - 1])
    whole = np.zeros(len(codes), bool)  # where a window fits into its context
    windows = lengths - WINDOW + 1
    whole[np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())] = True
    order = order[whole[order]]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[np.searchsorted(ends, order, "right")]
    joined = _equal(codes.astype(np.uint16), order[:-1], order[1:]) & (group[1:] == group[:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~joined)))
    # Contexts are in the order of their places, so the least place of equal windows is the first.
    least = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(order))))
    again = np.sort(order[order != least])
    if not len(again):
        return []
    context = np.searchsorted(ends, again, "right")
    runs = np.flatnonzero(np.concatenate(([True], (again[1:] != again[:-1] + 1) | (context[1:] != context[:-1]))))
    until = np.append(runs[1:], len(again)) - 1
    out = []
    for i, a, b in zip(context[runs].tolist(), again[runs].tolist(), again[until].tolist(), strict=True):
        d, t, first, _ = contexts[i]
        out.append((d, t, first + a - int(begins[i]), first + b - int(begins[i])))
    return out


@tidy
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of contexts that come by anchor, and then by place."""
    schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def found(groups):
        columns = list(zip(*_repeated([g for g in groups if len(g) > 1]), strict=True)) if any(len(g) > 1 for g in groups) else []
        columns = columns or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    at, groups, size = None, [], 0
    for batch in batches:
        names = ("anchor", "d", "t", "first", "text")
        for anchor, *context in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if anchor != at or not groups:
                if size >= _POOL:
                    yield found(groups)
                    groups, size = [], 0
                at = anchor
                groups.append([])
            if not groups[-1] or groups[-1][-1][:3] != tuple(context[:3]):  # a row listed twice counts once
                groups[-1].append(tuple(context))
                size += len(context[3])
    if groups:
        yield found(groups)


def _pieces(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts cut into pieces of at most ``width`` windows that share a larger stretch, and dealt by it."""
    low = F.col("lead") - (F.col("last") - F.col("first"))  # least offset of the anchor in a window
    cells = F.sequence((low / width).cast("int"), (F.col("lead") / width).cast("int"))
    rows = contexts.withColumn("low", low).withColumn("cell", F.explode(cells)).withColumns({
        "high_r": F.least(F.col("lead"), (F.col("cell") + 1) * width - 1), "low_r": F.greatest("low", F.col("cell") * width),
    })
    # What all windows of a cell hold: from the begin of its last window to the end of its first one.
    core = F.substring("text", F.col("lead") - F.col("cell") * width + 1, F.lit(WINDOW - width + 1))
    skip = F.col("lead") - F.col("high_r")
    piece = F.substring("text", skip + 1, F.col("high_r") - F.col("low_r") + WINDOW)
    rows = rows.withColumns({
        "key": F.xxhash64("anchor", "cell", core), "piece": piece, "begin": (F.col("first") + skip).cast("int"),
        "until": (F.col("first") + F.col("lead") - F.col("low_r")).cast("int"),
    })
    return rows.select(
        F.col("key").alias("anchor"), F.xxhash64("piece", "high_r").alias("context"), "d", "t", F.col("begin").alias("first"),
        F.col("until").alias("last"), F.col("high_r").cast("short").alias("lead"), F.col("piece").alias("text"),
    )


_COLUMNS = "anchor bigint, context bigint, d bigint, t bigint, first int, last int, lead smallint"


def _grouped_sites(sites: DataFrame, columns: str) -> DataFrame:
    dealt = sites.repartition("anchor").sortWithinPartitions("anchor", "context", "d", "t", "first")
    return written(dealt.mapInArrow(_grouped, f"{columns}, again boolean"), "sites")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """Ranges of windows of ``texts(d, t, text)`` that stand earlier, in the order of ``(d, t)`` and within a text.

    ``(d, t, first, last)``: where the first and the last window of a range begin.  ``(d, t)`` is unique, ``text`` binary.
    """
    bounded_batches(texts.sparkSession)
    place = ["d", "t", "first", "last"]
    found = _grouped_sites(texts.mapInArrow(_sites, _COLUMNS), _COLUMNS)
    out = found.where("again").select(place)
    site = F.struct("anchor", "context", "first", "last", "lead")
    asked = found.where("not again").groupBy("d", "t").agg(F.collect_list(site).alias("asked"))
    with_text = f"{_COLUMNS}, text binary"
    contexts = join_unique(texts, asked, ["d", "t"]).select("d", "t", "text", "asked").mapInArrow(_fetched, with_text)
    contexts = written(contexts, "contexts")

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select("anchor", "d", "t", "first", "text")
        return rows.repartition("anchor").sortWithinPartitions("anchor", "d", "t", "first").mapInArrow(_compared, _PLACE)

    for width in _FINER:
        many = contexts.groupBy("anchor").count().where(F.col("count") > MOST).select("anchor")
        out = out.unionByName(compared(contexts.join(many, "anchor", "left_anti")))
        pieces = _pieces(contexts.join(many, "anchor", "left_semi"), width)
        found = _grouped_sites(pieces, with_text)
        out = out.unionByName(found.where("again").select(place))
        contexts = found.where("not again")
    return out.unionByName(compared(contexts))  # none, unless hashes of whole windows collide


def _kept(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes of its repeated windows."""
    for batch in batches:
        out, texts = [], batch.column("text")
        for i, (key, ranges) in enumerate(zip(batch.column("key").to_pylist(), batch.column("ranges").to_pylist(), strict=True)):
            text = memoryview(texts[i].as_buffer())
            digest, at, spans, removed, begin = hashlib.sha256(), 0, 0, 0, None
            for first, last in sorted((x["first"], x["last"]) for x in ranges or ()):
                if begin is None or first > at:
                    digest.update(text[at:first])
                    spans, begin = spans + 1, first
                    at = first
                end = last + WINDOW
                removed += max(0, end - at)
                at = max(at, end)
            digest.update(text[at:])
            out.append((key, len(text), removed, spans, digest.hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def without_repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` of every document, its repeated bytes removed.

    A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document of smaller ``key`` (an integer),
    or before in the same one.  Null texts are empty; a null key comes last.  Rows that share a key are documents of their own, in the
    order of a hash of the text; those that share the text as well are one document, with the same result in each row.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    content = F.encode(text_of(text), "UTF-8")
    d = F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1))
    repeated = not docs.groupBy(d.alias("d")).count().where("count > 1").isEmpty()
    t = F.xxhash64(text_of(text)) if repeated else F.lit(0).cast("bigint")
    rows = docs.select(F.col(key).alias("key"), d.alias("d"), t.alias("t"), content.alias("text"))
    texts = rows.select("d", "t", "text")
    ranges = repeated_windows(texts.dropDuplicates(["d", "t"]) if repeated else texts)
    by_text = ranges.groupBy("d", "t").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    joined = join_unique(rows, by_text, ["d", "t"], "left").select("key", "text", "ranges")
    kind = docs.schema[key].dataType
    schema = pa.schema([
        ("key", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ])
    ddl = f"key {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(partial(_kept, schema=schema), ddl).withColumnRenamed("key", key)
