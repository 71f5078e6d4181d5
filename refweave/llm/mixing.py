"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the wanted number of copies of each of its
documents.  The whole part is taken at once.  The fractions are rounded dependently:
two documents transfer words of expectation to each other, in a random direction and
without changing the sum, until one of them is taken or left.  That is done along
bounded leaves of a source; the one undecided document of each leaf moves up a tree of
such groups, so the words of the whole source are off by part of one document only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from refweave.llm.common import WORD, text_of, written

LEAF = 8192  # documents of a group, about
_STATE = "source string, leaf bigint, key_ string, size bigint, p double, copies bigint"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint")


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """Words per source: ``share`` of all words by weight, at most ``limit`` times the source's size.

    What a source cannot take is shared by weight among the others until none is above.
    """
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        per_weight = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per_weight * weights[i] >= limit * sizes[i]}
        for i in full or open_:
            out[i] = min(limit * sizes[i], per_weight * weights[i])
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def pivot(sizes: list[int], p: list[float], draws: list[float]) -> tuple[list[float], int | None]:
    """Round the fractions ``p`` pair by pair; the sum of ``size * p`` stays.

    Returns the new fractions, all 0 or 1 but for one at most, and the place of that one.
    """
    p, held = list(p), None
    for i, (size, draw) in enumerate(zip(sizes, draws, strict=True)):
        if not 0 < p[i] < 1:
            continue
        if held is None:
            held = i
            continue
        a = min(sizes[held] * p[held], size * (1 - p[i]))  # words that can go from held to i
        b = min(size * p[i], sizes[held] * (1 - p[held]))  # and from i to held
        giver, taker, words = (held, i, a) if draw * (a + b) < b else (i, held, b)
        empties = words == sizes[giver] * p[giver]
        fills = words == sizes[taker] * (1 - p[taker])
        p[giver] = 0.0 if empties else p[giver] - words / sizes[giver]
        p[taker] = 1.0 if fills else p[taker] + words / sizes[taker]
        undecided = [x for x in (held, i) if 1e-12 < p[x] < 1 - 1e-12]
        for x in (held, i):
            if x not in undecided:
                p[x] = float(round(p[x]))
        held = undecided[0] if undecided else None
    return p, held


def _round(seed: int, level: int):
    def group(rows: pa.Table) -> pa.Table:
        frame = rows.to_pandas()
        # Largest first: what stays undecided at the end is then likely small.
        frame = frame.sort_values(["size", "key_"], ascending=[False, True], kind="stable", na_position="last")
        source, leaf = frame["source"].iloc[0], int(frame["leaf"].iloc[0])
        name = int.from_bytes((source or "").encode()[:64], "little") if source is not None else 1 << 600
        draws = np.random.default_rng([seed, level, leaf, name]).random(len(frame))
        p, held = pivot(frame["size"].tolist(), frame["p"].tolist(), draws.tolist())
        frame["p"] = p
        frame["copies"] += np.array([0 if i == held else int(x) for i, x in enumerate(p)], np.int64)
        if held is not None:
            frame["leaf"] = leaf
        frame.loc[[i != held for i in range(len(frame))], "leaf"] = -1
        return pa.Table.from_pandas(frame, schema=rows.schema, preserve_index=False)

    return group


def mix(
    df: DataFrame,
    key: str,
    source: str,
    text: str,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)`` per row; other columns are not carried.

    Sources in code point order, null last, get the ``weights`` in turn.  A null or
    empty text has size 0 and is taken 0 times; repeated rows are rounded one by one.
    A source of size 0 has target 0.  Rounding depends on keys, sizes and ``seed``
    only, so reruns agree.  Per source one row of sums goes to the driver: a mix has
    a weight for each source, so there are as many as someone can name.
    """
    rows = written(
        df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), word_count(text_of(text)).alias("size")),
        "mix",
    )
    sums = (
        rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count_if(F.col("size") > 0).alias("docs"))
        .orderBy(F.col("_source").asc_nulls_last()).collect()
    )
    wanted = targets([r.n for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share, limit)
    plan = []
    for row, target in zip(sums, wanted, strict=True):
        copies = min(target / row.n, limit) if row.n else 0.0
        whole = int(copies + 1e-12)
        plan.append((row._source, row.n, target, whole, max(0.0, copies - whole), max(1, -(-row.docs // LEAF))))
    plan = df.sparkSession.createDataFrame(
        plan, "source string, source_size bigint, target double, whole bigint, fraction double, leaves bigint"
    )
    state = rows.join(plan, F.col("_source").eqNullSafe(F.col("source"))).select(
        "source",
        F.when(F.col("size") > 0, F.pmod(F.xxhash64("_key", F.lit(seed)), "leaves")).otherwise(-1).alias("leaf"),
        F.col("_key").cast("string").alias("key_"),
        "size",
        F.when(F.col("size") > 0, F.col("fraction")).otherwise(0.0).alias("p"),
        F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"),
    )
    done, level = state.where("leaf = -1"), 0
    state, leaves = state.where("leaf >= 0"), max((r.docs for r in sums), default=0) // LEAF + 1
    while True:
        rounded = written(state.groupBy("source", "leaf").applyInArrow(_round(seed, level), _STATE), "mix")
        done = done.unionByName(rounded.where("leaf = -1"))
        rest = rounded.where("leaf >= 0")
        if leaves <= 1:
            break
        leaves, level = -(-leaves // LEAF), level + 1
        state = rest.withColumn("leaf", F.floor(F.col("leaf") / LEAF).cast("bigint"))
    # One document of a source has nothing left to pair with: the nearer whole number.
    done = done.unionByName(rest.withColumn("copies", F.col("copies") + F.round("p").cast("bigint")))
    kind = df.schema[key].dataType
    return done.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("key_").cast(kind).alias(key),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
