"""Joins of many rows with at most one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import DEALT, MEET


def is_dealt(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the rows lie by one of the keys, as those of :func:`refweave.session.read_table` do."""
    return any(DEALT in df.schema[k].metadata for k in keys)


def met(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A side of a join by ``keys``, never sent to the driver if it is dealt.

    Dealt tables meet where they are, and Spark takes them for far smaller than they are, as most columns
    of a record are empty: a side that it would broadcast may be larger than the driver.
    """
    return df.hint("merge") if is_dealt(df, keys) else df


def join_hashed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by string keys whose first ones are alike in most rows: a hash in front spares comparing them in sorts."""
    hashed = F.xxhash64(*keys)
    return met(left.withColumn("_h", hashed), keys).join(right.withColumn("_h", hashed), ["_h", *keys], how).drop("_h")


def join_unique(
    many: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join with a side that was aggregated to one row per ``keys``.

    Joined on its grouping keys, an aggregate would feed the join without a shuffle in
    between, and then adaptive execution cannot split a hot key of the other side.  A
    hash computed after the aggregate is part of the key, so the one-row-per-key side
    is shuffled once more, narrow as it is, and skewed partitions of ``many`` split.
    Only a table that is dealt by one of the keys stays where it is.
    """
    hashed = F.xxhash64(*keys)
    if not is_dealt(many, keys) and many.sparkSession.conf.get(MEET, "true") == "false":
        # Some of the keys would do for Spark then, so it must not know how the aggregate is dealt.
        unique = unique.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
    return (
        many.withColumn("_h", hashed)
        .join(met(unique.withColumn("_h", hashed), keys), ["_h", *keys], how)
        .drop("_h")
    )
