"""What the operators share: tables, word rules, batch limits."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refweave.functions.text import running_starts
from refweave.session import scratch

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Give the memory of a task back when it ends: Python workers are used again, for other work."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


class Remembered(dict):
    """Results for strings met before in a task, of at most ``limit`` bytes, by a rough count, besides those of one batch."""

    def __init__(self, limit: int = 24 << 20):
        super().__init__()
        self.limit, self.size = limit, 0

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` to be found out; when full, all."""
        if self.size > self.limit:
            self.clear()
            self.size = 0
        return list(wanted.difference(self))

    def learn(self, keys: Sequence[str], values: Sequence) -> None:
        self.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) * 3 + 200 * len(keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed, and how to name them back."""
    back = {}
    for name in df.columns:
        if name in names:
            new = unused(df, f"_{name}")
            df, back[new] = df.withColumnRenamed(name, new), name
    return df, back


def with_matches(
    df: DataFrame, name: str, text: str, pattern: str, possible: Column, measure: Callable[[Column], Column] = F.length
) -> DataFrame:
    """Add ``name``: the matches of ``pattern`` where ``possible``, as ``(x, before, after, start)``.

    ``before`` and ``after`` are the text up to the neighbouring matches, ``start`` is the
    ``measure`` of all text before, by default its length.  Arrays are zipped before they are
    transformed: an outer expression inside a lambda would be evaluated for each element.
    """
    m, g, n = f"_m_{name}", f"_g_{name}", f"_n_{name}"
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    before, after = F.slice(g, F.lit(1), F.size(m)), F.slice(g, F.lit(2), F.size(m))
    df = df.withColumn(
        n,
        F.transform(
            F.arrays_zip(F.col(m).alias("x"), before.alias("before")),
            lambda z: (measure(z["x"]) + measure(z["before"])).cast("int"),
        ),
    )
    zipped = F.arrays_zip(
        F.col(m).alias("x"), before.alias("before"), after.alias("after"), running_starts(F.col(n)).alias("at")
    )
    found = F.transform(
        zipped,
        lambda z: F.struct(z["x"], z["before"], z["after"], (z["at"] + measure(z["before"])).cast("int").alias("start")),
    )
    return df.withColumn(name, found).drop(m, g, n)
