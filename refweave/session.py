"""Session defaults and tables derived once per session."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_local_folder: dict[str, tempfile.TemporaryDirectory] = {}  # removed when Python ends
_written: dict[tuple[str, str], str] = {}


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("refweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # Small tables in many files, so that all cores read them.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        # Hash instead of sort where every partition of one side turns out to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a single-machine session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.TemporaryDirectory(prefix="refweave-", ignore_cleanup_errors=True)
    return _local_folder[app].name


def scratch(spark: SparkSession, name: str) -> str:
    """New, unused folder below the shared one."""
    return f"{shared_folder(spark)}/refweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Text of one task that makes many wide rows of each word.
TASK_BYTES = 8 << 20


#: Text of one bucket of a dealt table.  Joins and aggregates sort and hash some hundred times as much.
DEALT_BYTES = 4 << 20


def spread_text(df: DataFrame, text: str, *keys: str | Column) -> DataFrame:
    """Deal rows to tasks of like amounts of text, at least one a core; rows with equal ``keys`` stay together."""
    return df.repartition(text_tasks(df, text), *keys)


def text_tasks(df: DataFrame, text: str, size: int | None = None) -> int:
    """Number of tasks of ``size`` bytes of text; by default, to which :func:`spread_text` deals."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // (size or TASK_BYTES)))


DEALT = "dealt"  # in the metadata of the column by which a table is dealt
MEET = "spark.sql.requireAllClusterKeysForCoPartition"

OPEN_FILES = 64  # of a task
#: Scans and joins that feed a table are cut fine, so that tasks need not spill what they deal out or sort.
_WRITING = {
    "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES),
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


@contextlib.contextmanager
def configured(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold in between."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def derived_table(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    dealt_by: str | None = None,
    tasks: Callable[[], int] | None = None,
) -> DataFrame:
    """Write ``build()`` as Parquet on first use in this session, then read it back.

    A written table cuts lineage, survives lost executors and gives every later
    query partition pruning and column statistics.  Each task keeps a file open for
    every value of ``partition_by`` it meets, up to ``OPEN_FILES``, and sorts only
    beyond that: rows are neither shuffled nor sorted to be written, so ``build()``
    says how many tasks there are and in which order rows stand in the files.

    With ``dealt_by`` rows are dealt by that column to ``tasks()`` buckets, unless ``build()`` has done so, and
    Spark knows it: whatever goes together by that column, and others, meets without a shuffle.
    """
    app = spark.sparkContext.applicationId
    key = (app, f"{name}:{source}")
    if key not in _written:
        digest = hashlib.sha256(source.encode()).hexdigest()[:16]
        path = f"{scratch(spark, name)}-{digest}"
        with configured(spark, _WRITING):
            _written[key] = write_table(build(), name, path, partition_by, dealt_by, tasks() if dealt_by else 0)
    return read_table(spark, _written[key], dealt_by)


def write_table(
    df: DataFrame, name: str, path: str, partition_by: Sequence[str] = (), dealt_by: str | None = None, tasks: int = 0
) -> str:
    """Write to the folder ``path``; what :func:`read_table` finds it by."""
    if not dealt_by:
        df.write.partitionBy(*partition_by).parquet(path)
        return path
    found = f"refweave_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(tasks, dealt_by)  # Spark leaves this out if rows are dealt so already
    out = dealt.write.partitionBy(*partition_by).bucketBy(tasks, dealt_by).option("path", path)
    out.format("parquet").saveAsTable(found)
    return found


def read_table(spark: SparkSession, found: str, dealt_by: str | None = None) -> DataFrame:
    if not dealt_by:
        return spark.read.parquet(found)
    # Tables dealt by one column meet by it and others as they are.
    spark.conf.set(MEET, "false")
    table = spark.table(found)
    # Without the table's name, which a union takes for another column.
    return table.toDF(*table.columns).withMetadata(dealt_by, {DEALT: True})
