"""Views followed live: state that does not grow, timers, closed views."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from refweave.plans import registry
from refweave.streaming import live

SF = "/root/testdata/sf0.001"
SCHEMA = "view_id string, ts timestamp, kind string, change_count bigint"


def follow(spark, folder, batches, **options):
    """Runs one micro-batch per list of ``(view, second, kind, version)``; the output and each batch's state size."""
    for batch in batches:
        df = spark.createDataFrame(batch, "view_id string, s double, kind string, change_count bigint")
        df.select("view_id", F.timestamp_micros((F.col("s") * 1_000_000 + 10**15).cast("bigint")).alias("ts"), "kind", "change_count").coalesce(
            1
        ).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        live.followed(stream.withWatermark("ts", options.pop("lateness", "0 seconds")), **options)
        .writeStream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return spark.read.schema(live.OUTPUT).parquet(f"{folder}/out"), sizes


def test_a_busy_view_holds_one_burst(spark, tmp_path):
    batches = [[("v", b * 100 + n * 0.05, "modified", b * 2000 + n) for n in range(2000)] for b in range(3)]
    out, sizes = follow(spark, tmp_path, [*batches, [("w", 1000.0, "saved", 9999)]], gap="10 seconds")
    found = rows(live.bursts(out), "view_id", "change_count", "n_edits")
    assert found == [("v", 5999, 6000)]
    assert max(sizes) <= 16  # versions, one burst and timers, not thousands of edits
    assert live.stale(out).count() == 0


def test_saves_pauses_and_closes(spark, tmp_path):
    batches = [
        [("a", 0.0, "modified", 1), ("a", 0.1, "saved", 2), ("b", 0.0, "modified", 3), ("c", 0.0, "modified", 4)],
        [("a", 1.0, "modified", 5), ("c", 0.9, "closed", 6)],
        [("b", 1.3, "modified", 7)],
    ]
    out, sizes = follow(spark, tmp_path, batches, gap="600 milliseconds", drop_closed=True)
    assert ("b", 3, 1) in rows(live.bursts(out), "view_id", "change_count", "n_edits")
    # The edit of a at 1.0 is due at 1.6, the last one of b at 1.9; the last event is at 1.3.
    assert rows(live.stale(out), "view_id", "change_count", "analysed_count") == [("a", 5, 1), ("b", 7, 3)]


@pytest.mark.parametrize("live_query, query, columns", [
    ("live_bursts", "debounced_edits", ["view_id", "first_edit", "analyse_at", "change_count", "n_edits"]),
    ("live_stale_files", "stale_files", ["view_id", "change_count", "analysed_count"]),
])
def test_live_equals_batch(spark, live_query, query, columns):
    q = registry.all_queries()
    assert rows(q[live_query](spark, SF), *columns) == rows(q[query](spark, SF), *columns)
