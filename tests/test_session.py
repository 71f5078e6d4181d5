from pyspark.sql import functions as F

from refweave.operators import position as ps
from refweave.operators import regions as rg
from refweave.operators.joins import join_unique
from refweave.plans import registry
from refweave.session import derived_table, spread_text
from refweave.sources import documents as docs


def test_tables_by_kind_are_written_without_a_shuffle(spark):
    """Rows go to the files of their kind from the task that made them, in the order they came in."""
    rows = spark.range(0, 4000, 1, 4).select("id", (F.col("id") % 5).alias("kind"))
    spark.sparkContext.setJobGroup("by-kind", "")
    try:
        table = derived_table(spark, "by-kind", "test_session", lambda: rows, partition_by=["kind"])
    finally:
        spark.sparkContext.setJobGroup("others", "")
    status = spark.sparkContext.statusTracker()
    stages = [n for job in status.getJobIdsForGroup("by-kind") for n in status.getJobInfo(job).stageIds]
    tasks = [status.getStageInfo(n).numTasks for n in stages]
    assert 4 in tasks and max(tasks) == 4 and len([n for n in tasks if n == 4]) == 1
    assert len(table.inputFiles()) == 4 * 5
    assert table.groupBy("kind").count().where("count = 800").count() == 5
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_many_texts_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr("refweave.session.TASK_BYTES", 1000)
    texts = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    assert spread_text(texts, "text", "id").rdd.getNumPartitions() == 10
    assert spread_text(texts.where("id < 0"), "text", "id").rdd.getNumPartitions() == 4
    assert sorted(r.id for r in spread_text(texts, "text", "id").collect()) == list(range(100))


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in line]


def test_tables_dealt_by_project_meet_without_a_shuffle(spark, monkeypatch):
    """Only documents are dealt: no record, caret or answer is shuffled after that."""
    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = registry.records(spark, sf)
        asked = ps.at_position(records, docs.cursors(registry._dealt(spark, sf)))
        assert {line.split("Exchange ")[1].split("(")[1] for line in _exchanges(asked)} == {"concat"}
        for name in ("call_degrees", "deduped", "var_usages", "usages", "ns_usages_in_view"):
            assert not _exchanges(registry.all_queries()[name](spark, sf)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dealt_tables_hold_every_row_once(spark):
    """Also with null and repeated keys, and if rows were dealt otherwise before."""
    rows = spark.range(0, 300, 1, 3).selectExpr("id", "if(id % 7 = 0, null, concat('p', id % 5)) as project", "id % 2 as kind")
    for n, given in enumerate((rows, rows.repartition(6, "project"))):
        table = derived_table(spark, f"dealt-{n}".replace("-", "_"), "test_session", lambda df=given: df, ["kind"], "project", lambda: 6)
        assert sorted(map(tuple, table.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_starts_of_words_in_lines_short_and_long(spark, monkeypatch):
    text = "  Ab, cd  éf \n" + " ".join(f"w{n}" for n in range(200)) + "\n\nend"
    df = spark.createDataFrame([(1, text, "en"), (2, "", None), (3, None, "de")], "doc_id bigint, text string, lang string")
    found = []
    for limit in (0, 64, 1000):
        monkeypatch.setattr(docs, "LONG_LINE", limit)
        found.append(sorted((r.row, r.i, r.col, r.tok) for r in docs.tokens(df).collect()))
    assert found[0] == found[1] == found[2]
    lines = text.split("\n")
    assert all(lines[row - 1][col - 1 :].startswith(tok) for row, _, col, tok in found[0]) and len(found[0]) == 204


def test_other_tables_are_split_as_before(make, spark):
    """Dealt tables in a session do not keep a hot key of another table from being shuffled on both sides."""
    registry.records(spark, "/root/testdata/sf0.001")
    many = make(("var_usage", {"name": "hot"}), ("var_usage", {"name": "x"}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_unique(many, many.groupBy("project", "name").count(), ["project", "name"])
        assert len(_exchanges(joined)) == 3 and joined.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reports_are_streamed_a_few_at_once(spark, monkeypatch):
    seen = []

    class Done:
        def awaitTermination(self):
            raise InterruptedError

    name = "spark.sql.parquet.columnarReaderBatchSize"
    monkeypatch.setattr(registry.ig, "ingest", lambda *_: seen.append(spark.conf.get(name)) or Done())
    before = spark.conf.get(name)
    try:
        registry.all_queries()["hooks"](spark, "/root/testdata/sf0.001")
    except InterruptedError:
        pass
    assert int(seen[0]) <= 256 and spark.conf.get(name) == before


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_tables_are_not_sent_to_the_driver(spark):
    """Spark takes records, whose columns are mostly empty, for far smaller than they are."""
    sf = "/root/testdata/sf0.001"
    for name in ("symbol_usages", "symbol_definitions", "usage_answers", "usages_by_scope", "usages_in_view"):
        assert "BroadcastExchange" not in _plan(registry.all_queries()[name](spark, sf)), name


def test_small_tables_that_are_not_dealt_are_still_broadcast(make):
    many = make(("var_usage", {"name": "a"}), ("var_usage", {"name": "b"}))
    assert "MergeJoin" not in _plan(join_unique(many, many.limit(1).select("name"), ["name"]))


def test_groups_are_sorted_by_a_hash(spark):
    """Keys of one file begin alike, so a sort by them compares long strings."""
    sf = "/root/testdata/sf0.001"
    counts = rg.highlights(registry.carets(spark, sf), registry.region_groups(spark, sf))
    joins = [line for line in _plan(counts).split("\n") if "SortMergeJoin" in line]
    assert sum("SortMergeJoin [_h#" in line for line in joins) == 2


def test_requests_meet_their_carets_by_project(spark):
    """All carets are asked which of them rename something, so they must not be dealt anew for that."""
    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, _ = registry._rename_regions(spark, sf)
        assert not [line for line in _exchanges(found) if "cursor_id" in line.split("Exchange ")[1]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_are_dealt_to_tasks_of_less_text(spark, monkeypatch, tmp_path):
    """Sorts and hash tables of a bucket are some hundred times its text."""
    docs_of = spark.range(0, 100, 1, 1).selectExpr("id as doc_id", "repeat('x', 100) as text", "'en' as lang")
    docs_of.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("refweave.plans.registry.DEALT_BYTES", 500)
    assert registry._n_tasks(spark, str(tmp_path)) == 20
