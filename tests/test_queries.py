"""Every query against its SQL, and one key that holds a third of all rows."""

from pathlib import Path

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from refweave.operators import lookup as lk

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def canonical(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("\0" if r[i] is None else str(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_hot_key_grows_linearly(make):
    """A var used in most rows: one answer row per usage, not one per pair of usages."""
    r = make(("var_definition", {"name": "hot", "ns": "n", "name_row": 1}))
    template = make(("var_usage", {"name": "hot", "to_ns": "n", "name_row": 1}))
    n = 20_000
    many = template.drop("pos", "row").crossJoin(
        template.sparkSession.range(n).select(F.col("id").alias("pos"), (F.col("id") + 1).cast("int").alias("row"))
    )
    found = lk.var_usages(r.unionByName(many))
    assert found.count() == n
    assert found.select("n_asked").distinct().first().n_asked == n + 1


def test_hot_key_is_split(make, spark):
    """Partitions of a key that is nearly everything are split by adaptive execution."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    n = 20_000
    one = make(("var_usage", {"name": "hot", "to_ns": "n", "name_row": 1}))
    hot = one.drop("pos", "row", "name").crossJoin(
        spark.range(0, n, 1, 8).select(
            F.col("id").alias("pos"),
            (F.col("id") + 1).cast("int").alias("row"),
            F.when(F.col("id") % 100 == 0, F.concat(F.lit("v"), "id")).otherwise("hot").alias("name"),
        )
    )
    r = make(("var_definition", {"name": "hot", "ns": "n", "name_row": 1})).unionByName(hot)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for df in (lk.var_usages(r), lk.var_definition_first(r)):
            assert len(df.collect()) >= n
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
