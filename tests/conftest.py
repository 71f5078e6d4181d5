import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from refweave.functions.scalars import file_extension
from refweave.schema import KEY_COLUMNS, RECORD_FIELDS
from refweave.session import local_session

SF = "/root/testdata/sf0.001"
_DDL = (
    "project string, scope string, semantic string, ext string, file_ord bigint, pos bigint, "
    + ", ".join(f"{c} {t}" for c, _, t in RECORD_FIELDS)
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Records from ``(semantic, fields)`` pairs; order of appearance is index order."""

    def build(*rows, project="p", scope="paths"):
        names = [*KEY_COLUMNS, *(c for c, _, _ in RECORD_FIELDS)]
        files, out = {}, []
        for n, (semantic, fields) in enumerate(rows):
            f = {"project": project, "scope": scope, "filename": "/p/a.clj", "row": 1, "col": 1} | fields
            f |= {"semantic": semantic, "pos": f.get("pos", n)}
            f["file_ord"] = f.get("file_ord", files.setdefault(f["filename"], len(files)))
            out.append(tuple(f.get(c) for c in names))
        df = spark.createDataFrame(out, _DDL)
        return df.withColumn("ext", F.coalesce(file_extension(F.col("filename")), F.lit("")))

    return build


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
