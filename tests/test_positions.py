import random
import zipfile

from conftest import SF, rows
from pyspark.sql import functions as F

from refweave.operators import position as ps
from refweave.operators import regions as rg
from refweave.operators import rewrite as rw
from refweave.sources import files as fs


def carets(spark, *points, filename="/p/a.clj"):
    data = [(n, "p", filename, *p, *p) for n, p in enumerate(points)]
    return spark.createDataFrame(
        data, "cursor_id bigint, project string, filename string, begin_row int, begin_col int, end_row int, end_col int"
    )


def test_priority_and_both_ends(spark, make):
    at = {"row": 1, "col": 5, "end_row": 1, "end_col": 8, "name_row": 1, "name_col": 5, "name_end_row": 1, "name_end_col": 8}
    r = make(("symbol", at), ("keyword", at), ("var_usage", at), ("local_usage", at | {"local_id": 1}),
             ("namespace_usage", {"row": 2, "name_row": 2, "name_col": 1, "name_end_row": 2, "name_end_col": 4, "to_ns": "n",
                                  "alias": "al", "alias_row": 3, "alias_col": 1, "alias_end_row": 3, "alias_end_col": 3}))
    hit = ps.at_position(r, carets(spark, (1, 5), (1, 8), (1, 4), (1, 9), (2, 2), (3, 2)))
    assert rows(hit, "cursor_id", "hit_type") == [
        (0, "local_usage"), (1, "local_usage"), (4, "namespace_usage"), (5, "namespace_usage_alias"),
    ]


def test_position_join_equals_brute_force(spark):
    rng = random.Random(7)
    regions = []
    for n in range(300):
        row = rng.randint(1, 4)
        end_row = row + (rng.random() < 0.1)
        col = rng.randint(1, 200)
        end = rng.randint(1, 300) if end_row > row else col + rng.choice([0, 1, 5, 31, 32, 33, 150])
        regions.append(("p", "f", n, "symbol", n % 3, row, row, col, end_row, end, n))
    carets_ = [(i, "p", "f", rng.randint(1, 5), rng.randint(1, 260)) for i in range(200)]
    r = spark.createDataFrame(
        regions, "project string, filename string, hit_pos bigint, hit_type string, priority int, idx_row int, "
        "start_row int, start_col int, end_row int, end_col int, payload int")  # fmt: skip
    c = spark.createDataFrame(carets_, "cursor_id bigint, project string, filename string, begin_row int, begin_col int")
    c = c.withColumns({"end_row": F.col("begin_row"), "end_col": F.col("begin_col")})
    expected = {}
    for cid, _, _, row, col in carets_:
        inside = [x for x in regions if x[5] == row and (x[6], x[7]) <= (row, col) <= (x[8], x[9])]
        if inside:
            expected[cid] = min(inside, key=lambda x: (x[4], x[2]))[2]
    pairs = ps.containing(r, ps.as_carets(c))
    got = pairs.groupBy("cursor_id").agg(F.min(F.struct("priority", "hit_pos")).alias("m")).select("cursor_id", "m.hit_pos")
    assert dict(rows(got, "cursor_id", "hit_pos")) == expected


def test_one_row_only_files_never_pair_everything(spark):
    """A line of n words with n carets joins about n pairs, not n squared."""
    n = 5000
    words = spark.range(n).select(
        F.lit("p").alias("project"), F.lit("f").alias("filename"), F.col("id").alias("hit_pos"), F.lit(1).alias("idx_row"),
        F.lit(1).alias("start_row"), (F.col("id") * 6 + 1).cast("int").alias("start_col"), F.lit(1).alias("end_row"),
        (F.col("id") * 6 + 5).cast("int").alias("end_col"),
    )
    points = words.select("project", "filename", F.col("hit_pos").alias("cursor_id"), F.lit(1).alias("begin_row"),
                          (F.col("start_col") + 1).alias("begin_col"), F.lit(1).alias("sel_end_row"),
                          (F.col("start_col") + 1).alias("sel_end_col"))
    pairs = ps.containing(words, points)
    assert pairs.count() == n
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_long_regions_on_one_line(spark):
    """Nested regions of a minified line: few buckets each, every caret in all that contain it."""
    rng = random.Random(3)
    regions = []
    for n in range(400):
        length = int(10 ** rng.uniform(0, 6))
        start = rng.randint(1, 10**6)
        regions.append(("p", "f", n, 1, 1, start, 1, start + length))
    r = spark.createDataFrame(
        regions, "project string, filename string, hit_pos bigint, idx_row int, start_row int, start_col int, end_row int, end_col int"
    )
    at = [rng.randint(1, 10**6) for _ in range(200)] + [x[5] for x in regions[:50]] + [x[7] for x in regions[:50]]
    c = spark.createDataFrame([("p", "f", i, 1, col, 1, col) for i, col in enumerate(at)],
                              "project string, filename string, cursor_id bigint, begin_row int, begin_col int, sel_end_row int, sel_end_col int")
    want = sorted((i, x[2]) for i, col in enumerate(at) for x in regions if x[5] <= col <= x[7])
    assert rows(ps.containing(r, c), "cursor_id", "hit_pos") == sorted(want, key=str)
    long = r.where("end_col - start_col >= 256")
    assert long.select(F.explode(ps._wide_buckets())).count() <= 5 * long.count()


def test_regions_are_scanned_once_to_see_what_kinds_there_are(spark):
    """Widths of long regions, and whether any region goes over several rows, come from one pass."""
    at = "project string, filename string, hit_pos bigint, idx_row int, start_row int, start_col int, end_row int, end_col int"
    for rows_ in ([], [("p", "f", 1, 1, 1, 1, 1, 900)], [("p", "f", 2, 1, 1, 1, 3, 2)], [("p", "f", 1, 1, 1, 1, 1, 900), ("p", "f", 2, 1, 1, 1, 3, 2)]):
        r = spark.createDataFrame([*rows_, ("p", "f", 0, 1, 1, 5, 1, 9)], at)
        c = spark.createDataFrame([("p", "f", 0, 1, 7, 1, 7), ("p", "f", 1, 1, 800, 1, 800)],
                                  "project string, filename string, cursor_id bigint, begin_row int, begin_col int, sel_end_row int, sel_end_col int")
        pairs = ps.containing(r, c)
        assert rows(pairs, "cursor_id", "hit_pos") == sorted([(0, 0), *((i, x[2]) for i in (0, 1) for x in rows_)], key=str)
        found = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert found.count("collect_set") > 0 and "count(1)" not in found


CONTENT = "(defn f [x]\n  (f x))\n(f 1)\n"


def f_records(make):
    def at(row, col, size):
        return {"row": row, "col": col, "end_row": row, "end_col": col + size, "name_row": row, "name_col": col,
                "name_end_row": row, "name_end_col": col + size}

    return make(
        ("var_usage", {"name": "f", "to_ns": "n"} | at(3, 2, 1)),
        ("var_definition", {"name": "f", "ns": "n"} | at(1, 7, 1)),
        ("var_usage", {"name": "f", "to_ns": "n"} | at(2, 4, 1)),
        ("local", {"name": "x", "local_id": 1, "row": 1, "col": 10, "end_row": 1, "end_col": 11}),
        ("local_usage", {"name": "x", "local_id": 1} | at(2, 6, 1)),
    )


def test_highlights_leave_out_the_caret_itself(spark, make):
    r = f_records(make)
    asked = ps.at_position(r, carets(spark, (1, 7), (3, 2), (2, 6), (1, 1)))
    got = {x.cursor_id: (x.n_regions, x.n_highlighted) for x in rg.highlights(rg.caret_targets(asked, r), rg.region_groups(r)).collect()}
    assert got == {0: (3, 2), 1: (3, 2), 2: (2, 1)}
    whole = rg.highlight_counts(rg.caret_targets(asked, r), rg.region_groups(r), highlight_self=True).first()
    assert (whole.n_carets, whole.n_highlighted) == (3, 8)


def test_rename(spark, make):
    r = f_records(make)
    files = spark.createDataFrame([("p", "/p/a.clj", CONTENT)], "project string, filename string, content string")
    requests = carets(spark, (3, 2)).withColumn("new_text", F.lit("fact"))
    found = rg.text_regions(ps.at_position(r, requests), r, files)
    out = rw.renamed_files(found, requests, files).first()
    assert out.new_content == "(defn fact [x]\n  (fact x))\n(fact 1)\n"
    assert (out.n_edits, out.n_overlapping) == (3, 0)


def test_rename_tables_answer_every_caret(spark, make):
    r = f_records(make)
    files = spark.createDataFrame([("p", "/p/a.clj", CONTENT)], "project string, filename string, content string")
    asked = ps.at_position(r, carets(spark, (1, 7), (1, 10), (2, 4), (2, 6), (3, 2), (1, 1))).localCheckpoint()
    keyed, groups = rg.caret_targets(asked, r).localCheckpoint(), rg.region_groups(r).localCheckpoint()
    targets, edits = (df.collect() for df in rg.rename_tables(asked, keyed, groups, files))
    got = {(t.cursor_id, e.a, e.b) for t in targets for e in edits if (t.key, t.region_text) == (e.key, e.region_text)}
    f, x = [(6, 7), (15, 16), (22, 23)], [(9, 10), (17, 18)]
    assert got == {(c, *e) for c, es in enumerate([f, x, f, x, f]) for e in es}
    # Each region once per group, not once per caret.
    assert len(edits) == len({(e.key, e.a, e.b) for e in edits})


def test_rename_skips_other_text_and_reports_overlap(spark):
    files = spark.createDataFrame([("p", "f", "aaaa b")], "project string, filename string, content string")
    regions = spark.createDataFrame(
        [(1, "p", "f", 1, 3), (1, "p", "f", 0, 2), (1, "p", "f", 2, 4), (1, "p", "f", 0, 2)],
        "cursor_id int, project string, filename string, a int, b int")
    requests = spark.createDataFrame([(1, "X")], "cursor_id int, new_text string")
    out = rw.renamed_files(regions, requests, files).first()
    # The third overlaps the second, which is left out itself.
    assert (out.n_edits, out.n_overlapping) == (2, 1) and out.new_content == "XX b"


def test_archives(spark, tmp_path):
    jar = tmp_path / "lib.jar"
    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("a/b.clj", "(ns a.b) é")
        z.writestr("c.clj", "(ns c)")
        z.writestr("bytes.clj", b"\xff\xfe")
    bad = tmp_path / "bad.jar"
    bad.write_bytes(b"no archive")
    names = [f"{jar}:a/b.clj", f"{jar}:gone.clj", "/plain.clj", f"{jar}:x:y", f"{jar}:bytes.clj", f"{bad}:c.clj"]
    wanted = fs.wanted_members(spark.createDataFrame([(n,) for n in names], "filename string"))
    got = fs.read_members(fs.scan_archives(spark, str(tmp_path)), wanted)
    assert rows(got.where("error IS NULL"), "archive", "member", "content") == [(str(jar), "a/b.clj", "(ns a.b) é")]
    assert rows(got.where("error IS NOT NULL"), "archive", "member") == [(str(bad), None), (str(jar), "bytes.clj")]


def test_text_scan(spark, tmp_path):
    (tmp_path / "a.clj").write_text("x\ny")
    assert rows(fs.scan_text(spark, str(tmp_path)), "filename", "content") == [(str(tmp_path / "a.clj"), "x\ny")]


def test_no_query_nests_loops(spark):
    from refweave.plans import registry

    for name in ("at_position", "usages", "definitions_by_scope", "next_prev", "highlights", "rename_regions"):
        plan = registry.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_carets_are_read_once_if_regions_are_short_and_on_one_row(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def column(n):
        read.add(1)
        return n

    carets = spark.range(40).select(
        F.lit("p").alias("project"), F.lit("/p/a.clj").alias("filename"), F.lit(1).alias("begin_row"),
        column(F.col("id").cast("int")).alias("begin_col"), F.lit(1).alias("sel_end_row"), F.col("id").cast("int").alias("sel_end_col"),
    )
    region = "'p' project, '/p/a.clj' filename, 1 idx_row, 1 start_row, 3 start_col, {} end_row, {} end_col"
    for end_row, end_col, hit, times in ((1, 8, 6, 1), (1, 700, 37, 2), (2, 1, 37, 2)):
        before = read.value
        regions = spark.sql("SELECT " + region.format(end_row, end_col))
        assert ps.containing(regions, carets).count() == hit
        assert read.value - before <= 40 * times
