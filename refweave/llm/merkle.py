"""Merkle manifest: a content-addressed DAG over all rows, and proofs by descent from its root.

Every row is a leaf; the leaves of a group, in order, form a tree in which every two
consecutive nodes become one, and the groups' roots form the tree of the whole.  A node is
stored as a record from its digest to the digests of its children.  Records of up to
``LEVELS`` levels lie together in a pack, found by the digest at its top, so that a table of
n rows takes ``log(n) / LEVELS`` rounds of one shuffle, each of narrow rows only.

Proofs are not read from the tree that was built: a request knows its rank, descends from the
root by the digits of the rank through the records, and collects the children it does not
select.  Requests of one pack share the way down to it.  What was collected, level by level,
is reversed into the order of a proof: from the leaf to the root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from refweave.llm.common import bounded_batches, written
from refweave.operators.joins import join_unique

LEVELS = 10  # of a pack: it has at most 2 ** LEVELS bottom nodes
_ALL = "*"  # the tree of the groups' roots
_CHILDREN = "map<string,array<string>>"
_TOP = "tree string, rank bigint, members bigint, digest string"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns in order, each with its length in bytes; null is ``-``."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def _hash(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``rank`` (from 0) in the ``order`` within ``tree``, and the tree's ``members``.

    Sorted over the cluster, then numbered per range of the sort; only one row per range and
    tree meets in a window.  Equal rows have ranks next to each other, in any order, and may
    be spread over several ranges.
    """
    ties = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col("tree"), *order, F.col("_tie")]
    placed = ties.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "members": F.sum("_n").over(whole)}
    )
    found = join_unique(placed, runs, ["tree", "_range"])
    return found.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_range", "_first", "_n", "_before"
    )


def _depth(members: Column) -> Column:
    return F.when(members > 1, F.length(F.bin(members - 1))).otherwise(0)


def _packed(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Packs of nodes that come in order: ``(tree, rank, members, height, digest)`` in runs of one pack."""
    schema = pa.schema([
        ("tree", pa.string()), ("rank", pa.int64()), ("members", pa.int64()), ("height", pa.int32()),
        ("digest", pa.string()), ("children", pa.map_(pa.string(), pa.list_(pa.string()))),
    ])

    def close(at, nodes):
        tree, rank, members, height = at
        children = {}
        for _ in range(height):
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [_hash(pair) for pair in pairs]
            children.update(zip(nodes, pairs, strict=True))
        return {"tree": tree, "rank": rank, "members": members, "height": height, "digest": nodes[0],
                "children": list(children.items())}

    at, nodes = None, []
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("tree", "rank", "members", "height", "digest"))
        for tree, rank, members, height, digest in zip(*columns, strict=True):
            now = (tree, rank >> levels, members, height)
            if now != at:
                if at is not None:
                    out.append(close(at, nodes))
                at, nodes = now, []
            nodes.append(digest)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([close(at, nodes)], schema=schema)


def build(leaves: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The DAG over ``leaves(tree, rank, members, digest)``: its packs by round from the bottom, and ``(tree, digest)`` of the roots."""
    bounded_batches(leaves.sparkSession)
    nodes = leaves.select("tree", "rank", "members", "digest")
    deepest = leaves.agg(F.max(_depth(F.col("members")))).first()[0] or 0
    rounds, roots = [], nodes.where(_depth(F.col("members")) == 0).select("tree", "digest")
    for k in range(-(-deepest // levels)):
        left = _depth(F.col("members")) - k * levels
        rows = nodes.where(left > 0).withColumn("height", F.least(left, F.lit(levels)))
        # A pack in one task, in order: it has a bounded number of nodes.
        rows = rows.repartition("tree", F.shiftright("rank", levels)).sortWithinPartitions("tree", "rank")
        schema = f"tree string, rank bigint, members bigint, height int, digest string, children {_CHILDREN}"
        packs = written(rows.mapInArrow(partial(_packed, levels=levels), schema), "packs")
        rounds.append(packs)
        nodes = packs.select("tree", "rank", "members", "digest")
        roots = roots.unionByName(packs.where(_depth(F.col("members")) <= (k + 1) * levels).select("tree", "digest"))
    return rounds, roots


def _by_digest(packs: DataFrame) -> DataFrame:
    """The records as stored: one pack per digest, wherever it occurs."""
    return packs.select("digest", "height", "children").dropDuplicates(["digest"])


def _descend(children: dict[str, list[str]], digest: str, height: int, rank: int) -> tuple[str, list[str]]:
    """Node ``rank`` below ``digest``, and per level from the top the child that was not selected.

    A way is noted as ``<`` or ``>`` (which side the other child is on) and its digest, or as ``.``
    where there is no other.
    """
    path = []
    for level in range(height - 1, -1, -1):
        pair = children[digest]
        digit = rank >> level & 1
        digest = pair[digit]
        path.append("." if len(pair) == 1 else "<>"[1 - digit] + pair[1 - digit])
    return digest, path


def _expanded(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """From the top of each pack to all its bottom nodes that are asked for."""
    for batch in batches:
        for row in batch.to_pylist():
            children, below = dict(row["children"]), -(-row["members"] // (1 << row["scale"]))
            first = row["rank"] << levels
            out = []
            for rank in range(first, min(first + (1 << levels), below)):
                digest, path = _descend(children, row["digest"], row["height"], rank - first)
                out.append({"tree": row["tree"], "rank": rank, "members": row["members"], "digest": digest,
                            "path": row["path"] + path})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("tree", pa.string()), ("rank", pa.int64()), ("members", pa.int64()), ("digest", pa.string()),
                ("path", pa.list_(pa.string())),
            ]))


def _heads(tops: DataFrame, rounds: list[DataFrame], to: int, levels: int) -> DataFrame:
    """From the roots ``tops(tree, members, digest, path)`` down to the tops of the packs of round ``to``."""
    tops = tops.withColumn("rank", F.lit(0).cast("bigint"))
    n_rounds = F.ceil(_depth(F.col("members")) / levels)
    found = None
    for k in range(len(rounds), to, -1):
        begin = tops.where(n_rounds == k)
        found = begin if found is None else found.unionByName(begin)
        joined = join_unique(found, _by_digest(rounds[k - 1]), ["digest"]).withColumn("scale", F.lit((k - 1) * levels))
        found = joined.mapInArrow(partial(_expanded, levels=levels), f"{_TOP}, path array<string>")
    begin = tops.where(n_rounds <= to)
    return begin if found is None else found.unionByName(begin)


def _folded(leaf: str, way: Sequence[str]) -> str:
    """The root that a leaf and a way upwards lead to."""
    for other in way:
        side, other = other[0], other[1:]
        leaf = _hash([leaf]) if side == "." else _hash([other, leaf] if side == "<" else [leaf, other])
    return leaf


def _answered(key_type: pa.DataType, levels: int):
    schema = pa.schema([
        ("key", key_type), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
        ("proof_sha256", pa.string()), ("folded_root", pa.string()),
    ])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a pack: its head first, then the requests for its bottom nodes."""
        head = children = None
        names = ("head", "rank", "key", "leaf", "tampered")
        for batch in batches:
            out, heads = [], batch.column("top")
            for i, (is_head, rank, key, leaf, tampered) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if is_head:
                    head = heads[i].as_py()
                    children = dict(head["children"] or ())
                    continue
                first = rank >> levels << levels
                found, path = _descend(children, head["digest"], head["height"] or 0, rank - first)
                way = (head["path"] + path)[::-1]
                # Left to right within a level, levels from the leaf up: at most one other child each.
                proof = _hash([other[1:] for other in way])
                out.append((key, found, head["subroot"], head["root"], proof, _folded(tampered or leaf, way)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return answer


def manifest(rows: DataFrame, key: str, group: str, columns: Sequence[str], changed: dict[str, Column], tampered: Column,
             levels: int = LEVELS) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row.

    The leaves of a ``group`` ascend by ``key`` (null first; rows of one key by their digest), groups by
    their UTF-8 bytes (null first).  Where ``tampered`` is true, the root is folded from a leaf whose columns are as in ``changed``; null is
    not tampered.  Rows that are alike in all ``columns`` are leaves of their own next to each other, and which of
    their proofs belongs to which cannot be told.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    values = [F.col(c) for c in columns]
    altered = [changed.get(c, F.col(c)) for c in columns]
    # A group's name begins with a sign, so that null sorts before the empty string.
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"),
        leaf_digest(values).alias("digest"),
        F.when(tampered, leaf_digest(altered)).alias("tampered"),
    )
    leaves = written(ranked(rows, [F.col("key").asc_nulls_first(), F.col("digest")]), "leaves")
    rounds, subroots = build(leaves, levels)
    sizes = leaves.groupBy("tree").agg(F.max("members").alias("inner"))
    groups = subroots.withColumnsRenamed({"tree": "name", "digest": "subroot"}).withColumn("tree", F.lit(_ALL))
    groups = written(ranked(groups, [F.col("name")]).withColumn("digest", F.col("subroot")), "groups")
    upper, root = build(groups, levels)

    # From the root to the groups' roots, then from each of those to the packs of leaves.
    top = root.join(groups.groupBy("tree").agg(F.max("members").alias("members")), "tree")
    top = top.select("tree", "members", "digest", F.array().cast("array<string>").alias("path"))
    reached = _heads(top, upper, 0, levels).select("rank", "digest", "path")
    found = groups.select("rank", F.col("name").alias("tree")).join(reached, "rank").join(sizes, "tree")
    tops = written(found.select("tree", F.col("inner").alias("members"), "digest", "path"), "tops")
    heads = _heads(tops, rounds, 1, levels)
    packs = _by_digest(rounds[0]) if rounds else spark.createDataFrame([], f"digest string, height int, children {_CHILDREN}")
    heads = join_unique(heads, packs, ["digest"], "left")
    ends = groups.join(root.select("tree", F.col("digest").alias("root")), "tree").select(F.col("name").alias("tree"), "subroot", "root")
    heads = join_unique(heads, ends, ["tree"])

    top_type = f"struct<digest:string,height:int,children:{_CHILDREN},path:array<string>,subroot:string,root:string>"
    heads = heads.select(
        "tree", F.shiftleft("rank", levels).alias("rank"), F.lit(True).alias("head"),
        F.lit(None).cast(leaves.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("leaf"),
        F.lit(None).cast("string").alias("tampered"),
        F.struct("digest", "height", "children", "path", "subroot", "root").cast(top_type).alias("top"),
    )
    asked = leaves.select(
        "tree", "rank", F.lit(False).alias("head"), "key", F.col("digest").alias("leaf"), "tampered",
        F.lit(None).cast(top_type).alias("top"),
    )
    stream = heads.unionByName(asked).withColumn("pack", F.shiftright("rank", levels))
    stream = stream.repartition("tree", "pack").sortWithinPartitions("tree", "pack", F.desc("head"), "rank")
    kind = leaves.schema["key"].dataType
    schema = f"key {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = stream.mapInArrow(_answered(to_arrow_type(kind), levels), schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)


def documents_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of a documents table; where 7 divides the CRC-32 of the id, one character too many is claimed."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": more}, hit, levels)
