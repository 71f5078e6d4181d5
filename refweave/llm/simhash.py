"""Near duplicates by SimHash: fingerprints, Hamming links from BK-trees, components.

Fingerprints that differ in at most ``radius`` of 64 bits agree in at least one of
``radius + 1`` blocks of bits, so each distinct fingerprint goes to one shard per
block.  Shards with more than ``SHARD`` members are dealt anew by the same rule on
the other bits; what is still larger then is cut into chunks, and every two chunks
meet.  No link is lost on the way.  Each shard has a BK-tree, which goes to the
queries of its shard by the shuffle: a broadcast from the driver would bring all
fingerprints there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from refweave.llm.common import bounded_batches, text_of, tidy, written
from refweave.llm.graph import components
from refweave.operators.joins import join_unique

SHARD = 4096  # members of a shard before it is dealt anew
BIN = 16384  # members of the shards that one Python call works on, about
_QUERIES = 2048  # searched at a time
_SHINGLES = 1 << 16  # whose bits are counted at a time
_KIND_BITS = 5  # of a shard's name
LEAST = 0.8  # Jaccard similarity of near copies, over shingles of
JACCARD_WIDTH = 5  # words
_MAP = 1 << 26  # bits
BANDS, BAND = 24, 5  # a similarity of 0.8 misses all bands with probability 1e-4
_MEMBERS = 256  # pairs of a hub that are compared in one task
_MET = 1 << 19  # shingles of members of a band that meet in one task, about
_MARKS = 1 << 16  # bits a set is marked with, at most
_ENDS = ("a", "b", "root_a", "root_b")
_MIXED = 1 << 13  # shingles whose hashes are mixed at a time
_FACTORS, _TERMS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * BAND, 1), np.uint64) | np.uint64(1)
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles after A-Z are lower-cased, in bounded pieces; fewer words: one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()  # bytes split at ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _SHINGLES):
        stop = min(n, start + _SHINGLES)
        pairs = zip(starts[start:stop], ends[start + last : stop + last], strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: str, width: int, seed: int) -> int:
    """SimHash of the word shingles, repeats counted, as a signed 64-bit integer; no words: 0."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        counts += _bits_set(hashes)
        n += len(hashes)
    return _packed(counts * 2 > n)


def several_fingerprints(text: str, width: int, several: int) -> list[int]:
    """Independent fingerprints of the set of shingles: their hashes are mixed anew for each."""
    parts = [np.unique(h) for h in shingle_hashes(text, width, 42)]
    hashes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    out = []
    for n in range(1, several + 1):
        counts = np.zeros(64, np.int64)
        for start in range(0, len(hashes), _SHINGLES):
            h = hashes[start : start + _SHINGLES] ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            counts += _bits_set(h ^ (h >> np.uint64(32)))
        out.append(_packed(counts * 2 > len(hashes)))
    return out


def fingerprints(df: DataFrame, key: str, text: str, width: int = 4, seed: int = 42, several: int = 0) -> DataFrame:
    """``(key, fp)`` per row, or ``(key, fps)`` with ``several`` of them.

    A null or empty text, or one without words, has fingerprint 0.
    """
    bounded_batches(df.sparkSession)
    name, kind = ("fps", pa.list_(pa.int64())) if several else ("fp", pa.int64())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                several_fingerprints(t, width, several) if several else fingerprint(t, width, seed)
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, name])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {name} {'array<bigint>' if several else 'bigint'}"
    return df.select(F.col(key), text_of(text).alias("_text")).mapInArrow(run, schema)


class BKForest:
    """One BK-tree per shard over distinct fingerprints; all trees grow level by level."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        _, first, tree = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[tree]
        at = self.root.copy()
        todo = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        keys, children = [], []
        while len(todo):
            edge = at[todo] * 65 + np.bitwise_count(fp[todo] ^ fp[at[todo]])
            found, index, group = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(todo[index])
            at[todo] = todo[index][group]
            todo = np.delete(todo, index)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]  # parent * 65 + distance
        self.children = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def links(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect each query with all members of its tree within the radius.

        Below a node within the radius of the query, everything at most ``radius`` away
        from that node is connected through the node and is not followed.
        """
        from_, to = [], []
        query, node = queries, self.root[queries]
        while len(query):
            distance = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = distance <= radius
            hit = near & (query != node)
            from_.append(query[hit])
            to.append(node[hit])
            low = np.where(near, radius + 1, distance - radius)
            low, high = np.maximum(low, 0), np.minimum(distance + radius, 64)
            start = np.searchsorted(self.edges, node * 65 + low)
            count = np.searchsorted(self.edges, node * 65 + high, side="right") - start
            query = np.repeat(query, count)
            place = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            node = self.children[np.repeat(start, count) + place]
        return np.concatenate(from_), np.concatenate(to)


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected with each of ``n`` nodes."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _bits(fp, first: int, n: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))


def _blocks(width: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [width * n // blocks for n in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shards(fps: DataFrame, radius: int, size: int = SHARD) -> DataFrame:
    """``(shard, fp, node)``: any two fingerprints of a kind within ``radius`` bits share a shard of bounded size."""
    blocks = _blocks(64, radius + 1)
    fp = F.col("fp")

    def turned(first: int, n: int):
        """The bits outside a block, as the low 64 - n bits."""
        top = first + n
        low = _bits(fp, 0, first) if first else F.lit(0).cast("bigint")
        high = F.shiftrightunsigned(fp, top) if top < 64 else F.lit(0).cast("bigint")
        return F.shiftleft(high, first).bitwiseOR(low)

    def shard(*parts: Column) -> Column:
        """A hash whose low bits are the kind: kinds never meet, whatever the hash."""
        return F.shiftleft(F.xxhash64(*parts), _KIND_BITS).bitwiseOR(F.col("kind").cast("bigint"))

    dealt = fps.select(
        "kind", "fp", "node",
        F.explode(F.array(*[
            F.struct(shard(F.lit(k), _bits(fp, a, n)).alias("shard"), turned(a, n).alias("rest"), F.lit(64 - n).alias("n"))
            for k, (a, n) in enumerate(blocks)
        ])).alias("s"),
    ).select("kind", "fp", "node", "s.*")

    def large(df: DataFrame) -> DataFrame:
        return df.groupBy("shard").count().where(F.col("count") > size)

    hot = large(dealt)
    small = dealt.join(hot, "shard", "left_anti").select("shard", "fp", "node")
    again = join_unique(dealt, hot, ["shard"]).select(
        "kind", "fp", "node",
        F.explode(F.flatten(F.array(*[
            F.when(F.col("n") == free, F.array(*[
                shard(F.col("shard"), F.lit(k), _bits(F.col("rest"), a, n)) for k, (a, n) in enumerate(_blocks(free, radius + 1))
            ])).otherwise(F.array().cast("array<bigint>"))
            for free in sorted({64 - n for _, n in blocks})
        ]))).alias("shard"),
    )
    again = written(again, "shards")
    hot = large(again)
    small = small.unionByName(again.join(hot, "shard", "left_anti").select("shard", "fp", "node"))
    n = F.ceil(F.col("count") / size).cast("int")
    chunks = (
        join_unique(again, hot, ["shard"])
        .select("kind", "shard", "fp", "node", n.alias("n"), F.pmod(F.xxhash64("fp"), n).cast("int").alias("c"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(shard(F.col("shard"), F.least("c", "o"), F.greatest("c", "o")).alias("shard"), "fp", "node")
    )
    return small.unionByName(chunks)


def links(fps: DataFrame, radius: int, size: int = SHARD) -> DataFrame:
    """Edges ``(a, b)`` between nodes that connect every two fingerprints of a kind within ``radius`` bits.

    ``fps(kind, fp, node)`` has each fingerprint of a kind once.  Each shard gives a star per
    group of connected members, not all its pairs.
    """
    dealt = shards(fps, radius, size)
    bins = max(1, -(-(radius + 1) * fps.count() // BIN))

    def search(group: pa.Table) -> pa.Table:
        shard, fp, node = (group.column(c).to_numpy() for c in ("shard", "fp", "node"))
        order = np.lexsort((fp, shard))
        shard, fp, node = shard[order], fp[order].view(np.uint64), node[order]
        forest = BKForest(shard, fp)
        pairs = [
            forest.links(np.arange(n, min(n + _QUERIES, len(fp))), radius) for n in range(0, len(fp), _QUERIES)
        ]
        label = _stars(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), len(fp))
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    return (
        dealt.withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(bins)))
        .groupBy("bin")
        .applyInArrow(search, "a bigint, b bigint")
    )


def near_duplicates(
    df: DataFrame, key: str, text: str, width: int = 4, seed: int = 42, radius: int = 4, size: int = SHARD
) -> DataFrame:
    """``(key, fp, component_id)`` per row; ``component_id`` is the smallest key of its component.

    Words are runs of non-blank characters after A-Z are lower-cased; texts of fewer than
    ``width`` words are one shingle.  Rows without words share fingerprint 0 and are linked.
    Repeated rows stay repeated.  A null key is never the smallest; a component of null
    keys only has a null id.  Other columns are not carried.
    """
    rows = written(fingerprints(df, key, text, width, seed), "fingerprints")
    # The same fingerprint is one node, however many rows have it.
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links(_one_kind(nodes), radius, size)).withColumnRenamed("node", "fp")
    linked = join_unique(nodes, roots, ["fp"])
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (
        join_unique(linked, least, ["root"])
        .select("fp", "component_id")
        .unionByName(nodes.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id")))
    )
    return join_unique(rows, named, ["fp"]).select(key, "fp", "component_id")


def _one_kind(fps: DataFrame) -> DataFrame:
    return fps.select(F.lit(0).alias("kind"), "fp", F.col("fp").alias("node"))


def _normalized(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_UPPER).split())


def shingle_set(text: str, width: int = JACCARD_WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words: of the text as a whole."""
    parts = [np.unique(h) for h in shingle_hashes(text, width, 42)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands(shingles: np.ndarray) -> list[int]:
    """A hash per band of ``BAND`` min-wise hashes, which no other band has: two sets agree in each with a probability of their similarity."""
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), _MIXED):
        least = np.minimum(least, (shingles[start : start + _MIXED] * _FACTORS + _TERMS).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND).T:
        out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; of two empty ones: 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketches(df: DataFrame, key: str, text: str, width: int, several: int) -> DataFrame:
    """``(key, same, size, fps, bands)``: a hash of all words, equal for equal texts only, number of shingles, fingerprints, bands."""
    import xxhash

    bounded_batches(df.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            same = [xxhash.xxh3_128_digest(_normalized(t)) for t in texts]
            fps = [several_fingerprints(t, width, several) for t in texts]
            sized = [(len(x), bands(x)) for x in map(shingle_set, texts)]
            sizes = pa.array([n for n, _ in sized], pa.int64())
            longs = (pa.array(x, pa.list_(pa.int64())) for x in (fps, [x for _, x in sized]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), sizes, *longs], names=[key, "same", "size", "fps", "bands"]
            )

    schema = f"`{key}` bigint, same binary, size bigint, fps array<bigint>, bands array<bigint>"
    return df.select(F.col(key), text_of(text).alias("_text")).mapInArrow(run, schema)


def _texts_of(wanted: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """``(_key, _text)`` of the documents ``wanted(n)`` and a few others.

    A bit map of hashed keys, of at most ``_MAP`` bits, keeps the texts of all other documents out of the shuffle.
    """
    at = F.pmod(F.xxhash64("n"), F.lit(_MAP))
    found = (
        wanted.groupBy(F.expr(f"pmod(xxhash64(n), {_MAP}) div 64").alias("at"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(n), {_MAP}) % 64 as int))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(_MAP // 64, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            inside = (held[place >> 6] >> (place & 63)) & 1 == 1
            yield batch.select([0, 1]).filter(pa.array(inside))

    docs = df.select(F.col(key).alias("n"), text_of(text).alias("_text"))
    return docs.select(F.col("n").alias("_key"), "_text", at.alias("at")).mapInArrow(run, "_key bigint, _text string")


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` of keys whose texts have a Jaccard similarity of ``least`` or more.

    Exact over the sets of five-word shingles.  ``b`` may be a hub: its text comes once to every ``_MEMBERS`` of its
    pairs, about, ahead of theirs, and its set is kept from row to row.
    """
    parts = F.ceil(F.col("c") / _MEMBERS)
    sizes = pairs.groupBy("b").agg(F.count("*").alias("c"))
    part = F.pmod(F.xxhash64("a"), parts).cast("int").alias("part")
    pairs = written(join_unique(pairs, sizes, ["b"]).select("a", "b", part), "pairs")
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("n")), df, key, text)
    hubs = pairs.select("b", "part").distinct()
    hubs = join_unique(hubs, texts.withColumnRenamed("_key", "b"), ["b"]).select("b", "part", F.lit(None).cast("bigint").alias("a"), "_text")
    members = join_unique(pairs, texts.withColumnRenamed("_key", "a"), ["a"]).select("b", "part", "a", "_text")
    both = hubs.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            b, a, texts = batch.column(0), batch.column(2), batch.column(3)
            near = np.zeros(batch.num_rows, bool)
            for n in range(batch.num_rows):
                found = shingle_set(texts[n].as_py())
                if a[n].is_valid:
                    near[n] = jaccard(found, held) >= least
                else:
                    held = found
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a bigint, b bigint")


def near_copies(
    df: DataFrame, key: str, text: str, width: int = 2, several: int = 8, radius: int = 4, size: int = SHARD
) -> DataFrame:
    """``(key, component_id)`` per row, for copies with edits; ``key`` is a unique long.

    Candidates are documents of which any of ``several`` independent fingerprints, over sets of
    ``width``-word shingles, are linked, and documents that agree in a band of min-wise hashes, which
    finds a similarity of 0.8 or more wherever the edits lie.  Each link between different texts is an
    edge only if the Jaccard similarity of their five-word shingles is ``LEAST`` or more.

    Sets whose sizes alone keep them below ``LEAST`` are not compared.
    A document is compared with the candidate that it agrees with most often, and with the others only if that leaves them apart.
    Members of a band are compared with its smallest node.  Where that leaves members apart, they meet in one task, which
    compares those that are still apart unless marks of their sets show that they are not similar; so every two members of a band
    that are similar are connected.  Bands too large for a task are cut into chunks, and every two chunks meet.  Before, the members of such a band
    are compared with nodes that are drawn anew for each band and round, until a round links nothing more: one comparison
    a member and band connects most of a dense group.  A node that all of a band have met leaves the band, and no pair of texts is compared twice.
    Texts without words are one text.
    """
    if several >= 1 << _KIND_BITS:
        raise ValueError("too many fingerprints")
    rows = written(sketches(df, key, text, width, several), "sketches")
    # The same text is one node, however many rows have it.
    nodes = written(rows.groupBy("same").agg(*(F.min_by(c, key).alias(c) for c in ("size", "fps", "bands")), F.min(key).alias("node")), "nodes")
    spread = nodes.select("node", F.posexplode("fps").alias("kind", "fp"))
    # A fingerprint stands for the smallest node that has it.
    first = written(spread.groupBy("kind", "fp").agg(F.min("node").alias("first")), "first")
    shared = join_unique(spread, first, ["kind", "fp"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    agreed = nodes.select("node", F.explode("bands").alias("band"))
    heads = agreed.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    agreed = written(join_unique(agreed, heads, ["band"]).where("node != b"), "agreed")

    found = shared.unionByName(links(first.withColumnRenamed("first", "node"), radius, size))
    found = found.unionByName(agreed.select(F.col("node").alias("a"), "b")).where("a != b")
    found = written(_unordered(found, F.max(F.struct("a", "b")).alias("p"), F.count("*").alias("c")).select("p.*", "c"), "candidates")
    roots = written(nodes.select("node", F.col("node").alias("root"), "size"), "roots")
    likely = _rooted(found, roots)
    best = likely.groupBy("a").agg(F.min(F.struct(-F.col("c"), "b", "root_a", "root_b")).alias("best")).select("a", "best.*")
    best = written(best.select(*_ENDS), "best")
    roots, _ = _connected(roots, best, df, key, text)
    others = likely.select("a", "b").join(best, ["a", "b"], "left_anti")
    roots, _ = _connected(roots, _rooted(others, roots), df, key, text)
    members = written(_apart(agreed.select("node", "band"), roots).select("node", "band", "n"), "members")
    large = members.where("n > 1").select("node", "band")
    if not large.isEmpty():
        large, roots = _thinned(large, roots, found, df, key, text)
    members = members.where("n = 1").select("node", "band").unionByName(large)
    roots, _ = _connected(roots, _met(members, roots, df, key, text), df, key, text)
    named = join_unique(nodes.select("same", "node"), roots, ["node"]).select("same", F.col("root").alias("component_id"))
    return join_unique(rows.select(key, "same"), named, ["same"]).select(key, "component_id")


def _unordered(pairs: DataFrame, *found: Column) -> DataFrame:
    """``(x, y)``, the smaller end first, and what is ``found`` of all ``pairs(a, b)`` of these ends."""
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(*found)


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that are not connected and may be similar, with ``root_a`` and ``root_b``."""
    for side in ("a", "b"):
        of_side = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"), F.col("size").alias(f"size_{side}"))
        pairs = join_unique(pairs, of_side, [side])
    return written(pairs.where("root_a != root_b").where(_alike()).drop("size_a", "size_b"), "apart")


def _alike() -> Column:
    """Two sets are not more similar than the smaller size is to the larger one."""
    return F.try_divide(F.least("size_a", "size_b"), F.greatest("size_a", "size_b")) >= LEAST


def _connected(roots: DataFrame, pairs: DataFrame, df: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``roots(node, root)`` with the similar ones of ``pairs(a, b, root_a, root_b)`` connected, and whether there are any."""
    near = written(verified(pairs.select("a", "b"), df, key, text), "near")
    if near.isEmpty():
        return roots, False
    # Between roots only: what is connected is not gone through again.
    edges = join_unique(near, pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(join_unique(roots, moved, ["root"], "left").select("node", F.coalesce("to", "root").alias("root"), "size"), "roots"), True


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, band, root, size, n)`` of ``members(node, band)``: of bands with the same members one, none whose members are all connected.

    Members of a band are met in ``n`` chunks.
    """
    rooted = join_unique(members, roots, ["node"])
    chunks = F.ceil(F.greatest(F.sum("size") / _MET, F.count("*") / SHARD)).cast("int")
    bands = rooted.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), chunks.alias("n"),
        F.struct(F.count("*"), *(F.bit_xor(F.xxhash64("node", F.lit(n))) for n in range(2))).alias("all"),
    )
    bands = bands.where("low < high").groupBy("all").agg(F.min(F.struct("band", "n")).alias("one")).select("one.*")
    return join_unique(rooted, bands, ["band"])


def _met(members: DataFrame, roots: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """Similar pairs ``(a, b, root_a, root_b)``, one for two roots, that connect all similar ``members(node, band)`` of a band."""
    apart = written(_apart(members, roots), "apart")
    # A chunk meets itself and each other one.
    dealt = apart.withColumn("c", F.pmod(F.xxhash64("node"), "n").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    shard = F.xxhash64("band", F.least("c", "o"), F.greatest("c", "o"))
    texts = _texts_of(apart.select(F.col("node").alias("n")), df, key, text).withColumnRenamed("_key", "node")
    dealt = dealt.select(shard.alias("shard"), "node", "root", F.when(F.col("c") != F.col("o"), F.col("c")).alias("side"))
    dealt = join_unique(dealt, texts, ["node"]).select("shard", "node", "root", "side", "_text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in itertools.groupby(rows, lambda row: row[0]):
            _, node, root, side, sets = zip(*((*row[:4], shingle_set(row[4])) for row in group), strict=True)
            # A chunk that meets itself has no sides, so all its members are of different ones.
            side = np.array([-1 - n if x is None else x for n, x in enumerate(side)])
            found = [(node[i], node[j], root[i], root[j]) for i, j in similar(np.array(root), side, sets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((),) * 4)], names=[*_ENDS])

    pairs = dealt.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, ", ".join(f"{c} bigint" for c in _ENDS))
    ends = [F.least("root_a", "root_b"), F.greatest("root_a", "root_b")]
    return written(pairs.groupBy(*ends).agg(F.min(F.struct(*_ENDS)).alias("p")).select("p.*"), "met")


def similar(root: np.ndarray, side: np.ndarray, sets: Sequence[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of similar ``sets``, of different roots and sides, that connect all such pairs.

    Each set has a bit for each of its hashes, of which several may share one.  A bit that only one set has stands for a
    hash at least that only this one has, so two sets with too many of these are not similar.
    """
    sizes = np.array([len(s) for s in sets])
    bits = min(_MARKS, max(64, 1 << int(8 * sizes.max(initial=1) - 1).bit_length()))
    marks = np.zeros((len(sets), bits // 64), np.uint64)
    for n, s in enumerate(sets):
        mark = np.zeros(bits, bool)
        mark[s & np.uint64(bits - 1)] = True
        marks[n] = np.packbits(mark).view(np.uint64)
    label = np.unique(root, return_inverse=True)[1]
    for i in range(1, len(sets)):
        others = np.flatnonzero((label[:i] != label[i]) & (side[:i] != side[i]))
        others = others[np.minimum(sizes[others], sizes[i]) >= LEAST * np.maximum(sizes[others], sizes[i])]
        own = np.bitwise_count(marks[i] & ~marks[others]).sum(axis=1, dtype=np.int64)
        theirs = np.bitwise_count(marks[others] & ~marks[i]).sum(axis=1, dtype=np.int64)
        both = np.minimum(sizes[i] - own, sizes[others] - theirs)
        possible = both >= LEAST * (sizes[i] + sizes[others] - both)
        for j in others[possible][np.argsort(-both[possible], kind="stable")].tolist():
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= LEAST:
                yield i, j
                label[label == label[j]] = label[i]


def _thinned(
    members: DataFrame, roots: DataFrame, found: DataFrame, df: DataFrame, key: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """``members(node, band)`` that are left, and ``roots``, after rounds of comparisons with drawn nodes; ``found`` were compared before."""
    compared = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    for draw in itertools.count(1):
        members, pairs = _drawn(members, roots, draw)
        # The same pair may be drawn in several bands, and either way round.
        pairs = _unordered(pairs, F.max(F.struct(*_ENDS)).alias("p")).join(compared, ["x", "y"], "left_anti").select("p.*")
        pairs = written(pairs, "drawn")
        roots, linked = _connected(roots, pairs, df, key, text)
        if not linked:
            return members, roots
        compared = compared.unionByName(_unordered(pairs, F.count("*")).select("x", "y"))


def _drawn(members: DataFrame, roots: DataFrame, draw: int) -> tuple[DataFrame, DataFrame]:
    """One round: ``(node, band)`` of the ``members`` that are left, and pairs ``(a, b, root_a, root_b)`` to be compared.

    Bands whose members are all connected are left out; so are drawn nodes, which all others of their band meet now.
    """
    rooted = join_unique(members, roots, ["node"])
    rank = F.xxhash64("band", "node", F.lit(draw))
    heads = rooted.groupBy("band").agg(
        F.min_by(F.struct("node", "root", "size"), rank).alias("head"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    heads = heads.where("low < high").select(
        "band", F.col("head.node").alias("b"), F.col("head.root").alias("root_b"), F.col("head.size").alias("size_b")
    )
    rooted = written(join_unique(rooted, heads, ["band"]).where("node != b"), "members")
    pairs = rooted.withColumnsRenamed({"node": "a", "root": "root_a", "size": "size_a"}).where("root_a != root_b").where(_alike())
    return rooted.select("node", "band"), pairs.select(*_ENDS)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
