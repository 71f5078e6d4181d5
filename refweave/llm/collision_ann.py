"""Approximate nearest neighbours by collision counting.

Each block of vectors has one sorted array per random projection.  A query centres a
window in each array and widens all windows together, round by round (virtual
rehashing: the radius grows, the buckets are never built).  A vector that lies in
enough of a query's windows has collided often enough to be verified by its exact
cosine.  A query leaves a block when enough verified vectors are within the radius of
the round, or when enough have been verified: ``LEAST`` or ``SHARE`` of the block, besides as many as are asked for.
The first radius of a block is the one at which few of its vectors would collide with one another.

A window is a range of places in its sorted array, its ends rounded outwards to one of ``PLACES`` equal steps.  So a
vector is in it if its place there is, and one pass over the places of a block, a byte each, counts the collisions
of all its vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

PROJECTIONS, PLACES = 240, 255  # both are counted in 8 bits
THRESHOLD = 0.55  # share of windows to lie in; a vector at the radius lies in 0.68 of them
SHARE, LEAST = 0.03, 200  # of a block that is verified before a query leaves it, and a number of vectors
GROWTH, LEAP, BEGIN = 1.04, 1.25, 0.005  # of the radius in a round, and where few collide; share of a block that collides in the first one
BLOCK, QUERIES = 8192, 16384  # vectors and queries that meet in one task
SEED = 7
_APART = 1e3  # between the sorted arrays, which are searched as one
_SAMPLE = 64


class Block:
    """Vectors of one block with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray):
        self.ids, self.vectors, self.lines = ids, vectors, lines
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        values = lines @ (vectors / self.norms[:, None]).T
        order = np.argsort(values, axis=1, kind="stable")
        step = -(-len(ids) // PLACES)
        self.place = np.empty(values.shape, np.uint8)
        np.put_along_axis(self.place, order, (np.arange(len(ids)) // step).astype(np.uint8)[None, :], 1)
        self.apart = np.arange(len(lines)) * max(_APART, 4 * np.abs(values).max(initial=0))
        steps = np.take_along_axis(values, order[:, ::step], 1)
        self.begins = np.arange(len(lines)) * steps.shape[1]
        self.steps = (steps + self.apart[:, None]).ravel()
        self.first_radius = self._first_radius(values)
        self._offset, self._inside = np.empty_like(self.place), np.empty(self.place.shape, bool)

    def _first_radius(self, values: np.ndarray) -> float:
        """At which a share of the block, as seen in a sample of it, collides often enough with a vector of it."""
        some = np.linspace(0, len(self.ids) - 1, min(_SAMPLE, len(self.ids))).astype(int)
        apart = np.abs(values[:, some, None] - values[:, None, some])
        need = min(len(self.lines) - 1, int(np.ceil(THRESHOLD * len(self.lines))) - 1)
        radius = np.partition(apart, need, axis=0)[need][~np.eye(len(some), dtype=bool)]
        # Of equal vectors it would be nothing, and then it could not grow.
        return max(0.05, float(np.quantile(radius, BEGIN))) if len(radius) else 1.0

    def collisions(self, at: np.ndarray, radius: float) -> np.ndarray:
        """In how many windows of the radius around the projections ``at`` each vector lies."""
        low = np.searchsorted(self.steps, at + self.apart - radius, "right") - 1 - self.begins
        high = np.searchsorted(self.steps, at + self.apart + radius, "right") - self.begins
        low, n = np.maximum(low, 0).astype(np.uint8)[:, None], len(self.steps) // len(at)
        size = (np.clip(high, 0, n).astype(np.uint8)[:, None] - low)
        # Places below the window wrap around and are not in it either.
        np.subtract(self.place, low, out=self._offset)
        np.less(self._offset, size, out=self._inside)
        return np.add.reduce(self._inside.view(np.uint8), axis=0, dtype=np.uint8)

    def cosines(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        # Row sums, not a matrix product: equal vectors then have equal scores.
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)

    def search(self, query_id, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and cosines of the ``k`` best verified vectors, ties to smaller ids, and how many were verified."""
        norm = float(np.sqrt((query * query).sum()))
        at = self.lines @ (query / norm)
        need, enough = int(np.ceil(THRESHOLD * len(self.lines))), k + max(LEAST, SHARE * len(self.ids))
        other = self.ids != query_id
        verified = ~other
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        radius = self.first_radius
        while True:
            fresh = np.flatnonzero((self.collisions(at, radius) >= need) & ~verified)
            verified[fresh] = True
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self.cosines(fresh, query, norm)])
            # On the unit sphere, distance r is cosine 1 - r^2 / 2.
            within = int((scores >= 1 - radius * radius / 2).sum())
            if within >= k or len(rows) >= enough or verified.all():
                best = np.lexsort((self.ids[rows], -scores))[:k]
                return self.ids[rows[best]], scores[best], len(rows)
            radius *= GROWTH if len(rows) > enough / 100 else LEAP


def usable(vector: Column) -> Column:
    """Not null, not zero, and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``df`` nearest to each query by cosine.

    Rows with the query's own key are no candidates.  Vectors that are null, zero or
    hold null or non-finite components take no part, nor do null keys; vectors of different
    length do not meet.  Repeated rows of ``df`` are candidates each; queries of the same key
    are one query, with the least vector.  Fewer than ``k`` candidates are all returned.
    """
    kind = df.schema[key].dataType.simpleString()

    def clean(rows: DataFrame) -> DataFrame:
        vectors = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return vectors.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("d", F.size("v"))

    rows = clean(df)
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n_rows, n_asked = rows.count(), asked.count()
    blocks, parts = max(1, -(-n_rows // BLOCK)), max(1, -(-n_asked // QUERIES))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Rows of the same key may be many: they are dealt by vector too.
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("b", block).withColumn("p", every(parts))
    asked = asked.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("b", every(blocks))
    schema = f"query_id {kind}, vec_id {kind}, score double"
    id_type = to_arrow_type(df.schema[key].dataType)
    result = pa.schema([("query_id", id_type), ("vec_id", id_type), ("score", pa.float64())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        return np.asarray(table.column("id").to_pylist()), flat.reshape(table.num_rows, -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result.empty_table()
        ids, vectors = matrix(left)
        query_ids, query_vectors = matrix(right)
        lines = np.random.default_rng(seed).standard_normal((PROJECTIONS, vectors.shape[1]))
        order = np.lexsort((ids,))
        index = Block(ids[order], vectors[order], lines)
        out = [(q, *index.search(q, v, k)[:2]) for q, v in zip(query_ids, query_vectors, strict=True)]
        return pa.table(
            [
                pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).tolist(), id_type),
                pa.array(np.concatenate([i for _, i, _ in out]).tolist(), id_type),
                np.concatenate([s for _, _, s in out]),
            ],
            schema=result,
        )

    found = rows.groupBy("d", "b", "p").cogroup(asked.groupBy("d", "b", "p")).applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
