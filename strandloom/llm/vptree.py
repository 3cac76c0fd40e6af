"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

All vectors get one more coordinate, so that each has the largest norm of the table; queries get a
zero there. Then the largest inner product is the smallest Euclidean distance, for which the triangle
inequality holds. A node has a vantage point and the median distance to it; the far half of a
node is visited only if the query lies within ``factor`` times its current k-th distance of the
border. Factor one is exact search; a smaller factor prunes more and may miss neighbours.

Lengths are taken of vectors divided by a power of two, one for the table and one for each query, so that no square
overflows; such a division leaves the digits of a product as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import bounded_batches

SHARD_ROWS = 4096
#: Rows that are compared with a block of queries at once. Exact search visits most leaves where vectors have no
#: clusters: small ones cost it more in steps than they save. A relaxed one leaves out a leaf as a whole.
LEAF_ROWS, EXACT_LEAF_ROWS = 96, 512
QUERY_ROWS = 512
#: Blocks of queries that meet a shard in one task.
GROUP_BLOCKS = 16
#: Keeps the longest norm itself below the largest double; a power of two.
HEADROOM = 1 << 20
#: Bound on the rounding of an inner product, in products of norms.
ROUNDING = 1e-12


class Tree:
    """Vantage-point tree over the distinct vectors of a shard, searched by blocks of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float, members: int, leaf_rows: int):
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(1)
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(ids))
        # Equal vectors tie, so of each only the smallest ids can be among the nearest.
        self.members = [np.unique(ids[a:b])[:members] for a, b in zip(starts, ends)]
        self.vectors = vectors[starts]
        self.norm2, self.leaf_rows = norm2, leaf_rows
        lift = np.sqrt(np.maximum(0.0, norm2 - (self.vectors**2).sum(1)))
        self.points = np.column_stack([self.vectors, lift])
        self.root = self._build(np.arange(len(starts)))

    def _build(self, rows: np.ndarray):
        """A leaf is its rows; a node is (vantage, radius, inside, outside)."""
        if len(rows) <= self.leaf_rows:
            return rows
        # The row farthest from the first one: a corner sees the others at differing distances.
        far = ((self.points[rows] - self.points[rows[0]]) ** 2).sum(1).argmax()
        vantage = rows[far]
        rest = np.delete(rows, far)
        away = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(1))
        radius = np.median(away)
        inside = away <= radius
        if inside.all():  # many at one distance
            return rows
        return vantage, radius, self._build(rest[inside]), self._build(rest[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` nearest distinct vectors per query and their inner products; -1 where
        there are fewer."""
        best = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), -1)
        worst = np.full(len(queries), -np.inf)
        # A query's own length does not change its order: for distances it has that of the points.
        length = np.sqrt(self.norm2 / (queries**2).sum(1))
        base = 2 * self.norm2
        slack = 1e-7 * np.sqrt(base)  # an error of the last digit of a square is this much of a small root

        def distance(who, scores):
            return np.sqrt(np.maximum(0.0, base - 2 * length[who] * scores))

        def offer(who, rows):
            scores = queries[who] @ self.vectors[rows].T
            some = np.flatnonzero(scores.max(1) >= worst[who])  # the others keep what they have
            if len(some):
                who, new = who[some], scores[some]
                both = np.concatenate([best[who], new], 1)
                ids = np.concatenate([found[who], np.broadcast_to(rows, new.shape)], 1)
                top = np.argpartition(-both, k - 1, 1)[:, :k]
                best[who] = np.take_along_axis(both, top, 1)
                found[who] = np.take_along_axis(ids, top, 1)
                worst[who] = best[who].min(1)
            return scores

        def visit(node, who):
            if isinstance(node, np.ndarray):
                offer(who, node)
                return
            vantage, radius, inside, outside = node
            score = offer(who, np.array([vantage]))[:, 0]
            away = distance(who, score)
            near = away <= radius
            for group, first, second in ((near, inside, outside), (~near, outside, inside)):
                if group.any():
                    own, gap = who[group], np.abs(away[group] - radius)
                    visit(first, own)
                    reach = distance(own, worst[own])
                    left = gap <= factor * reach + slack
                    if left.any():
                        visit(second, own[left])

        visit(self.root, np.arange(len(queries)))
        return found, best

    def ranked(self, query: np.ndarray, rows: np.ndarray, name: int, k: int) -> list[tuple[float, int]]:
        """The ``k`` nearest (negative score, id) among the members of ``rows``, without ``name``."""
        # Summed the same way for every vector, so that equal scores tie.
        scores = (self.vectors[rows] * query).sum(1)
        pairs = {(-s, i) for s, r in zip(scores.tolist(), rows.tolist())
                 for i in self.members[r].tolist() if i != name}
        return sorted(pairs)[:k]

    def tying(self, query: np.ndarray, least: float) -> np.ndarray:
        """All rows that score ``least`` or more, however many tie there."""
        return np.flatnonzero((self.vectors * query).sum(1) >= least)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with a key and a vector that is neither null, empty nor zero and has finite components
    only, as (key, vector of doubles)."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vectors.select(F.col(key).cast("long").alias("key"), v.alias("vector")).where(
        F.col("key").isNotNull() & F.coalesce(fine, F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten()).reshape(-1, width)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """For each query its ``k`` nearest among ``vectors``: query_id, rank, vec_id, score.

    Nearest is the largest inner product in double precision, ties go to the smaller key, and a
    query's own key is no candidate of its own. Rows that ``usable`` leaves out take no part. Vectors of
    differing lengths never meet. Repeated rows count once. Each shard holds SHARD_ROWS vectors by
    a hash of their key, whatever their values; each (shard, group of query blocks) is one task's
    work, and merging goes in two steps. A query whose k-th score ties with the last that the search of
    a shard kept meets all vectors of the shard, so that no tie is cut. Scores beyond the largest double are
    infinite, ranked as they would be without that bound. Other columns play no part; empty inputs give no rows.
    """
    bounded_batches(vectors.sparkSession)
    items = usable(vectors, key, vector).withColumn("dim", F.size("vector"))
    asked = usable(queries, key, vector).withColumn("dim", F.size("vector"))
    most = F.array_max(F.transform("vector", F.abs))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("_most")) * (x / F.col("_most")))
    rows, longest = items.withColumn("_most", most).agg(
        F.count("*"), F.max(F.col("_most") / HEADROOM * F.sqrt(squares))).first()
    n_asked = asked.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    blocks = max(1, -(-n_asked // QUERY_ROWS))
    groups = -(-blocks // GROUP_BLOCKS)
    power = int(np.frexp(longest or 1.0)[1]) + HEADROOM.bit_length() - 1
    norm2 = float(np.ldexp(longest or 1.0, HEADROOM.bit_length() - 1 - power)) ** 2 * (1 + 1e-12)

    placed = items.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    spread = placed if groups == 1 else placed.withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = spread if "group" in spread.columns else spread.withColumn("group", F.lit(0))
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks))
    each = asked.distinct().select(
        "key", "vector", "dim", (block % groups).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    by = ["dim", "shard", "group"]
    leaf_rows = EXACT_LEAF_ROWS if factor >= 1 else LEAF_ROWS

    def search(items: pa.Table, asked: pa.Table) -> pa.Table:
        parts, exponents = [], []
        if items.num_rows and asked.num_rows:
            width = items["dim"][0].as_py()
            scaled = np.ldexp(_matrix(items["vector"], width), -power)
            tree = Tree(np.array(items["key"]), scaled, norm2, k + 1, leaf_rows)
            names, points = np.array(asked["key"]), _matrix(asked["vector"], width) + 0.0
            powers = np.frexp(np.abs(points).max(1))[1]
            points = np.ldexp(points, -powers[:, None])
            shard = items["shard"][0].as_py()
            for at in range(0, len(names), QUERY_ROWS):
                who, block = names[at : at + QUERY_ROWS], points[at : at + QUERY_ROWS]
                found, best = tree.search(block, k + 8, factor)
                for name, point, row, low in zip(who.tolist(), block, found, best.min(1).tolist()):
                    pairs = tree.ranked(point, row[row >= 0], name, k)
                    # What the search left out scores at most ``low``, but for the rounding of its sums.
                    least = -pairs[-1][0] if len(pairs) == k else -np.inf
                    if row.min() >= 0 and least <= low + ROUNDING * (norm2 * (point**2).sum()) ** 0.5:
                        pairs = tree.ranked(point, tree.tying(point, least), name, k)
                    parts.append((name, shard, [{"n": s, "i": i} for s, i in pairs]))
            exponents = (powers + power).tolist()
        return pa.table({
            "query_id": pa.array([p[0] for p in parts], pa.int64()),
            "shard": pa.array([p[1] for p in parts], pa.int32()),
            "near": pa.array([p[2] for p in parts],
                             pa.list_(pa.struct([("n", pa.float64()), ("i", pa.int64())]))),
            "power": pa.array(exponents, pa.int32()),
        })

    found = spread.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(
        search, "query_id long, shard int, near array<struct<n: double, i: bigint>>, power int")

    def merged(df: DataFrame, *names) -> DataFrame:
        near = F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("near")))), 1, k)
        return df.groupBy(*names).agg(near.alias("near"), F.max("power").alias("power"))

    some = max(1, int(shards**0.5))
    half = merged(found, "query_id", (F.col("shard") % some).alias("part"))
    full = merged(half, "query_id")
    half = F.shiftright("power", 1)  # either half of the scale is a double where the score is one
    score = -F.col("hit.n") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.col("power") - half)
    return full.select("query_id", "power", F.posexplode("near").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.i").alias("vec_id"), score.alias("score"))
