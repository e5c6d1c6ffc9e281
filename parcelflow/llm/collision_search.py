"""Nearest neighbours by collision-counting hashing.

Every vector has one sorted array of its projections for each of PROJECTIONS random directions. A query opens a window about its own projection in each
array; a vector that lies in at least ``threshold`` windows is verified. The windows belong to a radius, and grow with it by virtual
rehashing: only what a wider window has more is looked at. The search ends when the k-th best verified vector is no farther than the radius.

Largest inner products become nearest neighbours by one more component, which gives all vectors of a block the same length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import finite, grid, ids_of, matrix, none_of, numbered, width_of

#: Directions, half a window's width for radius 1, and how many standard deviations the threshold is below the collisions expected at the radius.
PROJECTIONS, HALF, SLACK = 64, 1.0, 1.0
#: The radius grows by this factor at most; it begins at half a distance that a few vectors show to be enough.
GROWTH, PROBE = 1.35, 256


def directions(width: int, count: int = PROJECTIONS, seed: int = 12) -> np.ndarray:
    """``count`` directions as columns, orthogonal in groups of ``width``; a projection of a random unit vector has variance 1."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-count // width))]
    return np.concatenate(groups, axis=1)[:, :count] * math.sqrt(width)


def threshold(count: int = PROJECTIONS) -> int:
    """Collisions that a vector at the radius has or exceeds but for chance."""
    p = math.erf(HALF / math.sqrt(2))
    return max(1, math.floor(count * p - SLACK * math.sqrt(count * p * (1 - p))))


class Block:
    """The sorted arrays of some vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        scale = np.abs(vectors).max(initial=0) or 1.0
        unit = vectors / scale
        squares = (unit * unit).sum(axis=1)
        self.length = math.sqrt(squares.max(initial=0)) or 1.0
        self.norm = scale * self.length
        lifted = np.concatenate([unit, np.sqrt(np.maximum(0, self.length**2 - squares))[:, None]], axis=1) / self.length
        self.directions = directions(lifted.shape[1])
        projected = (lifted @ self.directions).T
        self.apart = 4 * math.sqrt(lifted.shape[1]) + 8  # projections of one array are all between those of its neighbours
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = (np.take_along_axis(projected, self.order, axis=1) + self.apart * np.arange(len(projected))[:, None]).reshape(-1)
        self.order = self.order.reshape(-1)

    def near(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of at least the k nearest vectors found; row ``own`` is left out."""
        n = len(self.vectors)
        left = np.ones(n, dtype=bool)
        if own is not None:
            left[own] = False
        size = np.abs(query).max(initial=0)
        length = size * math.sqrt(((query / size) ** 2).sum())
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0)

        def verify(at: np.ndarray) -> float:
            """The distance of the k-th best after looking at some more vectors."""
            nonlocal places, scores
            left[at] = False
            places = np.concatenate([places, at])
            scores = np.concatenate([scores, (self.vectors[at] * query).sum(axis=1)])
            if len(scores) < k:
                return math.inf
            kth = -np.partition(-scores, k - 1)[k - 1]
            keep = scores >= kth  # all ties
            places, scores = places[keep], scores[keep]
            return math.sqrt(max(0.0, 2 - 2 * kth / self.norm / length))

        if left.sum() <= max(k, PROBE):
            verify(np.flatnonzero(left))
            return places, scores
        far = verify(np.flatnonzero(left[: PROBE + 1])[:PROBE])
        lifted = np.append(query / length, 0.0) @ self.directions + self.apart * np.arange(self.directions.shape[1])
        counts, enough, radius = np.zeros(n, dtype=np.int64), threshold(), max(far / 2, 1e-6) if far < math.inf else 0.5
        low = high = np.searchsorted(self.sorted, lifted)
        ends = np.arange(len(lifted) + 1) * n
        while True:
            a = np.maximum(np.searchsorted(self.sorted, lifted - HALF * radius), ends[:-1])
            b = np.minimum(np.searchsorted(self.sorted, lifted + HALF * radius, "right"), ends[1:])
            more = [self.order[x:y] for x, y in zip(a.tolist(), low.tolist(), strict=True)] + [self.order[x:y] for x, y in zip(high.tolist(), b.tolist(), strict=True)]
            counts += np.bincount(np.concatenate(more), minlength=n)
            low, high = a, b
            new = np.flatnonzero((counts >= enough) & left)
            if len(new):
                far = min(far, verify(new))
            if far <= radius:
                return places, scores
            if radius >= 2:  # as far as two vectors can be
                verify(np.flatnonzero(left))
                return places, scores
            radius = min(GROWTH * radius, far)


_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return none_of(_FOUND)
        width = width_of(rows, queries)
        block, wanted = Block(matrix(rows.column("vector"), width)), matrix(queries.column("vector"), width)
        ids, null = ids_of(rows.column("vec_id"))
        numbers = rows.column("row").to_numpy()
        place = {r: i for i, r in enumerate(numbers.tolist())}
        of, at, score = [], [], []
        for i, r in enumerate(queries.column("row").to_pylist()):
            places, scores = block.near(wanted[i], k, place.get(r))
            best = np.lexsort((numbers[places], ids[places], ~null[places], -scores))[:k]
            of.append(np.full(len(best), i))
            at.append(places[best])
            score.append(scores[best])
        join = lambda x, kind: np.concatenate([np.zeros(0, dtype=kind), *x]).astype(kind)
        of, at = pa.array(join(of, np.int64)), pa.array(join(at, np.int64))
        return pa.table(
            {
                "query_row": queries.column("row").take(of), "query_id": queries.column("vec_id").take(of),
                "row": rows.column("row").take(at), "vec_id": rows.column("vec_id").take(at), "score": pa.array(join(score, np.float64)),
            }
        )

    return run


def taking_part(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, row) of the rows that can be searched."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return numbered(rows.where(finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearness is the inner product, ties go to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part; shorter ones
    count as if zeros followed. A null id is no query but may be found, and is smaller than any other. Rows that repeat an id are rows of their own: each
    finds the others and, if a query, has its own result. An empty table gives an empty one; other columns are ignored.

    Rows are dealt to blocks, queries to chunks, and each block meets each chunk; a block's best k of a query are merged. No candidate
    is capped: all that collide often enough are verified, and all rows if a radius passes the largest distance there is.
    """
    rows = taking_part(embeddings, id_col, vector_col)
    found = grid(rows, rows.where(F.col("vec_id") % every == 0)).applyInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
