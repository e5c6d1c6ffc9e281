"""Hard negatives by a GNAT-style multiway hyperplane tree.

A node has a few split points; every vector goes to the nearest one. For each split point the node keeps the ranges of its distances to all of
the node's subtrees. A query asks for scores in a window, which is an annulus of distances about it; the distance from the query to a split point shifts the
annulus, and a subtree whose range does not meet it is left out. Leaves are exact: integer inner products.

Scores become distances by one more component, which gives all vectors of a block the same length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import finite, grid, ids_of, matrix, none_of, numbered, width_of

#: Split points of a node, vectors of a leaf, and vectors looked at for each split point when a node is made.
SPLITS, LEAF, TRIED = 8, 512, 8

_EXACT = 1 << 53


@dataclass
class Node:
    rows: np.ndarray
    points: np.ndarray | None = None  # split points, as vectors
    low: np.ndarray | None = None  # [i, j]: least and largest distance of split point i to the vectors of child j
    high: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


class Tree:
    """A tree over the vectors of a block. ``looked`` counts the pairs of vector and query that leaves have looked at."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, splits: int = SPLITS):
        self.leaf, self.splits, self.looked = leaf, splits, 0
        self.vectors = vectors
        self.scale = np.abs(vectors).max(initial=0) or 1.0
        unit = vectors / self.scale
        squares = (unit * unit).sum(axis=1)
        self.square = squares.max(initial=0)
        self.lifted = np.concatenate([unit, np.sqrt(np.maximum(0, self.square - squares))[:, None]], axis=1)
        self.slack = 1e-5 * (1 + math.sqrt(self.square))
        self.random = np.random.default_rng(11)
        self.root = self._node(np.arange(len(vectors)))

    def _node(self, rows: np.ndarray) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows)
        tried = self.lifted[self.random.choice(rows, min(len(rows), self.splits * TRIED), replace=False)]
        points, far = [tried[0]], _distances(tried[:1], tried)[0]
        while len(points) < self.splits and far.max() > 0:  # the next is the one farthest from those that there are
            points.append(tried[far.argmax()])
            far = np.minimum(far, _distances(points[-1][None, :], tried)[0])
        points = np.array(points)
        d = _distances(points, self.lifted[rows])
        nearest = d.argmin(axis=0)
        groups = [np.flatnonzero(nearest == j) for j in range(len(points))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # equal vectors: nothing can part them
            return Node(rows)
        low = np.array([[d[i, g].min() for g in groups] for i in range(len(points))])
        high = np.array([[d[i, g].max() for g in groups] for i in range(len(points))])
        return Node(rows, points, low, high, [self._node(rows[g]) for g in groups])

    def _radius(self, squares: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector has a score; ``squares`` are of the query."""
        return np.sqrt(np.maximum(0, squares + self.square - 2 * score))

    def search(self, q: Queries, k: int) -> None:
        """Gives ``q`` the best ``k`` of its windows."""
        unit = q.vectors / self.scale
        squares = (unit * unit).sum(axis=1)
        lifted = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)

        def visit(node: Node, who: np.ndarray) -> None:
            if not node.children:
                self.looked += len(node.rows) * len(who)
                for some in np.array_split(who, -(-len(who) * len(node.rows) // (1 << 21))):
                    q.offer(some, node.rows, self.vectors[node.rows], k)
                return
            d = _distances(lifted[who], node.points)
            for j in np.argsort([d[:, i].mean() for i in range(len(node.children))]):  # near ones first, which narrows windows
                inner = self._radius(squares[who], q.high[who] / self.scale**2)
                outer = self._radius(squares[who], q.low[who] / self.scale**2)
                nearest = np.maximum(node.low[:, j] - d, d - node.high[:, j]).max(axis=1)  # no vector of the child is nearer, or farther
                farthest = (d + node.high[:, j]).min(axis=1)
                left = who[(nearest <= outer + self.slack) & (farthest >= inner - self.slack)]
                if len(left):
                    visit(node.children[j], left)

        if len(self.vectors) and len(unit):
            visit(self.root, np.arange(len(unit)))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; too large ones for doubles by Python's integers."""
    if (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return a @ b.T
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[sum(x * y for x, y in zip(r, s, strict=True)) for s in whole[1]] for r in whole[0]], dtype=object)


class Queries:
    """Queries of a chunk, each with a window of scores that closes from below as better rows are found."""

    def __init__(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, labels: np.ndarray, own: np.ndarray, same: bool, block: tuple[np.ndarray, ...]):
        self.vectors, self.low, self.high, self.labels, self.own, self.same = vectors, low, high, labels, own, same
        self.block_labels, self.block_ids, self.block_null, self.block_rows = block
        self.best = [np.zeros(0, dtype=np.int64) for _ in vectors]
        self.scores = [np.zeros(0) for _ in vectors]

    def offer(self, who: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> None:
        scores = _products(self.vectors[who], vectors)
        fits = (self.labels[who][:, None] == self.block_labels[rows][None, :]) == self.same
        fits &= (scores >= self.low[who][:, None]) & (scores <= self.high[who][:, None])
        fits &= self.own[who][:, None] != self.block_rows[rows][None, :]
        for i in np.flatnonzero(fits.any(axis=1)):
            q, at = who[i], np.flatnonzero(fits[i])
            places, score = np.concatenate([self.best[q], rows[at]]), np.concatenate([self.scores[q], scores[i, at]])
            if len(score) > k:  # all ties of the k-th stay
                keep = score >= -np.partition(-score, k - 1)[k - 1]
                places, score = places[keep], score[keep]
            order = np.lexsort((self.block_rows[places], self.block_ids[places], ~self.block_null[places], -score))[:k]
            self.best[q], self.scores[q] = places[order], score[order]
            if len(order) == k:
                self.low[q] = max(self.low[q], score[order[-1]])


_FOUND = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, vec_id long, score long"


def _mine(k: int, same: bool, leaf: int):
    """The best ``k`` rows of a block for each query: of its own label without a window, or of other labels from 80 to 100 percent of its positive's score."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return none_of(_FOUND)
        width = width_of(rows, queries)
        vectors, wanted = (np.floor(256 * matrix(t.column("vector"), width)) for t in (rows, queries))
        column = lambda t, name: t.column(name).to_numpy()
        if same:
            low, high = np.full(len(wanted), -np.inf), np.full(len(wanted), np.inf)
        else:
            positive = column(queries, "positive_score")
            low, high = -((-4 * positive) // 5).astype(float), positive.astype(float)
        asked = np.flatnonzero(low <= high)  # a window below zero is empty
        block = (column(rows, "label"), *ids_of(rows.column("vec_id")), column(rows, "row"))
        q = Queries(wanted[asked], low[asked], high[asked], column(queries, "label")[asked], column(queries, "anchor_row")[asked], same, block)
        if len(asked):
            Tree(vectors, leaf).search(q, k)
        of = pa.array(np.repeat(asked, [len(b) for b in q.best]).astype(np.int64))
        at = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *q.best]))
        score = pa.array(np.concatenate([np.zeros(0), *q.scores]).astype(float).clip(-(2.0**63), 2.0**63 - 1024).astype(np.int64))
        return pa.table({c: queries.column(c).take(of) for c in ("anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score")} | {"row": rows.column("row").take(at), "vec_id": rows.column("vec_id").take(at), "score": score})

    return run


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Anchors are rows whose id is divisible by ``every``, their positives the best ``positives`` other rows of the same label, the negatives the best ``negatives`` rows of other
    labels with 80 to 100 percent of the positive's score; ties go to the smaller id. Rows with a null label or vector, or a null or non-finite component, take no part; shorter
    vectors count as if zeros followed. A null id is no anchor but may be found, and is smaller than any other. Rows that repeat an id are rows of
    their own. An empty table gives an empty one; other columns are ignored. Scores are longs; larger ones end at a long's bounds.

    Rows are dealt to blocks with a tree each, anchors to chunks, and each block meets each chunk; a block's best are merged.
    """
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)).cast("long")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), label.alias("label"))
    rows = numbered(rows.where(finite(F.col("vector")) & F.col("label").isNotNull()))
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "vector", "label")
    none = [F.lit(None).cast("long").alias(c) for c in ("positive_row", "positive_id", "positive_score")]
    near = grid(rows, anchors.select("*", *none), "anchor_row").applyInArrow(_mine(positives, True, leaf), _FOUND)
    near = _first(near, positives, "anchor_row").select("anchor_row", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = grid(rows, anchors.join(near, "anchor_row"), "anchor_row").applyInArrow(_mine(negatives, False, leaf), _FOUND)
    ranked = _first(found, negatives, "anchor_row", "positive_row")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined_sql() -> str:
    """The same for ids that do not repeat, in DuckDB."""
    return """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank, s.vec_id as negative_id,
  p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
qualify rank <= 5"""
