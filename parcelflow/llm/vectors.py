"""What the vector operators share: rows that take part, blocks of rows against chunks of queries, arrays of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rows of a block and queries of a chunk: a task holds one of each, some ten MB.
BLOCK_ROWS, CHUNK_ROWS = 16_384, 1_024


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers (256 times over, too)."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * 256) < F.lit(float("inf")), F.lit(False)))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row``, a number of each row, in a written table: it tells rows apart that repeat their id."""
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def grid(rows: DataFrame, queries: DataFrame, key: str = "row", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS):
    """Every block of ``rows`` with every chunk of ``queries``, as cogroups.

    Rows are dealt to blocks and queries to chunks by hashes of their numbers, so that no value can make one larger.
    """
    blocks, chunks = max(1, -(-rows.count() // block_rows)), max(1, -(-queries.count() // chunk_rows))
    of = lambda c, n: F.pmod(F.xxhash64(F.lit(n), c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", of("row", blocks)).withColumn("chunk", every(chunks))
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, where both are of one table
    right = queries.withColumn("chunk", of(key, chunks)).withColumn("block", every(blocks))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))


def none_of(schema: str) -> pa.Table:
    """An empty table: what a block without queries, or a chunk without rows, gives."""
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles; missing components count as zero."""
    out = np.zeros((len(column), width))
    sizes = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def width_of(*tables: pa.Table) -> int:
    """The most components that a vector of the tables has, at least one."""
    return max([1, *(pa.compute.max(pa.compute.list_value_length(t.column("vector"))).as_py() or 0 for t in tables)])


def ids_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which are null; nulls sort first."""
    null = column.is_null().to_numpy()
    return column.fill_null(0).to_numpy(), null
