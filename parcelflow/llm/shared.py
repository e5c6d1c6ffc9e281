"""Table access and intermediate tables for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a local folder is made on a single machine (tests); on a cluster that is an error.
    """
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if found:
        return found
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives any executor."""
    path = new_folder(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has made in the shared one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``written`` makes meanwhile is deleted at the end; results have to be written elsewhere before that."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            removed(spark, path)


def sampled(hashed: Column, rows: int, total: int) -> Column:
    """Whether a 64-bit hash is among the lowest ``rows`` of ``total``, about; exact to one part in 2^64 at any size."""
    return hashed < F.lit(-(1 << 63) + (rows << 64) // total) if rows < total else F.lit(True)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``tables``."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Copies of one row that are dealt out by one task.
COPIES = 50_000


def cut_copies(df: DataFrame, copies: str, chunk: str) -> DataFrame:
    """Rows that stand for ``copies`` rows each, cut into rows that stand for COPIES at most; ``chunk`` numbers them from 0."""
    at, left = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES))), fresh("left", df)
    cut = df.withColumn(chunk, at).withColumn(left, F.least(F.lit(COPIES).cast("long"), F.col(copies) - F.col(chunk) * COPIES))
    return cut.drop(copies).withColumnRenamed(left, copies)


def dealt(df: DataFrame, copies: str) -> DataFrame:
    """Every row as often as its ``copies`` says, without that column, with a number ``copy`` from 0.

    Rows of very many copies are cut first and the cuts spread over all tasks; other rows are not exchanged.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few, many = df.where(F.col(copies) <= COPIES), df.where(F.col(copies) > COPIES)
    chunk = fresh("chunk", df)
    spread = cut_copies(many, copies, chunk)
    whole = few.withColumn(chunk, F.lit(0).cast("long")).unionByName(spread.repartition(parts, *columns(spread)))
    first = F.col(chunk) * COPIES
    return whole.withColumn("copy", F.explode(F.sequence(first, first + F.col(copies) - 1))).drop(chunk, copies)


class Marks:
    """A bit map of 64-bit hashes, so that rows which surely have none of them need no exchange.

    It has sixteen bits for each hash, but 2^23 at least and 2^27 at most: it is a table of at most 4,096 rows of 4 KB,
    and only this is broadcast. Beyond some 10^8 hashes it tells few rows apart and more rows are exchanged; no result
    depends on it, since it never misses a hash that is there.
    """

    def __init__(self, hashes: DataFrame, probes: int = 1):
        """``hashes``: one column of hashes, already written. Of each hash, ``probes`` bits are marked."""
        self.bits, self.probes = min(1 << 27, max(1 << 23, 1 << (16 * hashes.count()).bit_length())), probes
        mask, h = F.lit(self.bits - 1), F.col(hashes.columns[0])
        step = F.shiftrightunsigned(h, 32).bitwiseAND(mask).bitwiseOR(F.lit(1))
        at = F.array(*[(h.bitwiseAND(mask) + step * i).bitwiseAND(mask) for i in range(probes)])
        cut = hashes.select(F.explode(at).alias("at")).select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
        self.table = written(cut.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")), "marks")

    def bytes(self) -> np.ndarray:
        """The bit map on the driver (16 MB at most), for ``marked``."""
        out = np.zeros((self.bits // 8 // 4096 + 1, 4096), dtype=np.uint8)
        for r in self.table.toLocalIterator():
            out[r["bucket"]] = np.frombuffer(r["map"], dtype=np.uint8)
        return out.reshape(-1)

    def split(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows of ``df`` whose ``key`` may be marked, and those whose key is not."""
        bucket, bits = fresh("bucket", df), fresh("map", df)
        at = F.pmod(key, F.lit(self.bits))
        byte = F.substring(F.col(bits), (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))
        bit = F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), (F.bitmap_bit_position(at) % 8).cast("int"))
        maybe = F.coalesce(bit == 1, F.lit(False))
        joined = df.join(F.broadcast(self.table.toDF(bucket, bits)), F.bitmap_bucket_number(at) == F.col(bucket), "left")
        return joined.where(maybe).select(columns(df)), joined.where(~maybe).select(columns(df))


def marked(bits: np.ndarray, hashes: np.ndarray, probes: int) -> np.ndarray:
    """Which hashes ``Marks.bytes`` may have."""
    mask = np.uint64((len(bits) - 4096) * 8 - 1)
    first, step = hashes & mask, ((hashes >> np.uint64(32)) & mask) | np.uint64(1)
    here = np.arange(len(hashes))
    for i in range(probes):
        at = ((first[here] + step[here] * np.uint64(i)) & mask).astype(np.int64)
        at = np.where(at > 0, at + 32767, 0)  # buckets of 32,768 bits begin at 0, 1, 32,769, ...
        here = here[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return here


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most ``rows`` rows from here on: texts are long, and a batch is held several times on its way.

    Workers live on through the stages of a pipeline, and so does what they have once asked the system for. A stage is
    evaluated after its function has returned, so the setting stays; ``kept_batches`` puts it back.
    """
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def kept_batches(spark: SparkSession) -> Iterator[None]:
    """The session's batch size is afterwards what it was before."""
    before = spark.conf.get(BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
