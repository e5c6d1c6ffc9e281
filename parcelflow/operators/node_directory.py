"""A directory of all ids: which table has one, and whether it is shown. One clustered table in place of sixteen that are scanned for each lookup.

A commit is a folder of rows (id, priority, visible, gone), sorted by id in files of distinct ranges, so that a lookup skips the files and row groups without its
ids; the priority is the table's place in ``NODE_TABLES``. Of the rows of one (id, priority) that of the newest commit counts. Rows are dealt out once for a commit:
the ranges that order them also bring equal ids together. What a compaction has replaced is not read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.sources.snapshot import folders

from .page import NODE_TABLES, node_tables, union_nodes

_SCHEMA = "id string, priority int, visible boolean, gone boolean, commit int"


def _type(priority: str) -> Column:
    return F.element_at(F.array(*map(F.lit, NODE_TABLES)), F.col(priority) + 1)


class NodeDirectory:
    """The directory under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _put(self, rows: DataFrame, newest: Callable[[DataFrame], DataFrame], commit: int) -> None:
        """Write what ``newest`` makes of ``rows``; it groups by (id, priority), for which the ranges need no other exchange."""
        ordered = newest(rows.repartitionByRange("id")).select("id", "priority", "visible", "gone").sortWithinPartitions("id", "priority")
        ordered.write.mode("overwrite").parquet(f"{self.folder}/commit={commit}")

    def _finished(self, kind: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in folders(self.spark, self.folder) if n.startswith(f"{kind}=") and "_SUCCESS" in folders(self.spark, f"{self.folder}/{n}"))

    def _commits(self) -> list[int]:
        """The commits that count: the last compaction and those after it."""
        base = max(self._finished("base"), default=0)
        return [n for n in self._finished("commit") if n >= base]

    def commit(self, tables: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None) -> None:
        """Add what a batch has written, by names of ``NODE_TABLES``; ``removed`` (of lookups, the only ones that go) leave the directory."""
        place = {name: i for i, name in enumerate(NODE_TABLES)}
        rows = []
        for gone, given in ((False, tables), (True, removed or {})):
            for kind, df, key, shown in node_tables(given):
                one = union_nodes([(kind, df, key, shown)]).where("id is not null")
                rows.append(one.select("id", F.lit(place[kind]).alias("priority"), F.coalesce("visible", F.lit(False)).alias("visible"), F.lit(gone).alias("gone")))
        both = rows[0]
        for more in rows[1:]:
            both = both.union(more)
        newest = lambda df: df.groupBy("id", "priority").agg(F.max("visible").alias("visible"), F.min("gone").alias("gone"))
        self._put(both, newest, max(self._commits(), default=-1) + 1)

    def _rows(self) -> DataFrame:
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", self.folder).parquet(*[f"{self.folder}/commit={n}" for n in commits])

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("id", "priority").agg(F.max_by(F.struct("visible", "gone"), "commit").alias("n"))
        return last.where("not n.gone").select("id", "priority", "n.visible")

    def compact(self) -> None:
        """One commit with the rows that count; older ones stay for their readers until they are deleted. It counts as the base once its mark is there."""
        commit = max(self._commits(), default=-1) + 1
        self._put(self._rows(), lambda df: self._newest(df).withColumn("gone", F.lit(False)), commit)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/base={commit}")

    def nodes(self, ids: list[str]) -> DataFrame:
        """(pos, id, type) in the order asked; the first table that has the id wins, and a hidden hit there gives NULL."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
        hits = self._newest(self._rows().where(F.col("id").isin(list(dict.fromkeys(ids)))))
        first = hits.groupBy("id").agg(F.min_by(F.struct(_type("priority").alias("type"), "visible"), "priority").alias("n"))
        return asked.join(first, "id", "left").select("pos", "id", F.when(F.col("n.visible"), F.col("n.type")).alias("type")).orderBy("pos")

    def match(self, asked: DataFrame, column: str = "id") -> DataFrame:
        """``asked`` with ``type``, for any number of ids."""
        hits = self._newest(self._rows().join(asked.select(F.col(column).alias("id")).distinct(), "id", "left_semi"))
        first = hits.groupBy("id").agg(F.min_by(F.struct(_type("priority").alias("type"), "visible"), "priority").alias("__n")).withColumnRenamed("id", "__id")
        return asked.join(first, F.col(column) == F.col("__id"), "left").select(*asked.columns, F.when(F.col("__n.visible"), F.col("__n.type")).alias("type"))
