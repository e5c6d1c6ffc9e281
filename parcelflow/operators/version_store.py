"""A store of versions: open and closed ones apart, each bucketed by key, with commits that appear at once.

A commit adds a partition to both tables: to ``open`` the versions that are open after it, to ``closed`` those that it has closed. Nothing is rewritten, so an open version
that was superseded stays until ``compact``; the newest of a key counts. Both tables are bucketed by key: the newest is found, and a batch joined, without an exchange of what
is stored, and a batch of few keys reads only their buckets. The pointer of a commit is written last; one that was cut short is replaced when it is tried again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.sources.snapshot import path_exists, remove_path

from .versions import data_text, version_batch, written_once

#: A batch of at most so many keys names them to the scan, which then reads only their buckets.
FEW_KEYS = 1_000


class VersionStore:
    """Versions of one resource under ``folder``; opening it again finds what was committed.

    ``columns`` are the data columns, in the order that texts compare them. Rows without a key are not stored: a record has one, or is poison.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.columns, self.buckets = spark, folder, key, columns, buckets
        self.tables: dict[str, str] = {}
        self.base, self.commit = 0, 0
        if path_exists(spark, f"{folder}/pointer"):
            last = spark.read.parquet(f"{folder}/pointer").orderBy(F.desc("commit")).first()
            self.base, self.commit = last["base"], last["commit"]
            for name in ("open", "closed"):
                self._create(name, spark.read.parquet(f"{folder}/{name}").drop("commit"))

    def _create(self, name: str, like: DataFrame) -> None:
        """A table over the folder; the catalog only has it for this session."""
        table, key = f"{name}_{uuid.uuid4().hex}", self.key.replace("`", "``")
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in like.schema.fields)
        self.spark.sql(f"create table {table} ({fields}, commit bigint) using parquet partitioned by (commit) clustered by (`{key}`) sorted by (`{key}`) into {self.buckets} buckets location '{self.folder}/{name}'")
        if path_exists(self.spark, f"{self.folder}/{name}"):
            self.spark.sql(f"alter table {table} recover partitions")
        self.tables[name] = table

    def _put(self, name: str, rows: DataFrame, commit: int) -> None:
        if name not in self.tables:
            self._create(name, rows)
        fields = self.spark.table(self.tables[name]).columns[:-1]
        self._drop(name, commit)  # what a commit that was cut short has left
        rows.select(*fields, F.lit(commit).cast("long").alias("commit")).repartition(self.buckets, self.key).write.insertInto(self.tables[name])

    def _drop(self, name: str, commit: int) -> None:
        self.spark.sql(f"alter table {self.tables[name]} drop if exists partition (commit = {commit})")
        remove_path(self.spark, f"{self.folder}/{name}/commit={commit}")

    def _point(self, base: int, commit: int) -> None:
        row = self.spark.range(1).select(F.lit(base).cast("long").alias("base"), F.lit(commit).cast("long").alias("commit"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointer/number={commit:012d}")
        self.base, self.commit = base, commit

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name]).where(F.col("commit").between(self.base, self.commit))

    def open_versions(self, keys: list | None = None) -> DataFrame:
        """The open version of each key (of ``keys``); where the newest version is a delete, that."""
        rows = self._read("open")
        if keys is not None:
            rows = rows.where(F.col(self.key).isin(keys))
        rest = [c for c in rows.columns if c not in (self.key, "commit")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "raw_seq").alias("v")).select(self.key, "v.*")

    def history(self) -> DataFrame:
        return self.open_versions().unionByName(self._read("closed").drop("commit"))

    def _state(self, open_: DataFrame) -> DataFrame:
        gone = F.col("change_type") == "delete"
        return open_.select(self.key, F.lit(True).alias("found"), gone.alias("tomb"), F.col("valid_from").alias("at"), F.when(~gone, data_text(self.columns)).alias("text"), F.col("raw_seq").alias("seq"))

    def _of_batch(self, batch: DataFrame) -> DataFrame:
        keys = batch.select(self.key).distinct().limit(FEW_KEYS + 1).collect()
        return self.open_versions([r[0] for r in keys] if len(keys) <= FEW_KEYS else None)

    def apply(self, typed: DataFrame) -> DataFrame:
        """Fold a batch (raw_seq, source_modified_at, mlg_can_view, data) into the store; its outcomes.

        A batch that is applied again after its commit is stale or no change, and adds nothing.
        """
        batch = written_once(typed.where(F.col(self.key).isNotNull()), "batch")
        stored = self._of_batch(batch) if self.tables else None
        outcomes, fresh = version_batch(batch, self.key, self.columns, None if stored is None else self._state(stored), stored)
        fresh = written_once(fresh, "fresh")
        closed = fresh.where("valid_to is not null")
        if stored is not None:
            first = fresh.groupBy(self.key).agg(F.min_by("valid_from", "raw_seq").alias("__until"))
            closed = closed.unionByName(stored.join(first, self.key).withColumn("valid_to", F.col("__until")).drop("__until"))
        self._put("open", fresh.where("valid_to is null"), self.commit + 1)
        self._put("closed", closed, self.commit + 1)
        self._point(self.base, self.commit + 1)
        return outcomes

    def entities(self) -> DataFrame:
        """(key, version_id, mlg_can_view, the data of the newest visible version): current state, pointing at the open version."""
        shown = self.history().where("change_type <> 'delete'").groupBy(self.key).agg(F.max_by(F.struct(*self.columns), "raw_seq").alias("d"))
        return self.open_versions().select(self.key, "version_id", "mlg_can_view").join(shown, self.key, "left").select(self.key, "version_id", "mlg_can_view", *[F.col(f"d.{c}").alias(c) for c in self.columns])

    def _replace(self, history: DataFrame) -> None:
        """A new base: the whole history, written anew. Readers of older commits keep theirs."""
        commit = self.commit + 1
        rows = written_once(history, "history")
        self._put("open", rows.where("valid_to is null"), commit)
        self._put("closed", rows.where("valid_to is not null"), commit)
        self._point(commit, commit)

    def compact(self) -> None:
        """One partition of each table again, without superseded open versions."""
        if self.tables:
            self._replace(self.history())

    def vacuum(self) -> None:
        """Drop the partitions from before the base; commits from before it can no longer be read."""
        for name, table in self.tables.items():
            numbers = [int(r["partition"].partition("=")[2]) for r in self.spark.sql(f"show partitions {table}").collect()]
            for number in numbers:
                if number < self.base:
                    self._drop(name, number)

    def reprocess(self, typed: DataFrame, from_seq: int | None = None) -> int:
        """Replay rows of the ledger (from ``from_seq`` on, or all), typed by the mapping of today; the number of keys whose history changed.

        What was folded before ``from_seq`` stays and seeds the replay; the versions from there on are replaced, and the version open before them is open until the first new one.
        Where a replay gives a key what it has, nothing is written.
        """
        rows = written_once(typed.where(F.col(self.key).isNotNull() & (F.lit(True) if from_seq is None else F.col("raw_seq") >= from_seq)), "replay")
        history = written_once(self.history(), "history")
        kept = history.where("false" if from_seq is None else F.col("raw_seq") < from_seq)
        last = kept.groupBy(self.key).agg(F.max("raw_seq").alias("raw_seq"))
        seed = kept.join(last, [self.key, "raw_seq"], "left_semi").withColumn("valid_to", F.lit(None).cast(history.schema["valid_to"].dataType))
        _, fresh = version_batch(rows, self.key, self.columns, self._state(seed), seed)
        first = (fresh := written_once(fresh, "fresh")).groupBy(self.key).agg(F.min_by("valid_from", "raw_seq").alias("__until"))
        reopened = seed.join(first, self.key, "left").withColumn("valid_to", F.col("__until")).drop("__until")
        after = kept.join(last, [self.key, "raw_seq"], "left_anti").unionByName(reopened).unionByName(fresh)
        after = written_once(after.select(*history.columns), "after")
        changed = self._differ(history, after)
        count = changed.count()
        if count:
            self._replace(after)
        return count

    def _differ(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """The keys that have not the same versions in both."""

        def mark(df: DataFrame, sign: int) -> DataFrame:
            return df.select(self.key, self._text(df).alias("__text"), F.lit(sign).alias("__sign"))

        both = mark(one, 1).union(mark(other, -1)).groupBy(self.key, "__text").agg(F.sum("__sign").alias("n"))
        return both.where("n <> 0").select(self.key).distinct()

    def _text(self, df: DataFrame) -> Column:
        plain = [F.to_json(F.map_entries(c)) if df.schema[c].dataType.simpleString().startswith("map") else F.col(c) for c in df.columns if c != self.key]
        return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(plain)]), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}), 256)
