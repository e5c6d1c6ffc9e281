"""The same work on a stream of feed files: land once, fold versions with state, link children at the end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parcelflow.operators.project import poison_split, project, project_resource
from parcelflow.operators.state import resolve_parent
from parcelflow.operators.versions import WRITTEN, data_text, fold_step, written_once
from parcelflow.plans.registry import RESOURCES
from parcelflow.sources.feed import RAW_KEY, explode_pages, land_raw, raw_records, split_children
from parcelflow.sources.snapshot import folders, remove_path, write_snapshot


#: What is there is processed and the query ends; ``POLL`` keeps looking for new pages.
DRAIN, POLL = {"availableNow": True}, {"processingTime": "15 minutes"}


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Records of page envelopes as their files arrive."""
    pages = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    return explode_pages(pages.select(F.col("_metadata.file_path").alias("page"), "value"))


#: States are kept in so many buckets of keys. Every so many commits, one has the states of all keys again; a day of the ledger with so many batches becomes one folder.
BUCKETS, FULL = 64, 16
#: About so many rows of one batch and day are one file of the ledger, so that many tasks write it and read it.
FILE_ROWS = 50_000


def ledger_paths(spark: SparkSession, root: str, days: list[str], before: int | None = None) -> list[str]:
    """The folders that have the ledger's rows of some days, of batches before one. Only the folders of these days are listed.

    ``upto=n`` has what batches to n have landed; what it was made from may still be there, and is left out.
    """
    paths = []
    for day in days:
        parts = [n.split("=") for n in folders(spark, f"{root}/ledger/day={day}") if "=" in n]
        done = max((int(n) for kind, n in parts if kind == "upto"), default=-1)
        paths += [f"{root}/ledger/day={day}/upto={done}"] if done >= 0 else []
        paths += [f"{root}/ledger/day={day}/batch={n}" for kind, n in parts if kind == "batch" and int(n) > done and (before is None or int(n) < before)]
    return paths


def read_ledger(spark: SparkSession, root: str, schema, days: list[str] | None = None) -> DataFrame:
    """All rows that were landed (on some days)."""
    days = [n.partition("=")[2] for n in folders(spark, f"{root}/ledger") if n.startswith("day=")] if days is None else days
    paths = ledger_paths(spark, root, days)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def land_batch(batch: DataFrame, batch_id: int, root: str, span: str = "yyyy-MM-dd") -> DataFrame:
    """Land a batch's rows that the ledger has not yet; what it has landed.

    The ledger is kept by day of the rows' own time (or by another ``span``, a date pattern, for feeds that go over many days at once), and by batch. A repeated row has the time of the first one, so a batch meets only the days that it has itself. A batch that is
    tried again is not compared with what it has left, so it lands the same rows. Days with many batches are merged, without the batch itself.
    The batch is written first, since its days are asked for before its rows, and pages would be cut twice.
    """
    spark, schema = batch.sparkSession, batch.schema.add("change_type", "string")
    day = F.coalesce(F.date_format("source_modified_at", span), F.lit("none"))
    batch = written_once(batch, "batch")
    rows = {r["day"]: r["count"] for r in batch.groupBy(day.alias("day")).count().collect()}
    days = sorted(rows)
    paths = ledger_paths(spark, root, days, batch_id)
    fresh = land_raw(spark.read.schema(schema).parquet(*paths) if paths else None, batch)
    out = fresh.withColumns({"day": day, "batch": F.lit(batch_id)})
    place = F.lit(0).cast("long")
    for d, n in rows.items():
        if n > FILE_ROWS:
            place = F.when(F.col("day") == d, F.pmod(F.xxhash64(*RAW_KEY), F.lit(-(-n // FILE_ROWS)))).otherwise(place)
    out.repartition("day", place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{root}/ledger")
    for d in days:
        old = ledger_paths(spark, root, [d], batch_id)
        if len(old) > FULL:
            spark.read.schema(schema).parquet(*old).write.mode("overwrite").parquet(f"{root}/ledger/day={d}/upto={batch_id - 1}")
            for path in old:
                remove_path(spark, path)
    mine = [f"{root}/ledger/day={d}/batch={batch_id}" for d in days if f"batch={batch_id}" in folders(spark, f"{root}/ledger/day={d}")]
    return spark.read.schema(schema).parquet(*mine) if mine else spark.createDataFrame([], schema)


def land_stream(rows: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exact, unbounded dedup: each micro-batch is anti-joined with the ledger, and landed under its batch id."""
    land = lambda batch, batch_id: land_batch(batch, batch_id, root)
    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start()


def dedup_within(rows: DataFrame, bound: str = "2 days") -> DataFrame:
    """Bounded dedup by Spark's own state: a row whose key was seen within ``bound`` of its time is dropped, and keys are forgotten after that.

    For feeds that repeat rows only for a while; what comes again later is landed again, where ``land_stream`` would know it.
    """
    return rows.withWatermark("source_modified_at", bound).dropDuplicatesWithinWatermark(RAW_KEY)


class VersionFold(StatefulProcessor):
    """Per key: the time, text and visibility of the last written version. Late rows are stale rows; no watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "found boolean, tomb boolean, at timestamp, text string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("raw_seq")
        found, tomb, at, text, seq = self.open.get() if self.open.exists() else (False, False, None, None, None)
        out = []
        for r in batch.itertuples(index=False):
            if at is not None and r.source_modified_at <= pd.Timestamp(at):
                o = "skip-stale"
            elif not r.mlg_can_view:
                o = "skip-tombstoned" if found and tomb else "delete"
            elif not found:
                o = "insert"
            else:
                o = "skip-no-diff" if r.text == text else "update"
            out.append((key[0], r.raw_seq, o, seq))
            if o in WRITTEN:
                found, tomb, at, text, seq = True, o == "delete", r.source_modified_at, None if o == "delete" else r.text, r.raw_seq
        if at is not None:
            self.open.update((found, tomb, pd.Timestamp(at).to_pydatetime(), text, seq))
        frame = pd.DataFrame(out, columns=["key", "raw_seq", "outcome", "prior_seq"])
        yield frame.astype({"prior_seq": "Int64"})

    def close(self) -> None:
        pass


def version_stream(typed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, raw_seq, outcome, prior_seq) of a stream of typed rows, with per-key state (needs the RocksDB provider)."""
    kind = typed.schema[key].dataType.simpleString()
    rows = typed.select(F.col(key).alias("key"), "raw_seq", F.col("source_modified_at").cast("timestamp").alias("source_modified_at"), "mlg_can_view", data_text(columns).alias("text"))
    return rows.groupBy("key").transformWithStateInPandas(VersionFold(), f"key {kind}, raw_seq long, outcome string, prior_seq long", "append", "none")


def fold_batch(batch: DataFrame, batch_id: int, root: str, key: str, columns: list[str]) -> None:
    """Fold a batch against the states before it and commit its outcomes and states.

    A commit has the states of the keys that its batch has written, by buckets of keys; a batch reads the commits since the last full one, and of them the buckets of its own keys, by
    their paths. States of before the last but one full commit are deleted. The commit's number is the batch's, so that a retried batch replaces its own commit: outcomes, states
    and cursor move together.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
    schema = f"{key} {batch.schema[key].dataType.simpleString()}, found boolean, tomb boolean, at timestamp, text string, seq long, commit long, bucket int"

    def latest(buckets: list[int] | None) -> DataFrame | None:
        wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
        commits = [f"{root}/state/commit={n}" for n in range((batch_id - 1) // FULL * FULL, batch_id)]
        paths = [f"{c}/{b}" for c in commits for b in folders(spark, c) if b.startswith("bucket=") and (wanted is None or b in wanted)]
        if not paths:
            return None
        kept = spark.read.schema(schema).option("basePath", f"{root}/state").parquet(*paths)
        return kept.groupBy(key).agg(F.max_by(F.struct("found", "tomb", "at", "text", "seq"), "commit").alias("s")).select(key, "s.*")

    state = latest([r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]) if batch_id else None
    out = fold_step(batch, state, key, columns)
    fresh = out["state"]
    full = batch_id and batch_id % FULL == 0
    if full and (before := latest(None)) is not None:
        fresh = before.join(fresh, key, "left_anti").select(*fresh.columns).union(fresh)
    fresh.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/state/commit={batch_id}")
    write_snapshot({"outcomes": out["outcomes"]}, root, batch_id)
    if full:
        for name in folders(spark, f"{root}/state"):
            if name.startswith("commit=") and int(name[7:]) < batch_id - FULL:
                remove_path(spark, f"{root}/state/{name}")


def fold_batches(typed: DataFrame, root: str, checkpoint: str, key: str, columns: list[str], trigger: dict | None = None) -> StreamingQuery:
    """The recommended form of the fold on a stream: ``fold_batch`` for each micro-batch."""
    one = lambda batch, batch_id: fold_batch(batch, batch_id, root, key, columns)
    return typed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start()


def committed_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """The outcomes of all commits that have a pointer: one that was cut short is not read."""
    return spark.read.parquet(*(r["folder"] + "/outcomes" for r in spark.read.parquet(f"{root}/pointer/*").select("folder").collect()))


LANDED = "raw_seq long, resource string, source_key string, source_modified_at timestamp, payload string"


def numbered_records(pages: DataFrame, resource: str, now) -> DataFrame:
    """Records of pages in folders ``page=<n>`` as raw rows, numbered by page and place in it: the order of arrival, whatever batch has them."""
    page = F.regexp_extract("page", r"page=(\d+)", 1).cast("long")
    return raw_records(pages, resource, now).select((F.shiftleft(page, 32) + F.col("ord")).alias("raw_seq"), "resource", "source_key", F.col("source_modified_at").cast("timestamp").alias("source_modified_at"), "payload")


def ingest_stream(pages: DataFrame, root: str, checkpoint: str, now, resource: str = "property", trigger: dict | None = None, span: str = "yyyy-MM-dd") -> StreamingQuery:
    """Pages of a resource all the way: land records once, split off a property's children, fold versions, keep the children's rows.

    One batch is one step: whatever is cut short is done again as a whole and replaces what it has left. Poison and broken children are set aside.
    """
    kind = RESOURCES[resource]

    def one(batch: DataFrame, batch_id: int) -> None:
        landed = land_batch(numbered_records(batch, resource, now), batch_id, root, span)
        aside = []
        if resource == "property":
            split, errors = split_children(landed)
            landed = written_once(split, "split")
            landed.where("resource <> 'property'").write.mode("overwrite").parquet(f"{root}/children/batch={batch_id}")
            aside.append(errors.select("raw_seq", "resource", "error"))
        good, poison = poison_split(written_once(project_resource(landed, resource), "typed"))
        aside.append(poison.select("raw_seq", F.lit(resource).alias("resource"), "error"))
        reduce(DataFrame.union, aside).write.mode("overwrite").parquet(f"{root}/aside/batch={batch_id}")
        fold_batch(good, batch_id, root, kind.key_column, kind.data_columns)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start()


def link_landed(spark: SparkSession, root: str, child: str, parents: DataFrame) -> DataFrame:
    """The finalizing step: the newest row of each record of a kind that hangs on listings, with its parent where ``parents`` (listing_key) has it.

    Embedded children are where ``ingest_stream`` keeps them, open houses are in the ledger itself. Written to ``links``, replacing what was there.
    """
    names = folders(spark, f"{root}/children")
    raw = spark.read.parquet(*[f"{root}/children/{n}" for n in names]) if names else read_ledger(spark, root, LANDED)
    key = RESOURCES[child].key_column
    newest = raw.where(F.col("resource") == child).groupBy("source_key").agg(F.max_by(F.struct("raw_seq", "source_modified_at", "payload"), "raw_seq").alias("r")).select("r.*")
    rows, _ = poison_split(project(newest, child))
    resolve_parent(rows, parents).select(key, "listing_key", "parent_listing_key").write.mode("overwrite").parquet(f"{root}/links/{child}")
    return spark.read.parquet(f"{root}/links/{child}")


def finish(query: StreamingQuery, finalize: Callable[[], None]) -> None:
    """Drain a stream, then finalize (link children) once."""
    query.awaitTermination()
    if query.exception() is None:
        finalize()


def progress(query: StreamingQuery) -> list[dict]:
    return [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress]
