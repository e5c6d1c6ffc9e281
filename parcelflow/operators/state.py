"""Current-state tables: upserts, tombstones, parked children, lookups, reprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import start_runs


def latest_changes(versions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each key of a batch: its newest version, and the data of its newest visible one."""
    order = F.col("raw_seq")
    shown = F.col("change_type") != "delete"
    return versions.groupBy(key).agg(
        F.max_by("version_id", order).alias("current_version_id"),
        F.max_by("mlg_can_view", order).alias("mlg_can_view"),
        F.max_by(F.when(shown, F.struct(F.col("valid_from").alias("source_modified_at"), *columns)), F.when(shown, order)).alias("data"),
        F.max_by("valid_from", order).alias("touched_at"),
    )


def merge_entities(entity: DataFrame | None, versions: DataFrame, key: str, columns: list[str], now, sticky: tuple[str, ...] = ()) -> DataFrame:
    """Current state after a batch of new versions.

    An upsert overwrites every data column, NULL included; created_at and ``sticky`` columns stay. A tombstone only
    clears visibility and moves the pointer: other values keep what the last visible version said. A key that is
    first seen deleted is a sparse row.
    """
    fresh = latest_changes(versions, key, columns)
    at = F.lit(now).cast("timestamp")
    full = ["source_modified_at", *columns]
    if entity is None:
        first = [F.coalesce(F.col("data.source_modified_at"), F.col("touched_at")).alias("source_modified_at"), *[F.col(f"data.{c}").alias(c) for c in columns]]
        return fresh.select(key, *first, "mlg_can_view", "current_version_id", at.alias("created_at"), at.alias("modified_at"), *[F.lit(None).cast("string").alias(c) for c in sticky])
    old = entity.select(key, *[F.col(c).alias(f"old_{c}") for c in (*full, "mlg_can_view", "current_version_id", "created_at", "modified_at", *sticky)])
    both = old.join(fresh.withColumn("__fresh", F.lit(True)), key, "full")
    changed, shown = F.col("__fresh").isNotNull(), F.col("data").isNotNull()
    known = F.col("old_created_at").isNotNull()

    def data(c: str):
        value = F.when(changed & shown, F.col(f"data.{c}")).otherwise(F.col(f"old_{c}"))
        return (F.when(changed & ~shown & ~known, F.col("touched_at")).otherwise(value) if c == "source_modified_at" else value).alias(c)

    return both.select(
        key, *[data(c) for c in full],
        *[F.when(changed, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("mlg_can_view", "current_version_id")],
        F.coalesce("old_created_at", at).alias("created_at"), F.when(changed, at).otherwise(F.col("old_modified_at")).alias("modified_at"), *[F.col(f"old_{c}").alias(c) for c in sticky],
    )


def resolve_parent(children: DataFrame, properties: DataFrame) -> DataFrame:
    """``children`` with parent_listing_key: the listing key where that property exists, else NULL (parked)."""
    keys = properties.select(F.col("listing_key").alias("__parent")).distinct()
    return children.join(keys, F.col("listing_key") == F.col("__parent"), "left").withColumnRenamed("__parent", "parent_listing_key")


def promote_parent(existing: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """A parent once found is never cleared."""
    found = resolved.select(key, F.col("parent_listing_key").alias("__new"))
    return existing.join(found, key, "left").withColumn("parent_listing_key", F.coalesce("parent_listing_key", "__new")).drop("__new")


def relink_children(children: DataFrame, properties: DataFrame) -> DataFrame:
    """Fill NULL parents whose property is there by now; ``relinked`` says which. Repeating it changes nothing."""
    keys = properties.select(F.col("listing_key").alias("__parent")).distinct()
    joined = children.join(keys, F.col("listing_key") == F.col("__parent"), "left")
    fill = F.col("parent_listing_key").isNull() & F.col("__parent").isNotNull()
    return joined.select(*[c for c in children.columns if c != "parent_listing_key"], F.coalesce("parent_listing_key", "__parent").alias("parent_listing_key"), fill.alias("relinked"))


def fold_lookup(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(lookup_key, raw_seq, outcome): no stale rule; hidden rows delete, or are skipped where nothing is there."""
    w = Window.partitionBy("lookup_key").orderBy("raw_seq")
    shown = rows.select("lookup_key", "raw_seq", F.col("mlg_can_view").alias("visible"))
    there = F.lag("visible").over(w)
    if existing is not None:
        shown = shown.join(existing.select("lookup_key", F.lit(True).alias("__there")), "lookup_key", "left")
        there = F.coalesce(there, F.col("__there"))
    there = F.coalesce(there, F.lit(False))
    outcome = F.when(F.col("visible"), F.when(there, "update").otherwise("insert")).otherwise(F.when(there, "delete").otherwise("skip-tombstoned"))
    return shown.select("lookup_key", "raw_seq", outcome.alias("outcome"))


def upsert_lookup(existing: DataFrame | None, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The lookup table after a batch: the last arrival of each key, absent where that is hidden."""
    last = rows.groupBy("lookup_key").agg(F.max_by(F.struct("mlg_can_view", *columns), "raw_seq").alias("r"))
    fresh = last.where("r.mlg_can_view").select("lookup_key", *[F.col(f"r.{c}").alias(c) for c in columns])
    if existing is None:
        return fresh
    return existing.select("lookup_key", *columns).join(last, "lookup_key", "left_anti").union(fresh)


def cascade_cancel_jobs(jobs: DataFrame, media: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """Jobs of the media of tombstoned listings are canceled where they are not finished; their claim is cleared."""
    of_listing = media.where("resource_type = 'property'").join(tombstoned, F.col("resource_record_key") == F.col("listing_key"), "left_semi")
    hit = jobs.join(of_listing.select("media_key", F.lit(True).alias("__hit")).distinct(), "media_key", "left")
    cancel = F.col("__hit").isNotNull() & F.col("status").isin("pending", "retrying", "in_progress")
    cleared = {c: F.when(~cancel, F.col(c)) for c in ("claimed_at", "claimed_by") if c in jobs.columns}
    return hit.withColumns({"status": F.when(cancel, "canceled").otherwise(F.col("status")), **cleared}).drop("__hit")


def reprocess(raw: DataFrame, cursors: DataFrame, resource: str, now, from_seq: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the raw rows that a reprocessing run reads again, the cursors after its start, its row of the run ledger).

    The resource's cursor goes back to just before ``from_seq``, or to the beginning; one that is missing is made.
    """
    rows = raw.where(F.col("resource") == resource)
    at = F.lit(None if from_seq is None else from_seq - 1).cast("double")
    if from_seq is not None:
        rows = rows.where(F.col("raw_seq") >= from_seq)
    back = cursors.sparkSession.range(1).select(F.lit(resource).alias("resource"), at.alias("last_raw_seq"), F.lit(now).cast("timestamp").alias("modified_at"))
    kinds = {f.name: f.dataType for f in cursors.schema.fields}
    moved = cursors.where(F.col("resource") != resource).union(back.select(*[(F.col(c) if c in back.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in cursors.columns]))
    run = start_runs(back.select("resource", F.lit(None).cast("timestamp").alias("cursor")), now, "reprocess").drop("queried_from")
    return rows, moved, run
