"""The run ledger: high-water marks, cursors, outcomes, and the freshness report built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.plans.registry import FETCHED, PASS_ORDER

STALE = "2 hours"


def last_successful_hwm(events: DataFrame) -> DataFrame:
    """(resource, high_water_mark): the newest one of a successful run."""
    return events.where("status = 'success' and high_water_mark is not null").groupBy("resource").agg(F.max("high_water_mark").alias("high_water_mark"))


def next_cursor(events: DataFrame, now, resources: tuple[str, ...] = FETCHED) -> DataFrame:
    """(resource, cursor): where the next delta starts; a month ago for a resource without a mark."""
    spark = events.sparkSession
    every = spark.createDataFrame([(r,) for r in resources], "resource string")
    start = F.lit(now).cast("timestamp") - F.expr("interval 1 month")
    return every.join(last_successful_hwm(events), "resource", "left").select("resource", F.coalesce("high_water_mark", start).alias("cursor"))


def stamp_outcome(events: DataFrame, results: DataFrame) -> DataFrame:
    """Running events closed by ``results`` (sync_event_id, ok, ended_at, record_count, hwm, queried_from, error).

    Success keeps the mark, or carries the cursor it asked from where nothing was written (a first import: its own
    start). Failure has an error and no mark. Of several results of one run a success, then the last to end, counts.
    """
    one = results.groupBy("sync_event_id").agg(F.max(F.struct("ok", "ended_at", "record_count", "hwm", "queried_from", "error")).alias("r"))
    r = one.select("sync_event_id", "r.ok", F.col("r.ended_at").alias("__ended"), F.col("r.record_count").alias("__count"), "r.hwm", "r.queried_from", "r.error")
    joined = events.join(r, "sync_event_id", "left")
    hit = F.col("ok").isNotNull() & (F.col("status") == "running")
    mark = F.when(F.col("ok"), F.coalesce("hwm", "queried_from", "started_at"))
    new = {
        "status": F.when(hit, F.when(F.col("ok"), "success").otherwise("failed")).otherwise(F.col("status")),
        "ended_at": F.when(hit, F.col("__ended")).otherwise(F.col("ended_at")),
        "record_count": F.when(hit, F.col("__count")).otherwise(F.col("record_count")),
        "high_water_mark": F.when(hit, mark).otherwise(F.col("high_water_mark")),
        "error_summary": F.when(hit & ~F.col("ok"), F.col("error")).otherwise(F.col("error_summary")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in events.columns])


def sweep_stale_running(events: DataFrame, now, threshold: str = STALE) -> DataFrame:
    """Runs that started too long ago have failed."""
    at = F.lit(now).cast("timestamp")
    stale = (F.col("status") == "running") & (F.col("started_at") < at - F.expr(f"interval {threshold}"))
    new = {
        "status": F.when(stale, "failed").otherwise(F.col("status")),
        "ended_at": F.when(stale, at).otherwise(F.col("ended_at")),
        "error_summary": F.when(stale, F.lit(f"stale: running for more than {threshold}")).otherwise(F.col("error_summary")),
    }
    return events.select(*[new.get(c, F.col(c)).alias(c) for c in events.columns])


def start_runs(cursor: DataFrame, now, run_type: str = "sync") -> DataFrame:
    """A running event for each row of ``cursor`` (resource, cursor), which it asks from."""
    started = F.lit(now).cast("timestamp")
    name = F.concat_ws("/", F.lit(run_type), "resource", started.cast("string"))
    return cursor.select(
        F.sha2(name, 256).alias("sync_event_id"), "resource", F.lit(run_type).alias("run_type"), F.lit("running").alias("status"), started.alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"), F.lit(None).cast("long").alias("record_count"), F.lit(None).cast("timestamp").alias("high_water_mark"),
        F.lit(None).cast("string").alias("error_summary"), F.col("cursor").cast("timestamp").alias("queried_from"),
    )


def delta_run(events: DataFrame, records: DataFrame, now, resources: tuple[str, ...] = FETCHED) -> tuple[DataFrame, DataFrame]:
    """One turn of the delta loop: (the records since each resource's mark, the ledger after it).

    ``records`` (resource, source_modified_at, ...). A run that finds nothing carries on the mark that it asked from.
    """
    runs = start_runs(next_cursor(events, now, resources), now)
    found = records.join(runs.select("resource", "queried_from"), "resource").where("source_modified_at >= queried_from").drop("queried_from")
    seen = found.groupBy("resource").agg(F.count("*").alias("record_count"), F.max("source_modified_at").cast("timestamp").alias("hwm"))
    results = runs.select("sync_event_id", "resource", "queried_from").join(seen, "resource", "left").select(
        "sync_event_id", F.lit(True).alias("ok"), F.lit(now).cast("timestamp").alias("ended_at"), F.coalesce("record_count", F.lit(0)).alias("record_count"), "hwm", "queried_from", F.lit(None).cast("string").alias("error")
    )
    new = stamp_outcome(runs.drop("queried_from"), results)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    return found, events.union(new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in events.columns]))


def latest_event(events: DataFrame) -> DataFrame:
    """The newest run of each resource, by start."""
    rest = [c for c in events.columns if c != "resource"]
    return events.groupBy("resource").agg(F.max_by(F.struct(*rest), F.struct("started_at", "sync_event_id")).alias("e")).select("resource", "e.*")


def backlog(raw: DataFrame, cursors: DataFrame) -> DataFrame:
    """(resource, pending): raw rows after each resource's cursor."""
    at = cursors.select("resource", F.col("last_raw_seq").alias("__last"))
    return raw.join(at, "resource", "left").where("__last is null or raw_seq > __last").groupBy("resource").agg(F.count("*").alias("pending"))


DEFAULTS = {"staleness_minutes": 30, "backlog": 10_000, "failures": 100}


def _listed(order: tuple[str, ...], name: Column, after: Column | str = "") -> Column:
    """The names that are not NULL, each with what comes after it, in a stated order."""
    place = F.array_position(F.array(*map(F.lit, order)), name)
    said = F.concat(name, F.lit(after) if isinstance(after, str) else after)
    found = F.array_sort(F.collect_list(F.when(name.isNotNull(), F.struct(place.alias("at"), said.alias("said")))))
    return F.array_join(F.transform(found, lambda x: x["said"]), ", ")


def sync_health(events: DataFrame, cursors: DataFrame, raw: DataFrame, jobs: DataFrame, now, thresholds: dict | None = None, resources: tuple[str, ...] = FETCHED) -> DataFrame:
    """(name, status, message); status is pass, warn, fail or skipped. Healthy is a report without fail.

    Before each resource has had a successful first import, all other checks are skipped. The backlog is that of all resources that are processed, and names
    those with rows but without a cursor; the state of resources is one check that names those whose newest run failed or is stuck.
    """
    t = DEFAULTS | (thresholds or {})
    if t["staleness_minutes"] <= 0 or t["backlog"] < 0 or t["failures"] < 0:
        raise ValueError("staleness is positive, the other thresholds are not negative")
    spark, at = events.sparkSession, F.lit(now).cast("timestamp")
    every = spark.createDataFrame([(r,) for r in resources], "resource string")
    imported = events.where("run_type = 'backfill' and status = 'success'").select("resource").distinct()
    missing = every.join(imported, "resource", "left_anti").agg(_listed(resources, F.col("resource")).alias("names"))

    def check(df: DataFrame, name: Column | str, status: Column, message: Column) -> DataFrame:
        return df.select((F.lit(name) if isinstance(name, str) else name).alias("name"), status.alias("status"), message.alias("message"))

    first = check(missing, "initial_import", F.when(F.col("names") == "", "pass").otherwise("fail"), F.when(F.col("names") == "", "initial import complete for all required resources").otherwise(F.concat(F.lit("initial import not complete for: "), "names")))
    fetched = events.where("status = 'success' and ended_at is not null").groupBy("resource").agg(F.max("ended_at").alias("last"))
    fresh = F.col("last") >= at - F.expr(f"interval {t['staleness_minutes']} minutes")
    freshness = check(every.join(fetched, "resource", "left"), F.concat("resource", F.lit("_fetch_freshness")), F.when(fresh, "pass").otherwise("fail"), F.when(F.col("last").isNull(), "never fetched").when(fresh, "fresh").otherwise("stale"))
    waiting = backlog(raw.where(F.col("resource").isin(*PASS_ORDER)), cursors).join(cursors.select("resource", F.lit(True).alias("has")).distinct(), "resource", "left")
    waiting = waiting.agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("n"), _listed(PASS_ORDER, F.when(F.col("has").isNull(), F.col("resource"))).alias("bare"))
    note = F.when(F.col("bare") != "", F.concat(F.lit(" (no processor cursor yet for: "), "bare", F.lit(")"))).otherwise("")
    over, pending = F.col("n") > t["backlog"], F.col("n").cast("string")
    said = F.when(over, F.concat(F.lit("raw backlog "), pending, F.lit(f" exceeds threshold {t['backlog']}"), note)).otherwise(F.concat(pending, F.lit(f" raw records pending (threshold {t['backlog']})"), note))
    behind = check(waiting, "raw_backlog", F.when(over, "fail").otherwise("pass"), said)
    moved = cursors.agg(F.max("modified_at").alias("last"))
    processing = check(moved, "processing_freshness", F.when(fresh, "pass").otherwise("warn"), F.when(F.col("last").isNull(), "never processed").when(fresh, "fresh").otherwise("stale"))
    dead = jobs.where("status = 'permanently_failed'").agg(F.count("*").alias("n"))
    failures = check(dead, "attachment_failures", F.when(F.col("n") > t["failures"], "fail").otherwise("pass"), F.concat(F.col("n").cast("string"), F.lit(" failed")))
    newest = latest_event(events).join(every, "resource", "left_semi")
    stuck = (F.col("status") == "running") & (F.col("started_at") < at - F.expr(f"interval {STALE}"))
    bad = newest.agg(_listed(resources, F.when(stuck | (F.col("status") == "failed"), F.col("resource")), F.when(stuck, " (stuck running)").otherwise(" (failed)")).alias("bad"))
    resource_state = check(bad, "resource_state", F.when(F.col("bad") != "", "fail").otherwise("pass"), F.when(F.col("bad") != "", F.concat(F.lit("resource(s) in a bad state: "), "bad")).otherwise("no required resource stuck in a failed state"))
    rest = reduce(DataFrame.union, [freshness, behind, processing, failures, resource_state])
    ready = missing.select((F.col("names") == "").alias("ready"))
    rest = rest.join(F.broadcast(ready)).select("name", F.when(F.col("ready"), F.col("status")).otherwise("skipped").alias("status"), F.when(F.col("ready"), F.col("message")).otherwise("before the first import").alias("message"))
    return first.union(rest)


def healthy(report: DataFrame) -> DataFrame:
    return report.agg((F.coalesce(F.sum((F.col("status") == "fail").cast("int")), F.lit(0)) == 0).alias("healthy"))
