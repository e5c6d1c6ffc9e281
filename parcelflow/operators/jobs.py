"""Media download jobs as table transforms: planning, canceling, reaping, applying results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A job in one of these states at a revision speaks for that revision.
BLOCKING = ("pending", "retrying", "in_progress", "succeeded")
WARM = ("Active", "ActiveUnderContract")
MAX_ATTEMPTS, BATCH = 3, 50


def newest_revisions(media: DataFrame) -> DataFrame:
    """(media_key, revision): the latest media time, else modification time, of each visible media key."""
    revision = F.coalesce("media_modification_timestamp", "source_modified_at")
    return media.where("mlg_can_view").groupBy("media_key").agg(F.max(revision).alias("revision"))


def latest_blocking(jobs: DataFrame) -> DataFrame:
    """(media_key, blocked_at, blocked_status) of the newest blocking job; its revision may be NULL."""
    found = jobs.where(F.col("status").isin(*BLOCKING)).groupBy("media_key").agg(F.max_by(F.struct("media_modified_at", "status"), F.struct("created_at", "attachment_job_id")).alias("j"))
    return found.select("media_key", F.col("j.media_modified_at").alias("blocked_at"), F.col("j.status").alias("blocked_status"))


def enqueue_jobs(media: DataFrame, jobs: DataFrame) -> DataFrame:
    """(media_key, revision) to queue: not where the newest blocking job covers the revision; a NULL one never does."""
    wanted = newest_revisions(media).join(latest_blocking(jobs), "media_key", "left")
    covered = F.col("blocked_at").isNotNull() & (F.col("revision").isNull() | (F.col("blocked_at") >= F.col("revision")))
    return wanted.where(~F.coalesce(covered, F.lit(False))).select("media_key", "revision")


def warm_plan(listings: DataFrame, media: DataFrame, jobs: DataFrame, statuses: tuple[str, ...] = WARM, limit: int | None = None) -> DataFrame:
    """Media keys of listings in some states without an attachment that no job speaks for, in order of key.

    Hidden listings and media count, and so do jobs that have succeeded: their attachment is there, only not linked yet.
    """
    active = listings.where(F.col("standard_status").isin(*statuses)).select("listing_key")
    bare = media.where("resource_type = 'property' and attachment_id is null")
    todo = bare.join(active, F.col("resource_record_key") == F.col("listing_key"), "left_semi")
    todo = todo.join(jobs.where(F.col("status").isin(*BLOCKING)).select("media_key").distinct(), "media_key", "left_anti").select("media_key").distinct()
    return todo if limit is None else todo.orderBy("media_key").limit(limit)


def warm_exclusive(jobs: DataFrame, keep: DataFrame) -> DataFrame:
    """Waiting jobs whose media are not in ``keep`` are canceled."""
    kept = jobs.join(keep.select("media_key", F.lit(True).alias("__keep")).distinct(), "media_key", "left")
    cancel = F.col("status").isin("pending", "retrying") & F.col("__keep").isNull()
    return kept.withColumn("status", F.when(cancel, "canceled").otherwise(F.col("status"))).drop("__keep")


def repair_links(media: DataFrame, jobs: DataFrame) -> DataFrame:
    """Media without an attachment get that of their newest succeeded job."""
    done = jobs.where("status = 'succeeded' and attachment_id is not null").groupBy("media_key").agg(F.max_by("attachment_id", F.struct("created_at", "attachment_job_id")).alias("__done"))
    return media.join(done, "media_key", "left").withColumn("attachment_id", F.coalesce("attachment_id", "__done")).drop("__done")


def reap_stale(jobs: DataFrame, now, lease: str = "10 minutes") -> DataFrame:
    """Jobs claimed too long ago wait again; attempts stay, the claim goes."""
    stale = (F.col("status") == "in_progress") & (F.col("claimed_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {lease}"))
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "claimed_at": F.when(~stale, F.col("claimed_at")), "claimed_by": F.when(~stale, F.col("claimed_by"))})


def apply_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after ``results`` (attachment_job_id, claimed_by, ok, attachment_id, store_full), with ``applied``.

    Only jobs still in progress under the same claimant change: success -> succeeded with its attachment; failure ->
    one more attempt, retrying, or permanently_failed at the third or where the store is full. Other results are lost.
    Of several results of one claim a success counts; the number of rows stays that of ``jobs``.
    """
    one = results.groupBy(F.col("attachment_job_id").alias("__job"), F.col("claimed_by").alias("__by")).agg(F.max(F.struct("ok", "store_full", "attachment_id")).alias("r"))
    one = one.select("__job", "__by", "r.ok", "r.store_full", F.col("r.attachment_id").alias("__attachment"))
    any_ = results.select(F.col("attachment_job_id").alias("__any")).distinct()
    joined = jobs.join(one, (F.col("attachment_job_id") == F.col("__job")) & F.col("claimed_by").eqNullSafe(F.col("__by")), "left")
    joined = joined.join(any_, F.col("attachment_job_id") == F.col("__any"), "left")
    has = F.col("__any").isNotNull()
    live = F.col("ok").isNotNull() & (F.col("status") == "in_progress")
    failed = live & ~F.col("ok")
    attempts = F.col("attempt_count") + F.when(failed, 1).otherwise(0)
    final = F.when(F.col("store_full") | (attempts >= MAX_ATTEMPTS), "permanently_failed").otherwise("retrying")
    status = F.when(live & F.col("ok"), "succeeded").when(failed, final).otherwise(F.col("status"))
    applied = F.when(live & F.col("ok"), "succeeded").when(failed, final).when(has, "lost")
    columns = {"status": status, "attempt_count": attempts, "attachment_id": F.when(live & F.col("ok"), F.col("__attachment")).otherwise(F.col("attachment_id")), "applied": applied}
    cleared = {c: F.when(~live, F.col(c)) for c in ("claimed_at", "claimed_by")}
    return joined.select(*[(columns | cleared).get(c, F.col(c)).alias(c) for c in jobs.columns], applied.alias("applied"))


def result_counts(applied: DataFrame) -> DataFrame:
    return applied.where("applied is not null").groupBy("applied").agg(F.count("*").alias("n"))


def link_media(media: DataFrame, applied: DataFrame) -> DataFrame:
    """Media take the attachment of the newest of the jobs that just succeeded."""
    done = applied.where("applied = 'succeeded'").groupBy("media_key").agg(F.max_by("attachment_id", F.struct("created_at", "attachment_job_id")).alias("__new"))
    return media.join(done, "media_key", "left").withColumn("attachment_id", F.coalesce("__new", "attachment_id")).drop("__new")


def next_batch(jobs: DataFrame, n: int = BATCH) -> DataFrame:
    """The oldest waiting jobs."""
    return jobs.where("status in ('pending', 'retrying')").orderBy("created_at", "attachment_job_id").limit(n)
