"""Feed pages and the raw ledger: reading, splitting embedded children, landing, windows over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions.json_text import page_items, split_records
from parcelflow.functions.parse import RFC3339
from parcelflow.plans.registry import CHILDREN, RESOURCES

RAW_KEY = ["resource", "source_key", "source_modified_at"]
RAW_SCHEMA = "raw_seq long, sync_event_id string, resource string, source_key string, change_type string, source_modified_at timestamp, payload string"


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, ord, record, odata_count) from page envelopes, one JSON object per file; a record stays the text that it is."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), "value")
    return explode_pages(pages)


def explode_pages(pages: DataFrame) -> DataFrame:
    count = F.from_json("value", "`@odata.count` bigint")["@odata.count"]
    return pages.select("page", page_items("value").alias("items"), count.alias("odata_count")).select("page", F.posexplode("items").alias("ord", "record"), "odata_count")


def json_timestamp(payload: Column, key: str = "ModificationTimestamp") -> Column:
    text = F.get_json_object(payload, f"$.{key}")
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def record_timestamp(payload: Column, otherwise: Column) -> Column:
    """The record's own stamp, or another time: that of ingest, for a child its parent's."""
    return F.coalesce(json_timestamp(payload), otherwise)


def raw_records(pages: DataFrame, resource: str, now) -> DataFrame:
    """Records of feed pages (page, ord, record) as raw rows without a number: key, time and payload."""
    key = F.nullif(F.get_json_object("record", f"$.{RESOURCES[resource].key}"), F.lit(""))
    time = record_timestamp(F.col("record"), F.lit(now).cast("timestamp"))
    return pages.select("page", "ord", F.lit(resource).alias("resource"), key.alias("source_key"), time.alias("source_modified_at"), F.col("record").alias("payload"))


def split_children(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Property records (raw_seq, source_key, source_modified_at, payload) -> raw rows of parents and children, errors.

    The three embedded arrays leave the parent; what is not an array is dropped with them. Media get
    ``ResourceName`` and rooms and unit types ``ListingKey``. A child without a key or that is no object is an error. All that stays keeps its text.
    Children come in the parent's place of arrival (``ord`` breaks ties).
    """
    records = records.select("raw_seq", F.col("source_key").alias("parent_key"), F.col("source_modified_at").cast("timestamp").alias("parent_time"), "payload")
    links, keys = {name: how[1] for name, how in CHILDREN.items()}, {name: RESOURCES[how[0]].key for name, how in CHILDREN.items()}
    # errors are looked for among the children that do not plainly have a key; the others need not leave the records
    return _found(split_records(records, links)).where("error is null").drop("pos", "error"), _found(split_records(records, links, keys)).where("error is not null").select("raw_seq", "resource", "pos", "error")


def _found(one: DataFrame) -> DataFrame:
    """The texts of ``split_records`` as raw rows, with what is wrong with them."""

    def of_kind(pick) -> Column:
        first, *others = enumerate(CHILDREN.items())
        out = F.when(F.col("kind") == first[0], pick(*first[1]))
        for number, (name, how) in others:
            out = out.when(F.col("kind") == number, pick(name, how))
        return out

    child = F.col("kind") >= 0
    key = F.when(child, of_kind(lambda _, how: F.get_json_object("text", f"$.{RESOURCES[how[0]].key}"))).otherwise(F.col("parent_key"))
    # as a generated column the key is a value: the filters on errors, and nullif, would else read it anew from the text
    named = one.select("*", F.explode(F.array(key)).alias("key")).withColumn("resource", F.coalesce(of_kind(lambda _, how: F.lit(how[0])), F.lit("property")))
    named = named.withColumn("source_key", F.when(~child | (F.col("key") != ""), F.col("key"))).drop("key")
    wrong = F.when(~F.coalesce(F.col("text").startswith("{"), F.lit(False)), of_kind(lambda name, _: F.lit(f"{name}: not an object")))
    wrong = wrong.when(F.col("source_key").isNull(), of_kind(lambda name, how: F.lit(f"{name}: no {RESOURCES[how[0]].key}")))
    time = F.coalesce(F.when(child, json_timestamp(F.col("text"))), F.col("parent_time"))

    def linked(_: str, how: tuple) -> Column:
        """The child's text with its link in front; one of its own was cut out."""
        link, value = how[1], F.lit(how[2]) if how[2] else F.col("parent_key")
        head = F.to_json(F.struct(value.alias(link)))
        return F.when(F.col("text").rlike(r"^\{\s*\}$"), head).otherwise(F.concat(F.rtrim(head, F.lit("}")), F.lit(","), F.substring("text", 2, 1 << 30)))

    payload = F.when(child, of_kind(linked)).otherwise(F.col("text"))
    return named.select("raw_seq", "ord", "pos", "resource", "source_key", time.alias("source_modified_at"), payload.alias("payload"), F.when(child, wrong).alias("error"))


def land_raw(ledger: DataFrame | None, incoming: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """The rows of ``incoming`` that are new to the ledger: first arrival of each (resource, key, time), as inserts."""
    order = [F.col(c) for c in arrival or ["raw_seq"]]
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*RAW_KEY).orderBy(*order))).where("__n = 1").drop("__n")
    if ledger is not None:
        first = first.join(ledger.select(*RAW_KEY), RAW_KEY, "left_anti")
    return first.withColumn("change_type", F.lit("insert"))


def parent_hwm(new_rows: DataFrame, resource: str) -> DataFrame:
    """The latest time among the parent's rows that were written; NULL if there are none."""
    return new_rows.where(F.col("resource") == resource).agg(F.max("source_modified_at").alias("high_water_mark"))


def initial_window(records: DataFrame, system: str) -> DataFrame:
    return records.where(F.col("originating_system_name") == system)


def delta_window(records: DataFrame, system: str, since) -> DataFrame:
    """At or after ``since``, in order; the boundary is read again on purpose."""
    return initial_window(records, system).where(F.col("source_modified_at") >= F.lit(since)).orderBy("source_modified_at")


def distinct_systems(records: DataFrame, payload: str = "payload") -> DataFrame:
    name = F.get_json_object(payload, "$.OriginatingSystemName")
    return records.select(name.alias("originating_system_name")).where("originating_system_name <> ''").distinct().orderBy("originating_system_name")


def pending_raw(raw: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows after their resource's cursor (all where there is none)."""
    at = cursors.select("resource", F.col("last_raw_seq").alias("__last"))
    return raw.join(at, "resource", "left").where("__last is null or raw_seq > __last").drop("__last")


def latest_media_url(raw: DataFrame) -> DataFrame:
    """(source_key, media_url) from the newest raw row of each media key."""
    return raw.where("resource = 'media'").groupBy("source_key").agg(F.max_by(F.get_json_object("payload", "$.MediaURL"), "raw_seq").alias("media_url"))


def read_media_files(spark: SparkSession, path: str) -> DataFrame:
    """(media_key, content, mime_type) of files named by their media key."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind.isin("png", "gif", "webp"), F.concat(F.lit("image/"), kind)).otherwise("application/octet-stream")
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("media_key"), "content", mime.alias("mime_type"))


def content_addressed(files: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Files (media_key, content, mime_type) -> one attachment per distinct content, and each key's link to it.

    The first key of a content names the object: ``<prefix>media/<media_key>/<sha256>``; later copies re-use it.
    """
    prefix = prefix.strip("/") + "/" if prefix.strip("/") else ""
    hashed = files.select("media_key", "mime_type", F.octet_length("content").alias("size_bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("source_hash"))
    first = hashed.groupBy("source_hash").agg(F.min(F.struct("media_key", "mime_type", "size_bytes")).alias("f"))
    attachments = first.select("source_hash", F.concat(F.lit(f"{prefix}media/"), "f.media_key", F.lit("/"), "source_hash").alias("object_key"), "f.mime_type", "f.size_bytes")
    return attachments, hashed.select("media_key", F.col("source_hash").alias("attachment_id"))
