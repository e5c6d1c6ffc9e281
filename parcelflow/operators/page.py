"""List queries: ordering, keyset pages, page flags, node lookup."""

from __future__ import annotations

import decimal
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.geo import region
from parcelflow.plans.registry import RESOURCES
from parcelflow.sources.snapshot import work_folder

from .where import where as where_rows

PAGE = 500


def clamp(first: int | None = None, last: int | None = None) -> tuple[int | None, int | None]:
    """Page sizes: 500 by default and at most; both or negative ones are errors."""
    if first is not None and last is not None:
        raise ValueError("first and last exclude each other")
    if (first or 0) < 0 or (last or 0) < 0:
        raise ValueError("a page size is not negative")
    if last is not None:
        return None, min(last, PAGE)
    return min(PAGE if first is None else first, PAGE), None


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return F.lit(str(value)).cast(f"decimal({max(len(value.as_tuple().digits), -value.as_tuple().exponent) + 1},{max(0, -value.as_tuple().exponent)})")
    return F.lit(value)


def order_columns(order: str | None, key: str, descending: bool, reverse: bool = False) -> list[Column]:
    """The order value, NULL last where it ascends and first where it descends, then the key."""
    down = descending != reverse
    one = [] if order is None else [F.col(order).desc_nulls_first() if down else F.col(order).asc_nulls_last()]
    return [*one, F.col(key).desc() if down else F.col(key).asc()]


def after_cursor(order: str | None, key: str, descending: bool, cursor: tuple, forward: bool = True) -> Column:
    """Rows behind the cursor (order value, key) in the order, or before it. NULL is the largest value."""
    value, at = cursor
    up = descending != forward
    beyond = F.col(key) > at if up else F.col(key) < at
    if order is None:
        return beyond
    c = F.col(order)
    if value is None:
        return (c.isNull() & beyond) if up else (c.isNotNull() | beyond)
    v = _plain(value)
    return ((c > v) | c.isNull() | ((c == v) & beyond)) if up else ((c < v) | ((c == v) & beyond))


@dataclass
class Page:
    rows: DataFrame  # at most one more than the page has, in order
    size: int
    total: DataFrame  # one row: total_count
    backward: bool
    after: tuple | None
    before: tuple | None

    def page(self) -> DataFrame:
        """The rows of the page."""
        return self.rows.where(F.col("__place") <= self.size).drop("__place")

    def info(self) -> DataFrame:
        """One row: has_next_page, has_previous_page, start_key, end_key, total_count.

        has_next starts out true with a ``before``, has_previous with an ``after``, whatever the data say; a page of
        size 0 has a next one if there is anything.
        """
        n = F.coalesce(F.max("__place"), F.lit(0))
        more = n > self.size
        within = F.col("__place") <= self.size
        first, last = F.min_by("__key", F.when(within, F.col("__place"))), F.max_by("__key", F.when(within, F.col("__place")))
        if self.backward:
            first, last = last, first
        got = self.rows.agg(more.alias("more"), first.alias("start_key"), last.alias("end_key"))
        both = got.join(F.broadcast(self.total))
        following, previous = F.lit(self.before is not None), F.lit(self.after is not None)
        if self.size == 0:
            following = F.col("total_count") > 0
        elif self.backward:
            previous = previous | F.col("more")
        else:
            following = following | F.col("more")
        return both.select(following.alias("has_next_page"), previous.alias("has_previous_page"), "start_key", "end_key", "total_count")


def list_query(
    df: DataFrame,
    key: str,
    where: dict | None = None,
    geo: dict | None = None,
    order: str | None = None,
    descending: bool = False,
    first: int | None = None,
    last: int | None = None,
    after: tuple | None = None,
    before: tuple | None = None,
    visible_only: bool = True,
    edges: dict | None = None,
) -> Page:
    """A filtered, ordered page. Versions and source systems are listed with ``visible_only=False``."""
    first, last = clamp(first, last)
    rows = df.where("mlg_can_view") if visible_only else df
    if geo is not None:
        rows = rows.where(region(F.col("latitude"), F.col("longitude"), geo))
    rows = where_rows(rows, where, edges)
    total = rows.agg(F.count("*").alias("total_count"))
    for cursor, forward in ((after, True), (before, False)):
        if cursor is not None:
            rows = rows.where(after_cursor(order, key, descending, cursor, forward))
    size = first if last is None else last
    over = rows.orderBy(*order_columns(order, key, descending, reverse=last is not None)).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order_columns(order, key, descending, reverse=last is not None)))
    return Page(over.withColumn("__place", place).withColumn("__key", F.col(key)), size, total, last is not None, after, before)


#: The lists by name: resource and whether they show versions. Entities are listed where visible, versions always.
LISTS = {
    "lookups": ("lookup", False), "mediaSlice": ("media", False), "members": ("member", False), "offices": ("office", False),
    "openHouses": ("open_house", False), "properties": ("property", False), "propertyRooms": ("property_rooms", False), "propertyUnitTypes": ("property_unit_types", False),
    "mediaVersions": ("media", True), "memberVersions": ("member", True), "officeVersions": ("office", True), "openHouseVersions": ("open_house", True),
    "propertyVersions": ("property", True), "propertyRoomVersions": ("property_rooms", True), "propertyUnitTypeVersions": ("property_unit_types", True),
}


def named_list(tables: dict[str, DataFrame], name: str, **query) -> Page:
    """A page of one of the lists, or of ``sourceSystems``; ``query`` as of ``list_query``.

    ``tables``: the entities by resource, their versions as ``<resource>_version``, and ``source_system``.
    """
    if name == "sourceSystems":
        return list_query(tables["source_system"], "source_system_id", visible_only=False, **query)
    resource, versions = LISTS[name]
    if versions:
        return list_query(tables[f"{resource}_version"], "version_id", visible_only=False, **query)
    return list_query(tables[resource], RESOURCES[resource].key_column, **query)


#: The tables in which an id is looked up, in this order, and their keys.
NODE_TABLES = {
    "lookup": "lookup_key", "media": "media_key", "media_version": "version_id", "member": "member_key", "member_version": "version_id", "office": "office_key", "office_version": "version_id",
    "open_house": "open_house_key", "open_house_version": "version_id", "property": "listing_key", "property_room": "room_key", "property_room_version": "version_id",
    "property_unit_type": "unit_type_key", "property_unit_type_version": "version_id", "property_version": "version_id", "source_system": "source_system_id",
}


def node_tables(tables: dict[str, DataFrame]) -> list[tuple[str, DataFrame, str, bool]]:
    """What ``nodes`` takes, in the order of lookup; entities may be hidden, versions and source systems may not."""
    if unknown := set(tables) - set(NODE_TABLES):
        raise ValueError(f"not tables of nodes: {sorted(unknown)}")
    return [(name, tables[name], key, key not in ("version_id", "source_system_id")) for name, key in NODE_TABLES.items() if name in tables]


def union_nodes(tables: list[tuple[str, DataFrame, str, bool]]) -> DataFrame:
    """(priority, id, type, visible) of many tables (type, rows, key, has visibility)."""
    each = [
        df.select(F.lit(i).alias("priority"), F.col(key).cast("string").alias("id"), F.lit(kind).alias("type"), (F.col("mlg_can_view") if shown else F.lit(True)).alias("visible"))
        for i, (kind, df, key, shown) in enumerate(tables)
    ]
    return reduce(DataFrame.unionByName, each)


def nodes(tables: list[tuple[str, DataFrame, str, bool]], ids: list[str], spark) -> DataFrame:
    """(pos, id, type) in the order asked; the first table that has the id wins, and a hidden hit there gives NULL."""
    asked = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    hits = union_nodes(tables).join(asked.select("id").distinct(), "id", "left_semi")
    first = hits.groupBy("id").agg(F.min_by(F.struct("type", "visible"), "priority").alias("n"))
    return asked.join(first, "id", "left").select("pos", "id", F.when(F.col("n.visible"), F.col("n.type")).alias("type")).orderBy("pos")


def page_numbers(df: DataFrame, order: list[str], size: int = 1000, by: str | None = None) -> DataFrame:
    """Disjoint pages of ``size`` rows in a stated order (within ``by``), numbered from 0.

    Rows are dealt out by ranges of the order and numbered within their range; the counts of the ranges before (one row for
    each range and ``by``) give where a range begins. So no task sorts more than a range, however many rows ``by`` has.
    """
    spark = df.sparkSession
    group = [by] if by else []
    path = work_folder(spark, "ranges")
    df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema(df.schema.add("__range", "integer")).parquet(path)
    counts = cut.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__range").alias("__r"), *[F.col(c).alias("__by") for c in group], F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)) - 1
    here = F.col("__range") == F.col("__r")
    numbered = cut.withColumn("__place", place).join(offsets, here & F.col(by).eqNullSafe(F.col("__by")) if by else here)
    return numbered.select(*df.columns, F.floor((F.col("__before") + F.col("__place")) / size).alias("page_no"))


def to_wire(df: DataFrame) -> DataFrame:
    """Decimals as exact text, times in RFC 3339, empty arrays as NULL."""

    def one(f) -> Column:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith("decimal"):
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif kind.startswith("array"):
            c = F.when(F.size(c) > 0, c)
        return c.alias(f.name)

    return df.select(*map(one, df.schema.fields))
