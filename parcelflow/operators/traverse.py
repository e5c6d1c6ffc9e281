"""Joins between entities: soft keys, child lists, trees, primary photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: role -> (key column, kind of entity)
ROLES = {f"{role}_{who}": (f"{role}_{who}_key", who) for who in ("agent", "office") for role in ("list", "co_list", "buyer", "co_buyer")}


def property_media(listings: DataFrame, media: DataFrame) -> DataFrame:
    """(listing_key, media_key, ...) of the visible media of each listing."""
    own = media.where("resource_type = 'property' and mlg_can_view")
    return listings.select("listing_key").join(own, F.col("listing_key") == F.col("resource_record_key"))


def primary_photo(listings: DataFrame, media: DataFrame) -> DataFrame:
    """(listing_key, media_key): preferred first, then lowest order (NULL last), then lowest key; NULL without photo."""
    first = property_media(listings, media).groupBy("listing_key").agg(
        F.min(F.struct((~F.coalesce("preferred_photo_yn", F.lit(False))).alias("a"), F.col("preferred_photo_yn").isNull().alias("b"), F.col("order").isNull().alias("c"), F.col("order").alias("d"), F.col("media_key").alias("e"))).alias("m")
    )
    return listings.select("listing_key").join(first, "listing_key", "left").select("listing_key", F.col("m.e").alias("media_key"))


def _left_join(df: DataFrame, key: str, side: DataFrame, own: str) -> DataFrame:
    """``df`` left-joined with ``side`` where ``key`` equals ``own``, which is dropped. Rows without a key match nothing; they are dealt out by their other columns, else they were one task."""
    plain = [n for n, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    salted = df.withColumn("__salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(1 << 20)) + 1).otherwise(0))
    # no constant, which would be folded into the condition
    named = side.withColumn("__none", F.when(F.col(own).isNull(), F.lit(1)).otherwise(0).cast("long"))
    return salted.join(named, (F.col(key) == F.col(own)) & (F.col("__salt") == F.col("__none")), "left").drop("__salt", "__none", own)


def soft_join(df: DataFrame, key: str, entity: DataFrame, entity_key: str, columns: dict[str, str], prefix: str) -> DataFrame:
    """``df`` with columns of the visible entity that ``key`` names; NULL where it is absent or hidden, the key stays."""
    side = entity.where("mlg_can_view").select(F.col(entity_key).alias("__key"), *[F.col(c).alias(f"{prefix}_{n}") for n, c in columns.items()])
    return _left_join(df, key, side, "__key")


def with_roles(listings: DataFrame, members: DataFrame, offices: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """The agents and offices of a listing by name, for each of its (up to eight) roles."""
    for role in roles or [r for r, (key, _) in ROLES.items() if key in listings.columns]:
        key, who = ROLES[role]
        table, own, name = (members, "member_key", "member_full_name") if who == "agent" else (offices, "office_key", "office_name")
        listings = soft_join(listings, key, table, own, {"name": name}, role)
    return listings


def member_office(members: DataFrame, offices: DataFrame) -> DataFrame:
    own = offices.select(F.col("office_key"), F.col("office_name"), "mlg_can_view")
    return soft_join(members, "office_key", own, "office_key", {"name": "office_name"}, "office")


def office_tree(offices: DataFrame) -> DataFrame:
    """(office_key, main_name, branches): the main office and the number of branches, hidden ones too."""
    main = offices.select(F.col("office_key").alias("__main"), F.col("office_name").alias("main_name"))
    below = offices.groupBy(F.col("main_office_key").alias("__of")).agg(F.count("*").alias("branches"))
    joined = offices.join(main, F.col("main_office_key") == F.col("__main"), "left").join(below, F.col("office_key") == F.col("__of"), "left")
    return joined.select("office_key", "main_name", F.coalesce("branches", F.lit(0)).alias("branches"))


def office_ancestors(offices: DataFrame, most: int = 64) -> DataFrame:
    """(office_key, ancestor_key, depth): all main offices above each office, the nearest at depth 1; hidden ones too.

    An office is its own ancestor nowhere: where main offices go round in a circle, each sees the others once. A key without a row of its own ends a chain, and so does depth ``most``.
    """
    return offices.sparkSession.sql(
        f"""with recursive up (office_key, ancestor_key, depth, seen) max recursion level {most + 1} as (
          select office_key, main_office_key, 1, array(office_key, main_office_key) from {{edges}}
          union all
          select up.office_key, e.main_office_key, up.depth + 1, array_append(up.seen, e.main_office_key) from up join {{edges}} e on e.office_key = up.ancestor_key
            where up.depth < {most} and not array_contains(up.seen, e.main_office_key))
        select office_key, ancestor_key, depth from up limit all""",
        edges=offices.where("main_office_key is not null and main_office_key <> office_key").select("office_key", "main_office_key"),
    )


def children_of(listings: DataFrame, children: DataFrame, key: str, name: str, include_hidden: bool = True) -> DataFrame:
    """``listings`` with the sorted keys of their children under ``name``; tombstoned children count by default."""
    rows = children if include_hidden else children.where("mlg_can_view")
    lists = rows.where("parent_listing_key is not null").groupBy(F.col("parent_listing_key").alias("__of")).agg(F.array_sort(F.collect_list(key)).alias(name))
    return listings.join(lists, F.col("listing_key") == F.col("__of"), "left").drop("__of")


def child_parent(children: DataFrame, listings: DataFrame, columns: list[str]) -> DataFrame:
    side = listings.select(F.col("listing_key").alias("__p"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return _left_join(children, "parent_listing_key", side, "__p")


def orphan_keys(df: DataFrame, key: str, entity: DataFrame, entity_key: str) -> DataFrame:
    """(key, n): soft keys without a visible target, and how often they are used."""
    there = entity.where("mlg_can_view").select(F.col(entity_key).alias("__key"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).join(there, F.col(key) == F.col("__key"), "left_anti")


def refresh_listings(claimed: DataFrame, media: DataFrame, listings: DataFrame) -> DataFrame:
    """Distinct listings (with a listing_id) of claimed property media: those whose links are to be fetched again."""
    own = media.where("resource_type = 'property'").join(claimed.select("media_key").distinct(), "media_key", "left_semi")
    found = listings.where("listing_id is not null").join(own, F.col("listing_key") == F.col("resource_record_key"), "left_semi")
    return found.select("listing_key", "listing_id").distinct()


def version_chain(versions: DataFrame, key: str) -> DataFrame:
    """Each version with the ones before and after it."""
    w = Window.partitionBy(key).orderBy("raw_seq")
    return versions.select(key, "raw_seq", F.lag("raw_seq").over(w).alias("previous_seq"), F.lead("raw_seq").over(w).alias("next_seq"))
