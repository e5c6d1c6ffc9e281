"""Listing-shaped views of the driver's star schema. One SQL text serves Spark and, for comparison, DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"

VIEWS = {
    "feed": """select user_id as source_key, (event_id * 7919) % 10007 * 1000000 + event_id as raw_seq, ts as source_modified_at,
  event_type <> 'error' as mlg_can_view, cast(floor(value / 10) as bigint) as list_price, event_type as status from {events}""",
    "listing": """select concat('L', cast(o_orderkey as string)) as listing_key, case when o_orderkey % 9 <> 0 then concat('#', cast(o_orderkey as string)) end as listing_id,
  cast(o_totalprice as decimal(13,2)) as list_price,
  case o_orderstatus when 'O' then 'Active' when 'P' then 'ActiveUnderContract' else 'Closed' end as standard_status,
  n_name as city, r_name as state_or_province, lpad(cast((o_custkey * 37) % 100000 as string), 5, '0') as postal_code,
  cast(o_orderkey % 900 + 100 as string) as street_number, p_name as street_name,
  case when o_orderkey % 17 <> 0 then 30 + cast(o_orderkey % 1000 as double) / 1000 end as latitude, -97 - cast(o_custkey % 500 as double) / 500 as longitude,
  o_orderkey % 10 <> 0 as mlg_can_view, concat('A', cast(case when o_orderkey % 13 = 0 then o_orderkey + 100000000 else o_custkey end as string)) as list_agent_key,
  concat('F', cast(o_custkey % 120 as string)) as list_office_key, o_orderdate as source_modified_at, o_orderkey as raw_seq
  from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
  join {part} on p_partkey = o_orderkey % 200""",
    "agent": """select concat('A', cast(c_custkey as string)) as member_key, c_name as member_full_name, concat('F', cast(c_custkey % 120 as string)) as office_key,
  c_custkey % 7 <> 0 as mlg_can_view from {customer}""",
    "office": """select concat('F', cast(s_suppkey as string)) as office_key, s_name as office_name,
  case when s_suppkey >= 10 then concat('F', cast(cast(floor(s_suppkey / 10) as bigint) as string)) end as main_office_key, s_suppkey % 11 <> 0 as mlg_can_view from {supplier}""",
    "media": """select concat('M', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as media_key, 'property' as resource_type, concat('L', cast(l_orderkey as string)) as resource_record_key,
  case when l_linenumber % 5 <> 0 then l_linenumber end as "order", case when l_linenumber % 4 <> 0 then max(l_returnflag) = 'R' end as preferred_photo_yn,
  (l_orderkey + l_linenumber) % 6 <> 0 as mlg_can_view, case when l_linenumber % 3 <> 0 then max(l_shipdate) end as media_modification_timestamp, max(l_shipdate) as source_modified_at,
  case when (l_orderkey + l_linenumber) % 3 = 0 then concat('X', cast(l_orderkey as string)) end as attachment_id from {lineitem} group by l_orderkey, l_linenumber""",
    "room": """select distinct concat('R', cast(l_orderkey as string), '-', cast(l_partkey as string)) as room_key,
  concat('L', cast(case when l_partkey % 19 = 0 then l_orderkey + 100000000 else l_orderkey end as string)) as listing_key,
  case when l_partkey % 3 <> 0 and l_partkey % 19 <> 0 then concat('L', cast(l_orderkey as string)) end as parent_listing_key,
  case when l_partkey % 2 = 0 then 'Main' else 'Upper' end as room_level, l_partkey % 8 <> 0 as mlg_can_view from {lineitem}""",
    "open_house": """select concat('H', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as open_house_key, concat('L', cast(l_orderkey as string)) as listing_key,
  case when l_linenumber % 5 <> 0 then concat('L', cast(l_orderkey as string)) end as parent_listing_key, max(l_shipdate) as open_house_date, case when l_linenumber % 2 = 0 then 'Active' else 'Canceled' end as open_house_status,
  (l_orderkey + l_linenumber) % 9 <> 0 as mlg_can_view from {lineitem} where l_linenumber % 3 = 0 group by l_orderkey, l_linenumber""",
    "unit_type": """select concat('U', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as unit_type_key, concat('L', cast(l_orderkey as string)) as listing_key,
  concat('L', cast(l_orderkey as string)) as parent_listing_key, cast(l_orderkey % 6 as int) as unit_type_beds_total, (l_orderkey + l_linenumber) % 4 <> 0 as mlg_can_view
  from {lineitem} where l_linenumber % 4 = 0 group by l_orderkey, l_linenumber""",
    "lookup": """select concat('K', cast(p_partkey as string)) as lookup_key, p_brand as lookup_name, p_name as lookup_value, p_partkey % 8 <> 0 as mlg_can_view from {part}""",
    "source_system": """select concat('S', cast(r_regionkey as string)) as source_system_id, r_name as name from {region}""",
    "territory": " union all ".join(
        f"select concat('F', cast(s_suppkey as string)) as region_id, {ring} as ring, {seq} as seq, 30 + cast(s_suppkey * {ring + 37} % 700 + {up} as double) / 1000 as latitude, -98 + cast(s_suppkey * {53 - ring} % 400 + {right} as double) / 500 as longitude from {{supplier}}"
        for ring, corners in enumerate([[(0, 0), (100, 0), (100, 60), (50, 90), (0, 60)], [(20, 10), (220, 10), (20, 110), (120, 60)]])
        for seq, (up, right) in enumerate(corners)
    ),
    "roles": """select listing_key, list_agent_key, concat('A', cast(raw_seq % 700 as string)) as co_list_agent_key, concat('A', cast(raw_seq % 1100 as string)) as buyer_agent_key,
  case when raw_seq % 3 = 0 then concat('A', cast(raw_seq % 900 as string)) end as co_buyer_agent_key, list_office_key, concat('F', cast(raw_seq % 50 as string)) as co_list_office_key,
  concat('F', cast(raw_seq % 70 as string)) as buyer_office_key, case when raw_seq % 4 = 0 then concat('F', cast(raw_seq % 90 as string)) end as co_buyer_office_key from {listing}""",
    "job": """select concat('J', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as attachment_job_id, concat('M', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as media_key,
  case (l_orderkey + l_linenumber) % 7 when 0 then 'pending' when 1 then 'retrying' when 2 then 'in_progress' when 3 then 'succeeded' when 4 then 'permanently_failed' when 5 then 'canceled' else 'pending' end as status,
  case when l_orderkey % 5 <> 0 then max(l_shipdate) end as media_modified_at, min(l_shipdate) as created_at, max(l_shipdate) as claimed_at,
  concat('w', cast(l_orderkey % 3 as string)) as claimed_by, cast(l_orderkey % 4 as int) as attempt_count, case when (l_orderkey + l_linenumber) % 7 = 3 then concat('Y', cast(l_orderkey as string)) end as attachment_id
  from {lineitem} where l_linenumber % 2 = 1 group by l_orderkey, l_linenumber""",
    "sync_event": """select event_id as sync_event_id, case user_id % 5 when 0 then 'property' when 1 then 'member' when 2 then 'office' when 3 then 'open_house' else 'lookup' end as resource,
  case event_id % 4 when 0 then 'backfill' else 'sync' end as run_type, case event_id % 7 when 0 then 'failed' when 1 then 'running' else 'success' end as status, ts as started_at,
  case when event_id % 7 <> 1 then ts + interval 5 minutes end as ended_at, cast(floor(value) as bigint) as record_count, case when event_id % 7 > 1 and event_id % 3 <> 0 then ts end as high_water_mark,
  cast(null as string) as error_summary from {events}""",
    "cursors": """select resource, max(sync_event_id) * 9 / 10 as last_raw_seq, max(started_at) as modified_at from {sync_event} where resource <> 'lookup' group by resource""",
    "raw": """select event_id as raw_seq, case user_id % 5 when 0 then 'property' when 1 then 'member' when 2 then 'office' when 3 then 'open_house' else 'lookup' end as resource,
  cast(user_id as string) as source_key, date_trunc('day', ts) as source_modified_at, 'insert' as change_type, props as payload from {events}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores. The driver's tables have one row group each, which would be one task of a long computation."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    if name == "room":  # a room is its two keys: these are made distinct, and not the five texts made of them
        text = text.replace("select distinct", "select").replace("from {lineitem}", "from (select distinct l_orderkey, l_partkey from {lineitem})")
    text = text.replace('"order"', "`order`").replace("date_trunc('day', ts)", "cast(date_trunc('day', ts) as timestamp_ntz)")
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if f"{{{t}}}" in text})


def sql(body: str, *views: str) -> str:
    """DuckDB text of ``body`` after the views that it names."""
    needed: list[str] = []

    def add(name: str) -> None:
        for t in VIEWS:
            if f"{{{t}}}" in VIEWS[name]:
                add(t)
        if name not in needed:
            needed.append(name)

    for v in views:
        add(v)
    parts = []
    for n in needed:
        text = VIEWS[n]
        for t in (*TABLES, *VIEWS):
            text = text.replace(f"{{{t}}}", t)
        parts.append(f"{n} as ({text})")
    body = body.strip()
    if body.startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}" if parts else body
    if body.startswith("recursive "):
        return f"with recursive {', '.join([*parts, body[10:]])}"
    return f"with {', '.join(parts)} {body}" if parts else body
