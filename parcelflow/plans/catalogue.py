"""The registered queries over the listing views, each with the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import trigram
from parcelflow.functions.geo import geodesic, region
from parcelflow.operators import audit, jobs, ledger, page, project, state, traverse, versions
from parcelflow.operators.where import predicate
from parcelflow.operators.where import where as where_rows
from parcelflow.sources import feed as feed_source
from parcelflow.sources.snapshot import work_folder
from parcelflow.streaming import feed_stream

from . import registry
from .demo import NOW, VIEWS, spread, sql, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FEED_DATA = ["list_price", "status"]


def query(*views: str, oracle: str | None = None) -> Callable:
    """Register ``f(*views as DataFrames)`` under its name, with the SQL over the same views."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views))

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *(v for v in views if v not in ("documents", "orders", "events", "lineitem")))
        return f

    return register


def _time(column: str) -> F:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _t(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') as {column.split('.')[-1]}"


# --- version history -------------------------------------------------------------------------------------------

#: The fold as a recursive query: row by row per key, in order of arrival.
_FOLD = """recursive numbered as (select *, row_number() over (partition by source_key order by raw_seq) as rn, concat(list_price, '/', status) as txt from feed),
rec as (
  select source_key, cast(0 as bigint) as rn, cast(null as bigint) as raw_seq, cast(null as varchar) as outcome, cast(null as bigint) as prior_seq, false as found, false as tomb,
    cast(null as timestamp) as open_at, cast(null as varchar) as open_txt, cast(null as bigint) as open_seq from (select distinct source_key from feed)
  union all
  select source_key, rn, raw_seq, o, open_seq, found or w, case when w then o = 'delete' else tomb end, case when w then source_modified_at else open_at end,
    case when w then case when o <> 'delete' then txt end else open_txt end, case when w then raw_seq else open_seq end
  from (select *, o in ('insert', 'update', 'delete') as w from (
    select n.source_key, n.rn, n.raw_seq, n.source_modified_at, n.txt, r.found, r.tomb, r.open_at, r.open_txt, r.open_seq,
      case when r.open_at is not null and n.source_modified_at <= r.open_at then 'skip-stale' when not n.mlg_can_view and r.found and r.tomb then 'skip-tombstoned'
        when not n.mlg_can_view then 'delete' when not r.found then 'insert' when r.open_txt is not distinct from n.txt then 'skip-no-diff' else 'update' end as o
    from rec r join numbered n on n.source_key = r.source_key and n.rn = r.rn + 1))),
outcomes as (select source_key, raw_seq, outcome, prior_seq from rec where rn > 0),
written as (select o.*, f.source_modified_at, f.mlg_can_view, f.list_price, f.status from outcomes o join feed f using (raw_seq) where outcome in ('insert', 'update', 'delete')),
versions as (select w.source_key, w.raw_seq, w.source_modified_at as valid_from, lead(w.source_modified_at) over (partition by w.source_key order by w.raw_seq) as valid_to, outcome as change_type, w.mlg_can_view,
  case when outcome <> 'delete' then w.list_price end as list_price, case when outcome <> 'delete' then w.status end as status, p.mlg_can_view as old_view,
  case when p.mlg_can_view then p.list_price end as old_price, case when p.mlg_can_view then p.status end as old_status from written w left join feed p on p.raw_seq = w.prior_seq) """


def _outcomes(feed: DataFrame) -> DataFrame:
    return versions.fold_versions(feed, "source_key", FEED_DATA)


def _versions(feed: DataFrame) -> DataFrame:
    return versions.version_batch(feed, "source_key", FEED_DATA)[1]


@query("feed", oracle=_FOLD + "select outcome, count(*) as n from outcomes group by 1")
def outcomes(feed):
    return versions.outcome_counts(_outcomes(feed))


@query("feed", oracle=_FOLD + "select source_key, raw_seq, outcome, coalesce(prior_seq, -1) as prior_seq from outcomes")
def fold_rows(feed):
    return _outcomes(feed).fillna(-1, ["prior_seq"])


@query("feed", oracle=_FOLD + "select source_key, raw_seq, outcome, coalesce(prior_seq, -1) as prior_seq from outcomes")
def fold_long_histories(feed):
    return versions.fold_versions(feed, "source_key", FEED_DATA, long_history=60).fillna(-1, ["prior_seq"])


@query("feed", oracle=_FOLD + """select count(*) as processed, count(*) filter (outcome = 'insert') as "insert", count(*) filter (outcome = 'update') as "update", count(*) filter (outcome = 'delete') as "delete",
  count(*) filter (outcome = 'skip-stale') as skip_stale, count(*) filter (outcome = 'skip-no-diff') as skip_no_diff, count(*) filter (outcome = 'skip-tombstoned') as skip_tombstoned from outcomes""")  # fmt: skip
def pass_stats(feed):
    return versions.pass_stats(_outcomes(feed))


@query("feed", oracle=_FOLD + f"select source_key, raw_seq, {_t('valid_from')}, {_t('valid_to')}, change_type, mlg_can_view, coalesce(list_price, -1) as list_price, status from versions")
def version_history(feed):
    return _versions(feed).select("source_key", "raw_seq", _time("valid_from"), _time("valid_to"), "change_type", "mlg_can_view", *FEED_DATA).fillna(-1, ["list_price"])


@query("feed", oracle=_FOLD + """select source_key, raw_seq, field, old, "new" from (
  select source_key, raw_seq, 'list_price' as field, cast(old_price as varchar) as old, cast(list_price as varchar) as "new" from versions where change_type = 'update'
  union all select source_key, raw_seq, 'status', old_status, status from versions where change_type = 'update'
  union all select source_key, raw_seq, 'mlg_can_view', cast(old_view as varchar), cast(mlg_can_view as varchar) from versions where change_type = 'update') where old is distinct from "new" """)  # fmt: skip
def changed_fields(feed):
    return versions.expand_changes(_versions(feed), "source_key")


@query("feed", oracle=_FOLD + """select source_key, arg_max(raw_seq, raw_seq) as last_seq, arg_max(mlg_can_view, raw_seq) as mlg_can_view, coalesce(arg_max(list_price, raw_seq) filter (change_type <> 'delete'), -1) as list_price,
  arg_max(status, raw_seq) filter (change_type <> 'delete') as status from versions group by 1""")  # fmt: skip
def current_state(feed):
    v = _versions(feed)
    last = v.groupBy("source_key").agg(F.max("raw_seq").alias("last_seq"))
    return state.merge_entities(None, v, "source_key", FEED_DATA, NOW).join(last, "source_key").select("source_key", "last_seq", "mlg_can_view", *FEED_DATA).fillna(-1, ["list_price"])


@query("feed", oracle=_FOLD + """select source_key, arg_max(raw_seq, raw_seq) as last_seq, arg_max(mlg_can_view, raw_seq) as mlg_can_view, coalesce(arg_max(list_price, raw_seq) filter (change_type <> 'delete'), -1) as list_price,
  arg_max(status, raw_seq) filter (change_type <> 'delete') as status from versions group by 1""")  # fmt: skip
def current_state_in_two_batches(feed):
    """The same from two batches in order of arrival, the second folded against the stored state of the first."""
    half = feed.where("raw_seq < 5000000000")
    rest = feed.where("raw_seq >= 5000000000")
    v1 = _versions(half)
    e1 = state.merge_entities(None, v1, "source_key", FEED_DATA, NOW)
    seed = versions.fold_state(e1, v1, "source_key", FEED_DATA, rest)
    out2 = versions.fold_versions(rest, "source_key", FEED_DATA, seed)
    v2 = versions.build_versions(rest, out2, "source_key", FEED_DATA, v1.where("valid_to is null"))
    e2 = state.merge_entities(e1, v2, "source_key", FEED_DATA, NOW)
    last = versions.append_versions(v1, v2, "source_key").where("valid_to is null").select("source_key", F.col("raw_seq").alias("last_seq"))
    return e2.join(last, "source_key").select("source_key", "last_seq", "mlg_can_view", *FEED_DATA).fillna(-1, ["list_price"])


@query("feed", oracle=_FOLD + "select source_key, raw_seq, coalesce(list_price, -1) as list_price from versions where valid_from <= timestamp '2024-01-15' and (valid_to > timestamp '2024-01-15' or valid_to is null)")
def as_of(feed):
    return versions.as_of(_versions(feed), F.expr("timestamp '2024-01-15'")).select("source_key", "raw_seq", "list_price").fillna(-1, ["list_price"])


@query("feed", oracle=_FOLD + "select source_key, raw_seq, coalesce(lag(raw_seq) over w, -1) as previous_seq, coalesce(lead(raw_seq) over w, -1) as next_seq from versions window w as (partition by source_key order by raw_seq)")
def version_chain(feed):
    return traverse.version_chain(_versions(feed), "source_key").fillna(-1)


@query("feed", oracle=_FOLD + """, n as (select source_key, count(*) as n from versions group by 1)
  select source_key, case when source_key % 7 = 0 and n > 1 then 'several open versions' else 'entity does not point at the open version' end as problem from n where source_key % 7 = 0 and n > 1 or source_key % 5 = 0""")  # fmt: skip
def version_invariants(feed):
    """With breaches planted: every seventh key has all its versions open, every fifth entity points nowhere."""
    v = _versions(feed)
    entity = state.merge_entities(None, v, "source_key", FEED_DATA, NOW)
    spoiled = v.withColumn("valid_to", F.when(F.col("source_key") % 7 != 0, F.col("valid_to")))
    lost = entity.withColumn("current_version_id", F.when(F.col("source_key") % 5 == 0, "nowhere").otherwise(F.col("current_version_id")))
    return versions.version_invariants(spoiled, lost, "source_key")


@query("feed", oracle=_FOLD + "select 'status' as resource, max(raw_seq) as last_raw_seq from outcomes")
def advance_cursor(feed):
    return versions.advance_cursor(_outcomes(feed), "status")


@query("feed", oracle=_FOLD + f"select source_key, raw_seq, {_t('valid_from')} from versions where source_key in (select min(source_key) from feed)")
def key_history(feed):
    first = feed.agg(F.min("source_key")).first()[0]
    return versions.history(_versions(feed), "source_key", first).select("source_key", "raw_seq", _time("valid_from"))


@query("feed", oracle="""with n as (select source_key, min(raw_seq) as a, count(*) as n from feed group by 1)
  select case source_key % 3 when 0 then 'insert,update' when 1 then 'insert,skip-no-diff' else 'insert,update' end as outcomes, case when source_key % 3 <> 1 then 'extended_fields' else '' end as changed, count(*) as n from n group by 1, 2""")  # fmt: skip
def leftover_types(feed):
    """Records whose leftover field changes from "5" to 5, whose fields only change places, and whose nested value changes."""
    key = feed.groupBy("source_key").agg(F.min("raw_seq").alias("a")).withColumn("k", F.concat(F.lit("L"), F.col("source_key").cast("string")))
    head = lambda t: F.concat(F.lit('{"ListingKey":"'), F.col("k"), F.lit(f'","ModificationTimestamp":"2024-01-0{t}T00:00:00Z",'))
    first = F.when(F.col("source_key") % 3 == 0, '"X":"5"}').when(F.col("source_key") % 3 == 1, '"X":{"a":1,"b":[2]},"Y":true}').otherwise('"X":{"a":null}}')
    then = F.when(F.col("source_key") % 3 == 0, '"X":5}').when(F.col("source_key") % 3 == 1, '"Y":true,"X":{"b":[2],"a":1}}').otherwise('"X":{"a":0}}')
    rows = key.select(F.inline(F.array(*[F.struct((F.col("source_key") * 2 + i).alias("raw_seq"), F.expr("timestamp '2024-01-01'").alias("source_modified_at"), F.concat(head(i + 1), text).alias("payload")) for i, text in enumerate((first, then))])))
    typed = project.poison_split(project.project(spread(rows), "property"))[0]
    data = ["city", "list_price", "extended_fields"]
    outcomes = versions.fold_versions(typed, "listing_key", data)
    changes = versions.expand_changes(versions.build_versions(typed, outcomes, "listing_key", data), "listing_key").groupBy("listing_key").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("changed"))
    per_key = outcomes.groupBy("listing_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_seq", "outcome"))), lambda x: x["outcome"]), ",").alias("outcomes"))
    return per_key.join(changes, "listing_key", "left").select("outcomes", F.coalesce("changed", F.lit("")).alias("changed")).groupBy("outcomes", "changed").agg(F.count("*").alias("n"))


@query("feed", oracle="""with o as (select source_key, event_seq as raw_seq, mlg_can_view as v, concat(list_price, '/', status) as t, lag(mlg_can_view) over w as was, lag(concat(list_price, '/', status)) over w as bef
  from (select *, raw_seq % 1000000 as event_seq from feed) window w as (partition by source_key order by event_seq))
  select source_key, raw_seq, case when not v then case when was is false then 'skip-tombstoned' else 'delete' end when was is null then 'insert' when was and bef = t then 'skip-no-diff' else 'update' end as outcome from o""")  # fmt: skip
def versions_monotone(feed):
    ordered = feed.withColumn("raw_seq", F.col("raw_seq") % 1000000)
    return versions.fold_monotone(ordered, "source_key", FEED_DATA).select("source_key", "raw_seq", "outcome")


@query("feed", oracle=_FOLD + """, drift as (select source_key, 'list_price' as field, cast(cast(list_price + 1 as bigint) as varchar) as entity_value, cast(list_price as varchar) as version_value
  from versions where valid_to is null and change_type <> 'delete' and source_key % 5 = 0) select * from drift""")  # fmt: skip
def typed_drift(feed):
    v = _versions(feed)
    entity = state.merge_entities(None, v, "source_key", FEED_DATA, NOW)
    spoiled = entity.withColumn("list_price", F.when(F.col("source_key") % 5 == 0, F.col("list_price") + 1).otherwise(F.col("list_price")))
    return audit.validate_typed(spoiled, v, "source_key", FEED_DATA)


# --- lookups, parked children, cascades ------------------------------------------------------------------------


@query("feed", oracle="select source_key as lookup_key, raw_seq, case when mlg_can_view then case when coalesce(was, false) then 'update' else 'insert' end else case when coalesce(was, false) then 'delete' else 'skip-tombstoned' end end as outcome from (select *, lag(mlg_can_view) over (partition by source_key order by raw_seq) as was from feed)")
def lookup_outcomes(feed):
    return state.fold_lookup(feed.withColumnRenamed("source_key", "lookup_key"))


@query("feed", oracle="select source_key as lookup_key, list_price, status from (select *, row_number() over (partition by source_key order by raw_seq desc) as n from feed) where n = 1 and mlg_can_view")
def lookup_upsert(feed):
    return state.upsert_lookup(None, feed.withColumnRenamed("source_key", "lookup_key"), FEED_DATA)


@query("room", "listing", oracle="select room_key, coalesce(parent_listing_key, l.listing_key) as parent_listing_key, parent_listing_key is null and l.listing_key is not null as relinked from room r left join listing l on r.listing_key = l.listing_key")
def relink(room, listing):
    return state.relink_children(room, listing).select("room_key", "parent_listing_key", "relinked")


@query("room", "listing", oracle="select room_key, l.listing_key as parent_listing_key from room r left join listing l on r.listing_key = l.listing_key")
def resolve_parent(room, listing):
    return state.resolve_parent(room.drop("parent_listing_key"), listing).select("room_key", "parent_listing_key")


@query("job", "media", "listing", oracle="select attachment_job_id, case when status in ('pending', 'retrying', 'in_progress') and media_key in (select media_key from media where resource_record_key in (select listing_key from listing where not mlg_can_view)) then 'canceled' else status end as status from job")
def cascade_cancel(job, media, listing):
    return state.cascade_cancel_jobs(job, media, listing.where("not mlg_can_view")).select("attachment_job_id", "status")


@query("raw", "cursors", oracle=f"""select 'rows' as what, count(*) as n, cast(min(raw_seq) as double) as at from raw where resource = 'office' and raw_seq >= 100
  union all select 'cursor', 1, 99.0 union all select 'others', count(*), cast(max(last_raw_seq) as double) from cursors where resource <> 'office'
  union all select 'run', 1, cast(epoch(timestamp '{NOW}') as double)""")  # fmt: skip
def reprocess(raw, cursors):
    rows, moved, run = state.reprocess(raw, cursors, "office", NOW, from_seq=100)
    out = rows.agg(F.lit("rows").alias("what"), F.count("*").alias("n"), F.min("raw_seq").cast("double").alias("at"))
    out = out.union(moved.where("resource = 'office'").agg(F.lit("cursor"), F.count("*"), F.max("last_raw_seq").cast("double")))
    out = out.union(moved.where("resource <> 'office'").agg(F.lit("others"), F.count("*"), F.max("last_raw_seq").cast("double")))
    return out.union(run.where("run_type = 'reprocess' and status = 'running' and resource = 'office'").agg(F.lit("run"), F.count("*"), F.max(F.unix_timestamp("started_at")).cast("double")))


@query("room", "listing", oracle="select room_key, coalesce(r.parent_listing_key, l.listing_key) as parent_listing_key from room r left join listing l on l.listing_key = r.listing_key and l.list_price > 100000")
def promote_parent(room, listing):
    resolved = state.resolve_parent(room.drop("parent_listing_key"), listing.where("list_price > 100000"))
    return state.promote_parent(room, resolved, "room_key").select("room_key", "parent_listing_key")


@query("feed", oracle=_FOLD + """, last as (select source_key, arg_max(mlg_can_view, raw_seq) as mlg_can_view, arg_max(status, raw_seq) filter (change_type <> 'delete' and raw_seq >= 5000000000) as fresh from versions group by 1)
  select source_key, mlg_can_view, case when source_key % 2 = 0 then concat('note ', source_key) end as note from last where source_key in (select source_key from feed where raw_seq < 5000000000)""")  # fmt: skip
def sticky_columns(feed):
    """A column that the feed does not have survives the upserts of a second batch."""
    half, rest = feed.where("raw_seq < 5000000000"), feed.where("raw_seq >= 5000000000")
    v1 = _versions(half)
    e1 = state.merge_entities(None, v1, "source_key", FEED_DATA, NOW, sticky=("note",))
    e1 = e1.withColumn("note", F.when(F.col("source_key") % 2 == 0, F.concat(F.lit("note "), F.col("source_key").cast("string"))))
    seed = versions.fold_state(e1, v1, "source_key", FEED_DATA, rest)
    v2 = versions.build_versions(rest, versions.fold_versions(rest, "source_key", FEED_DATA, seed), "source_key", FEED_DATA, v1.where("valid_to is null"))
    merged = state.merge_entities(e1, v2, "source_key", FEED_DATA, NOW, sticky=("note",))
    return merged.join(e1.select("source_key"), "source_key", "left_semi").select("source_key", "mlg_can_view", "note")


# --- lists, filters, pages -------------------------------------------------------------------------------------

_ACTIVE = {"standardStatus": "Active", "listPriceGTE": 200000}


@query("listing", oracle="select listing_key, cast(list_price as double) as list_price, city from listing where mlg_can_view and standard_status = 'Active' and list_price >= 200000 order by list_price desc, listing_key desc limit 25")
def list_filtered(listing):
    return page.list_query(listing, "listing_key", _ACTIVE, order="list_price", descending=True, first=25).page().select("listing_key", F.col("list_price").cast("double"), "city")


@query("listing", oracle="select false as has_previous_page, true as has_next_page, min(listing_key) as start_key, max(listing_key) as end_key, any_value(n) as total_count from (select listing_key, count(*) over () as n from listing where mlg_can_view order by listing_key limit 25)")
def page_info(listing):
    return page.list_query(listing, "listing_key", first=25).info()


def _flags(where: str, behind: str, size: int, order: str, backward: bool = False, after: bool = False, before: bool = False) -> str:
    """SQL of page_info: the rows behind the cursors are counted and the page's ends looked up."""
    page_ = f"select listing_key, row_number() over (order by {order}) as n, count(*) over () as all_ from listing where {where} and {behind}"
    ends = f"(select listing_key from p where n = {{}}) "
    first, last = ("1", f"least({size}, all_)") if not backward else (f"least({size}, all_)", "1")
    more = f"coalesce((select max(all_) from p), 0) > {size}"
    total = f"(select count(*) from listing where {where})"
    following = f"{total} > 0" if size == 0 else "true" if before else "false" if backward else more
    previous = "true" if after else more if backward and size else "false"
    if after and not backward and size:
        previous = "true"
    start, end = ("null", "null") if size == 0 else (ends.format(first), ends.format(last))
    return f"(with p as ({page_}) select {following} as has_next_page, {previous} as has_previous_page, {start} as start_key, {end} as end_key, {total} as total_count)"


_SHOWN = "mlg_can_view and city = 'NATION_3'"
_PAGES = {
    "first": (dict(first=10), _flags(_SHOWN, "true", 10, "listing_key")),
    "first_after": (dict(first=10, after=(None, "L3")), _flags(_SHOWN, "listing_key > 'L3'", 10, "listing_key", after=True)),
    "last": (dict(last=10), _flags(_SHOWN, "true", 10, "listing_key desc", backward=True)),
    "last_before": (dict(last=10, before=(None, "L3")), _flags(_SHOWN, "listing_key < 'L3'", 10, "listing_key desc", backward=True, before=True)),
    "first_both": (dict(first=500, after=(None, "L2"), before=(None, "L3")), _flags(_SHOWN, "listing_key > 'L2' and listing_key < 'L3'", 500, "listing_key", after=True, before=True)),
    "first_0": (dict(first=0), _flags(_SHOWN, "true", 0, "listing_key")),
}


@query("listing", oracle=" union all ".join(f"select '{name}' as page, t.* from {text} t" for name, (_, text) in _PAGES.items()))
def page_flags(listing):
    """Forward, backward, behind and before cursors, between both, and a page of size 0."""
    infos = [page.list_query(listing, "listing_key", {"city": "NATION_3"}, **args).info().select(F.lit(name).alias("page"), "*") for name, (args, _) in _PAGES.items()]
    return reduce(DataFrame.union, infos)


_LISTED = {"lookup": "lookup", "media": "media", "member": "agent", "office": "office", "open_house": "open_house", "property": "listing", "property_rooms": "room", "property_unit_types": "unit_type"}
_KEYS = {name: registry.RESOURCES[name].key_column for name in _LISTED}


def _list_sql(name: str, resource: str, versions_: bool) -> str:
    key, table = _KEYS[resource], _LISTED[resource]
    id_ = f"concat({key}, '@1')" if versions_ else key
    return f"select '{name}' as list, id, row_number() over (order by id desc) as pos from (select {id_} as id from {table} {'' if versions_ else 'where mlg_can_view'} order by 1 desc limit 7)"


@query(*_LISTED.values(), "source_system", oracle=" union all ".join([f"({_list_sql(n, r, v)})" for n, (r, v) in page.LISTS.items()] + ["select 'sourceSystems' as list, source_system_id as id, row_number() over (order by source_system_id desc) as pos from source_system"]))
def all_lists(*tables):
    """The last seven rows of each of the lists: entities, their versions, source systems."""
    known = dict(zip([*_LISTED, "source_system"], tables, strict=True))
    for name in _LISTED:
        known[f"{name}_version"] = known[name].withColumn("version_id", F.concat(_KEYS[name], F.lit("@1")))
    found = []
    for name in [*page.LISTS, "sourceSystems"]:
        own = "source_system_id" if name == "sourceSystems" else "version_id" if page.LISTS[name][1] else _KEYS[page.LISTS[name][0]]
        rows = page.named_list(known, name, last=7).page()
        found.append(rows.select(F.lit(name).alias("list"), F.col(own).alias("id"), F.row_number().over(Window.orderBy(F.desc(own))).alias("pos")))
    return reduce(DataFrame.union, found)


@query("listing", oracle="select listing_key, cast(list_price as double) as list_price from listing where mlg_can_view and (list_price < 300000 or list_price = 300000 and listing_key < 'L5') order by list_price desc, listing_key desc limit 40")
def page_after(listing):
    return page.list_query(listing, "listing_key", order="list_price", descending=True, first=40, after=(300000, "L5")).page().select("listing_key", F.col("list_price").cast("double"))


@query("listing", oracle="select listing_key, city from listing where mlg_can_view and (city < 'NATION_2' or city = 'NATION_2' and listing_key < 'L5') order by city desc, listing_key desc limit 40")
def page_before(listing):
    return page.list_query(listing, "listing_key", order="city", last=40, before=("NATION_2", "L5")).page().select("listing_key", "city")


@query("listing", oracle="select listing_key, latitude from listing where mlg_can_view and city = 'NATION_7' order by latitude desc nulls first, listing_key desc limit 60")
def order_nulls(listing):
    return page.list_query(listing, "listing_key", {"city": "NATION_7"}, order="latitude", descending=True, first=60).page().select("listing_key", "latitude")


@query("listing", oracle="""select listing_key from listing where list_price between 50000 and 400000 and standard_status <> 'Closed' and (city in ('NATION_1', 'NATION_2', 'NATION_3') or street_name like 'b%' or contains(lower(street_name), 'gear')
  or ends_with(street_name, 'ring') and not (latitude is null)) and state_or_province not in ('ASIA') and not (lower(city) = 'nation_2' and list_price < 100000) and contains(street_name, 'o')""")  # fmt: skip
def where_all_ops(listing):
    spec = {
        "listPriceGTE": 50000, "listPriceLTE": 400000, "standardStatusNEQ": "Closed", "stateOrProvinceNotIn": ["ASIA"], "streetNameContains": "o",
        "or": [{"cityIn": ["NATION_1", "NATION_2", "NATION_3"]}, {"streetNameHasPrefix": "b"}, {"streetNameContainsFold": "GEAR"}, {"streetNameHasSuffix": "ring", "not": {"latitudeIsNil": True}}],
        "not": {"and": [{"cityEqualFold": "Nation_2"}, {"listPriceLT": 100000}]},
    }
    return where_rows(listing, spec).select("listing_key")


@query("listing", "room", oracle="select listing_key from listing where mlg_can_view and listing_key in (select parent_listing_key from room where room_level = 'Main')")
def has_rooms_with(listing, room):
    edges = {"rooms": (room, "parent_listing_key", "listing_key")}
    return where_rows(listing.where("mlg_can_view"), {"hasRoomsWith": {"roomLevel": "Main"}}, edges).select("listing_key")


@query("listing", "room", oracle="select listing_key from listing where listing_key not in (select parent_listing_key from room where parent_listing_key is not null)")
def has_no_rooms(listing, room):
    return where_rows(listing, {"not": {"hasRooms": True}}, {"rooms": (room, "parent_listing_key", "listing_key")}).select("listing_key")


@query("listing", "room", "media", oracle="""select listing_key from listing where city = 'NATION_5' or list_price > 100000 and (listing_key in (select parent_listing_key from room where room_level = 'Main' and room_key in
  (select room_key from room where mlg_can_view)) or not exists (select 1 from media where resource_record_key = listing_key)) """)  # fmt: skip
def edges_anywhere(listing, room, media):
    """Edges under and, or and not, and inside the filter of another edge."""
    rooms = (room, "parent_listing_key", "listing_key", {"self": (room, "room_key", "room_key")})
    edges = {"rooms": rooms, "media": (media, "resource_record_key", "listing_key")}
    spec = {"or": [{"city": "NATION_5"}, {"and": [{"listPriceGT": 100000}, {"or": [{"hasRoomsWith": {"roomLevel": "Main", "hasSelfWith": {"mlgCanView": True}}}, {"not": {"hasMedia": True}}]}]}]}
    return where_rows(listing, spec, edges).select("listing_key")


@query("feed", oracle=_FOLD + "select change_type, count(*) as n from versions where change_type in ('insert', 'update') and not change_type = 'update' or change_type <> 'insert' and list_price > 5 group by 1")
def change_types(feed):
    v = _versions(feed)
    spec = {"or": [{"changeTypeIn": ["insert", "update"], "not": {"changeType": "update"}}, {"changeTypeNEQ": "insert", "listPriceGT": 5}]}
    return v.where(predicate(v, spec)).groupBy("change_type").agg(F.count("*").alias("n"))


@query("listing", oracle="select listing_key from listing where raw_seq % 5 = 0 or standard_status = 'Closed'")
def array_filters(listing):
    tagged = listing.withColumn("tags", F.when(F.col("raw_seq") % 5 == 0, F.array(F.lit("a"), F.lit("b"), "standard_status")).otherwise(F.array("standard_status")))
    return where_rows(tagged, {"or": [{"tagsHasAll": ["a", "b"]}, {"tagsHasAny": ["Closed", "none"]}]}).select("listing_key")


@query("listing", "agent", "office", oracle="""with asked as (select * from (values (0, 'L5'), (1, 'A3'), (2, 'nothing'), (3, 'F4'), (4, 'L10'), (5, 'L5')) t(pos, id))
  select pos, id, case when exists (select 1 from listing where listing_key = id and mlg_can_view) then 'property' when exists (select 1 from agent where member_key = id and mlg_can_view) then 'member'
  when exists (select 1 from office where office_key = id and mlg_can_view) then 'office' end as type from asked""")  # fmt: skip
def nodes_lookup(listing, agent, office):
    tables = [("property", listing, "listing_key", True), ("member", agent, "member_key", True), ("office", office, "office_key", True)]
    return page.nodes(tables, ["L5", "A3", "nothing", "F4", "L10", "L5"], listing.sparkSession)


_NODES = {"lookup": "lookup", "media": "media", "member": "agent", "office": "office", "open_house": "open_house", "property": "listing", "property_room": "room", "property_unit_type": "unit_type"}
_NODE_SQL = [
    f"select {i} as p, {_NODES[n]}.{key} as id, '{n}' as type, mlg_can_view as shown from {_NODES[n]}" if n in _NODES
    else f"select {i}, {key}, '{n}', true from source_system" if n == "source_system"
    else f"select {i}, concat({page.NODE_TABLES[n.removesuffix('_version')]}, '@1'), '{n}', true from {_NODES[n.removesuffix('_version')]}"
    for i, (n, key) in enumerate(page.NODE_TABLES.items())
]


@query(*_NODES.values(), "source_system", oracle="""with asked as (select * from (values (0, 'M1-1'), (1, 'H2-3'), (2, 'U2-4'), (3, 'K3'), (4, 'K8'), (5, 'L5@1'), (6, 'A3@1'), (7, 'F2'), (8, 'nothing@1'), (9, 'S1'), (10, 'L5'), (11, 'K3@1'), (12, 'F3'), (13, 'L7')) t(pos, id)),
  known as (""" + " union all ".join(_NODE_SQL) + """ union all select 3, unnest(['L5', 'K8', 'F3']), 'member', true union all select 5, 'L7', 'office', false)
  select pos, asked.id, case when arg_min(shown, p) then arg_min(type, p) end as type from asked left join known using (id) group by 1, 2""")  # fmt: skip
def nodes_of_all_tables(*tables):
    """Planted: members with the ids of a listing, a hidden lookup and an office; a hidden office with the id of a listing. A lookup has no versions."""
    entities = dict(zip(_NODES, tables, strict=False))
    history = {f"{n}_version": df.select(F.concat(page.NODE_TABLES[n], F.lit("@1")).alias("version_id")) for n, df in entities.items() if n != "lookup"}
    planted = lambda n, ids, shown: entities[n].select(page.NODE_TABLES[n], "mlg_can_view").union(entities[n].sparkSession.createDataFrame([(i, shown) for i in ids], "id string, shown boolean"))
    entities |= {"member": planted("member", ["L5", "K8", "F3"], True), "office": planted("office", ["L7"], False), "source_system": tables[-1]}
    asked = ["M1-1", "H2-3", "U2-4", "K3", "K8", "L5@1", "A3@1", "F2", "nothing@1", "S1", "L5", "K3@1", "F3", "L7"]
    return page.nodes(page.node_tables(entities | history), asked, tables[0].sparkSession)


@query("listing", oracle="select listing_key, cast(floor((row_number() over (partition by city order by source_modified_at, listing_key) - 1) / 50) as bigint) as page_no from listing")
def page_numbers(listing):
    return page.page_numbers(listing, ["source_modified_at", "listing_key"], 50, by="city").select("listing_key", "page_no")


@query("listing", oracle="select listing_key, cast(floor((row_number() over (order by list_price, listing_key) - 1) / 1000) as bigint) as page_no from listing")
def page_numbers_of_all(listing):
    return page.page_numbers(listing, ["list_price", "listing_key"]).select("listing_key", "page_no")


@query("listing", oracle="select listing_key, cast(list_price as varchar) as list_price, strftime(source_modified_at, '%Y-%m-%dT%H:%M:%SZ') as source_modified_at from listing")
def to_wire(listing):
    return page.to_wire(listing.select("listing_key", "list_price", "source_modified_at"))


# --- joins and traversals --------------------------------------------------------------------------------------


@query("listing", "agent", "office", oracle="select l.listing_key, list_agent_key, a.member_full_name as list_agent_name, list_office_key, o.office_name as list_office_name from listing l left join agent a on a.member_key = list_agent_key and a.mlg_can_view left join office o on o.office_key = list_office_key and o.mlg_can_view")
def soft_keys(listing, agent, office):
    return traverse.with_roles(listing, agent, office).select("listing_key", "list_agent_key", "list_agent_name", "list_office_key", "list_office_name")


_ROLES = list(traverse.ROLES)
_ROLE_SQL = [f"{'m' if r.endswith('agent') else 'f'}_{r}.{'member_full_name' if r.endswith('agent') else 'office_name'} as {r}_name" for r in _ROLES]
_ROLE_JOINS = [f"left join {'agent' if r.endswith('agent') else 'office'} {'m' if r.endswith('agent') else 'f'}_{r} on {'m' if r.endswith('agent') else 'f'}_{r}.{'member_key' if r.endswith('agent') else 'office_key'} = r.{r}_key and {'m' if r.endswith('agent') else 'f'}_{r}.mlg_can_view" for r in _ROLES]


@query("roles", "agent", "office", oracle=f"select r.listing_key, {', '.join(_ROLE_SQL)} from roles r {' '.join(_ROLE_JOINS)}")
def all_roles(roles, agent, office):
    return traverse.with_roles(roles, agent, office).select("listing_key", *[f"{r}_name" for r in _ROLES])


@query("agent", "office", oracle="select member_key, a.office_key, office_name from agent a left join office o on o.office_key = a.office_key and o.mlg_can_view")
def member_office(agent, office):
    return traverse.member_office(agent, office).select("member_key", "office_key", "office_name")


@query("listing", "agent", oracle="select list_agent_key, count(*) as n from listing where list_agent_key not in (select member_key from agent where mlg_can_view) group by 1")
def orphans(listing, agent):
    return traverse.orphan_keys(listing, "list_agent_key", agent, "member_key")


@query("office", oracle="select o.office_key, m.office_name as main_name, (select count(*) from office b where b.main_office_key = o.office_key) as branches from office o left join office m on m.office_key = o.main_office_key")
def office_tree(office):
    return traverse.office_tree(office)


@query("listing", "media", oracle="""select l.listing_key, p.media_key from listing l left join (select resource_record_key as k, media_key, row_number() over (partition by resource_record_key
  order by preferred_photo_yn desc nulls last, "order" asc nulls last, media_key) as n from media where mlg_can_view) p on p.k = l.listing_key and n = 1""")  # fmt: skip
def primary_photo(listing, media):
    return traverse.primary_photo(listing, media)


@query("listing", "media", "room", oracle="""select listing_key, array_to_string((select list(media_key order by media_key) from media where resource_record_key = listing_key and mlg_can_view), ',') as media,
  array_to_string((select list(room_key order by room_key) from room where parent_listing_key = l.listing_key), ',') as rooms from listing l""")  # fmt: skip
def property_bundle(listing, media, room):
    lists = traverse.property_media(listing, media).groupBy("listing_key").agg(F.array_join(F.array_sort(F.collect_list("media_key")), ",").alias("media"))
    rooms = traverse.children_of(listing.select("listing_key"), room, "room_key", "rooms")
    return rooms.join(lists, "listing_key", "left").select("listing_key", "media", F.array_join("rooms", ",").alias("rooms"))


@query("listing", "unit_type", "open_house", oracle="""select listing_key, coalesce((select string_agg(unit_type_key, ',' order by unit_type_key) from unit_type where parent_listing_key = l.listing_key), '') as units,
  coalesce((select string_agg(open_house_key, ',' order by open_house_key) from open_house where parent_listing_key = l.listing_key and mlg_can_view), '') as houses from listing l""")  # fmt: skip
def units_and_houses(listing, unit_type, open_house):
    units = traverse.children_of(listing.select("listing_key"), unit_type, "unit_type_key", "units")
    both = traverse.children_of(units, open_house, "open_house_key", "houses", include_hidden=False)
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return both.select("listing_key", text("units"), text("houses"))


@query("room", "listing", oracle="select room_key, city as parent_city from room r left join listing l on l.listing_key = r.parent_listing_key")
def child_parent(room, listing):
    return traverse.child_parent(room, listing, ["city"]).select("room_key", "parent_city")


@query("job", "media", "listing", oracle="select distinct listing_key, listing_id from listing where listing_id is not null and listing_key in (select resource_record_key from media where media_key in (select media_key from job where status = 'in_progress'))")
def refresh_listings(job, media, listing):
    return traverse.refresh_listings(job.where("status = 'in_progress'"), media, listing)


# --- regions and addresses -------------------------------------------------------------------------------------


@query("listing", oracle="select listing_key from listing where mlg_can_view and latitude between 30.2 and 30.4 and longitude between -97.5 and -97.1")
def geo_bounds(listing):
    return _region(listing, {"bounds": {"sw": (30.2, -97.5), "ne": (30.4, -97.1)}})


def _region(listing: DataFrame, geo: dict) -> DataFrame:
    return listing.where("mlg_can_view").where(region(F.col("latitude"), F.col("longitude"), geo, decimal=True)).select("listing_key")


@query("listing", oracle="""select listing_key from listing where mlg_can_view and (latitude between 30.1 and 30.3 and longitude between -97.4 and -97.2
  or latitude >= 30.5 and longitude >= -97.9 and (latitude - 30.5) + (longitude + 97.9) <= 0.4)""")  # fmt: skip
def geo_polygons(listing):
    square = [(30.1, -97.4), (30.3, -97.4), (30.3, -97.2), (30.1, -97.2)]
    triangle = [(30.5, -97.9), (30.9, -97.9), (30.5, -97.5), (30.5, -97.9)]
    return _region(listing, {"polygons": [square, triangle]})


_CENTER = (30.5, -97.5)


def _vincenty(turns: int = 8) -> str:
    """DuckDB text: (listing_key, metres), Vincenty's inverse formula as a chain of tables, one for each turn."""
    f, a = 1 / 298.257223563, 6378137.0
    b, u1 = a * (1 - f), math.atan((1 - f) * math.tan(math.radians(_CENTER[0])))
    su, cu = math.sin(u1), math.cos(u1)
    terms = f"""t{{i}} as (select *, cs - case when c2 < 1e-12 then cs else 2 * {su} * s / c2 end as m from (select *, 1 - sa * sa as c2 from (select *, case when ss = 0 then 0 else {cu} * c * sin(lam) / ss end as sa
      from (select *, sqrt(pow(c * sin(lam), 2) + pow({cu} * s - {su} * c * cos(lam), 2)) as ss, {su} * s + {cu} * c * cos(lam) as cs from l{{i}})))"""
    turn = f"""l{{j}} as (select listing_key, s, c, l, l + (1 - k) * {f} * sa * (atan2(ss, cs) + k * ss * (m + k * cs * (2 * m * m - 1))) as lam
      from (select *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) as k from t{{i}}))"""
    steps = [f"l0 as (select listing_key, sin(u) as s, cos(u) as c, l, l as lam from (select listing_key, atan({1 - f} * tan(radians(latitude))) as u, radians(longitude - {_CENTER[1]}) as l from listing where mlg_can_view and latitude is not null))"]
    for i in range(turns):
        steps += [terms.format(i=i) + ")", turn.format(i=i, j=i + 1)]
    steps.append(terms.format(i=turns) + ")")
    return f"""with {", ".join(steps)}, x as (select *, c2 * {(a * a - b * b) / (b * b)} as q from t{turns}),
      y as (select *, 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768)) as big, q / 1024 * (256 + q * (q * (74 - 47 * q) - 128)) as small from x),
      v as (select listing_key, {b} * big * (atan2(ss, cs) - small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) as metres from y) """


@query("listing", oracle=_vincenty() + "select listing_key, round(metres, 3) as metres from v where metres <= 10000")
def geo_radius(listing):
    """Every row up to the edge, by the spheroid's distance, and that distance to the millimetre."""
    metres = geodesic(F.col("latitude"), F.col("longitude"), _CENTER)
    inside = region(F.col("latitude"), F.col("longitude"), {"radius": {"center": _CENTER, "meters": 10000}})
    return spread(listing.where("mlg_can_view")).where(inside).select("listing_key", F.round(metres, 3).alias("metres"))


@query("listing", oracle="select listing_key from listing where mlg_can_view and standard_status = 'Active' and list_price >= 200000 and latitude between 30.2 and 30.7 and longitude between -97.6 and -97.1 and postal_code like '0%'")
def geo_where_address(listing):
    """Region, filter and address together."""
    return trigram.search_address(listing, "0", where=_ACTIVE, geo={"bounds": {"sw": (30.2, -97.6), "ne": (30.7, -97.1)}}).select("listing_key")


@query("listing", oracle="select listing_key, cast(list_price as double) as list_price from listing where mlg_can_view and standard_status = 'Active' and list_price >= 200000 and latitude between 30.2 and 30.7 and longitude between -97.6 and -97.1 order by list_price, listing_key limit 30")
def list_in_region(listing):
    found = page.list_query(listing, "listing_key", _ACTIVE, geo={"bounds": {"sw": (30.2, -97.6), "ne": (30.7, -97.1)}}, order="list_price", first=30)
    return found.page().select("listing_key", F.col("list_price").cast("double"))


def _similar(query_text: str, text: str) -> str:
    """DuckDB text of word_similarity of a constant with a column."""
    q = sorted(set(trigram.trigrams_of(query_text)))
    wanted = "[" + ", ".join(f"'{t}'" for t in q) + "]"
    words = f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))"
    part = "list_distinct(t[a:b])"
    shared = f"len(list_intersect({part}, {wanted}))"
    best = f"list_max(list_transform(hits, lambda a: list_max(list_transform(list_filter(hits, lambda b: b >= a), lambda b: {shared} / ({len(q)} + len({part}) - {shared})))))"
    return f"(select coalesce({best}, 0.0) from (select t, list_filter(range(1, len(t) + 1), lambda i: list_contains({wanted}, t[i])) as hits from (select {grams} as t)))"


@query("listing", oracle=f"""with s as (select street_name as n, {_similar('larg ringe', 'street_name')} as s from (select distinct street_name from listing)),
  c as (select city as n, {_similar('nation 7', 'city')} as s from (select distinct city from listing))
  select listing_key from listing join s on s.n = street_name join c on c.n = city where mlg_can_view and s.s >= 0.5 and c.s >= 0.6 and upper(state_or_province) = upper('Europe')""")  # fmt: skip
def address_fields(listing):
    return trigram.search_address_fields(trigram.search_address_fields(listing, street="larg ringe", state="Europe", threshold=0.5), city="nation 7", threshold=0.6).select("listing_key")


@query("listing", oracle=f"""with a as (select listing_key, concat(street_number, ' ', street_name, ' ', city, ' ', state_or_province, ' ', postal_code) as addr from listing where mlg_can_view)
  select listing_key from (select listing_key, {_similar('123 blue bolt', 'addr')} as s from a) where s >= 0.6""")  # fmt: skip
def address_search(listing):
    return trigram.search_address(spread(listing), " 123 blue bolt ", 0.6).select("listing_key")


@query("listing", oracle="select listing_key from listing where mlg_can_view and postal_code like '007%'")
def zip_prefix(listing):
    return trigram.search_address(listing, "007").select("listing_key")


# --- landing, cursors, runs ------------------------------------------------------------------------------------


@query("raw", oracle="select resource, source_key, min(raw_seq) as raw_seq from raw where raw_seq % 2 = 1 group by resource, source_key, source_modified_at having (resource, source_key, source_modified_at) not in (select (resource, source_key, source_modified_at) from raw where raw_seq % 2 = 0)")
def land_raw_dedup(raw):
    return feed_source.land_raw(raw.where("raw_seq % 2 = 0"), raw.where("raw_seq % 2 = 1")).select("resource", "source_key", "raw_seq")


@query("raw", oracle=f"select {_t('high_water_mark')} from (select max(source_modified_at) as high_water_mark from raw where resource = 'property' and (source_key, source_modified_at) not in (select (source_key, source_modified_at) from raw where resource = 'property' and raw_seq % 3 = 0))")
def parent_hwm(raw):
    new = feed_source.land_raw(raw.where("raw_seq % 3 = 0"), raw.where("raw_seq % 3 <> 0"))
    return feed_source.parent_hwm(new, "property").select(_time("high_water_mark"))


@query("raw", oracle="select raw_seq from raw where resource = 'office' and source_modified_at >= timestamp '2024-01-20'")
def delta_window(raw):
    return feed_source.delta_window(raw.withColumnRenamed("resource", "originating_system_name"), "office", F.expr("timestamp '2024-01-20'")).select("raw_seq")


@query("raw", "cursors", oracle="select raw_seq from raw left join cursors using (resource) where last_raw_seq is null or raw_seq > last_raw_seq")
def pending_raw(raw, cursors):
    return feed_source.pending_raw(raw, cursors).select("raw_seq")


@query("raw", "cursors", oracle="select resource, count(*) as pending from raw left join cursors using (resource) where last_raw_seq is null or raw_seq > last_raw_seq group by 1")
def backlog(raw, cursors):
    return ledger.backlog(raw, cursors)


@query("sync_event", oracle=f"select resource, {_t('cursor')} from (select resource, coalesce(m, timestamp '{NOW}' - interval 1 month) as cursor from (values ('lookup'), ('office'), ('member'), ('property'), ('open_house')) r(resource) left join (select resource, max(high_water_mark) as m from sync_event where status = 'success' and resource <> 'office' group by 1) using (resource))")
def hwm_cursor(sync_event):
    return ledger.next_cursor(sync_event.where("resource <> 'office'"), NOW).select("resource", _time("cursor"))


@query("sync_event", oracle=f"select sync_event_id, status, {_t('high_water_mark')}, error_summary from (select sync_event_id, case when status = 'running' and sync_event_id % 2 = 0 then case when sync_event_id % 3 = 0 then 'failed' else 'success' end else status end as status, case when status = 'running' and sync_event_id % 2 = 0 then case when sync_event_id % 3 <> 0 then started_at end else high_water_mark end as high_water_mark, case when status = 'running' and sync_event_id % 6 = 0 then 'boom' else error_summary end as error_summary from sync_event)")
def stamp_outcome(sync_event):
    results = sync_event.where("sync_event_id % 2 = 0").selectExpr("sync_event_id", "sync_event_id % 3 <> 0 as ok", "ended_at", "record_count", "cast(null as timestamp_ntz) as hwm", "cast(null as timestamp_ntz) as queried_from", "'boom' as error")
    return ledger.stamp_outcome(sync_event, results).select("sync_event_id", "status", _time("high_water_mark"), "error_summary")


@query("sync_event", oracle=f"select sync_event_id, case when status = 'running' and started_at < timestamp '{NOW}' - interval 2 hours then 'failed' else status end as status from sync_event")
def stale_sweep(sync_event):
    return ledger.sweep_stale_running(sync_event, NOW).select("sync_event_id", "status")


@query("sync_event", oracle="select resource, sync_event_id, status from (select *, row_number() over (partition by resource order by started_at desc, sync_event_id desc) as n from sync_event) where n = 1")
def latest_event(sync_event):
    return ledger.latest_event(sync_event).select("resource", "sync_event_id", "status")


_FETCHED = "(values (0, 'lookup'), (1, 'office'), (2, 'member'), (3, 'property'), (4, 'open_house')) t(i, resource)"
_HEALTH = f"""with names as (select * from {_FETCHED}),
  missing as (select coalesce(string_agg(resource, ', ' order by i), '') as who from names where resource not in (select resource from event where run_type = 'backfill' and status = 'success')),
  f as (select resource, max(ended_at) as last_at from event where status = 'success' and ended_at is not null group by 1),
  n as (select * from (select *, row_number() over (partition by resource order by started_at desc, sync_event_id desc) as k from event) where k = 1),
  b as (select count(*) as n, string_agg(distinct resource, ', ') filter (c.resource_ is null) as bare from raw left join (select resource as resource_, last_raw_seq from cursors) c on c.resource_ = raw.resource
    where (last_raw_seq is null or raw_seq > last_raw_seq) and resource <> 'nothing'),
  s as (select string_agg(concat(resource, case when status = 'failed' then ' (failed)' else ' (stuck running)' end), ', ' order by i) as bad from n join names using (resource)
    where status = 'failed' or status = 'running' and started_at < timestamp '{NOW}' - interval 2 hours),
  r as (select concat(resource, '_fetch_freshness') as name, case when last_at >= timestamp '{NOW}' - interval 60 minutes then 'pass' else 'fail' end as status, case when last_at is null then 'never fetched' when last_at >= timestamp '{NOW}' - interval 60 minutes then 'fresh' else 'stale' end as message from names left join f using (resource)
  union all select 'raw_backlog', case when n > 500 then 'fail' else 'pass' end, concat(case when n > 500 then concat('raw backlog ', n, ' exceeds threshold 500') else concat(n, ' raw records pending (threshold 500)') end, ' (no processor cursor yet for: ' || bare || ')') from b
  union all select 'processing_freshness', case when max(modified_at) >= timestamp '{NOW}' - interval 60 minutes then 'pass' else 'warn' end, case when max(modified_at) >= timestamp '{NOW}' - interval 60 minutes then 'fresh' else 'stale' end from cursors
  union all select 'attachment_failures', case when count(*) > 100 then 'fail' else 'pass' end, concat(count(*), ' failed') from job where status = 'permanently_failed'
  union all select 'resource_state', case when bad is null then 'pass' else 'fail' end, coalesce('resource(s) in a bad state: ' || bad, 'no required resource stuck in a failed state') from s)
  select 'initial_import' as name, case when who = '' then 'pass' else 'fail' end as status, case when who = '' then 'initial import complete for all required resources' else 'initial import not complete for: ' || who end as message from missing
  union all select name, case when who = '' then status else 'skipped' end, case when who = '' then message else 'before the first import' end from r, missing"""
_LIMITS = {"staleness_minutes": 60, "backlog": 500}


@query("sync_event", "cursors", "raw", "job", oracle=_HEALTH.replace("with names", "with event as (from sync_event), names"))
def health(sync_event, cursors, raw, job):
    return ledger.sync_health(sync_event, cursors, raw, job, NOW, _LIMITS)


@query("sync_event", "cursors", "raw", "job", oracle=_HEALTH.replace("with names", "with event as (from sync_event where not (resource = 'member' and run_type = 'backfill') and resource <> 'lookup'), names"))
def health_before_import(sync_event, cursors, raw, job):
    """Two resources without a first import: all else is skipped."""
    return ledger.sync_health(sync_event.where("not (resource = 'member' and run_type = 'backfill') and resource <> 'lookup'"), cursors, raw, job, NOW, _LIMITS)


@query("sync_event", "cursors", "raw", "job", oracle=_HEALTH.replace("with names", """with ranked as (select *, row_number() over (partition by resource order by started_at desc, sync_event_id desc) as newest from sync_event),
  event as (select * replace (case when resource in ('office', 'property') then 'running' when resource = 'member' then 'success' else status end as status)
    from ranked where newest = 1 union all from ranked where newest > 1 and run_type = 'backfill' and status = 'success'), names""").replace("from raw left", "from (from raw where raw_seq % 50 = 0 union all select raw_seq, 'nothing', source_key, source_modified_at, change_type, payload from raw) raw left"))  # fmt: skip
def health_of_stuck_runs(sync_event, cursors, raw, job):
    """The newest runs of two resources are stuck; most raw rows are of a resource that is not processed."""
    newest = ledger.latest_event(sync_event).select(sync_event.columns)
    status = F.when(F.col("resource").isin("office", "property"), "running").when(F.col("resource") == "member", "success").otherwise(F.col("status"))
    older = sync_event.where("run_type = 'backfill' and status = 'success'").join(newest.select("sync_event_id"), "sync_event_id", "left_anti").select(sync_event.columns)
    events = newest.withColumn("status", status).union(older)
    rows = raw.where("raw_seq % 50 = 0").union(raw.withColumn("resource", F.lit("nothing")).select(raw.columns))
    return ledger.sync_health(events, cursors, rows, job, NOW, _LIMITS)


# --- projection and audits -------------------------------------------------------------------------------------


def _payloads(listing: DataFrame) -> DataFrame:
    """Property records as JSON text; every 50th is poison in one of several ways."""
    record = F.struct(
        F.col("listing_key").alias("ListingKey"), F.date_format("source_modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ModificationTimestamp"), F.col("mlg_can_view").alias("MlgCanView"),
        F.col("list_price").cast("string").alias("ListPrice"), F.col("city").alias("City"), F.col("latitude").alias("Latitude"), (F.col("raw_seq") % 7).alias("BedroomsTotal"),
        F.when(F.col("raw_seq") % 4 != 0, F.date_format("source_modified_at", "yyyy-MM-dd")).alias("ListingContractDate"), F.array("state_or_province", F.when(F.col("raw_seq") % 13 != 0, F.col("standard_status"))).alias("View"),
        F.when(F.col("raw_seq") % 3 == 0, F.col("street_name")).alias("XStreet"), F.when(F.col("raw_seq") % 5 == 0, F.array(F.lit(1), F.lit(2))).alias("XList"), F.lit("").alias("Country"),
    )
    text = F.to_json(record)
    nth = lambda n: (F.col("raw_seq") % 150 == n) & (F.col("raw_seq") > 0)
    swap = lambda old, new: F.replace(text, F.lit(old), F.lit(new))
    bad = F.when(nth(50), swap('"BedroomsTotal":', '"BedroomsTotal":"x"+')).when(nth(100), swap('"ListPrice":"', '"ListPrice":"$')).when(nth(0), swap("T00:00:00Z", ""))
    return spread(listing).select("raw_seq", "source_modified_at", F.lit("property").alias("resource"), F.col("listing_key").alias("source_key"), F.coalesce(bad, text).alias("payload"))


def _records(df: DataFrame, resource: str, key: str, **fields) -> DataFrame:
    """Rows of ``df`` as raw rows of a resource: its key, a time, and the fields given."""
    stamp = F.date_format(F.expr("timestamp '2024-01-05 06:07:08'"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(F.struct(F.col(key).alias(registry.RESOURCES[resource].key), stamp.alias("ModificationTimestamp"), F.col("mlg_can_view").alias("MlgCanView"), *[c.alias(n) for n, c in fields.items()]))
    rows = df.select(F.xxhash64(key).alias("raw_seq"), F.lit(resource).alias("resource"), F.col(key).alias("source_key"), F.expr("timestamp '2024-01-05 06:07:08'").alias("source_modified_at"), body.alias("payload"))
    return project.poison_split(project.project(rows, resource))[0]


@query("agent", oracle="select member_key, member_full_name, office_key, mlg_can_view, '2024-01-05 06:07:08' as at from agent")
def project_member(agent):
    typed = _records(agent, "member", "member_key", MemberFullName=F.col("member_full_name"), OfficeKey=F.col("office_key"), MemberCity=F.lit(""))
    return typed.select("member_key", "member_full_name", "office_key", "mlg_can_view", F.date_format("source_modified_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("office", oracle="select office_key, office_name, main_office_key, mlg_can_view, office_key like '%1' as idx_office_participation_yn from office")
def project_office(office):
    typed = _records(office, "office", "office_key", OfficeName=F.col("office_name"), MainOfficeKey=F.col("main_office_key"), IdxOfficeParticipationYN=F.col("office_key").endswith("1"))
    return typed.select("office_key", "office_name", "main_office_key", "mlg_can_view", "idx_office_participation_yn")


@query("open_house", oracle="select open_house_key, listing_key, strftime(open_house_date, '%Y-%m-%d') as held, open_house_status from open_house where listing_key not like '%7'")
def project_open_house(open_house):
    """A listing key is required: without one a record is poison."""
    listed = F.when(~F.col("listing_key").endswith("7"), F.col("listing_key"))
    typed = _records(open_house, "open_house", "open_house_key", ListingKey=listed, OpenHouseDate=F.date_format("open_house_date", "yyyy-MM-dd"), OpenHouseStatus=F.col("open_house_status"))
    return typed.select("open_house_key", "listing_key", F.date_format("open_house_date", "yyyy-MM-dd").alias("held"), "open_house_status")


@query("media", oracle="""select media_key, 'property' as resource_type, resource_record_key, "order", preferred_photo_yn, strftime(media_modification_timestamp, '%Y-%m-%d') as changed from media where resource_record_key not like '%9'""")
def project_media(media):
    """Owners are told in any case; an unknown one is poison."""
    owner = F.when(F.col("resource_record_key").endswith("9"), "Planet").when(F.col("resource_record_key").endswith("3"), "PROPERTY").otherwise("Property")
    changed = F.date_format("media_modification_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    typed = _records(media, "media", "media_key", ResourceName=owner, ResourceRecordKey=F.col("resource_record_key"), Order=F.col("order"), PreferredPhotoYN=F.col("preferred_photo_yn"), MediaModificationTimestamp=changed)
    return typed.select("media_key", "resource_type", "resource_record_key", "order", "preferred_photo_yn", F.date_format("media_modification_timestamp", "yyyy-MM-dd").alias("changed"))


@query("room", oracle="select room_key, listing_key, room_level, concat(room_level, ';x') as features from room")
def project_room(room):
    typed = _records(room, "property_rooms", "room_key", ListingKey=F.col("listing_key"), RoomLevel=F.col("room_level"), RoomFeatures=F.array("room_level", F.lit("x")))
    return typed.select("room_key", "listing_key", "room_level", F.array_join("room_features", ";").alias("features"))


@query("unit_type", oracle="select unit_type_key, listing_key, unit_type_beds_total from unit_type")
def project_unit_type(unit_type):
    typed = _records(unit_type, "property_unit_types", "unit_type_key", ListingKey=F.col("listing_key"), UnitTypeBedsTotal=F.col("unit_type_beds_total"))
    return typed.select("unit_type_key", "listing_key", "unit_type_beds_total")


@query("lookup", oracle="select lookup_key, lookup_name, lookup_value, mlg_can_view from lookup")
def project_lookup(lookup):
    typed = _records(lookup, "lookup", "lookup_key", LookupName=F.col("lookup_name"), LookupValue=F.col("lookup_value"))
    return typed.select("lookup_key", "lookup_name", "lookup_value", "mlg_can_view")


_WIDE = {"strings": "array('a', 'b')", "string": "concat('s', raw_seq)", "timestamp": "'2024-01-02T03:04:05.5Z'", "date": "'2024-03-04'", "bool": "raw_seq % 2 = 0", "int16": "raw_seq % 30000", "int32": "raw_seq", "int64": "raw_seq * 1000000"}


@query("listing", oracle="select listing_key, 120 as filled, 34 as arrays, 'a,b' as view, raw_seq % 30000 as year_built, cast(1.25 as double) as list_price, '2024-01-02 03:04:05.5' as changed from listing")
def project_all_columns(listing):
    """Records in which every one of the 120 columns has a value."""
    columns = registry.RESOURCES["property"].columns
    fields = [F.expr(_WIDE.get(c.kind, "'1.25'")).alias(c.payload) for c in columns]
    record = F.struct(F.col("listing_key").alias("ListingKey"), F.lit("2024-01-05T06:07:08Z").alias("ModificationTimestamp"), *fields)
    rows = spread(listing).select("raw_seq", F.col("source_modified_at"), F.to_json(record).alias("payload"))
    typed = project.poison_split(project.project(rows, "property"))[0]
    filled = reduce(lambda a, b: a + b, [F.col(c.column).isNotNull().cast("int") for c in columns])
    arrays = reduce(lambda a, b: a + b, [(F.size(F.col(c.column)) == 2).cast("int") for c in columns if c.kind == "strings"])
    return typed.select("listing_key", filled.alias("filled"), arrays.alias("arrays"), F.array_join("view", ",").alias("view"), "year_built", F.col("list_price").cast("double"), F.date_format("photos_change_timestamp", "yyyy-MM-dd HH:mm:ss.S").alias("changed"))


_GOOD = "(raw_seq = 0 or raw_seq % 50 <> 0)"


@query("listing", oracle=f"select listing_key, cast(list_price as double) as list_price, city, latitude, cast(raw_seq % 7 as smallint) as bedrooms_total, mlg_can_view, strftime(case when raw_seq % 4 <> 0 then source_modified_at end, '%Y-%m-%d') as contract, concat(state_or_province, '+', case when raw_seq % 13 <> 0 then standard_status else '' end) as view, cast(null as varchar) as country from listing where {_GOOD}")
def project_property(listing):
    good, _ = project.poison_split(project.project(_payloads(listing), "property"))
    return good.select("listing_key", F.col("list_price").cast("double"), "city", F.col("latitude").cast("double"), "bedrooms_total", "mlg_can_view", F.date_format("listing_contract_date", "yyyy-MM-dd").alias("contract"), F.array_join("view", "+").alias("view"), "country")


@query("listing", oracle="select raw_seq, case raw_seq % 150 when 50 then 'payload: not a JSON object' when 100 then 'ListPrice: not a decimal(13,2)' else 'ModificationTimestamp: malformed' end as error from listing where raw_seq % 50 = 0 and raw_seq > 0")
def poison_rows(listing):
    return project.poison_split(project.project(_payloads(listing), "property"))[1]


@query("listing", oracle="select raw_seq, listing_key from listing where raw_seq < 50")
def poison_cutoff(listing):
    return project.poison_cutoff(project.project(_payloads(listing), "property")).select("raw_seq", "listing_key")


@query("listing", oracle=f"select 'XStreet' as key, count(*) filter (raw_seq % 3 = 0) as n from listing where {_GOOD} union all select 'XList', count(*) filter (raw_seq % 5 = 0) from listing where {_GOOD}")
def unconsumed_keys(listing):
    return audit.validate_raw(_payloads(listing), "property")["unconsumed"]


@query("listing", oracle=f"""with g as (select raw_seq, 'XStreet' as field, concat(chr(34), street_name, chr(34)) as v, concat('string, len ', strlen(street_name)) as shape from listing where {_GOOD} and raw_seq % 3 = 0
  union all select raw_seq, 'XNote', concat('["', repeat('é', 90 + raw_seq % 30), '"]'), 'array, 1 items' from listing where {_GOOD} and raw_seq % 11 = 0
  union all select raw_seq, 'XName', concat('"', repeat('ü', 1 + raw_seq % 30), '"'), concat('string, len ', 2 + 2 * (raw_seq % 30)) from listing where {_GOOD} and raw_seq % 7 = 0)
  select field, count(*) as n, min(raw_seq) as first_seq, case when strlen(arg_min(v, raw_seq)) > 200 then concat(left(arg_min(v, raw_seq), 101), '…(truncated)') else arg_min(v, raw_seq) end as sample, arg_min(shape, raw_seq) as shape from g group by 1""")  # fmt: skip
def field_drift(listing):
    """Planted: letters of two bytes each, in lists some of which are over the most bytes, and in strings."""
    rows = project.project(_payloads(listing), "property").where("error is null")
    letters = lambda letter, n: F.repeat(F.lit(letter), n.cast("int"))
    seq = F.col("raw_seq")
    note = F.when(seq % 11 == 0, F.create_map(F.lit("XNote"), F.concat(F.lit('["'), letters("é", 90 + seq % 30), F.lit('"]'))))
    name = F.when(seq % 7 == 0, F.create_map(F.lit("XName"), F.concat(F.lit('"'), letters("ü", 1 + seq % 30), F.lit('"'))))
    all_ = F.map_concat(*[F.coalesce(c, F.expr("map()").cast("map<string,string>")) for c in (F.col("extended_fields"), note, name)])
    return audit.resource_drift(rows.withColumn("extended_fields", all_), "property", ("XList",))


@query("listing", oracle="select count(*) as rows, count(*) filter (raw_seq % 50 = 0 and raw_seq > 0) as errors from listing")
def validate_totals(listing):
    return audit.validate_raw(_payloads(listing), "property")["totals"]


@query("listing", oracle=f"select case when count(*) filter (raw_seq % 5 = 0) > 0 then 'XList, ' else '' end || 'XStreet' as fields from listing where {_GOOD}")
def drift_summary(listing):
    return audit.drift_summary(audit.field_drift(project.project(_payloads(listing), "property").where("error is null"), []))


@query("sync_event", "raw", oracle=f"""with c as (select resource, coalesce(m, timestamp '{NOW}' - interval 1 month) as cursor from (values ('lookup'), ('office'), ('member'), ('property'), ('open_house')) r(resource)
  left join (select resource, max(high_water_mark) as m from sync_event where status = 'success' and resource <> 'office' and started_at < timestamp '2024-01-15' group by 1) using (resource)),
  f as (select c.resource, count(raw_seq) as n, max(source_modified_at) as hwm, any_value(cursor) as cursor from c left join raw on raw.resource = c.resource and source_modified_at >= cursor and raw.resource <> 'lookup' group by 1)
  select resource, n, strftime(coalesce(hwm, cursor), '%Y-%m-%d %H:%M:%S.%f') as high_water_mark from f""")  # fmt: skip
def delta_loop(sync_event, raw):
    """One turn of the loop from the marks of mid-month, without any of one resource and no new rows of another."""
    before = sync_event.where("resource <> 'office' and started_at < timestamp '2024-01-15'").withColumn("sync_event_id", F.col("sync_event_id").cast("string"))
    found, after = ledger.delta_run(before, raw.where("resource <> 'lookup'"), NOW)
    runs = after.join(before.select("sync_event_id"), "sync_event_id", "left_anti").where("status = 'success' and run_type = 'sync'")
    counts = found.groupBy("resource").agg(F.count("*").alias("n"))
    return runs.join(counts, "resource", "left").select("resource", F.coalesce("n", F.lit(0)).alias("n"), _time("high_water_mark"))


@query("listing", oracle="select unnest(['parcel_number', 'country']) as \"column\"")
def always_null(listing):
    found = audit.always_null(project.project(_payloads(listing), "property").where("error is null"), ["parcel_number", "list_price", "country", "city"])
    return found


@query("listing", oracle="select 'latitude' as \"column\", count(latitude) as filled, count(*) as total from listing union all select 'listing_id', count(listing_id), count(*) from listing")
def fill_rate(listing):
    return audit.fill_rate(listing, ["latitude", "listing_id"])


@query("listing", oracle="select 'ListingContractDate' as key, count(*) filter (raw_seq % 4 <> 0 and raw_seq % 150 <> 50) as n from listing union all select 'ModificationTimestamp', count(*) filter (raw_seq % 150 = 0 and raw_seq > 0) from listing")
def date_shaped(listing):
    return audit.date_shaped(_payloads(listing))


@query("listing", "lineitem", oracle="""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem),
  j as (select concat('L', l_orderkey) as k, 'K' || l_orderkey || '-' || l_partkey as c, l_partkey from l)
  select 'property' as resource, listing_key as source_key, listing_key as link from listing where listing_key in (select k from j)
  union all select 'media', c, 'Property' from j where l_partkey % 9 <> 0 union all select 'property_rooms', c, k from j where l_partkey % 9 <> 0""")  # fmt: skip
def split_children(listing, lineitem):
    rows, _ = feed_source.split_children(_nested(listing, lineitem))
    link = F.coalesce(F.get_json_object("payload", "$.ResourceName"), F.get_json_object("payload", "$.ListingKey"))
    return rows.select("resource", "source_key", link.alias("link"))


@query("listing", "lineitem", oracle="select resource, count(*) as n from (select unnest(['media', 'property_rooms']) as resource from lineitem where l_partkey % 9 = 0) group by 1")
def split_errors(listing, lineitem):
    return feed_source.split_children(_nested(listing, lineitem))[1].groupBy("resource").agg(F.count("*").alias("n"))


def _nested(listing: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Property records with embedded media and rooms; children of every ninth part have no key."""
    lists = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("c"))  # numbers, once; the texts are made of them after the exchange
    part = lambda c: c["l_partkey"]
    name = lambda c: F.when(part(c) % 9 != 0, F.concat(F.lit("K"), F.col("k").cast("string"), F.lit("-"), part(c).cast("string")))
    joined = listing.join(lists, F.col("raw_seq") == F.col("k")).withColumn("c", F.transform("c", lambda c: F.struct(name(c).alias("name"), c["l_linenumber"].alias("n"))))
    media = F.transform("c", lambda c: F.struct(c["name"].alias("MediaKey"), c["n"].alias("Order")))
    rooms = F.transform("c", lambda c: F.struct(c["name"].alias("RoomKey"), F.lit("Main").alias("RoomLevel")))
    record = F.struct(F.col("listing_key").alias("ListingKey"), "list_price", media.alias("Media"), rooms.alias("Rooms"), F.lit("none").alias("UnitTypes"))
    return joined.select("raw_seq", F.col("listing_key").alias("source_key"), "source_modified_at", F.to_json(record).alias("payload"))


@query("listing", oracle="select distinct city as originating_system_name from listing where list_price > 100000")
def distinct_systems(listing):
    rows = listing.where("list_price > 100000").select(F.to_json(F.struct(F.col("city").alias("OriginatingSystemName"))).alias("payload"))
    return feed_source.distinct_systems(rows)


@query("media", oracle="select resource_record_key as source_key, arg_max(media_key, (source_modified_at, media_key)) as media_url from media group by 1")
def latest_media_url(media):
    order = F.struct("source_modified_at", "media_key")
    rows = media.select(F.lit("media").alias("resource"), F.col("resource_record_key").alias("source_key"), order.alias("raw_seq"), F.to_json(F.struct(F.col("media_key").alias("MediaURL"))).alias("payload"))
    return feed_source.latest_media_url(rows)


# --- media jobs ------------------------------------------------------------------------------------------------


@query("media", "job", oracle=f"""with w as (select media_key, max(coalesce(media_modification_timestamp, source_modified_at)) as revision from media where mlg_can_view group by 1),
  b as (select media_key, media_modified_at as last_at from (select *, row_number() over (partition by media_key order by created_at desc, attachment_job_id desc) as n from job where status in ('pending', 'retrying', 'in_progress', 'succeeded')) where n = 1)
  select media_key, {_t('revision')} from w left join b using (media_key) where last_at is null or last_at < revision""")  # fmt: skip
def enqueue(media, job):
    return jobs.enqueue_jobs(media, job).select("media_key", _time("revision"))


_WARM = """select media_key from media where attachment_id is null and resource_record_key in (select listing_key from listing where standard_status in ('Active', 'ActiveUnderContract'))
  and media_key not in (select media_key from job where status in ('pending', 'retrying', 'in_progress', 'succeeded'))"""


@query("listing", "media", "job", oracle=_WARM)
def warm_plan(listing, media, job):
    return jobs.warm_plan(listing, media, job)


@query("listing", "media", "job", oracle="select attachment_job_id, case when status in ('pending', 'retrying') and media_key not in (select media_key from media where resource_record_key in (select listing_key from listing where standard_status = 'Active')) then 'canceled' else status end as status from job")
def warm_exclusive(listing, media, job):
    keep = media.join(listing.where("standard_status = 'Active'"), F.col("resource_record_key") == F.col("listing_key"), "left_semi")
    return jobs.warm_exclusive(job, keep).select("attachment_job_id", "status")


@query("media", "job", oracle="select media_key, coalesce(m.attachment_id, j.attachment_id) as attachment_id from media m left join (select media_key, arg_max(attachment_id, (created_at, attachment_job_id)) as attachment_id from job where status = 'succeeded' group by 1) j using (media_key)")
def repair_links(media, job):
    return jobs.repair_links(media, job).select("media_key", "attachment_id")


@query("job", oracle="select attachment_job_id, case when s then 'pending' else status end as status, case when not s then claimed_by end as claimed_by from (select *, status = 'in_progress' and claimed_at < timestamp '2000-01-01' - interval 10 minutes as s from job)")
def reap(job):
    return jobs.reap_stale(job, "2000-01-01 00:00:00").select("attachment_job_id", "status", "claimed_by")


_APPLIED = """with r as (select attachment_job_id, case when attempt_count = 1 then 'other' else claimed_by end as by_, (length(media_key) % 2 = 0) as ok, (length(media_key) % 3 = 0) as store_full from job where attempt_count <> 0),
  x as (select j.*, ok is not null and status = 'in_progress' and claimed_by = by_ as live, ok, store_full from job j left join r using (attachment_job_id)),
  applied as (select media_key, attachment_job_id, case when live and ok then 'succeeded' when live then case when store_full or attempt_count + 1 >= 3 then 'permanently_failed' else 'retrying' end when ok is not null then 'lost' end as applied,
    case when live and ok then 'succeeded' when live then case when store_full or attempt_count + 1 >= 3 then 'permanently_failed' else 'retrying' end else status end as status,
    attempt_count + case when live and not ok then 1 else 0 end as attempt_count, case when live and ok then 'new' else attachment_id end as attachment_id from x) """


def _applied(job: DataFrame) -> DataFrame:
    by = F.when(F.col("attempt_count") == 1, "other").otherwise(F.col("claimed_by"))
    results = job.where("attempt_count <> 0").select("attachment_job_id", by.alias("claimed_by"), (F.length("media_key") % 2 == 0).alias("ok"), F.lit("new").alias("attachment_id"), (F.length("media_key") % 3 == 0).alias("store_full"))
    return jobs.apply_results(job, results)


@query("job", oracle=_APPLIED + "select attachment_job_id, applied, status, attempt_count, attachment_id from applied")
def apply_results(job):
    return _applied(job).select("attachment_job_id", "applied", "status", "attempt_count", "attachment_id")


@query("job", oracle=_APPLIED + "select applied, count(*) as n from applied where applied is not null group by 1")
def job_counts(job):
    return jobs.result_counts(_applied(job))


@query("media", "job", oracle=_APPLIED + "select m.media_key, coalesce(a.attachment_id, m.attachment_id) as attachment_id from media m left join applied a on a.media_key = m.media_key and a.applied = 'succeeded'")
def link_media(media, job):
    return jobs.link_media(media, _applied(job)).select("media_key", "attachment_id")


@query("job", oracle="select attachment_job_id from job where status in ('pending', 'retrying') order by created_at, attachment_job_id limit 50")
def next_batch(job):
    return jobs.next_batch(job).select("attachment_job_id")


@query("documents", oracle="select sha256(coalesce(text, '')) as source_hash, concat('media/', min(doc_id), '/', sha256(coalesce(text, ''))) as object_key, any_value(octet_length(encode(coalesce(text, '')))) as size_bytes from documents group by sha256(coalesce(text, ''))")
def attachments_dedup(documents):
    files = documents.select(F.col("doc_id").alias("media_key"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit("text/plain").alias("mime_type"))
    found, _ = feed_source.content_addressed(files.withColumn("media_key", F.col("media_key")))
    return found.select("source_hash", "object_key", F.col("size_bytes").cast("long").alias("size_bytes"))


# --- streams ---------------------------------------------------------------------------------------------------


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over the feed as a stream of micro-batches, each committed with the state after it."""
    root = work_folder(spark, "stream")
    events = spark.readStream.schema(view(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    feed = spark.sql(VIEWS["feed"], events=events)
    stream = feed_stream.fold_batches(feed, f"{root}/snapshots", f"{root}/checkpoint", "source_key", FEED_DATA)
    stream.awaitTermination()
    return versions.outcome_counts(feed_stream.committed_outcomes(spark, f"{root}/snapshots"))


QUERIES["stream_versions"] = stream_versions
ORACLES["stream_versions"] = ORACLES["outcomes"]


from . import stores  # noqa: E402, F401  registers more queries
