"""Registered queries over indexes, grids, stores and joins of many questions at once. ``catalogue`` imports this last."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import sql
from parcelflow.operators.address_index import AddressIndex
from parcelflow.operators import audit, page, traverse, versions
from parcelflow.operators.node_directory import NodeDirectory
from parcelflow.operators.regions import RegionGrid
from parcelflow.operators.version_store import VersionStore
from parcelflow.sources.snapshot import work_folder
from parcelflow.streaming import feed_stream

from . import registry
from .demo import NOW, spread
from .catalogue import _FOLD, _GOOD, _NODE_SQL, _NODES, FEED_DATA, _payloads, _CENTER, _similar, _t, _time, _versions, _vincenty, query

# --- address search --------------------------------------------------------------------------------------------

_ADDRESS = "concat(street_number, ' ', street_name, ' ', city, ' ', state_or_province, ' ', postal_code)"
_ASKED = "concat(substr(street_name, 2), 'e ', city, ' ', postal_code)"


@query("listing", oracle=f"""with a as (select listing_key, {_ADDRESS} as addr from listing where mlg_can_view)
  select listing_key from (select listing_key, {_similar('123 blue bolt', 'addr')} as s from a) where s >= 0.6""")  # fmt: skip
def address_search_by_index(listing):
    return AddressIndex.build(listing).search_address(listing, " 123 blue bolt ", 0.6).select("listing_key")


@query("listing", oracle=f"""with a as (select listing_key, {_ADDRESS} as addr from listing where mlg_can_view)
  select listing_key, s as similarity from (select listing_key, {_similar('123 blue bolt', 'addr')} as s from a) where s >= 0.6""")  # fmt: skip
def address_search_in_sql(listing):
    """Fuzzy addresses in ``spark.sql``."""
    sql.register(listing.sparkSession)
    return listing.sparkSession.sql("""
        with a as (select listing_key, concat_ws(' ', street_number, street_name, city, state_or_province, postal_code) as address from {listing} where mlg_can_view)
        select listing_key, word_similarity('123 blue bolt', address) as similarity from a where fuzzy_match('123 blue bolt', address, 0.6D)""", listing=spread(listing))  # fmt: skip


@query("listing", oracle=_vincenty() + ", m as (select standard_status, v.metres from v join listing using (listing_key) where v.metres <= 10000) select standard_status, count(*) as n, round(max(metres), 3) as farthest from m group by 1")
def geo_radius_in_sql(listing):
    """Listings within ten kilometres by status, in ``spark.sql``, and how far the farthest is."""
    sql.register(listing.sparkSession)
    return listing.sparkSession.sql(f"""
        select standard_status, count(*) as n, round(max(geodesic_metres(latitude, longitude, {_CENTER[0]}D, {_CENTER[1]}D)), 3) as farthest
        from {{listing}} where mlg_can_view and within_radius(latitude, longitude, {_CENTER[0]}D, {_CENTER[1]}D, 10000D) group by standard_status""", listing=spread(listing.select("standard_status", "mlg_can_view", "latitude", "longitude")))  # fmt: skip


_GRAMS = "flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))"


@query("listing", oracle=f"""with t as materialized (select listing_key, {_GRAMS.format(_ADDRESS)} as t from listing where mlg_can_view),
  q as materialized (select listing_key as query_id, list_distinct({_GRAMS.format(_ASKED)}) as q from listing where not mlg_can_view and standard_status = 'Closed' and latitude is not null),
  c as materialized (select query_id, listing_key, q, t, list_filter(range(1, len(t) + 1), lambda i: list_contains(q, t[i])) as hits from q join t on len(list_intersect(list_distinct(t), q)) >= 0.7 * len(q)),
  s as (select query_id, listing_key, list_max(list_transform(hits, lambda a: list_max(list_transform(list_filter(hits, lambda b: b >= a),
    lambda b: len(list_intersect(list_distinct(t[a:b]), q)) / (len(q) + len(list_distinct(t[a:b])) - len(list_intersect(list_distinct(t[a:b]), q))))))) as similarity from c)
  select query_id, listing_key, similarity from s where similarity >= 0.7""")  # fmt: skip
def address_matches(listing):
    """Every closed, hidden listing with a place asks for visible listings at a similar address, by a text with two faults."""
    index = AddressIndex.build(listing.where("mlg_can_view"))
    asked = listing.where("not mlg_can_view and standard_status = 'Closed' and latitude is not null")
    queries = asked.select(F.col("listing_key").alias("query_id"), F.concat(F.expr("substr(street_name, 2)"), F.lit("e "), "city", F.lit(" "), "postal_code").alias("query"), F.lit(0.7).alias("threshold"))
    return index.match(queries).select("query_id", F.col("key").alias("listing_key"), "similarity")


# --- regions ---------------------------------------------------------------------------------------------------


@query("listing", "territory", oracle="""with e as (select region_id, ring, latitude as y1, longitude as x1, coalesce(lead(latitude) over w, first_value(latitude) over w) as y2, coalesce(lead(longitude) over w, first_value(longitude) over w) as x2
    from territory window w as (partition by region_id, ring order by seq)),
  b as (select region_id, ring, min(y1) as s, max(y1) as n, min(x1) as w, max(x1) as e from e group by 1, 2),
  p as (select listing_key, latitude as y, longitude as x, b.* from listing join b on latitude between s and n and longitude between w and e),
  h as (select listing_key, p.region_id, count(*) filter (((y1 > y) <> (y2 > y)) and x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1
      or bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)) as inside
    from p join e on e.region_id = p.region_id and e.ring = p.ring group by listing_key, p.region_id, p.ring)
  select region_id, count(distinct listing_key) as n from h where inside group by 1""")  # fmt: skip
def listings_per_region(listing, territory):
    """All listings against all offices' territories of two polygons each; corners and edges have listings on them."""
    return RegionGrid(territory).count(listing.select("latitude", "longitude"))


# --- version stores --------------------------------------------------------------------------------------------

_HISTORY = f"select source_key, raw_seq, {_t('valid_from')}, {_t('valid_to')}, change_type, mlg_can_view, coalesce(list_price, -1) as list_price, status from versions"
_REMAPPED = "recursive remapped as (select * replace (case when raw_seq >= 5000000000 and raw_seq % 4 = 0 then list_price * 10 else list_price end as list_price) from feed), "


def _stored(feed):
    """The feed applied to a store in four batches of arrival, compacted after the second, and opened again before the last."""
    spark = feed.sparkSession
    folder = work_folder(spark, "version-store")
    store = VersionStore(spark, folder, "source_key", FEED_DATA, buckets=8)
    for i in range(4):
        if i == 2:
            store.compact()
        if i == 3:
            store = VersionStore(spark, folder, "source_key", FEED_DATA, buckets=8)
        store.apply(feed.where((F.col("raw_seq") >= i * 2500000000) & (F.col("raw_seq") < (i + 1) * 2500000000 if i < 3 else F.lit(True))))
    return store


def _shown(history):
    return history.select("source_key", "raw_seq", _time("valid_from"), _time("valid_to"), "change_type", "mlg_can_view", *FEED_DATA).fillna(-1, ["list_price"])


@query("feed", oracle=_FOLD + _HISTORY)
def version_store(feed):
    """The history in a bucketed store after four batches is that of one fold."""
    return _shown(_stored(feed).history())


@query("feed", oracle=_REMAPPED + _FOLD.removeprefix("recursive ").replace("from feed", "from remapped").replace("join feed", "join remapped") + _HISTORY)
def reprocessed_history(feed):
    """A replay of the later half of the ledger under a changed mapping; one under the mapping that was used changes nothing."""
    store = _stored(feed)
    if store.reprocess(feed, from_seq=5000000000):
        raise AssertionError("an unchanged mapping has changed versions")
    price = F.when((F.col("raw_seq") >= 5000000000) & (F.col("raw_seq") % 4 == 0), F.col("list_price") * 10).otherwise(F.col("list_price"))
    store.reprocess(feed.withColumn("list_price", price.cast("long")), from_seq=5000000000)
    return _shown(store.history())


@query("feed", oracle=_FOLD + """, p as (select raw_seq as probe_seq, source_key, source_modified_at - interval 1 day as at from feed)
  select probe_seq, p.source_key, coalesce(v.raw_seq, -1) as raw_seq, v.change_type from p asof left join versions v on v.source_key = p.source_key and p.at >= v.valid_from""")  # fmt: skip
def as_of_each(feed):
    """What every row's key was like a day before it."""
    probes = feed.select(F.col("raw_seq").alias("probe_seq"), "source_key", F.expr("source_modified_at - interval 1 day").alias("at"))
    found = versions.as_of_each(_versions(feed), probes, "source_key", "at", ["change_type"])
    return found.select("probe_seq", "source_key", "raw_seq", "change_type").fillna(-1, ["raw_seq"])


# --- trees -----------------------------------------------------------------------------------------------------


@query("office", oracle="""recursive e as (select office_key, main_office_key from office where main_office_key is not null union all select * from (values ('C1', 'C2'), ('C2', 'C3'), ('C3', 'C1'), ('C0', 'C1')) t(a, b)),
  up as (select office_key, main_office_key as ancestor_key, 1 as depth, [office_key, main_office_key] as seen from e
    union all select up.office_key, e.main_office_key, depth + 1, list_append(seen, e.main_office_key) from up join e on e.office_key = up.ancestor_key where not list_contains(seen, e.main_office_key))
  select office_key, ancestor_key, depth from up""")  # fmt: skip
def office_ancestors(office):
    """All main offices above each office; planted are a circle of three, an office below it, and one that is its own main office."""
    planted = office.sparkSession.createDataFrame([("C1", "C2"), ("C2", "C3"), ("C3", "C1"), ("C0", "C1"), ("C9", "C9")], "office_key string, main_office_key string")
    return traverse.office_ancestors(office.select("office_key", "main_office_key").union(planted))


# --- streams ---------------------------------------------------------------------------------------------------

#: Pages of the demo have so many records, about; there are at least 18 of them, in 17 batches or more.
_PAGE, _LEAST = 1_000, 18


def _write_pages(feed, folder: str, pages: int, seqs: int, first: int, last: int, batch: int) -> None:
    """The feed, numbered below ``seqs``, as pages of open houses, in order of arrival; every tenth record comes again on the next page.

    A stream takes files by their times, ``batch`` at once, and folds what it has taken by number: so the files of one batch are written together, by many tasks, and batches one after the other.
    """
    stamp = F.date_format("source_modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    listing = F.concat(F.lit("L"), (F.col("source_key") * 3).cast("string"))
    fields = {"OpenHouseKey": F.col("source_key").cast("string"), "ModificationTimestamp": stamp, "MlgCanView": F.col("mlg_can_view"), "ListingKey": listing, "OpenHouseType": F.col("list_price").cast("string"), "OpenHouseStatus": F.col("status")}
    page = F.floor(F.col("raw_seq") * pages / seqs).cast("int")
    rows = feed.select(page.alias("page"), "raw_seq", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("text"))
    rows = rows.union(rows.where("raw_seq % 10 = 0").select(F.col("page") + 1, "raw_seq", "text")).where(F.col("page").between(first, last))
    there = sorted(r["page"] for r in rows.select("page").distinct().collect())  # numbers of files, which the stream lists too; a page may have no record
    envelope = F.concat(F.lit('{"value":['), F.array_join("r.text", ","), F.lit("]}"))
    for at in range(0, len(there), batch):
        of_batch = rows.where(F.col("page").between(there[at], there[at : at + batch][-1]))
        each = of_batch.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("raw_seq", "text"))).alias("r"))
        each.select(F.lpad(F.col("page").cast("string"), 6, "0").alias("page"), envelope.alias("value")).write.mode("append").partitionBy("page").text(folder)


@query("feed", "listing", oracle=_FOLD + """select 'version' as what, cast(o.source_key as varchar) as key, strftime(f.source_modified_at, '%Y-%m-%d %H:%M:%S.%f') as at, outcome as value from outcomes o join feed f using (raw_seq)
  union all select 'link', cast(source_key as varchar), null, listing_key from (select distinct source_key from feed) left join listing on listing_key = concat('L', source_key * 3)""")  # fmt: skip
def stream_chain(feed, listing):
    """Pages land, fold and link over 17 or more micro-batches, the stream being stopped after half of the pages; equal to the fold of the whole."""
    spark = feed.sparkSession
    root = work_folder(spark, "chain")
    kept = versions.written_once(feed, "feed")
    rows, newest = kept.agg(F.count("*"), F.max("raw_seq")).first()
    pages, seqs = max(_LEAST, -(-rows // _PAGE)), (newest or 0) + 1
    stream = lambda: feed_stream.ingest_stream(feed_stream.page_stream(spark, f"{root}/in/*", pages // 17), f"{root}/out", f"{root}/checkpoint", NOW, "open_house", span="yyyy-MM")
    _write_pages(kept, f"{root}/in", pages, seqs, 0, pages // 2, pages // 17)
    feed_stream.finish(stream(), lambda: None)
    _write_pages(kept, f"{root}/in", pages, seqs, pages // 2 + 1, pages, pages // 17)
    links = []
    feed_stream.finish(stream(), lambda: links.append(feed_stream.link_landed(spark, f"{root}/out", "open_house", listing)))
    times = feed_stream.read_ledger(spark, f"{root}/out", feed_stream.LANDED).select("raw_seq", F.date_format("source_modified_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    found = feed_stream.committed_outcomes(spark, f"{root}/out").join(times, "raw_seq")
    found = found.select(F.lit("version").alias("what"), F.col("open_house_key").alias("key"), "at", F.col("outcome").alias("value"))
    return found.union(links[0].select(F.lit("link"), "open_house_key", F.lit(None).cast("string"), "parent_listing_key"))


# --- node directory and audits ---------------------------------------------------------------------------------


@query(*_NODES.values(), "source_system", oracle="with known as (" + " union all ".join(_NODE_SQL) + """ union all select 3, unnest(['L5', 'K8', 'F3']), 'member', true union all select 5, 'L7', 'office', false),
  asked as (select listing_key as id from listing union select lookup_key from lookup union select concat(office_key, '@1') from office union select 'nothing' union select source_system_id from source_system union select member_key from agent)
  select id, case when arg_min(shown, p) then arg_min(type, p) end as type from asked left join known using (id) group by 1""")  # fmt: skip
def nodes_by_directory(*tables):
    """Very many ids through the directory, kept by three commits: the last corrects what an earlier one has said of offices and lookups."""
    spark = tables[0].sparkSession
    entities = dict(zip(_NODES, tables, strict=False)) | {"source_system": tables[-1]}
    directory = NodeDirectory(spark, work_folder(spark, "nodes"))
    wrong = entities["office"].withColumn("mlg_can_view", ~F.col("mlg_can_view"))
    stray = spark.createDataFrame([("L5", True), ("nothing", True)], "lookup_key string, mlg_can_view boolean")
    keys = page.NODE_TABLES
    directory.commit(entities | {"office": wrong, "lookup": entities["lookup"].select("lookup_key", "mlg_can_view").union(stray)})
    directory.commit({f"{n}_version": df.select(F.concat(keys[n], F.lit("@1")).alias("version_id")) for n, df in entities.items() if n not in ("lookup", "source_system")})
    directory.compact()
    planted = lambda n, ids, shown: entities[n].select(keys[n], "mlg_can_view").union(spark.createDataFrame([(i, shown) for i in ids], "id string, shown boolean"))
    directory.commit({"member": planted("member", ["L5", "K8", "F3"], True), "office": planted("office", ["L7"], False)}, removed={"lookup": stray})
    asked = entities["property"].select(F.col("listing_key").alias("id")).union(entities["lookup"].select("lookup_key")).union(entities["office"].select(F.concat("office_key", F.lit("@1"))))
    asked = asked.union(tables[-1].select("source_system_id")).union(entities["member"].select("member_key")).union(spark.createDataFrame([("nothing",)], "id string"))
    return directory.match(asked.distinct())


_FILLED = {"listing_key", "list_price", "city", "latitude", "bedrooms_total", "listing_contract_date", "view"}
_EMPTY = [c for c in [*registry.RESOURCES["property"].data_columns, "originating_system_name", "mlg_can_use"] if c not in _FILLED]


@query("listing", oracle=f"""select 'rows' as what, '' as name, count(*) as n from listing union all select 'errors', '', count(*) from listing where raw_seq % 50 = 0 and raw_seq > 0
  union all select 'unconsumed', 'XStreet', count(*) from listing where {_GOOD} and raw_seq % 3 = 0 union all select 'unconsumed', 'XList', count(*) from listing where {_GOOD} and raw_seq % 5 = 0
  union all select 'filled', 'latitude', count(latitude) from listing where {_GOOD} union all select 'filled', 'listing_contract_date', count(*) from listing where {_GOOD} and raw_seq % 4 <> 0
  union all select 'filled', unnest({sorted(_FILLED - {"latitude", "listing_contract_date"})}), (select count(*) from listing where {_GOOD}) union all select 'filled', unnest({sorted(_EMPTY)}), 0
  union all select 'always null', unnest({sorted(_EMPTY)}), 0""")  # fmt: skip
def audit_once(listing):
    """Totals, the fill of all columns, those that are always NULL and leftover keys, while the payloads are parsed once."""
    found = audit.audit_once(_payloads(listing), "property")
    zero = F.lit(0).cast("long")
    out = found["totals"].select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.lit("").alias("name"), F.col(c).alias("n")) for c in ("rows", "errors")])))
    out = out.union(found["unconsumed"].select(F.lit("unconsumed"), "key", "n")).union(found["fill_rate"].select(F.lit("filled"), "column", "filled"))
    return out.union(found["always_null"].select(F.lit("always null"), "column", zero))
