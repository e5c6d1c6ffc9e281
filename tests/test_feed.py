"""Scenarios of the feed: parsing, versioning, landing, pages, regions, addresses, streams."""

import datetime as dt
import decimal
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo, json_text, parse, trigram
from parcelflow.operators import audit, jobs, ledger, page, project, state, traverse, versions
from parcelflow.operators.where import where
from parcelflow.plans import registry
from parcelflow.sources import feed, snapshot
from parcelflow.streaming import feed_stream

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


# --- registry and projection -----------------------------------------------------------------------------------


def test_registry():
    count = {r.name: len(r.columns) for r in registry.RESOURCES.values()}
    assert count == {"property": 120, "member": 26, "office": 23, "open_house": 7, "media": 11, "property_rooms": 4, "property_unit_types": 3, "lookup": 3}
    assert [registry.snake_case(n) for n in ("MLSAreaMajor", "NewConstructionYN", "PostalCodePlus4", "MediaURL", "CoListAgentMlsId", "MemberAddress1")] == ["mls_area_major", "new_construction_yn", "postal_code_plus4", "media_url", "co_list_agent_mls_id", "member_address1"]
    assert registry.passes(["property"]) == ["property", "media", "property_rooms", "property_unit_types"]
    assert registry.passes()[0] == "lookup" and registry.key_field("media") == "MediaKey" and registry.from_api_name("PropertyRooms") == "property_rooms"
    with pytest.raises(ValueError):
        registry.passes(["nothing"])


def _project(spark, payloads, resource="property"):
    rows = [(i, T0, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    return [r.asDict() for r in project.project(spark.createDataFrame(rows, "raw_seq long, source_modified_at timestamp, payload string"), resource).orderBy("raw_seq").collect()]


def test_projection_is_strict(spark):
    base = {"ListingKey": "L1", "ModificationTimestamp": "2024-01-02T03:04:05Z"}
    cases = [
        base | {"ListPrice": "499000.00", "BedroomsTotal": 3, "ListingContractDate": "2012-03-14", "View": ["a", "b"], "Roof": [], "City": "", "Foo": {"x": 1}, "MlgCanView": None},
        base | {"ListPrice": 12.5, "Latitude": 30.2672, "ViewYN": True, "MlgCanView": False},
        base | {"BedroomsTotal": "3"},
        base | {"BedroomsTotal": 70000},
        base | {"TaxYear": 2020.5},
        base | {"ListPrice": "a"},
        base | {"ListPrice": True},
        base | {"ListingContractDate": "2012-03-14T00:00:00Z"},
        base | {"OnMarketTimestamp": "2012-03-14"},
        base | {"City": 5},
        base | {"View": ["a", 1]},
        base | {"View": "a"},
        base | {"ViewYN": "true"},
        {"ListingKey": "L1"},
        base | {"ModificationTimestamp": ""},
        base | {"ModificationTimestamp": "2024-01-02"},
        {"ModificationTimestamp": "2024-01-02T03:04:05Z"},
        "nonsense",
        None,
        [1],
    ]
    got = _project(spark, cases)
    assert got[0]["error"] is None and got[1]["error"] is None
    assert got[0]["list_price"] == decimal.Decimal("499000.00") and got[0]["bedrooms_total"] == 3 and got[0]["listing_contract_date"] == dt.datetime(2012, 3, 14)
    assert got[0]["view"] == ["a", "b"] and got[0]["roof"] is None and got[0]["city"] is None and got[0]["mlg_can_view"] is True and set(got[0]["extended_fields"]) == {"Foo"}
    assert got[1]["list_price"] == decimal.Decimal("12.50") and got[1]["latitude"] == decimal.Decimal("30.26720000") and got[1]["view_yn"] is True and got[1]["mlg_can_view"] is False
    assert [r["error"] for r in got[2:]] == [
        "BedroomsTotal: not a int16", "BedroomsTotal: not a int16", "TaxYear: not a int16", "ListPrice: not a decimal(13,2)", "ListPrice: not a decimal(13,2)", "ListingContractDate: not a date",
        "OnMarketTimestamp: not a timestamp", "City: not a string", "View: not a strings", "View: not a strings", "ViewYN: not a bool", "ModificationTimestamp: absent", "ModificationTimestamp: empty",
        "ModificationTimestamp: malformed", "ListingKey: required", "payload: not a JSON object", "payload: not a JSON object", "payload: not a JSON object",
    ]


def test_media_take_the_time_of_the_raw_row(spark):
    good, bad = _project(spark, [{"MediaKey": "m", "ResourceName": "Property", "ResourceRecordKey": "L1", "Order": 2}, {"MediaKey": "m", "ResourceName": "Planet", "ResourceRecordKey": "L1"}], "media")
    assert good["error"] is None and good["resource_type"] == "property" and good["source_modified_at"] == T0 and good["order"] == 2
    assert bad["error"] == "ResourceName: not a known owner"


@pytest.mark.parametrize("resource", ["member", "office", "open_house", "property_rooms", "property_unit_types", "lookup"])
def test_other_projections(spark, resource):
    r = registry.RESOURCES[resource]
    example = {"string": "x", "bool": True, "timestamp": "2024-01-02T03:04:05Z", "date": "2024-01-02", "int16": 3, "strings": ["x"]}
    payload = {r.key: "k", "ModificationTimestamp": "2024-01-02T03:04:05Z"} | {c.payload: example[c.kind] for c in r.columns}
    (got,) = _project(spark, [payload], resource)
    assert got["error"] is None and all(got[c.column] is not None for c in r.columns)


def test_poison_stops_or_is_set_aside(spark):
    rows = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "raw_seq long, error string")
    assert [r.raw_seq for r in project.poison_cutoff(rows).collect()] == [1]
    assert sorted(r.raw_seq for r in project.poison_cutoff(rows, quarantine=True).collect()) == [1, 3]
    assert sorted(r.raw_seq for r in project.poison_cutoff(rows.where("error is null")).collect()) == [1, 3]


# --- versions --------------------------------------------------------------------------------------------------

FEED = "key string, raw_seq long, source_modified_at timestamp, mlg_can_view boolean, price long"


def plain_fold(rows):
    states, out = {}, {}
    for key, seq, at, visible, price in sorted(rows, key=lambda r: r[1]):
        found, tomb, open_at, data, prior = states.get(key, (False, False, None, None, None))
        if open_at is not None and at <= open_at:
            o = "skip-stale"
        elif not visible:
            o = "skip-tombstoned" if found and tomb else "delete"
        elif not found:
            o = "insert"
        else:
            o = "skip-no-diff" if data == (price,) else "update"
        out[seq] = (key, o, prior)
        if o in versions.WRITTEN:
            states[key] = (True, o == "delete", at, None if o == "delete" else (price,), seq)
    return out


def _random_feed(seed, n=300):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(8)}", i, hours(rng.randrange(200)), rng.random() > 0.3, rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_plain_python(spark, seed):
    rows = _random_feed(seed)
    df = spark.createDataFrame(rows, FEED)
    want = plain_fold(rows)
    for long in (2_000, 30):
        got = {r.raw_seq: (r.key, r.outcome, r.prior_seq) for r in versions.fold_versions(df, "key", ["price"], long_history=long).collect()}
        assert got == want
    assert {o for _, o, _ in want.values()} == set(versions.OUTCOMES)


def test_monotone_fold_is_the_same_on_monotone_times(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(6)}", i, hours(i), rng.random() > 0.3, rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, FEED)
    got = {r.raw_seq: (r.key, r.outcome, r.prior_seq) for r in versions.fold_monotone(df, "key", ["price"]).collect()}
    assert got == plain_fold(rows)


def test_version_scenarios(spark):
    rows = [
        ("INS", 1, hours(0), True, 1),
        ("UPD", 2, hours(0), True, 1), ("UPD", 3, hours(1), True, 2),
        ("SAME", 4, hours(0), True, 1), ("SAME", 5, hours(1), True, 1),
        ("DEL", 6, hours(0), True, 7), ("DEL", 7, hours(1), False, None), ("DEL", 8, hours(2), False, None), ("DEL", 9, hours(3), True, 7),
        ("STALE", 10, hours(1), True, 1), ("STALE", 11, hours(0), True, 2), ("NEWDEL", 12, hours(0), False, 5),
    ]
    df = spark.createDataFrame(rows, FEED)
    outcomes = versions.fold_versions(df, "key", ["price"])
    assert [r.outcome for r in outcomes.orderBy("raw_seq").collect()] == ["insert", "insert", "update", "insert", "skip-no-diff", "insert", "delete", "skip-tombstoned", "update", "insert", "skip-stale", "delete"]
    v = versions.build_versions(df, outcomes, "key", ["price"])
    by = {r.raw_seq: r for r in v.collect()}
    assert {k: (x["old"], x["new"]) for k, x in by[3].changed_fields.items()} == {"price": ("1", "2")}
    assert {k: (x["old"], x["new"]) for k, x in by[9].changed_fields.items()} == {"mlg_can_view": ("false", "true"), "price": (None, "7")}
    assert by[2].valid_to == hours(1) and by[3].valid_to is None and by[7].price is None and by[1].changed_fields is None
    entity = state.merge_entities(None, v, "key", ["price"], "2024-02-01")
    rows = {r.key: r for r in entity.collect()}
    assert (rows["UPD"].price, rows["DEL"].price, rows["NEWDEL"].price, rows["NEWDEL"].mlg_can_view) == (2, 7, None, False)
    assert versions.version_invariants(v, entity, "key").count() == 0
    assert {r.key: r.price for r in versions.as_of(v, hours(0.5)).collect()} == {"INS": 1, "UPD": 1, "SAME": 1, "DEL": 7, "NEWDEL": None}
    assert [r.raw_seq for r in versions.history(v, "key", "UPD").collect()] == [2, 3]
    stats = versions.pass_stats(outcomes).first()
    assert (stats.processed, stats.insert, stats.skip_stale) == (12, 5, 1)


def test_tombstone_keeps_values(spark):
    v1 = spark.createDataFrame([("v1", "a", 1, hours(0), None, "insert", True, 5)], "version_id string, key string, raw_seq long, valid_from timestamp, valid_to timestamp, change_type string, mlg_can_view boolean, price long")
    e1 = state.merge_entities(None, v1, "key", ["price"], "2024-02-01", sticky=("attachment_id",)).withColumn("attachment_id", F.lit("keep"))
    v2 = spark.createDataFrame([("v2", "a", 2, hours(1), None, "delete", False, None), ("v3", "b", 3, hours(1), None, "insert", True, 1)], v1.schema)
    rows = {r.key: r for r in state.merge_entities(e1, v2, "key", ["price"], "2024-03-01", sticky=("attachment_id",)).collect()}
    assert (rows["a"].price, rows["a"].mlg_can_view, rows["a"].current_version_id, rows["a"].source_modified_at, rows["a"].attachment_id) == (5, False, "v2", hours(0), "keep")
    assert rows["a"].created_at == dt.datetime(2024, 2, 1) and rows["a"].modified_at == dt.datetime(2024, 3, 1) and rows["b"].price == 1


# --- landing ---------------------------------------------------------------------------------------------------


def test_pages_children_and_landing(spark, tmp_path):
    record = {
        "ListingKey": "L1", "ModificationTimestamp": "2024-01-02T03:04:05Z", "ListPrice": "1.10", "City": "x\"y", "Media": [{"MediaKey": "m1", "ResourceName": "Other"}, {"x": 1}, "text"],
        "Rooms": [{"RoomKey": "r1", "ModificationTimestamp": "2024-01-01T00:00:00Z"}], "UnitTypes": "none",
    }
    (tmp_path / "page1.json").write_text(json.dumps({"@odata.nextLink": "n", "@odata.count": 7, "value": [record, {"ListingKey": "L2"}]}))
    pages = feed.read_feed_pages(spark, str(tmp_path)).orderBy("ord").collect()
    assert [json.loads(p.record)["ListingKey"] for p in pages] == ["L1", "L2"] and pages[0].odata_count == 7
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    records = spark.createDataFrame([(1, "L1", at, pages[0].record)], "raw_seq long, source_key string, source_modified_at timestamp, payload string")
    rows, errors = feed.split_children(records)
    got = {r.resource: r for r in rows.collect()}
    assert set(got) == {"property", "media", "property_rooms"}
    assert json.loads(got["property"].payload) == {"ListingKey": "L1", "ModificationTimestamp": "2024-01-02T03:04:05Z", "ListPrice": "1.10", "City": "x\"y"}
    assert json.loads(got["media"].payload) == {"MediaKey": "m1", "ResourceName": "Property"} and got["media"].source_modified_at == at
    assert json.loads(got["property_rooms"].payload)["ListingKey"] == "L1" and got["property_rooms"].source_modified_at == dt.datetime(2024, 1, 1)
    assert sorted(r.error for r in errors.collect()) == ["Media: no MediaKey", "Media: not an object"]
    new = feed.land_raw(None, rows, ["raw_seq", "ord"])
    assert new.count() == 3 and feed.land_raw(new, rows, ["raw_seq", "ord"]).count() == 0
    assert feed.parent_hwm(new, "property").first()[0] == at and feed.parent_hwm(new, "office").first()[0] is None


def test_lookup_parking_and_cascade(spark):
    rows = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, True, "y"), ("b", 3, False, "z"), ("c", 4, True, "q"), ("c", 5, False, "q")], "lookup_key string, raw_seq long, mlg_can_view boolean, v string")
    assert [r.outcome for r in state.fold_lookup(rows).orderBy("raw_seq").collect()] == ["insert", "update", "skip-tombstoned", "insert", "delete"]
    assert [(r.lookup_key, r.v) for r in state.upsert_lookup(spark.createDataFrame([("c", "old"), ("d", "old")], "lookup_key string, v string"), rows, ["v"]).orderBy("lookup_key").collect()] == [("a", "y"), ("d", "old")]
    rooms = spark.createDataFrame([("r1", "L1", None), ("r2", "L9", None), ("r3", "L1", "L1")], "room_key string, listing_key string, parent_listing_key string")
    properties = spark.createDataFrame([("L1",)], "listing_key string")
    once = state.relink_children(rooms, properties)
    assert {r.room_key: (r.parent_listing_key, r.relinked) for r in once.collect()} == {"r1": ("L1", True), "r2": (None, False), "r3": ("L1", False)}
    assert not any(r.relinked for r in state.relink_children(once.drop("relinked"), properties).collect())
    parked = state.resolve_parent(rooms.drop("parent_listing_key"), properties)
    kept = state.promote_parent(rooms, parked, "room_key")
    assert {r.room_key: r.parent_listing_key for r in kept.collect()} == {"r1": "L1", "r2": None, "r3": "L1"}


def test_snapshot_pointer(spark, tmp_path):
    root = str(tmp_path)
    assert snapshot.read_snapshot(spark, root, "t") is None
    for commit in (0, 1, 1):
        snapshot.write_snapshot({"t": spark.range(commit + 1)}, root, commit)
    assert snapshot.read_snapshot(spark, root, "t").count() == 2


def test_content_addressed(spark):
    files = spark.createDataFrame([("m2", bytearray(b"x"), "a/b"), ("m1", bytearray(b"x"), "a/c"), ("m3", bytearray(b"y"), "a/b")], "media_key string, content binary, mime_type string")
    found, links = feed.content_addressed(files, "/pre/")
    keys = sorted(r.object_key for r in found.collect())
    assert len(keys) == 2 and keys[0].startswith("pre/media/m1/") and links.count() == 3


def test_media_files(spark, tmp_path):
    (tmp_path / "m1.JPG").write_bytes(b"x")
    (tmp_path / "m2.bin").write_bytes(b"yy")
    got = sorted((r.media_key, bytes(r.content), r.mime_type) for r in feed.read_media_files(spark, str(tmp_path)).collect())
    assert got == [("m1", b"x", "image/jpeg"), ("m2", b"yy", "application/octet-stream")]


# --- reads -----------------------------------------------------------------------------------------------------


def test_page_rules(spark):
    df = spark.createDataFrame([(f"lkp-{c}", True, None if c == "C" else ord(c)) for c in "ABCDE"], "id string, mlg_can_view boolean, v int")
    ids = lambda p: [r.id for r in p.page().collect()]
    info = lambda p: p.info().first().asDict()
    p = page.list_query(df, "id", last=2)
    assert sorted(ids(p)) == ["lkp-D", "lkp-E"] and info(p)["has_previous_page"] and info(p)["start_key"] == "lkp-D"
    assert sorted(ids(page.list_query(df, "id", last=2, before=(None, "lkp-D")))) == ["lkp-B", "lkp-C"]
    zero = info(page.list_query(df, "id", first=0))
    assert zero["total_count"] == 5 and zero["has_next_page"] and zero["start_key"] is None
    assert ids(page.list_query(df, "id", order="v", first=5)) == ["lkp-A", "lkp-B", "lkp-D", "lkp-E", "lkp-C"]
    assert ids(page.list_query(df, "id", order="v", descending=True, first=5)) == ["lkp-C", "lkp-E", "lkp-D", "lkp-B", "lkp-A"]
    seen, cursor = [], None
    while True:
        p = page.list_query(df, "id", order="v", descending=True, first=2, after=cursor)
        rows = p.page().collect()
        seen += [r.id for r in rows]
        if not info(p)["has_next_page"]:
            break
        cursor = (rows[-1].v, rows[-1].id)
    assert seen == ["lkp-C", "lkp-E", "lkp-D", "lkp-B", "lkp-A"]
    assert page.clamp() == (500, None) and page.clamp(first=900) == (500, None) and page.clamp(last=3) == (None, 3)
    for wrong in ({"first": 1, "last": 1}, {"first": -1}):
        with pytest.raises(ValueError):
            page.clamp(**wrong)


def test_where_compiler(spark):
    df = spark.createDataFrame([(1, "Ab", ["x", "y"]), (2, None, None), (3, "cd", ["x"])], "n int, big_name string, tags array<string>")
    ids = lambda spec: sorted(r.n for r in where(df, spec).collect())
    assert ids({"bigNameNEQ": "cd"}) == [1] and ids({"bigNameIsNil": True}) == [2] and ids({"bigNameEqualFold": "AB"}) == [1]
    assert ids({"or": [{"n": 1}, {"nGT": 2}]}) == [1, 3] and ids({"not": {"nIn": [1, 2]}}) == [3] and ids({"tagsHasAll": ["x", "y"]}) == [1] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        where(df, {"nothing": 1})


AUSTIN = (30.2672, -97.7431)


def test_regions(spark):
    df = spark.createDataFrame([(1, 30.2672, -97.7431), (2, 30.2772, -97.7431), (3, 30.2672, -96.7431), (4, None, -97.0)], "id int, lat double, lng double")
    ids = lambda g: [r.id for r in df.where(geo.region(F.col("lat"), F.col("lng"), g)).orderBy("id").collect()]
    assert [ids({"radius": {"center": AUSTIN, "meters": m}}) for m in (100, 5_000, 200_000)] == [[1], [1, 2], [1, 2, 3]]
    assert ids({"bounds": {"sw": (30.2, -98), "ne": (30.2772, -97)}}) == [1, 2]
    square = lambda a, b: [(a - 0.01, b - 0.01), (a + 0.01, b - 0.01), (a + 0.01, b + 0.01), (a - 0.01, b + 0.01)]
    assert ids({"polygons": [square(*AUSTIN), square(30.2672, -96.7431)]}) == [1, 2, 3] and ids(None) == [1, 2, 3, 4]
    for wrong in ({}, {"radius": {"center": (91, 0), "meters": 1}}, {"radius": {"center": AUSTIN, "meters": 0}}, {"bounds": {"sw": (1, 1), "ne": (1, 2)}}, {"polygons": []}, {"polygons": [[(0, 0), (1, 1)]]}):
        with pytest.raises(ValueError):
            geo.validate_geo(wrong)


def test_geodesic_against_known_distances(spark):
    """Degrees along the meridian and the equator of the WGS84 spheroid."""
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (90.0, 0.0), (0.0, 180.0)], "lat double, lng double")
    got = [r.m for r in df.select(geo.geodesic(F.col("lat"), F.col("lng"), (0.0, 0.0)).alias("m")).collect()]
    assert got[0] == pytest.approx(110574.389, abs=0.01) and got[1] == pytest.approx(111319.491, abs=0.01)
    assert got[2] == pytest.approx(0, abs=1e-6) and got[3] == pytest.approx(10001965.729, abs=0.1)


def test_polygon_edges_count(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5), (1.5, 0.5)], "lat double, lng double")
    ring = [(0, 0), (0, 2), (2, 2), (2, 0)]
    assert all(r.i for r in df.select(geo.within_polygon(F.col("lat"), F.col("lng"), ring).alias("i")).collect())


def test_slanted_edge_in_decimals(spark):
    """Places on and about the slanted edge of the demo's triangle, as SQL with its decimals has them; (30.802, -97.802) was outside."""
    places = [(30 + k / 1000, -97 - j / 500) for k in range(498, 904) for j in (k // 2, k // 2 + 1, k // 2 - 1) if k % 10]
    df = spark.createDataFrame(places, "lat double, lng double")
    triangle = geo.within_polygon(F.col("lat"), F.col("lng"), [(30.5, -97.9), (30.9, -97.9), (30.5, -97.5), (30.5, -97.9)], decimal=True)
    plain = F.expr("lat >= 30.5D and lng >= -97.9D and (lat - 30.5D) + (lng + 97.9D) <= 0.4D")
    assert df.where(triangle != plain).count() == 0 and df.where((F.col("lat") == 30 + 802 / 1000) & triangle).count() == 2


def test_monotone_fold_breaks_ties_by_time(spark):
    """Rows with one number go by their time, in whatever order they are read."""
    rows = [(1, 5, "2024-01-03", True, 1), (1, 5, "2024-01-02", False, 1), (1, 5, "2024-01-01", True, 1), (1, 6, "2024-01-04", False, 1)]
    frame = lambda r: spark.createDataFrame(r, "k int, raw_seq long, source_modified_at string, mlg_can_view boolean, price int").coalesce(1)
    found = [sorted(r.outcome for r in versions.fold_monotone(frame(r), "k", ["price"]).collect()) for r in (rows, rows[::-1], [rows[1], rows[0], rows[2], rows[3]])]
    assert found == [["delete", "delete", "insert", "update"]] * 3


def plain_word_similarity(query, text):
    q, t = set(trigram.trigrams_of(query)), trigram.trigrams_of(text)
    return max((len(q & set(t[a:b])) / len(q | set(t[a:b])) for a in range(len(t)) for b in range(a + 1, len(t) + 1)), default=0.0)


def test_word_similarity(spark):
    cases = [("word", "two words"), ("123 Main St", "123 Main St Austin TX 78704"), ("Austn", "Austin"), ("Main", "Maple Dr"), ("x", ""), ("héllo", "Héllo wörld"), ("abc", "zzz")]
    for q, text in cases:
        got = spark.createDataFrame([(text,)], "t string").select(trigram.word_similarity(q, F.col("t")).alias("s")).first().s
        assert got == pytest.approx(plain_word_similarity(q, text)), (q, text)
    assert plain_word_similarity("word", "two words") == pytest.approx(0.8)


def test_addresses(spark):
    rows = [("p1", "123", "Main St", "Austin", "TX", "78704", True), ("p2", "456", "Oak Ave", "Austin", "TX", "78702", True), ("p3", "789", "Maple Dr", "Dallas", "TX", "75201", True), ("p4", "123", "Main St", "Austin", "TX", "78704", False)]
    df = spark.createDataFrame(rows, "k string, street_number string, street_name string, city string, state_or_province string, postal_code string, mlg_can_view boolean")
    keys = lambda d: sorted(r.k for r in d.collect())
    assert keys(trigram.search_address(df, "123 Main St")) == ["p1"] and keys(trigram.search_address(df, "787")) == ["p1", "p2"] and keys(trigram.search_address(df, "78704")) == ["p1"]
    assert keys(trigram.search_address_fields(df, city="Austn")) == ["p1", "p2"] and keys(trigram.search_address_fields(df, state="tx")) == ["p1", "p2", "p3"]
    assert keys(trigram.search_address_fields(df, street="Main", city="Austin", zip_="78704")) == ["p1"] and keys(trigram.search_address_fields(df, zip_="7_7")) == ["p1", "p2"]
    for wrong in (lambda: trigram.search_address(df, "  "), lambda: trigram.search_address_fields(df), lambda: trigram.resolve_threshold(2)):
        with pytest.raises(ValueError):
            wrong()


def test_primary_photo(spark):
    media = [("a1", "A", 1, False, True), ("a2", "A", 9, True, True), ("b1", "B", 2, None, True), ("b2", "B", 1, None, True), ("c1", "C", 1, True, False), ("c2", "C", 2, False, True), ("d1", "D", None, False, True), ("d2", "D", 5, False, True)]
    m = spark.createDataFrame([(k, "property", p, o, f, v) for k, p, o, f, v in media], "media_key string, resource_type string, resource_record_key string, `order` int, preferred_photo_yn boolean, mlg_can_view boolean")
    got = traverse.primary_photo(spark.createDataFrame([(c,) for c in "ABCDE"], "listing_key string"), m)
    assert {r.listing_key: r.media_key for r in got.collect()} == {"A": "a2", "B": "b2", "C": "c2", "D": "d2", "E": None}


# --- jobs, health, audits --------------------------------------------------------------------------------------


def test_enqueue_gate(spark):
    schema = "media_key string, mlg_can_view boolean, media_modification_timestamp timestamp, source_modified_at timestamp"
    media = spark.createDataFrame([(k, k != "hidden", None, hours(1)) for k in ("same", "newer", "canceled", "failed", "hidden", "fresh", "null")], schema)
    job = [("same", "succeeded", hours(1)), ("newer", "succeeded", hours(0)), ("canceled", "canceled", hours(1)), ("failed", "permanently_failed", hours(1)), ("null", "pending", None)]
    jobs_ = spark.createDataFrame([(f"j{k}", k, s, r, hours(2)) for k, s, r in job], "attachment_job_id string, media_key string, status string, media_modified_at timestamp, created_at timestamp")
    assert sorted(r.media_key for r in jobs.enqueue_jobs(media, jobs_).collect()) == ["canceled", "failed", "fresh", "newer", "null"]


def test_health_before_and_after_import(spark):
    events = spark.createDataFrame([(1, "property", "backfill", "success", hours(0), hours(1), None)], "sync_event_id long, resource string, run_type string, status string, started_at timestamp, ended_at timestamp, high_water_mark timestamp")
    cursors = spark.createDataFrame([("property", 5, hours(1))], "resource string, last_raw_seq long, modified_at timestamp")
    raw = spark.createDataFrame([("property", 6)], "resource string, raw_seq long")
    none = spark.createDataFrame([], "status string")
    report = {r.name: r.status for r in ledger.sync_health(events, cursors, raw, none, "2024-01-01 01:10:00").collect()}
    assert report.pop("initial_import") == "fail" and set(report.values()) == {"skipped"}
    report = ledger.sync_health(events, cursors, raw, none, "2024-01-01 01:10:00", resources=("property",))
    assert {r.status for r in report.collect()} == {"pass"} and ledger.healthy(report).first().healthy
    with pytest.raises(ValueError):
        ledger.sync_health(events, cursors, raw, none, "2024-01-01", {"staleness_minutes": 0})


def test_health_names_bad_resources_and_missing_cursors(spark):
    event = "sync_event_id long, resource string, run_type string, status string, started_at timestamp, ended_at timestamp, high_water_mark timestamp"
    done = [(i, r, "backfill", "success", hours(0), hours(1), None) for i, r in enumerate(ledger.FETCHED)]
    cursors = spark.createDataFrame([("property", 5, hours(1))], "resource string, last_raw_seq long, modified_at timestamp")
    raw = spark.createDataFrame([(r, i) for r in ("media", "property", "lookup", "elsewhere") for i in range(10)], "resource string, raw_seq long")
    none = spark.createDataFrame([], "status string")

    def report(events, **limits):
        return {r.name: (r.status, r.message) for r in ledger.sync_health(spark.createDataFrame(events, event), cursors, raw, none, "2024-01-01 05:00:00", limits).collect()}

    well = report(done)
    assert len(well) == 10 and well["resource_state"] == ("pass", "no required resource stuck in a failed state")
    assert well["raw_backlog"] == ("pass", "24 raw records pending (threshold 10000) (no processor cursor yet for: lookup, media)")
    assert report(done, backlog=23)["raw_backlog"] == ("fail", "raw backlog 24 exceeds threshold 23 (no processor cursor yet for: lookup, media)")
    ill = report([*done, (9, "property", "sync", "failed", hours(3), hours(3), None), (8, "office", "sync", "running", hours(2), None, None), (7, "member", "sync", "running", hours(4), None, None), (6, "media", "sync", "failed", hours(4), None, None)])
    assert ill["resource_state"] == ("fail", "resource(s) in a bad state: office (stuck running), property (failed)")
    early = report([d for d in done if d[1] not in ("open_house", "lookup")])
    assert early.pop("initial_import") == ("fail", "initial import not complete for: lookup, open_house") and {s for s, _ in early.values()} == {"skipped"}


def test_warming_counts_hidden_rows_and_spoken_for_media(spark):
    listings = spark.createDataFrame([("a", "Active", False), ("b", "Closed", True), ("c", "ActiveUnderContract", True)], "listing_key string, standard_status string, mlg_can_view boolean")
    media = spark.createDataFrame([(f"{k}{i}", "property", k, False, None) for k in "abc" for i in range(6)] + [("c9", "property", "c", True, "there"), ("c8", "member", "c", True, None)], "media_key string, resource_type string, resource_record_key string, mlg_can_view boolean, attachment_id string")
    work = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(["pending", "retrying", "in_progress", "succeeded", "canceled", "permanently_failed"])], "media_key string, status string")
    assert sorted(r.media_key for r in jobs.warm_plan(listings, media, work).collect()) == ["a4", "a5", *(f"c{i}" for i in range(6))]
    assert [r.media_key for r in jobs.warm_plan(listings, media, work, limit=3).collect()] == ["a4", "a5", "c0"]


def test_node_order_decides(spark):
    keyed = lambda key, rows: spark.createDataFrame(rows, f"{key} string, mlg_can_view boolean")
    tables = page.node_tables({"source_system": spark.createDataFrame([("1",), ("2",), ("4",)], "source_system_id string"), "property": keyed("listing_key", [("1", True), ("3", True)]), "media_version": spark.createDataFrame([("3",), ("2",)], "version_id string"), "lookup": keyed("lookup_key", [("2", False)])})
    assert [t[0] for t in tables] == ["lookup", "media_version", "property", "source_system"] and len(page.NODE_TABLES) == 16
    assert [r.type for r in page.nodes(tables, ["1", "2", "3", "4", "5"], spark).collect()] == ["property", None, "media_version", "source_system", None]
    with pytest.raises(ValueError):
        page.node_tables({"lookup_version": None})


def test_null_elements_of_string_lists_are_empty(spark):
    rows = [(1, '["a", null]'), (2, "[null]"), (3, '["a", 1]'), (4, "[]"), (5, "null"), (6, '"a"')]
    stamp = '"ListingKey": "L", "ModificationTimestamp": "2024-01-02T03:04:05Z", "MlgCanView": true'
    raw = spark.createDataFrame([(i, f'{{{stamp}, "Appliances": {v}}}', "property", "L", hours(1)) for i, v in rows], "raw_seq long, payload string, resource string, source_key string, source_modified_at timestamp")
    got = {r.raw_seq: (r.appliances, r.error) for r in project.project(raw, "property").select("raw_seq", "appliances", "error").collect()}
    assert got == {1: (["a", ""], None), 2: ([""], None), 3: (got[3][0], "Appliances: not a strings"), 4: (None, None), 5: (None, None), 6: (got[6][0], "Appliances: not a strings")}


def test_samples_are_cut_by_bytes(spark):
    texts = ["é" * 100, "é" * 101, "x" + "é" * 100, "x" * 200, "x" * 201, None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(audit.cut_bytes(F.col("t"), 200)).collect()]
    assert got == ["é" * 100, "é" * 100 + "…(truncated)", "x" + "é" * 99 + "\ufffd…(truncated)", "x" * 200, "x" * 200 + "…(truncated)", None]
    rows = spark.createDataFrame([(1, {"OfficeEmail": '"é"', "New": '"éé"'}), (2, {"New": "1"})], "raw_seq long, extended_fields map<string,string>")
    assert [tuple(r) for r in audit.resource_drift(rows, "office").collect()] == [("New", 2, 1, '"éé"', "string, len 4")]
    assert {r.field for r in audit.resource_drift(rows, "property", ("New",)).collect()} == {"OfficeEmail"}


def test_describe_value(spark):
    texts = {"null": "null", "true": "bool", '"abc"': "string, len 3", "1.5": "number", "[1,2]": "array, 2 items", '{"a":1}': "object, 1 keys", "abc": "string, len 3"}
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", audit.describe_value(F.col("t")).alias("d")).collect()}
    assert got == texts and audit.set_sample_rate(-1, 0.5) == 0.5 and audit.set_sample_rate(7) == 1


# --- streams ---------------------------------------------------------------------------------------------------


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = _random_feed(9)
    for i in range(3):
        spark.createDataFrame(rows[100 * i : 100 * i + 100], FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = feed_stream.fold_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check", "key", ["price"])
    done = []
    feed_stream.finish(query, lambda: done.append(1))
    got = {r.raw_seq: (r.key, r.outcome, r.prior_seq) for r in spark.read.parquet(f"{tmp_path}/out/data/commit=*/outcomes").collect()}
    assert got == plain_fold(rows) and done == [1] and len(query.recentProgress) >= 3


def test_stream_of_pages_lands_once(spark, tmp_path):
    for i in range(2):  # the second page repeats the first one's record
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"value": [{"ListingKey": f"L{j}", "ModificationTimestamp": "2024-01-02T03:04:05Z"} for j in range(i + 1)]}))
    pages = feed_stream.page_stream(spark, str(tmp_path / "in"), 1)
    rows = pages.select(F.col("ord").cast("long").alias("raw_seq"), F.lit("property").alias("resource"), F.get_json_object("record", "$.ListingKey").alias("source_key"), feed.json_timestamp(F.col("record")).alias("source_modified_at"), F.col("record").alias("payload"))
    feed_stream.land_stream(rows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.source_key for r in spark.read.parquet(f"{tmp_path}/out/ledger").collect()) == ["L0", "L1"]


def test_stateful_stream_folds_like_the_batch(spark, tmp_path):
    """Each file is in order of arrival, and a micro-batch is one file."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _random_feed(11, 120)
    for i in range(2):
        spark.createDataFrame(rows[60 * i : 60 * i + 60], FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folded = feed_stream.version_stream(stream, "key", ["price"])
    query = folded.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.raw_seq: (r.key, r.outcome, r.prior_seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain_fold(rows)


# --- repeated results, JSON types, exact shortcuts -----------------------------------------------------------------


def test_leftovers_keep_json_types(spark):
    base = {"ListingKey": "L1", "ModificationTimestamp": "2024-01-02T03:04:05Z"}
    got = _project(spark, [base | {"B": "5", "A": {"y": 1, "x": [None, "a"]}}, base | {"A": {"x": [None, "a"], "y": 1}, "B": "5"}, base | {"B": 5}, base | {"B": None}, base | {"B": True}, base])
    assert [r["extended_fields"] for r in got] == [{"A": '{"x":[null,"a"],"y":1}', "B": '"5"'}, {"A": '{"x":[null,"a"],"y":1}', "B": '"5"'}, {"B": "5"}, {"B": "null"}, {"B": "true"}, None]
    assert list(got[0]["extended_fields"]) == list(got[1]["extended_fields"]) == ["A", "B"]
    texts = spark.createDataFrame([('"5"',), ("5",), ('"true"',), ("true",), ("[1,2]",), ('{"a":1}',), ("null",)], "t string")
    shapes = [r[0] for r in texts.select(audit.describe_value(F.col("t"))).collect()]
    assert shapes == ["string, len 1", "number", "string, len 4", "bool", "array, 2 items", "object, 1 keys", "null"]


def test_repeated_results_do_not_repeat_rows(spark):
    job = "attachment_job_id string, media_key string, status string, created_at timestamp, claimed_at timestamp, claimed_by string, attempt_count int, attachment_id string"
    waiting = spark.createDataFrame([("j1", "m1", "in_progress", hours(1), hours(2), "w", 0, None), ("j2", "m1", "in_progress", hours(3), hours(4), "w", 2, None), ("j3", "m2", "in_progress", hours(1), hours(1), "w", 2, None), ("j4", "m3", "pending", hours(1), None, None, 0, None)], job)
    results = spark.createDataFrame([("j1", "w", True, "x1", False), ("j1", "w", True, "x1", False), ("j1", "other", True, "y", False), ("j2", "w", True, "x2", False), ("j3", "w", False, None, False), ("j3", "w", False, None, False), ("j4", "w", True, "z", False)], "attachment_job_id string, claimed_by string, ok boolean, attachment_id string, store_full boolean")
    applied = jobs.apply_results(waiting, results)
    got = {r.attachment_job_id: (r.status, r.attempt_count, r.attachment_id, r.applied) for r in applied.collect()}
    assert applied.count() == 4
    assert got == {"j1": ("succeeded", 0, "x1", "succeeded"), "j2": ("succeeded", 2, "x2", "succeeded"), "j3": ("permanently_failed", 3, None, "permanently_failed"), "j4": ("pending", 0, None, "lost")}
    media = spark.createDataFrame([("m1", None), ("m2", "old")], "media_key string, attachment_id string")
    assert sorted(map(tuple, jobs.link_media(media, applied).select("media_key", "attachment_id").collect())) == [("m1", "x2"), ("m2", "old")]
    run = "sync_event_id string, status string, started_at timestamp, ended_at timestamp, record_count long, high_water_mark timestamp, error_summary string"
    events = spark.createDataFrame([("e", "running", hours(0), None, None, None, None)], run)
    ends = spark.createDataFrame([("e", False, hours(1), 0, None, None, "no"), ("e", True, hours(2), 5, hours(1), None, None), ("e", True, hours(2), 5, hours(1), None, None)], "sync_event_id string, ok boolean, ended_at timestamp, record_count long, hwm timestamp, queried_from timestamp, error string")
    (one,) = ledger.stamp_outcome(events, ends).collect()
    assert (one.status, one.record_count, one.high_water_mark) == ("success", 5, hours(1))


def test_shortcuts_of_regions_and_trigrams_change_nothing(spark):
    rng = random.Random(5)
    places = [(30.5 + rng.uniform(-0.12, 0.12), -97.5 + rng.uniform(-0.14, 0.14)) for _ in range(400)] + [(None, 1.0), (30.5, None), (30.5, -97.5)]
    frame = spark.createDataFrame(places, "lat double, lng double")
    whole = frame.select(geo.within_radius(F.col("lat"), F.col("lng"), (30.5, -97.5), 10_000.0).alias("a"), (geo.geodesic(F.col("lat"), F.col("lng"), (30.5, -97.5)) <= 10_000).alias("b"))
    assert all(bool(r.a) == bool(r.b) for r in whole.collect())
    words = ["main", "street", "maine", "austin", "st", "stone", "78704", "blue"]
    texts = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))),) for _ in range(300)] + [(None,)], "t string")
    for query, threshold in (("main stret", 0.5), ("blue stone", 0.7), ("zzz", 0.1), ("main", 1.0), ("", 0.2), ("blue", 0.0)):
        both = texts.select(trigram.fuzzy(F.col("t"), query, threshold).alias("a"), (trigram.word_similarity(query, F.col("t")) >= threshold).alias("b")).collect()
        assert all(r.a == r.b for r in both), query


def test_children_with_links_of_their_own_and_odd_items(spark):
    record = {"ListingKey": "L1", "City": "5", "Media": [{"MediaKey": "m1", "ResourceName": "Planet", "Order": 1, "ModificationTimestamp": "2024-01-02T03:04:05Z"}, {"MediaKey": ""}, 7, None], "Rooms": [{"RoomKey": "r}1"}, {"RoomKey": "r2", "Note": '"ListingKey"'}], "UnitTypes": "none"}
    rows, errors = feed.split_children(spark.createDataFrame([(1, "L1", T0, json.dumps(record))], "raw_seq long, source_key string, source_modified_at timestamp, payload string"))
    got = {r.source_key: (r.resource, r.ord, r.source_modified_at, json.loads(r.payload)) for r in rows.collect()}
    assert got["L1"] == ("property", -1, T0, {"ListingKey": "L1", "City": "5"})
    assert got["m1"][0] == "media" and got["m1"][3] == {"MediaKey": "m1", "ResourceName": "Property", "Order": 1, "ModificationTimestamp": "2024-01-02T03:04:05Z"} and got["m1"][2] != T0
    assert got["r}1"] == ("property_rooms", 1_000_000, T0, {"RoomKey": "r}1", "ListingKey": "L1"}) and got["r2"][3] == {"RoomKey": "r2", "Note": '"ListingKey"', "ListingKey": "L1"}
    assert sorted((r.resource, r.pos, r.error) for r in errors.collect()) == [("media", 1, "Media: no MediaKey"), ("media", 2, "Media: not an object"), ("media", 3, "Media: not an object")]


def test_payloads_keep_their_text(spark, tmp_path):
    """What the feed has written stays as it is: numbers, escapes, blanks and the order of members."""
    child = '{ "MediaKey" : "m1", "Price": 1.50, "Note": "\\u00e9 }, {" ,"ResourceName":"Planet", "Big": 1234567890123456789012345678901234567890123}'
    record = '{"ListingKey":"L1", "ListPrice":250000.00,"Media":[' + child + ', {"MediaKey":"m2"}],"X": {"y":[1.0 , 2e3],"z":null} ,"Rooms":[{"RoomKey":"r", "RoomLevel":"\\"ListingKey\\""}], "City":"a\\/b"}'
    (tmp_path / "p.json").write_text('{"@odata.count": 7, "value" : [' + record + " ,  " + '{"ListingKey":"L2"}' + "]}")
    (tmp_path / "bad.json").write_text('{"value": [{"ListingKey": ')
    pages = feed.read_feed_pages(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.record, r.odata_count) for r in pages] == [(record, 7), ('{"ListingKey":"L2"}', 7)]
    rows, errors = feed.split_children(spark.createDataFrame([(1, "L1", T0, record), (2, "L2", T0, '{"ListingKey":"L2"}'), (3, "L3", T0, "no"), (4, "L4", T0, '{"Media":[] }')], "raw_seq long, source_key string, source_modified_at timestamp, payload string"))
    got = {r.source_key: r.payload for r in rows.collect()}
    assert got == {
        "L1": '{"ListingKey":"L1","ListPrice":250000.00,"X": {"y":[1.0 , 2e3],"z":null},"City":"a\\/b"}',
        "L2": '{"ListingKey":"L2"}',
        "L3": None,
        "L4": "{}",
        "m1": '{"ResourceName":"Property","MediaKey" : "m1","Price": 1.50,"Note": "\\u00e9 }, {","Big": 1234567890123456789012345678901234567890123}',
        "m2": '{"ResourceName":"Property","MediaKey":"m2"}',
        "r": '{"ListingKey":"L1","RoomKey":"r", "RoomLevel":"\\"ListingKey\\""}',
    }
    assert errors.count() == 0


def test_raw_records_have_a_time(spark):
    pages = spark.createDataFrame([("p", 0, '{"OfficeKey":"o1","ModificationTimestamp":"2024-01-02T03:04:05Z"}'), ("p", 1, '{"OfficeKey":"o2"}')], "page string, ord int, record string")
    got = {r.source_key: r.source_modified_at for r in feed.raw_records(pages, "office", "2024-02-03 00:00:00").collect()}
    assert got == {"o1": dt.datetime(2024, 1, 2, 3, 4, 5), "o2": dt.datetime(2024, 2, 3)}


def test_stream_states_over_full_commits(spark, tmp_path, monkeypatch):
    """Ten batches with a full state at every third: states are found again whichever commit has them."""
    monkeypatch.setattr(feed_stream, "FULL", 3)
    rows = _random_feed(13)
    for i in range(10):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed_stream.fold_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check", "key", ["price"]).awaitTermination()
    got = {r.raw_seq: (r.key, r.outcome, r.prior_seq) for r in spark.read.parquet(f"{tmp_path}/out/data/commit=*/outcomes").collect()}
    assert got == plain_fold(rows)


def test_poison_cutoff_is_a_filter(spark):
    """The first poison is a number, so that rows behind it can be left out before they are typed."""
    projected = spark.createDataFrame([(i, "bad" if i in (3, 5) else None) for i in range(1, 7)], "raw_seq long, error string")
    found = project.poison_cutoff(projected)
    assert sorted(r.raw_seq for r in found.collect()) == [1, 2]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_types_and_texts_of_a_projection_are_made_once(spark):
    """In one projection with the values, each type was made some five times, and each text cast from a VARIANT."""
    columns = [*parse.METADATA, *registry.RESOURCES["property"].columns]
    raw = spark.createDataFrame([], "raw_seq long, source_modified_at timestamp, payload string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = project.project(raw, "property")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    numbers = sum(c.kind.startswith("decimal") for c in columns)
    assert plan.count("SchemaOfVariant") <= len(columns) + numbers + 8  # decimals name it once more; the key and the record's own time
    assert plan.count("variant_get(") <= numbers + sum(c.kind == "bool" for c in columns) + 8


def test_numbers_and_lists_as_they_are_sent(spark):
    sent = ["250000.00", "1e2", '"1e2"', '" 5"', "5", "true", "1e400", '{"a":1}', "123456789012.345", "null"]
    lists = ['["a",null]', "[]", "[null]", "[1]", '["a",1]', '"a"', '[["a"]]', "null"]
    one = lambda name, v: '{"ListingKey":"L","ModificationTimestamp":"2024-01-02T03:04:05Z","%s":%s}' % (name, v)
    rows = [(i, T0, one("ListPrice", v)) for i, v in enumerate(sent)] + [(100 + i, T0, one("View", v)) for i, v in enumerate(lists)]
    typed = project.project(spark.createDataFrame(rows, "raw_seq long, source_modified_at timestamp, payload string"), "property")
    got = {r["raw_seq"]: (r["list_price"] and float(r["list_price"]), r["error"]) for r in typed.where("raw_seq < 100").collect()}
    wrong = (None, "ListPrice: not a decimal(13,2)")
    assert [got[i] for i in range(len(sent))] == [(250000.0, None), (100.0, None), (100.0, None), wrong, (5.0, None), wrong, wrong, wrong, wrong, (None, None)]
    got = {r["raw_seq"]: (r["view"], r["error"]) for r in typed.where("raw_seq >= 100").collect()}
    bad = "View: not a strings"
    assert [got[100 + i][1] for i in range(len(lists))] == [None, None, None, bad, bad, bad, bad, None]
    assert [got[100 + i][0] for i in (0, 1, 2, 7)] == [["a", ""], None, [""], None]


def test_embedded_arrays_are_read_once(spark, monkeypatch):
    """The elements of an array were found after its end had been looked for, and the parent's members twice."""
    read = []
    scan = json_text._scan
    monkeypatch.setattr(json_text, "_scan", lambda text, at: read.append(at) or scan(text, at))
    cut = json_text.record_cutter({"Media": "ResourceName", "Rooms": "ListingKey"}).func
    text = '{"A":[1,2],"Media":[{"k":1}, {"k":2}],"Rooms":"none","Media":[{"k":3}],"B":{}}'
    wrong = ['{"Media":[1,]}', '{"Media":[1', '{"Media":[1 2]}', "[]", None, '{"Media":[]']
    got = next(iter(cut(iter([pd.Series([text, *wrong])]))))
    assert got.iloc[0].tolist() == ['{"A":[1,2],"B":{}}', ['{"k":3}'], None]
    assert got.iloc[1:].isna().all(axis=None)
    assert len([at for at in read if text[at : at + 1] == "{"]) >= 3
    read.clear()
    next(iter(cut(iter([pd.Series([text])]))))
    assert len(read) == len(set(read)) == 11  # five keys, three values beside the arrays cut out, three elements


def test_key_of_a_child_is_read_once(spark):
    """The filter on errors had read the key anew from the text."""
    records = spark.createDataFrame([], "raw_seq long, source_key string, source_modified_at timestamp, payload string")
    for rows in feed.split_children(records):
        plan = rows.drop("payload", "source_modified_at")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("$.MediaKey") <= 2  # nullif names it twice


def test_children_that_plainly_have_a_key_stay_in_their_records(spark):
    """Only what may be wrong leaves the records when errors are looked for, and it is judged as among all rows."""
    odd = [
        '{"MediaKey":"a","N":1}', '{ "N" : [1, "}"] , "MediaKey" : "b" }', '{"MediaKey":""}', '{"MediaKey":null}', '{"N":1}', "{}", "7", '"MediaKey"', "null", '[{"MediaKey":"a"}]',
        '{"N":{"MediaKey":"a"}}', '{"MediaKey":"","MediaKey":"a"}', '{"MediaKey":"a","MediaKey":""}', '{"MediaKey":"","Media\\u004bey":"a"}', '{"MediaKey":"a","N":NaN}', '{"MediaKey":"a","N":-Infinity}',
        '{"MediaKey":5}', '{"MediaKey":{"a":1}}', '{"MediaKey":"a","N":%s}' % ("1" * 1100), '{"N":"MediaKey","MediaKey":"{"}', '{"MediaKey":"é\\"","N":1}',
    ]
    texts = ['{"ListingKey":"L","Media":[%s],"Rooms":[{"RoomKey":"r"},{"RoomKey":""}],"UnitTypes":7}' % ", ".join(odd), None, "no", '{"Media":[]}', *['{"Media":[%s]}' % x for x in odd]]
    schema = "raw_seq long, source_key string, source_modified_at timestamp, payload string"
    records = spark.createDataFrame([(i, f"L{i}", T0, text) for i, text in enumerate(texts)], schema)
    good, errors = (sorted(map(tuple, df.collect()), key=str) for df in feed.split_children(records))
    links, keys = {"Media": "ResourceName", "Rooms": "ListingKey", "UnitTypes": "ListingKey"}, {"Media": "MediaKey", "Rooms": "RoomKey", "UnitTypes": "UnitTypeKey"}
    narrow = records.selectExpr("raw_seq", "source_key as parent_key", "source_modified_at as parent_time", "payload")
    every = feed._found(json_text.split_records(narrow, links))
    assert errors == sorted(map(tuple, every.where("error is not null").select("raw_seq", "resource", "pos", "error").collect()), key=str)
    assert [e[2] for e in sorted(e for e in errors if e[0] == 0 and e[1] == "media")] == [*range(2, 12), 13, 14, 15, 18] and len(good) == len(texts) + 2 * (len(odd) - 14) + 1
    one = json_text.split_records(narrow, links, keys, most=1)
    left = {(r.raw_seq, r.kind, r.pos): r.text for r in one.collect()}
    assert all(k >= 0 for _, k, _ in left) and (0, 0, 0) not in left and (0, 1, 0) not in left and left[0, 1, 1] == '{"RoomKey":""}' and (0, 0, 1) not in left and left[0, 0, 10] == odd[10]
    flat = sorted(map(tuple, json_text.split_records(narrow, links, most=1).collect()), key=str)
    assert flat == sorted(map(tuple, json_text.split_records(narrow, links).collect()), key=str)
    few = json_text.split_records(narrow.where("raw_seq = 0"), links, room=3).where("kind >= 0").collect()  # an array has as many numbers as the longest needs
    assert sorted((r.kind, r.pos, r.ord) for r in few) == [(0, i, i) for i in range(len(odd))] + [(1, i, len(odd) + i) for i in range(2)]
    plan = feed.split_children(records)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.MediaKey") == 1 and plan.count("Generate") == 1  # the key had been read for nullif once more, and children exploded from lists
