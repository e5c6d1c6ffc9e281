"""Indexes, grids and stores against plain scans."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo, sql, trigram
from parcelflow.operators import audit, project, traverse, versions
from parcelflow.operators import address_index
from parcelflow.operators.address_index import AddressIndex
from parcelflow.operators.node_directory import NodeDirectory
from parcelflow.operators.regions import RegionGrid, clustered
from parcelflow.operators.version_store import VersionStore
from parcelflow.streaming import feed_stream


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# --- address index ---------------------------------------------------------------------------------------------

LISTING = "listing_key string, street_number string, street_name string, city string, state_or_province string, postal_code string, mlg_can_view boolean"


@pytest.fixture(scope="module")
def addresses(spark):
    r = random.Random(3)
    names = ["Main", "Mainly", "Élan", "Oak-Ridge", "St. John", "Avenida", "7th", "Ostrava", "Zürich", "main main"]
    rows = [(f"L{i}", str(r.randrange(400)), f"{r.choice(names)} {r.choice(['St', 'Ave', ''])}", r.choice(["Kansas City", "Leawood", None]), r.choice(["MO", "KS"]), f"{r.randrange(64000, 64100)}", r.random() < 0.9) for i in range(600)]
    rows += [("none", None, None, None, None, None, True), ("signs", "#", "!!", "-", "", None, True)]
    return spark.createDataFrame(rows, LISTING)


def test_index_equals_scan(spark, addresses, tmp_path):
    index = AddressIndex.build(addresses, folder=f"{tmp_path}/index")
    again = AddressIndex(spark, f"{tmp_path}/index")
    for query, threshold in [("12 main st", 0.6), ("zurich", 0.4), ("Zürich st", 0.3), ("élan ave leawood ks", 0.8), ("main", 1.0), ("xyzzy", 0.2), ("640", 0.5), ("a", 0.3), ("main main main", 0.05)]:
        want = {r.listing_key for r in trigram.search_address(addresses, query, threshold).collect()} if not trigram.is_zip_query(query) else None
        if want is None:
            want = {r.listing_key for r in addresses.where("mlg_can_view").where(trigram.fuzzy_address(addresses, query, threshold)).collect()}
            got = again.search(query, threshold).join(addresses.where("mlg_can_view"), F.col("key") == F.col("listing_key"), "left_semi")
            assert {r.key for r in got.collect()} == want
        else:
            assert {r.listing_key for r in index.search_address(addresses, query, threshold).collect()} == want, query
    assert index.search_address(addresses, "64001").count() == addresses.where("mlg_can_view and postal_code = '64001'").count()
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            index.search_address(addresses, bad)


def test_many_queries_equal_the_scan(spark, addresses):
    index = AddressIndex.build(addresses)
    asked = [(1, "main st kansas", 0.5), (2, "12 oak ridge mo 64010", 0.7), (3, "", 0.5), (4, None, 0.5), (5, "élan", 1.0), (6, "st", 0.9), (7, "nowhere at all", 0.4), (8, "kansas city mo", 0.0), (9, "main st kansas", 0.5)]
    got = {}
    for r in index.match(spark.createDataFrame(asked, "query_id int, query string, threshold double")).collect():
        got.setdefault(r.query_id, {})[r.key] = r.similarity
    for i, text, threshold in asked:
        if not text or not threshold:
            assert i not in got
            continue
        scan = addresses.select("listing_key", trigram.word_similarity(text, trigram.combined_address(addresses)).alias("s")).where(F.col("s") >= threshold).collect()
        assert got.get(i, {}) == {r.listing_key: r.s for r in scan}


def test_search_reads_only_its_trigrams(addresses):
    index = AddressIndex.build(addresses)
    plan = plan_of(index.search("oak ridge leawood", 0.7))
    assert "PushedFilters: [In(gram, [" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Cartesian" not in (many := plan_of(index.match(addresses.select(F.col("listing_key").alias("query_id"), F.col("street_name").alias("query"), F.lit(0.5).alias("threshold"))))) and "NestedLoop" not in many


# --- regions ---------------------------------------------------------------------------------------------------


def test_grid_equals_predicates(spark):
    """Polygons of any size with points inside, on edges and on corners; circles about poles and over the date line."""
    r = random.Random(8)
    corner = lambda s: round(r.uniform(-s, s), 2)
    rings = {}
    for region in range(30):
        y, x, size = r.uniform(-60, 60), r.uniform(-120, 120), r.choice([0.02, 1, 20, 55])
        rings[f"r{region}"] = [[(round(y + corner(size), 2), round(x + corner(size), 2)) for _ in range(r.choice([3, 4, 9]))] for _ in range(r.choice([1, 2]))]
    rings["square"] = [[(0.0, 0.0), (0.0, 45.0), (45.0, 45.0), (45.0, 0.0), (0.0, 0.0)]]
    rings["line"] = [[(1.0, 1.0), (1.0, 3.0), (1.0, 1.0)]]
    circles = {"pole": (89.5, 10.0, 300_000.0), "date": (10.0, 179.9, 50_000.0), "small": (0.5, 0.5, 900.0), "half": (0.0, 0.0, 9_000_000.0)}
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(1500)] + [p for region in rings.values() for ring in region for p in ring]
    points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for region in rings.values() for ring in region for a, b in zip(ring, ring[1:], strict=False)]
    points += [(0.0, 22.5), (22.5, 0.0), (45.0, 45.0), (22.5, 22.5), (0.5, 0.505), (10.0, -179.8), (89.9, -170.0), (90.0, 180.0), (-90.0, -180.0), (1.0, 2.0)]
    points += [(y + r.uniform(-0.01, 0.01), x + r.uniform(-0.01, 0.01)) for region in rings.values() for y, x in region[0]]
    rows = [(f"p{i}", y, x) for i, (y, x) in enumerate(points)] + [("nowhere", None, 1.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "listing_key string, latitude double, longitude double")
    vertices = spark.createDataFrame([(n, i, k, y, x) for n, region in rings.items() for i, ring in enumerate(region) for k, (y, x) in enumerate(ring)], "region_id string, ring int, seq int, latitude double, longitude double")
    around = spark.createDataFrame([(n, *c) for n, c in circles.items()], "region_id string, latitude double, longitude double, meters double")
    got = {}
    for m in RegionGrid(vertices, around).match(df).collect():
        got.setdefault(m.region_id, []).append(m.listing_key)
    assert all(len(v) == len(set(v)) for v in got.values())
    lat, lng = F.col("latitude"), F.col("longitude")
    tests = {n: geo.region(lat, lng, {"polygons": v}) for n, v in rings.items()} | {n: geo.region(lat, lng, {"radius": {"center": c[:2], "meters": c[2]}}) for n, c in circles.items()}
    flags = df.select("listing_key", *[c.alias(n) for n, c in tests.items()]).collect()
    for n in tests:
        assert sorted(got.get(n, [])) == sorted(f.listing_key for f in flags if f[n]), n


def test_grid_plan_has_no_cross_join(spark):
    square = spark.createDataFrame([("s", 0, k, y, x) for k, (y, x) in enumerate([(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0)])], "region_id string, ring int, seq int, latitude double, longitude double")
    df = spark.createDataFrame([("a", 5.0, 5.0)], "listing_key string, latitude double, longitude double")
    grid = RegionGrid(square)
    assert "Cartesian" not in plan_of(grid.match(df)) and "NestedLoop" not in plan_of(grid.match(df))
    kinds = grid.cells.groupBy(F.col("edges").isNull().alias("whole")).count().collect()
    assert {k.whole for k in kinds} == {True, False}  # cells in the middle are never tested against edges
    with pytest.raises(ValueError):
        RegionGrid()


def test_points_written_by_place(spark, tmp_path):
    rows = [(f"p{i}", (i * 37 % 1000) / 10 - 45, (i * 91 % 1000) / 5 - 95) for i in range(1000)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "listing_key string, latitude double, longitude double")
    out = clustered(df, f"{tmp_path}/places", files=4)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    near = out.where("latitude between 1 and 4 and longitude between 1 and 9").select(F.input_file_name().alias("f")).distinct().count()
    assert 1 <= near < out.select(F.input_file_name().alias("f")).distinct().count()


# --- version store ---------------------------------------------------------------------------------------------

FEED = "key string, raw_seq long, source_modified_at timestamp, mlg_can_view boolean, price long, tags array<string>"


def feed_rows(seed, n=400, keys=25):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 3 + r.randrange(-4, 5)), r.random() < 0.85, r.randrange(3), r.choice([[], ["a"], None])) for i in range(n)]


def flat(versions):
    return sorted((r.key, r.raw_seq, r.valid_from, r.valid_to, r.change_type, r.price, str(r.changed_fields)) for r in versions.collect())


def whole(spark, rows):
    return flat(versions.version_batch(spark.createDataFrame(rows, FEED), "key", ["price", "tags"])[1])


def test_store_in_batches_equals_one_fold(spark, tmp_path):
    rows = feed_rows(1)
    store = VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=4)
    for i in range(0, 400, 100):
        store.apply(spark.createDataFrame(rows[i : i + 100], FEED))
        if i == 100:
            store.compact()
        if i == 200:  # as another session would
            store = VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=4)
    assert flat(store.history()) == whole(spark, rows)
    before = store.commit
    again = {r.outcome for r in store.apply(spark.createDataFrame(rows[300:], FEED)).select("outcome").distinct().collect()}
    assert again <= {"skip-stale", "skip-no-diff", "skip-tombstoned"} and flat(store.history()) == whole(spark, rows) and store.commit == before + 1
    store.compact()
    store.vacuum()
    assert flat(store.history()) == flat(VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=4).history()) == whole(spark, rows)
    ids = {r.key: r.version_id for r in store.open_versions().collect()}
    assert {r.key: r.version_id for r in store.entities().collect()} == ids


def test_commit_cut_short_is_replaced(spark, tmp_path, monkeypatch):
    rows = feed_rows(2)
    store = VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=4)
    store.apply(spark.createDataFrame(rows[:200], FEED))
    seen = flat(store.history())
    monkeypatch.setattr(store, "_point", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.apply(spark.createDataFrame(rows[200:], FEED))
    assert flat(store.history()) == seen
    store = VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=4)
    assert flat(store.history()) == seen
    store.apply(spark.createDataFrame(rows[200:], FEED))
    assert flat(store.history()) == whole(spark, rows)


def test_small_batch_reads_its_buckets_without_exchange(spark, tmp_path):
    store = VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=16)
    store.apply(spark.createDataFrame(feed_rows(3), FEED))
    plan = plan_of(store.open_versions(["k1"]))
    assert "SelectedBucketsCount: 1 out of 16" in plan and "Exchange" not in plan
    assert "Exchange" not in plan_of(store.open_versions())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.createDataFrame([("k1", 5)], "key string, n int")
        assert plan_of(batch.join(store.open_versions(), "key", "left")).count("\nExchange") + plan_of(batch.join(store.open_versions(), "key", "left")).count(") Exchange") <= 2
        joined = batch.join(store.open_versions(), "key", "left")._jdf.queryExecution().executedPlan().toString()
        assert joined.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("from_seq", [None, 150, 9999])
def test_reprocess(spark, tmp_path, from_seq):
    """Under a new mapping the history is that of a fold from scratch of old rows as they were and new ones as they are now."""
    rows = feed_rows(4)
    mapped = [(k, s, at, shown, price * 10 if s % 4 == 0 else price, tags) for k, s, at, shown, price, tags in rows]
    store = VersionStore(spark, f"{tmp_path}/s", "key", ["price", "tags"], buckets=4)
    store.apply(spark.createDataFrame(rows[:300], FEED))
    store.apply(spark.createDataFrame(rows[300:], FEED))
    commit = store.commit
    assert store.reprocess(spark.createDataFrame(rows, FEED), from_seq) == 0 and store.commit == commit
    changed = store.reprocess(spark.createDataFrame(mapped, FEED), from_seq)
    cut = 0 if from_seq is None else from_seq
    assert flat(store.history()) == whole(spark, rows[:cut] + mapped[cut:])
    assert (changed > 0) == (store.commit > commit) and (changed > 0) == (from_seq in (None, 150))
    assert version_invariants_hold(store)


def version_invariants_hold(store):
    entity = store.entities().withColumnRenamed("version_id", "current_version_id")
    return versions.version_invariants(store.history(), entity, "key").count() == 0


# --- many times at once, trees, rows without a key -------------------------------------------------------------


def test_as_of_each_over_many_ranges(spark, monkeypatch):
    """One key has nearly all versions and probes, and is cut into many ranges; probes at the very time of a version see it."""
    r = random.Random(6)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    kept = {k: sorted(r.sample(range(3000), n)) for k, n in (("hot", 600), ("a", 3), ("b", 1))}
    history = [(k, i * 7 + len(k), at(m), f"v{m}") for k, ms in kept.items() for i, m in enumerate(ms)] + [(None, 9, at(1), "none")]
    probes = [(i, r.choice(["hot"] * 9 + ["a", "b", "c"]), at(r.randrange(3100))) for i in range(800)] + [(900 + i, "hot", at(m)) for i, m in enumerate(kept["hot"][:5])] + [(-1, None, at(5)), (-2, "a", None), (-3, "hot", None)]
    v = spark.createDataFrame(history, "key string, raw_seq long, valid_from timestamp, name string")
    p = spark.createDataFrame(probes, "probe int, key string, at timestamp")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {x.probe: x.name for x in versions.as_of_each(v, p, "key", "at", ["name"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(probes)
    for i, k, t in probes:
        valid = [m for m in kept.get(k, []) if t is not None and at(m) <= t]
        assert got[i] == (f"v{valid[-1]}" if valid else None)


def test_office_ancestors_of_chains_and_circles(spark):
    up = {"a": "b", "b": "c", "c": None, "d": "e", "e": "f", "f": "e", "g": "g", "h": "gone", "i": "a"}
    got = {}
    for x in traverse.office_ancestors(spark.createDataFrame(list(up.items()), "office_key string, main_office_key string")).collect():
        got.setdefault(x.office_key, {})[x.ancestor_key] = x.depth
    assert got == {"a": {"b": 1, "c": 2}, "b": {"c": 1}, "d": {"e": 1, "f": 2}, "e": {"f": 1}, "f": {"e": 1}, "h": {"gone": 1}, "i": {"a": 1, "b": 2, "c": 3}}


def test_rows_without_a_key_are_one_history(spark):
    rows = [(None, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 5 != 4, i // 3, None) for i in range(40)]
    out = versions.fold_versions(spark.createDataFrame(rows, FEED), "key", ["price", "tags"]).orderBy("raw_seq").collect()
    named = versions.fold_versions(spark.createDataFrame([("k", *r[1:]) for r in rows], FEED), "key", ["price", "tags"]).orderBy("raw_seq").collect()
    assert [(r.raw_seq, r.outcome, r.prior_seq) for r in out] == [(r.raw_seq, r.outcome, r.prior_seq) for r in named] and {r.key for r in out} == {None}


def test_payloads_are_parsed_once(spark):
    """The typed rows of a batch are written, and nothing after that reads what they were made from."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    typed = spark.createDataFrame(feed_rows(7, 200), FEED).mapInArrow(count, FEED)
    outcomes, fresh = versions.version_batch(typed, "key", ["price", "tags"])
    assert fresh.count() > 0 and outcomes.count() == 200 and seen.value == 200


# --- streams ---------------------------------------------------------------------------------------------------


def test_chain_survives_a_batch_cut_short(spark, tmp_path, monkeypatch):
    """A batch fails after it has landed and folded, before its pointer; the stream resumes, does it again as a whole, and is equal to the fold of all pages."""
    monkeypatch.setattr(feed_stream, "FULL", 2)
    page = lambda n, records: ((tmp_path / "in" / f"page={n:06d}").mkdir(parents=True), (tmp_path / "in" / f"page={n:06d}" / "p.json").write_text(json.dumps({"value": records})))
    stamp = lambda h: (dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")
    r = random.Random(9)
    records = [[{"ListingKey": f"L{r.randrange(4)}", "ModificationTimestamp": stamp(10 * n + i), "ListPrice": r.randrange(3), "MlgCanView": r.random() < 0.8, "Rooms": [{"RoomKey": f"R{n}"}] if i == 0 else [3]} for i in range(6)] for n in range(6)]
    for n in range(6):
        page(n, records[n] + (records[n - 1][:2] if n else []) + ([{"ListingKey": "bad", "ModificationTimestamp": "2024-01-01"}] if n == 3 else []))
    start = lambda: feed_stream.ingest_stream(feed_stream.page_stream(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/out", f"{tmp_path}/check", "2024-02-01")
    write = feed_stream.write_snapshot
    monkeypatch.setattr(feed_stream, "write_snapshot", lambda frames, root, commit: 1 / 0 if commit == 3 else write(frames, root, commit))
    done = []
    with pytest.raises(Exception):  # noqa: B017
        feed_stream.finish(start(), lambda: done.append("too early"))
    monkeypatch.setattr(feed_stream, "write_snapshot", write)
    feed_stream.finish(start(), lambda: done.append(feed_stream.link_landed(spark, f"{tmp_path}/out", "property_rooms", spark.createDataFrame([("L0",), ("L1",), ("L2",)], "listing_key string"))))
    assert len(done) == 1
    ledger = feed_stream.read_ledger(spark, f"{tmp_path}/out", "raw_seq long, source_key string, source_modified_at timestamp, payload string").collect()
    assert len(ledger) == 37 and sorted(x.raw_seq for x in ledger) == sorted([(n << 32) + i for n in range(6) for i in range(6)] + [(3 << 32) + 8])
    out = {x.raw_seq: x.outcome for x in feed_stream.committed_outcomes(spark, f"{tmp_path}/out").collect()}
    typed = [(x["ListingKey"], (n << 32) + i, dt.datetime.strptime(x["ModificationTimestamp"], "%Y-%m-%dT%H:%M:%SZ"), x["MlgCanView"], x["ListPrice"], None) for n in range(6) for i, x in enumerate(records[n])]
    assert out == {x.raw_seq: x.outcome for x in versions.fold_versions(spark.createDataFrame(typed, FEED), "key", ["price"]).collect()}
    assert sorted((x.room_key, x.parent_listing_key) for x in done[0].collect()) == [(f"R{n}", key if (key := records[n][0]["ListingKey"]) != "L3" else None) for n in range(6)]
    aside = spark.read.parquet(f"{tmp_path}/out/aside/*").collect()
    assert {x.resource for x in aside} == {"property", "property_rooms"} and sum(x.resource == "property" for x in aside) == 1
    for day in feed_stream.folders(spark, f"{tmp_path}/out/ledger"):
        assert day.startswith("_") or len(feed_stream.ledger_paths(spark, f"{tmp_path}/out", [day.partition("=")[2]])) <= 3
    assert len(feed_stream.folders(spark, f"{tmp_path}/out/state")) <= 4


def test_bounded_dedup_forgets(spark, tmp_path):
    """A repeat within the bound is dropped, one far beyond it is landed again."""
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[("property", "a", at(0)), ("property", "b", at(0))], [("property", "a", at(0))], [("property", "c", at(30))], [("property", "d", at(31))], [("property", "c", at(30)), ("property", "a", at(0))]]
    schema = "resource string, source_key string, source_modified_at timestamp"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed_stream.dedup_within(stream, "2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x.source_key for x in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d"]


# --- node directory and audits ---------------------------------------------------------------------------------


def test_directory_of_nodes_by_commits(spark, tmp_path):
    keyed = lambda key, rows: spark.createDataFrame(rows, f"{key} string, mlg_can_view boolean")
    directory = NodeDirectory(spark, f"{tmp_path}/nodes")
    assert [r.type for r in directory.nodes(["1"]).collect()] == [None]
    directory.commit({"property": keyed("listing_key", [("1", True), ("2", False), (None, True)]), "lookup": keyed("lookup_key", [("1", False), ("3", True)]), "source_system": spark.createDataFrame([("2",), ("9",)], "source_system_id string")})
    asked = ["1", "2", "3", "9", "8", "1"]
    assert [r.type for r in directory.nodes(asked).collect()] == [None, None, "lookup", "source_system", None, None]
    directory.commit({"property": keyed("listing_key", [("2", True), ("8", None)])}, removed={"lookup": keyed("lookup_key", [("1", False)])})
    want = ["property", "property", "lookup", "source_system", None, "property"]
    assert [r.type for r in directory.nodes(asked).collect()] == want
    directory.compact()
    assert [r.type for r in directory.nodes(asked).collect()] == want
    got = {(r.id, r.type) for r in directory.match(spark.createDataFrame([(i,) for i in asked], "id string")).collect()}
    assert got == set(zip(asked, want, strict=True))
    assert "PushedFilters: [In(id, [" in plan_of(directory.nodes(asked))
    with pytest.raises(ValueError):
        directory.commit({"lookup_version": keyed("x", [])})


def test_audit_reads_payloads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "raw_seq long, source_modified_at timestamp, payload string"
    stamp = '"OfficeKey": "F", "ModificationTimestamp": "2024-01-02T03:04:05Z"'
    rows = [(1, None, f'{{{stamp}, "OfficeName": "a", "New": 1}}'), (2, None, f'{{{stamp}, "OfficeName": ""}}'), (3, None, f'{{{stamp}, "OfficeName": 5, "New": 2}}'), (4, None, "no"), (5, None, f'{{{stamp}, "OfficeName": "b", "New": 1, "Other": []}}')]
    raw = spark.createDataFrame(rows, schema)
    found = audit.audit_once(raw.mapInArrow(count, schema), "office")
    got = {name: [tuple(r) for r in df.collect()] for name, df in found.items()}
    assert seen.value == 5
    plain = {name: [tuple(r) for r in df.collect()] for name, df in audit.validate_raw(raw, "office").items()}
    for name in plain:
        assert sorted(got[name]) == sorted(plain[name])
    assert got["totals"] == [(5, 2)] and ("office_name", 2, 3) in got["fill_rate"] and got["unconsumed"] == [("New", 2), ("Other", 1)]
    empty = {name: df.count() for name, df in audit.audit_once(raw.where("false"), "lookup").items()}
    assert empty["totals"] == 1 and empty["errors"] == empty["unconsumed"] == 0


def test_sql_functions_equal_columns(spark):
    rng = random.Random(5)
    words = ["blue", "bolt", "bolts", "Größe", "straße", "12", "123", "way", ""]
    places = [(30.5, -97.5), (30.5, -97.4), (90.0, 0.0), (0.0, 0.0), (-30.0, 82.4), (1.0, None), (None, None)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(6))), *rng.choice(places)) for _ in range(60)] + [(None, 30.5, -97.45), ("?!", 30.58, -97.4)]
    rows += [("bolt", 30.5 + rng.uniform(-0.1, 0.1), -97.4 + rng.uniform(-0.11, 0.11)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "t string, lat double, lng double")
    for _ in range(2):  # again, as a session may
        sql.register(spark)
    for q in ("123 Blue bolt", "?!", "größe"):
        text = "word_similarity(:q, t), fuzzy_match(:q, t, 0.5D), geodesic_metres(lat, lng, 30.5D, -97.4D), within_radius(lat, lng, 30.5D, -97.4D, 9600D)"
        got = spark.sql(f"select {text} from {{frame}}", args={"q": q}, frame=frame).collect()
        lat, lng, place = F.col("lat"), F.col("lng"), (30.5, -97.4)
        want = frame.select(trigram.word_similarity(q, F.col("t")), trigram.fuzzy(F.col("t"), q, 0.5), geo.geodesic(lat, lng, place), geo.reached(lat, lng, place, F.lit(9600.0))).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert {r[3] for r in got} == {True, False}


def test_stream_chain_of_large_numbers(spark):
    """Events beyond the numbers of the smallest tables are on pages, too."""
    from parcelflow.plans.stores import stream_chain

    rows = [(k, 10_000_000_000 + k * 100_000_000, f"2024-01-{k:02d} 00:00:00", True, k, "view") for k in range(1, 13)]
    feed = spark.createDataFrame(rows, "source_key long, raw_seq long, t string, mlg_can_view boolean, list_price long, status string").withColumn("source_modified_at", F.col("t").cast("timestamp_ntz")).drop("t")
    found = stream_chain(feed, spark.createDataFrame([("L3",)], "listing_key string")).collect()
    assert sorted(int(r.key) for r in found if r.what == "version") == sorted(int(r.key) for r in found if r.what == "link") == list(range(1, 13))


def test_grid_counts_without_pairs(spark):
    """Counts are those of the matches: overlapping rings of one region, two regions of the same rings, places that repeat; pairs are not made one by one."""
    r = random.Random(3)
    rings = {n: [[(r.uniform(0, 4) + y, r.uniform(0, 4) + x) for y, x in ((0, 0), (3, 0), (3, 3), (0, 3))], [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0)]] for n in "abc"}
    rings["d"] = rings["a"]
    rows = [(n, i, k, y, x) for n, region in rings.items() for i, ring in enumerate(region) for k, (y, x) in enumerate(ring)]
    grid = RegionGrid(spark.createDataFrame(rows, "region_id string, ring int, seq int, latitude double, longitude double"))
    places = [(r.uniform(0, 8), r.uniform(0, 8)) for _ in range(400)] + [(1.0, 1.5), (1.5, 1.5), (2.0, 1.0)]
    df = spark.createDataFrame([(f"p{i}", y, x) for i, (y, x) in enumerate(places * 3)] + [("none", None, 1.0)], "listing_key string, latitude double, longitude double")
    counts = {m.region_id: m.n for m in grid.count(df).collect()}
    tests = [geo.region(F.col("latitude"), F.col("longitude"), {"polygons": v}).alias(n) for n, v in rings.items()]
    flags = df.select(*tests).collect()
    assert counts == {n: sum(f[n] for f in flags) for n in rings} and counts["a"] == counts["d"] > 0


def test_children_without_parent_are_many_tasks(spark):
    """Rows without a key match nothing, and are not dealt to one task."""
    rooms = spark.createDataFrame([(f"R{i}", "L1" if i % 4 == 0 else None) for i in range(400)], "room_key string, parent_listing_key string")
    listings = spark.createDataFrame([("L1", "x"), ("L2", "y"), (None, "z")], "listing_key string, city string")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("-1", "false"), strict=True):
            spark.conf.set(n, v)
        rows = traverse.child_parent(rooms, listings, ["city"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sorted((r.room_key, r.parent_city) for r in rows) == sorted((f"R{i}", "x" if i % 4 == 0 else None) for i in range(400))
    assert len({r.task for r in rows if r.parent_listing_key is None}) > 1


def test_rooms_are_made_distinct_by_their_keys(spark, tiny):
    """No text of a room goes into the exchange that makes rooms distinct."""
    from parcelflow.plans.demo import VIEWS, view

    rooms = view(spark, tiny, "room")
    plain = spark.sql(VIEWS["room"], lineitem=view(spark, tiny, "lineitem"))
    assert rooms.exceptAll(plain).isEmpty() and plain.exceptAll(rooms).isEmpty()
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in optimized(rooms) and "Aggregate [l_orderkey" not in optimized(plain)


def test_directory_deals_rows_out_once_and_forgets_what_was_compacted(spark, tmp_path):
    """A commit had two exchanges, one to group by id and one to order by it; lookups read compacted commits as well."""
    directory = NodeDirectory(spark, f"{tmp_path}/nodes")
    office = spark.createDataFrame([("1", True), ("1", False), ("2", True), ("3", False)], "office_key string, mlg_can_view boolean")
    dealt = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(office), "sortWithinPartitions", lambda self, *a, f=type(office).sortWithinPartitions: dealt.append(self) or f(self, *a))
        directory.commit({"office": office})
        directory.compact()
    assert [d._jdf.queryExecution().executedPlan().toString().count("Exchange") for d in dealt] == [1, 1]
    directory.commit({"member": spark.createDataFrame([("3", True)], "member_key string, mlg_can_view boolean")})
    assert directory._commits() == [1, 2]
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    assert sorted(map(tuple, directory.match(asked).collect())) == [("1", "office"), ("2", "office"), ("3", "member"), ("4", None)]


def test_streets_and_numbers_meet_before_pairs(spark):
    """Addresses of few words and many numbers: the rarest trigrams alone had let a tenth of all pairs meet."""
    streets = ["blue bolt", "large ring", "hot bolt", "blue ring"]
    rows = [(f"k{i}", f"{i % 90 + 100} {streets[i % 4]} nation {i % 5} {i * 7919 % 100000:05d}") for i in range(400)] + [("d", "12 34"), ("w", "hot ring"), ("w2", "hot bolt"), ("n", None)]
    texts = spark.createDataFrame(rows, "listing_key string, address string")
    asked = [(f"q{i}", f"{streets[i % 4][1:]}e nation {i % 5} {i * 7919 % 100000:05d}", 0.7) for i in range(0, 400, 40)] + [("12", "12 34", 0.5), ("hb", "hot bolt", 0.9), ("mix", "bolt 100 200", 0.3)]
    queries = spark.createDataFrame(asked, "query_id string, query string, threshold double")
    index = AddressIndex.build(texts, address=F.col("address"))
    got = {(r.query_id, r.key): round(r.similarity, 9) for r in index.match(queries).collect()}
    want = {}
    for name, query, threshold in asked:
        found = texts.select("listing_key", trigram.word_similarity(query, F.col("address")).alias("s")).where(F.col("s") >= threshold)
        want |= {(name, r.listing_key): round(r.s, 9) for r in found.collect()}
    assert got == want and ("12", "d") in want and ("hb", "w2") in want and ("q40", "k40") in want
    q = F.array_distinct(trigram.trigrams(F.col("query")))
    letters, numbers = address_index._parted(q)
    parted = queries.where("query_id like 'q%'").select("query_id", letters.alias("letters"), numbers.alias("numbers"), address_index._needed(F.size(q), F.col("threshold")).alias("needed"))
    assert 10 <= index._hits_by_street(parted).count() < 0.03 * 10 * 400


def test_pages_of_a_batch_are_written_together(spark, tmp_path):
    """One task had written all pages; now the files of a batch come from many, and none is older than one of a batch before."""
    from parcelflow.plans.stores import _write_pages

    feed = spark.range(0, 4000).where("id % 400 >= 200").selectExpr("id as raw_seq", "id % 7 as source_key", "timestamp_ntz '2024-01-02 03:04:05' as source_modified_at", "true as mlg_can_view", "id as list_price", "'view' as status")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _write_pages(feed.repartition(3), f"{tmp_path}/in", 40, 4000, 0, 40, 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "in").glob("page=*/part-*"))
    pages = [int(f.parent.name[5:]) for f in files]
    assert pages == [p for p in range(2, 41) if p % 4 != 1]
    batches = [files[i : i + 4] for i in range(0, len(files), 4)]
    assert max(len({f.name.split("-")[1] for f in b}) for b in batches) > 1
    for before, after in zip(batches, batches[1:], strict=False):
        assert max(f.stat().st_mtime_ns for f in before) < min(f.stat().st_mtime_ns for f in after)
    numbers = [int(n) for f in files for n in re.findall(r'"OpenHouseType":"(\d+)"', f.read_text())]
    assert len(numbers) == 2200 and set(numbers) == {i for i in range(4000) if i % 400 >= 200}


def test_large_days_are_landed_by_many_tasks(spark, tmp_path, monkeypatch):
    """A batch's rows of one day had been one file, written and read by one task; and its pages had been cut twice."""
    monkeypatch.setattr(feed_stream, "FILE_ROWS", 100)
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(0, 1010).selectExpr("id as raw_seq", "'open_house' as resource", "cast(id % 1005 as string) as source_key", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 1005 div 1000) as source_modified_at", "'{}' as payload")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        landed = feed_stream.land_batch(rows.mapInArrow(look, rows.schema), 0, f"{tmp_path}/root")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen.value == 1010
    assert sorted(r.raw_seq for r in landed.collect()) == list(range(1005))
    sizes = [len(list((tmp_path / "root" / "ledger" / f"day=2024-01-0{d}" / "batch=0").glob("*.parquet"))) for d in (1, 2)]
    assert sizes[0] > 1 and sizes[1] == 1
    again = feed_stream.land_batch(rows.where("raw_seq < 500"), 1, f"{tmp_path}/root")
    assert again.count() == 0


def test_runs_over_other_words_are_ruled_out_before_pairs_meet(spark, tmp_path):
    """Texts that share enough as a whole, but in no run, had met by the number of pairs; and postings were written that no query asked for."""
    streets = ["blue bolt", "large ring", "hot bolt", "blue ring"]
    rows = [(f"k{i}", f"{i % 90 + 100} {streets[i % 4]} nation {i % 5} {'asia' if i % 4 else 'middle east'} {i * 7919 % 100000:05d}") for i in range(400)]
    texts = spark.createDataFrame(rows, "listing_key string, address string")
    asked = [(f"q{i}", f"{streets[i % 4][1:]}e nation {i % 5} {i * 7919 % 100000:05d}", 0.7) for i in range(0, 400, 20)] + [(f"n{i}", f"{streets[i % 4]} nation {i % 5}", 0.8) for i in range(4)]
    queries = spark.createDataFrame(asked, "query_id string, query string, threshold double")
    index = AddressIndex.build(texts, address=F.col("address"), folder=f"{tmp_path}/index")
    got = {(r.query_id, r.key): round(r.similarity, 9) for r in index.match(queries).collect()}
    want = {}
    for name, query, threshold in asked:
        found = texts.select("listing_key", trigram.word_similarity(query, F.col("address")).alias("s")).where(F.col("s") >= threshold)
        want |= {(name, r.listing_key): round(r.s, 9) for r in found.collect()}
    assert got == want and want
    assert not (tmp_path / "index" / "postings").exists()
    q = F.array_distinct(trigram.trigrams(F.col("query")))
    letters, numbers = address_index._parted(q)
    parted = queries.where("query_id like 'q%'").select("query_id", letters.alias("letters"), numbers.alias("numbers"), "threshold", address_index._needed(F.size(q), F.col("threshold")).alias("needed"))
    assert index._hits_by_street(parted).count() < 10  # each of the twenty shares enough with its own address as a whole


def test_least_numbers_is_a_lower_bound():
    r = random.Random(5)
    pick = lambda n: " ".join(r.choice(["ab", "abc", "bca", "a1", "1b2", "12", "121", "212", "2"]) for _ in range(n))
    reached = 0
    for _ in range(3000):
        text, query, threshold = trigram.trigrams_of(pick(r.randrange(1, 7))), set(trigram.trigrams_of(pick(r.randrange(1, 4)))), r.choice([0.3, 0.5, 0.7, 0.9, 1.0])
        digit = lambda g: any(c.isdigit() for c in g)
        letters = {g for g in query if not digit(g)}
        least = address_index.least_numbers(letters, len(query), len(query) - len(letters), threshold, ["" if digit(g) else g for g in text])
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                run = set(text[a:b])
                if len(run & query) / len(run | query) >= threshold:
                    reached += 1
                    assert least is not None and least <= len({g for g in run & query if digit(g)})
    assert reached > 100


def test_audit_makes_no_texts_of_leftovers(spark):
    """Only their names are asked for; texts of their values had been made and sorted, and all columns been copied for a generated one."""
    stamp = '"OfficeKey": "F", "ModificationTimestamp": "2024-01-02T03:04:05Z"'
    bodies = [f"{{{stamp}}}", f'{{{stamp}, "Z": 1, "A": {{"b": [1, null]}}, "": null}}', f'{{{stamp}, "OfficeName": 5, "New": ""}}', '{"New": 1}', "{}", "[1]", "no", None, f'{{{stamp}, "New": 1,}}']
    raw = spark.createDataFrame(list(enumerate(bodies)), "raw_seq long, payload string").selectExpr("raw_seq", "timestamp '2024-01-02 00:00:00' as source_modified_at", "payload")
    names = project.typed_rows(raw, "office", names_only=True)
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "Generate" not in plan
    whole = project.project(raw, "office").withColumn("extended_fields", F.map_keys("extended_fields"))
    assert names.columns == whole.columns and sorted(map(str, names.withColumn("extended_fields", F.array_sort("extended_fields")).collect())) == sorted(map(str, whole.collect()))
    found, plain = audit.audit_once(raw, "office"), audit.validate_raw(raw, "office")
    for name in plain:
        assert sorted(map(str, found[name].collect())) == sorted(map(str, plain[name].collect()))
    assert [tuple(r) for r in found["unconsumed"].collect()] == [("", 1), ("A", 1), ("Z", 1)]
