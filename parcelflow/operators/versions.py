"""Version history: which raw rows become versions, and what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.sources.snapshot import work_folder

OUTCOMES = ("insert", "update", "delete", "skip-stale", "skip-no-diff", "skip-tombstoned")
WRITTEN = ("insert", "update", "delete")
#: Keys with more rows than this are folded from sorted rows, one at a time, instead of a collected array.
LONG_HISTORY = 500


def data_text(columns: list[str]) -> Column:
    """Canonical text of the data columns: equal texts are equal data (NULL and an empty array are the same)."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def _decide(exists: Column, tombstoned: Column, open_at: Column, open_text: Column, at: Column, visible: Column, text: Column) -> Column:
    return (
        F.when(open_at.isNotNull() & (at <= open_at), "skip-stale")
        .when(~visible & exists & tombstoned, "skip-tombstoned")
        .when(~visible, "delete")
        .when(~exists, "insert")
        .when(open_text.eqNullSafe(text), "skip-no-diff")
        .otherwise("update")
    )


_STATE = "struct<found:boolean,tomb:boolean,at:timestamp,text:string,seq:bigint,outs:array<struct<raw_seq:bigint,outcome:string,prior_seq:bigint>>>"


def _fold_native(rows: DataFrame, key: str) -> DataFrame:
    # by number: a fold is much work on few bytes, which adaptive execution would put into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = rows.repartition(parts, key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("raw_seq", F.col("source_modified_at").alias("at"), F.col("mlg_can_view").alias("visible"), "text"))).alias("rows"),
        *[F.first(f"state_{c}").alias(f"state_{c}") for c in ("found", "tomb", "at", "text", "seq")],
    )
    start = F.struct(
        F.coalesce("state_found", F.lit(False)).alias("found"), F.coalesce("state_tomb", F.lit(False)).alias("tomb"), F.col("state_at").alias("at"), F.col("state_text").alias("text"),
        F.col("state_seq").alias("seq"), F.expr("cast(array() as array<struct<raw_seq:bigint,outcome:string,prior_seq:bigint>>)").alias("outs"),
    ).cast(_STATE)

    def step(s: Column, x: Column) -> Column:
        outcome = _decide(s["found"], s["tomb"], s["at"], s["text"], x["at"], x["visible"], x["text"])

        def apply(o: Column) -> Column:  # the array of one is a LET: the outcome is computed once
            write = o.isin(*WRITTEN)
            return F.struct(
                (s["found"] | write).alias("found"),
                F.when(write, o == "delete").otherwise(s["tomb"]).alias("tomb"),
                F.when(write, x["at"]).otherwise(s["at"]).alias("at"),
                F.when(write, F.when(o != "delete", x["text"])).otherwise(s["text"]).alias("text"),
                F.when(write, x["raw_seq"]).otherwise(s["seq"]).alias("seq"),
                F.concat(s["outs"], F.array(F.struct(x["raw_seq"].alias("raw_seq"), o.alias("outcome"), s["seq"].alias("prior_seq")))).alias("outs"),
            )

        return F.transform(F.array(outcome), apply)[0].cast(_STATE)

    return gathered.select(key, F.aggregate("rows", start, step, lambda s: s["outs"]).alias("outs")).select(key, F.inline("outs"))


def _fold_sorted(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """The same over rows sorted by key and arrival: a task holds one state, however long a history is."""
    columns = ["key", "raw_seq", "at", "visible", "text", "found", "tomb", "state_at", "state_text", "state_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            keys, seqs, outcomes, priors = [], [], [], []
            for k, seq, at, visible, text, *seed in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if k != current:
                    current, state = k, seed
                found, tomb, open_at, open_text, open_seq = state
                if open_at is not None and at <= open_at:
                    o = "skip-stale"
                elif not visible:
                    o = "skip-tombstoned" if found and tomb else "delete"
                elif not found:
                    o = "insert"
                else:
                    o = "skip-no-diff" if text == open_text else "update"
                keys.append(k)
                seqs.append(seq)
                outcomes.append(o)
                priors.append(open_seq)
                if o in WRITTEN:
                    state = [True, o == "delete", at, None if o == "delete" else text, seq]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(seqs, pa.int64()), pa.array(outcomes, pa.string()), pa.array(priors, pa.int64())], names=[key, "raw_seq", "outcome", "prior_seq"])

    narrow = rows.select(
        F.col(key).alias("key"), "raw_seq", F.col("source_modified_at").alias("at"), F.col("mlg_can_view").alias("visible"), "text",
        F.coalesce("state_found", F.lit(False)).alias("found"), F.coalesce("state_tomb", F.lit(False)).alias("tomb"), "state_at", "state_text", "state_seq",
    )
    return narrow.repartition("key").sortWithinPartitions("key", "raw_seq").mapInArrow(run, f"{key} {kind}, raw_seq long, outcome string, prior_seq long")


def fold_versions(typed: DataFrame, key: str, columns: list[str], state: DataFrame | None = None, long_history: int = LONG_HISTORY) -> DataFrame:
    """(key, raw_seq, outcome, prior_seq) of every row, applied per key in order of raw_seq.

    A skipped row does not move what later rows are compared with. ``typed`` has raw_seq, source_modified_at,
    mlg_can_view and the data ``columns``; ``state`` (key, found, tomb, at, text, seq) seeds keys with their stored
    entity and open version. Only seq, time, visibility and canonical text are shuffled. They are written first, so that ``typed``
    (in real use the projection of payloads) is evaluated once. Rows without a key are one history, however long, and are folded in order.
    """
    narrow = typed.select(key, "raw_seq", "source_modified_at", "mlg_can_view", data_text(columns).alias("text"))
    return _fold(written_once(narrow, "narrow"), key, state, long_history)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the work folder: what is expensive and read by several branches is evaluated once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fold(rows: DataFrame, key: str, state: DataFrame | None, long_history: int) -> DataFrame:
    """``fold_versions`` of rows (key, raw_seq, source_modified_at, mlg_can_view, text)."""
    kind = rows.schema[key].dataType.simpleString()
    sizes = rows.groupBy(key).count()
    if state is not None:
        rows = rows.join(state.select(key, *[F.col(c).alias(f"state_{c}") for c in ("found", "tomb", "at", "text", "seq")]), key, "left")
    else:
        rows = rows.select("*", F.lit(None).cast("boolean").alias("state_found"), F.lit(None).cast("boolean").alias("state_tomb"), F.lit(None).cast("timestamp").alias("state_at"), F.lit(None).cast("string").alias("state_text"), F.lit(None).cast("long").alias("state_seq"))
    rows = rows.withColumn("source_modified_at", F.col("source_modified_at").cast("timestamp"))
    long = sizes.where((F.col("count") > long_history) | F.col(key).isNull()).select(F.col(key).alias("__long"))
    if long.isEmpty():
        return _fold_native(rows, key)
    of_long = F.col(key).eqNullSafe(F.col("__long"))
    return _fold_native(rows.join(long, of_long, "left_anti"), key).union(_fold_sorted(rows.join(long, of_long, "left_semi"), key, kind))


def fold_monotone(typed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``fold_versions`` where times rise strictly with raw_seq per key (no row can be stale), by window functions.

    Runs of equal rows are one version; of a run of hidden rows the first one counts. Rows with one number go by time, then by what they say.
    """
    w = Window.partitionBy(key).orderBy("raw_seq", "at", "visible", "text")
    rows = typed.select(key, "raw_seq", F.col("source_modified_at").alias("at"), F.col("mlg_can_view").alias("visible"), data_text(columns).alias("text"))
    rows = rows.select("*", F.lag("visible").over(w).alias("was"), F.lag("text").over(w).alias("before"))
    outcome = (
        F.when(~F.col("visible"), F.when(F.col("was").isNotNull() & ~F.col("was"), "skip-tombstoned").otherwise("delete"))
        .when(F.col("was").isNull(), "insert")
        .when(F.col("was") & (F.col("before") == F.col("text")), "skip-no-diff")
        .otherwise("update")
    )
    rows = rows.withColumn("outcome", outcome)
    prior = F.last(F.when(F.col("outcome").isin(*WRITTEN), F.col("raw_seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, "raw_seq", "outcome", prior.alias("prior_seq"))


def pass_stats(outcomes: DataFrame) -> DataFrame:
    """One row: processed, and the count of each outcome."""
    return outcomes.agg(F.count("*").alias("processed"), *[F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o.replace("-", "_")) for o in OUTCOMES])


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def advance_cursor(outcomes: DataFrame, resource: str) -> DataFrame:
    return outcomes.agg(F.max("raw_seq").alias("last_raw_seq")).select(F.lit(resource).alias("resource"), "last_raw_seq").where("last_raw_seq is not null")


def _as_text(c: Column, kind: str) -> Column:
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def diff_fields(old: dict[str, Column], new: dict[str, Column], types: dict[str, str]) -> Column:
    """``{column: {old, new}}`` of the columns that differ; a NULL and an empty array or map are the same."""
    entries = []
    for name in new:
        o, n = (_as_text(c, types[name]) for c in (old[name], new[name]))
        if types[name].startswith(("array", "map")):
            o, n = F.nullif(F.nullif(o, F.lit("[]")), F.lit("{}")), F.nullif(F.nullif(n, F.lit("[]")), F.lit("{}"))
        entries.append(F.struct(F.lit(name).alias("key"), F.struct(o.alias("old"), n.alias("new")).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: ~x["value"]["old"].eqNullSafe(x["value"]["new"])))


def build_versions(typed: DataFrame, outcomes: DataFrame, key: str, columns: list[str], open_versions: DataFrame | None = None) -> DataFrame:
    """The version rows of a batch: version_id, key, raw_seq, valid_from, valid_to, change_type, changed_fields, data.

    A delete's data is sparse: only key, time and visibility. ``changed_fields`` is there for updates only.
    ``valid_from`` is the row's own time, ``valid_to`` that of the next version. ``open_versions`` (raw_seq and data)
    is what an update of stored entities is compared with.
    """
    types = {f.name: f.dataType.simpleString() for f in typed.schema.fields}
    full = [c for c in ("mlg_can_view", *columns) if c in types]
    written = outcomes.where(F.col("outcome").isin(*WRITTEN))
    joined = written.join(typed.select("raw_seq", "source_modified_at", *full), "raw_seq")
    w = Window.partitionBy(key).orderBy("raw_seq")
    # what a version is compared with is the version before it: of this batch, or for a key's first one the stored open version
    before = F.lag(F.struct(*full)).over(w)
    if open_versions is not None:
        stored = open_versions.select(F.col("raw_seq").alias("prior_seq"), F.struct(*[F.col(c).cast(types[c]).alias(c) for c in full]).alias("__stored"))
        joined, before = joined.join(stored, "prior_seq", "left"), F.coalesce(before, F.col("__stored"))
    joined = joined.withColumn("__old", before).withColumn("__until", F.lead("source_modified_at").over(w))
    old = {c: F.col(f"__old.{c}") if c == "mlg_can_view" else F.when(F.col("__old.mlg_can_view"), F.col(f"__old.{c}")) for c in full}
    changed = F.when(F.col("outcome") == "update", diff_fields(old, {c: F.col(c) for c in full}, types))
    sparse = [F.when(F.col("outcome") != "delete", F.col(c)).alias(c) for c in columns]
    return joined.select(
        F.sha2(F.concat_ws("/", F.col(key).cast("string"), F.col("raw_seq").cast("string")), 256).alias("version_id"), key, "raw_seq", F.col("source_modified_at").alias("valid_from"),
        F.col("__until").alias("valid_to"), F.col("outcome").alias("change_type"), changed.alias("changed_fields"), "mlg_can_view", *sparse,
    )


def version_batch(typed: DataFrame, key: str, columns: list[str], state: DataFrame | None = None, open_versions: DataFrame | None = None, long_history: int = LONG_HISTORY) -> tuple[DataFrame, DataFrame]:
    """(outcomes, version rows) of a batch. Its typed rows are written once and read from there, by column: payloads are parsed once."""
    rows = written_once(typed.withColumn("__text", data_text(columns)), "typed")
    narrow = rows.select(key, "raw_seq", "source_modified_at", "mlg_can_view", F.col("__text").alias("text"))
    outcomes = written_once(_fold(narrow, key, state, long_history), "outcomes")
    return outcomes, build_versions(rows.drop("__text"), outcomes, key, columns, open_versions)


def close_prior(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored versions with the open one of each key closed at the time of the key's first new version."""
    first = fresh.groupBy(key).agg(F.min_by("valid_from", "raw_seq").alias("__closed"))
    return stored.join(first, key, "left").withColumn("valid_to", F.coalesce("valid_to", "__closed")).drop("__closed")


def append_versions(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return close_prior(stored, fresh, key).unionByName(fresh, allowMissingColumns=True)


def fold_state(entity: DataFrame, versions: DataFrame, key: str, columns: list[str], batch: DataFrame) -> DataFrame:
    """The seed of ``fold_versions`` for the keys of a batch, from stored entities and open versions."""
    keys = batch.select(key).distinct()
    open_ = versions.where("valid_to is null").join(keys, key, "left_semi")
    text = F.when(F.col("change_type") != "delete", data_text(columns))
    stored = entity.join(keys, key, "left_semi").select(key, (~F.col("mlg_can_view")).alias("tomb"))
    return stored.join(open_.select(key, F.col("valid_from").alias("at"), text.alias("text"), F.col("raw_seq").alias("seq")), key, "left").select(key, F.lit(True).alias("found"), "tomb", "at", "text", "seq")


def fold_step(batch: DataFrame, state: DataFrame | None, key: str, columns: list[str]) -> dict[str, DataFrame]:
    """One micro-batch: the outcomes of its rows, and the state after it of the keys that it has written."""
    outcomes = written_once(fold_versions(batch, key, columns, state), "outcomes")
    data = batch.select("raw_seq", F.col("source_modified_at").cast("timestamp").alias("at"), data_text(columns).alias("text"))
    last = outcomes.where(F.col("outcome").isin(*WRITTEN)).join(data, "raw_seq").groupBy(key).agg(F.max_by(F.struct("outcome", "at", "text"), "raw_seq").alias("s"), F.max("raw_seq").alias("seq"))
    gone = F.col("s.outcome") == "delete"
    fresh = last.select(key, F.lit(True).alias("found"), gone.alias("tomb"), F.col("s.at").alias("at"), F.when(~gone, F.col("s.text")).alias("text"), "seq")
    return {"outcomes": outcomes, "state": fresh}


def as_of(versions: DataFrame, at) -> DataFrame:
    """The version of each key that was valid at a time."""
    t = at if isinstance(at, Column) else F.lit(at)
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def as_of_each(versions: DataFrame, probes: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``probes`` with ``columns`` of the version that was valid at each one's own time ``at``; NULL where there was none.

    Probes and versions are sorted together by key and time, and the last version is carried forward. They are dealt out by ranges of (key, time), so that one very long
    history is many tasks; of each range and key only the last version goes on to the ranges after it. No pair of probe and version is made but the one that counts.
    """
    kind = dict(versions.select(F.col(key).alias("k"), F.col("valid_from").cast("timestamp").alias("t")).dtypes)
    mine = [F.col(c) for c in probes.columns]
    rows = versions.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col("valid_from").cast("timestamp").alias("__t"), F.lit(0).alias("__probe"), F.struct("raw_seq", *columns).alias("__version"))
    asked = probes.select(F.col(key).cast(kind["k"]).alias("__key"), F.col(at).cast("timestamp").alias("__t"), F.lit(1).alias("__probe"), F.struct(*mine).alias("__row"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    order = ["__t", "__probe", F.col("__version.raw_seq")]
    cut = written_once(both.repartitionByRange("__key", "__t", "__probe").withColumn("__range", F.spark_partition_id()), "probes")
    here = cut.withColumn("__here", F.last("__version", ignorenulls=True).over(Window.partitionBy("__range", "__key").orderBy(*order)))
    ends = cut.where("__probe = 0").groupBy("__key", "__range").agg(F.max_by("__version", F.struct("__t", "__version.raw_seq")).alias("__last"))
    spans = cut.select("__key", "__range").distinct().join(ends, ["__key", "__range"], "left")
    carried = spans.withColumn("__carried", F.last("__last", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("__carried is not null").select(F.col("__key").alias("__k"), F.col("__range").alias("__r"), "__carried")
    found = here.where("__probe = 1").join(carried, (F.col("__key") == F.col("__k")) & (F.col("__range") == F.col("__r")), "left")
    there = F.col("__t").isNotNull() & F.col("__key").isNotNull()
    version = F.when(there, F.coalesce("__here", "__carried")).alias("__v")
    return found.select("__row.*", version).select(*mine, *[F.col(f"__v.{c}").alias(c) for c in ("raw_seq", *columns)])


def history(versions: DataFrame, key: str, value) -> DataFrame:
    return versions.where(F.col(key) == value).orderBy("valid_from", "raw_seq")


def expand_changes(versions: DataFrame, key: str) -> DataFrame:
    """One row per changed field."""
    return versions.select(key, "raw_seq", F.explode("changed_fields").alias("field", "change")).select(key, "raw_seq", "field", F.col("change.old").alias("old"), F.col("change.new").alias("new"))


def version_invariants(versions: DataFrame, entity: DataFrame, key: str) -> DataFrame:
    """Keys that break a rule: more than one open version, or an entity that does not point at the open one."""
    open_ = versions.where("valid_to is null").groupBy(key).agg(F.count("*").alias("open"), F.max("version_id").alias("open_id"))
    joined = entity.select(key, "current_version_id").join(open_, key, "full")
    problem = F.when(F.col("open") > 1, "several open versions").when(~F.col("current_version_id").eqNullSafe(F.col("open_id")), "entity does not point at the open version")
    return joined.select(key, problem.alias("problem")).where("problem is not null")
