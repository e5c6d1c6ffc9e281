"""Audits: what the mapping misses, how entities and versions drift apart, which fields are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .project import project, typed_rows
from .versions import written_once


def unconsumed_keys(extended: DataFrame, column: str = "extended_fields") -> DataFrame:
    """(key, n): payload keys without a typed column, most frequent first."""
    return extended.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def _unpivot(df: DataFrame, columns: list[str], measure) -> DataFrame:
    """One pass over ``df``: (column, value) with an aggregate of each column."""
    one = df.agg(*[measure(F.col(c)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))


def always_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are NULL in every row, by name."""
    found = _unpivot(df, columns, lambda c: F.coalesce(F.max(c.isNotNull()), F.lit(False)))
    return found.where("not value").select("column").orderBy("column")


def fill_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, total)."""
    found = _unpivot(df, columns, lambda c: F.struct(F.count(c).alias("filled"), F.count("*").alias("total")))
    return found.select("column", "value.filled", "value.total")


def date_shaped(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, n): payload keys whose values look like bare dates."""
    pairs = payloads.select(F.explode(F.from_json(payload, "map<string,string>")).alias("key", "value"))
    return pairs.where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$")).groupBy("key").agg(F.count("*").alias("n"))


def validate_raw(raw: DataFrame, resource: str) -> dict[str, DataFrame]:
    """totals, errors, unconsumed keys and always-NULL columns of one resource's raw rows."""
    typed = project(raw, resource)
    good = typed.where("error is null")
    data = [c for c in typed.columns if c not in ("raw_seq", "error", "extended_fields", "mlg_can_view", "source_modified_at")]
    out = {
        "totals": typed.agg(F.count("*").alias("rows"), F.count("error").alias("errors")),
        "errors": typed.where("error is not null").select("raw_seq", "error"),
        "always_null": always_null(good, data),
    }
    if "extended_fields" in typed.columns:
        out["unconsumed"] = unconsumed_keys(good)
    return out


def audit_once(raw: DataFrame, resource: str) -> dict[str, DataFrame]:
    """``validate_raw``, and the fill of every typed column, from one evaluation of the payloads.

    Counts are observed while the rows go by; of the rows only what is reported on is written: errors, and the names of leftover keys.
    """
    spark = raw.sparkSession
    typed = typed_rows(raw, resource, names_only=True)
    good = F.col("error").isNull()
    data = [c for c in typed.columns if c not in ("raw_seq", "error", "extended_fields", "mlg_can_view", "source_modified_at")]
    seen = Observation(f"audit of {resource}")
    metrics = [F.count("*").alias("rows"), F.count("error").alias("errors"), *[F.count(F.when(good, F.col(c))).alias(f"filled {c}") for c in data]]
    left = F.col("extended_fields") if "extended_fields" in typed.columns else F.lit(None).cast("array<string>")
    rows = typed.observe(seen, *metrics).select("raw_seq", "error", F.when(good, left).alias("left")).where(~good | F.col("left").isNotNull())
    rows = written_once(rows, "audit")
    found = seen.get
    n = found["rows"] - found["errors"]
    fill = spark.createDataFrame([(c, found[f"filled {c}"], n) for c in data], "column string, filled long, total long")
    return {
        "totals": spark.createDataFrame([(found["rows"], found["errors"])], "rows long, errors long"),
        "errors": rows.where("error is not null").select("raw_seq", "error"),
        "fill_rate": fill,
        "always_null": fill.where("filled = 0").select("column").orderBy("column"),
        "unconsumed": rows.select(F.explode("left").alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key"),
    }


def shared_fields(entity: DataFrame, versions: DataFrame, key: str) -> list[str]:
    """The data columns that an entity table has in common with its version table."""
    skip = {key, "source_modified_at", "mlg_can_view", "current_version_id", "created_at", "modified_at"}
    return [c for c in entity.columns if c in versions.columns and c not in skip]


def validate_typed(entity: DataFrame, versions: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, field, entity_value, version_value): visible entities that differ from their open version.

    By default all the columns are compared that both tables have.

    An entity without an open version is one row with the field ``(no open version)``. NULL and empty are the same;
    arrays compare in order.
    """
    columns = columns or shared_fields(entity, versions, key)
    shown = entity.where("mlg_can_view").select(key, *columns)
    types = {f.name: f.dataType.simpleString() for f in shown.schema.fields}
    open_ = versions.where("valid_to is null").select(F.col(key).alias("__v"), *[F.col(c).alias(f"v_{c}") for c in columns])
    joined = shown.join(open_, F.col(key) == F.col("__v"), "left")

    def text(c: str, name: str) -> Column:
        column = F.col(name)
        if types[c].startswith(("array", "map")):
            return F.when(F.size(column) > 0, F.to_json(column))
        return column.cast("string")

    missing = F.when(F.col("__v").isNull(), F.array(F.struct(F.lit("(no open version)").alias("field"), F.lit(None).cast("string").alias("entity_value"), F.lit(None).cast("string").alias("version_value"))))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), text(c, c).alias("entity_value"), text(c, f"v_{c}").alias("version_value")) for c in columns])
    found = F.filter(pairs, lambda x: ~x["entity_value"].eqNullSafe(x["version_value"]))
    return joined.select(key, F.explode(F.coalesce(missing, found)).alias("d")).select(key, "d.*")


def set_sample_rate(rate: float, current: float = 1.0) -> float:
    """Negative rates are ignored, rates over 1 are 1; 0 turns sampling off."""
    return current if rate < 0 else min(rate, 1.0)


def describe_value(text: Column) -> Column:
    """The shape of a JSON text without its content; what is no JSON counts as a string. Lengths are bytes of UTF-8."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    size = lambda t: F.size(F.try_variant_get(v, "$", t))
    return (
        F.when(v.isNull(), F.concat(F.lit("string, len "), F.octet_length(text).cast("string")))
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", F.concat(F.lit("string, len "), F.octet_length(F.try_variant_get(v, "$", "string")).cast("string")))
        .when(kind.startswith("ARRAY"), F.concat(F.lit("array, "), size("array<variant>").cast("string"), F.lit(" items")))
        .when(kind.startswith("OBJECT"), F.concat(F.lit("object, "), size("map<string,variant>").cast("string"), F.lit(" keys")))
        .otherwise("number")
    )


def cut_bytes(text: Column, most: int) -> Column:
    """A text of at most ``most`` bytes of UTF-8 as it is; a longer one is cut there and marked. A character cut in half is a replacement mark."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("…(truncated)"))).otherwise(text)


#: Payload keys known to have no typed column. A property has some hundreds, which the caller brings.
KNOWN = {
    "lookup": [],
    "media": [],
    "office": ["@odata.id", "FranchiseAffiliation", "IDXOfficeParticipationYN", "OriginalEntryTimestamp", "OfficeEmail"],
    "member": ["@odata.id", "FHR_MainOfficeMlsId", "FHR_OfficeType", "FHR_Status", "MemberType", "OfficeName", "OriginalEntryTimestamp", "MemberEmail", "MemberNationalAssociationId", "MemberOfficePhone", "FHR_MemberDirectPhoneExt"],
    "open_house": ["@odata.id", "FHR_OH_StartTime", "OpenHouseRemarks"],
    "property_rooms": ["RoomDimensions", "RoomDescription"],
    "property_unit_types": ["UnitTypeType", "UnitTypeBathsTotal", "FHR_Vacant", "UnitTypeActualRent", "UnitTypeDescription", "FHR_LeaseExpires", "FHR_SecurityDeposit"],
}


def resource_drift(projected: DataFrame, resource: str, known: tuple[str, ...] = (), rate: float = 1.0) -> DataFrame:
    """``field_drift`` of a resource against its own allowlist: that of ``KNOWN``, and ``known``. Without either all leftover fields are novel."""
    return field_drift(projected, [*KNOWN.get(resource, []), *known], rate)


def field_drift(projected: DataFrame, allowed: list[str], rate: float = 1.0, most_bytes: int = 200) -> DataFrame:
    """(field, n, first_seq, sample, shape): extended fields that are not on the allowlist, on a sample of rows.

    The sample value is that of the first row that has the field, cut to ``most_bytes``. Rows are sampled by a hash.
    """
    rate = set_sample_rate(rate)
    # hashes are compared as they are: a rate is right to one part in 2^53, however small
    rows = projected if rate == 1 else projected.where(F.xxhash64("raw_seq") < F.lit(-(1 << 63) + int(rate * (1 << 64))))
    pairs = rows.select("raw_seq", F.explode("extended_fields").alias("field", "value"))
    novel = pairs.where(~F.col("field").isin(*allowed)) if allowed else pairs
    first = novel.groupBy("field").agg(F.count("*").alias("n"), F.min("raw_seq").alias("first_seq"), F.min_by("value", "raw_seq").alias("value"))
    return first.select("field", "n", "first_seq", cut_bytes(F.col("value"), most_bytes).alias("sample"), describe_value(F.col("value")).alias("shape"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """One row: the novel fields of a resource in order."""
    return drift.agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))
