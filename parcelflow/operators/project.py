"""Raw ledger rows -> typed rows, with poison rows told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import parse
from parcelflow.plans.registry import MEDIA_OWNERS, RESOURCES, Col


def project(raw: DataFrame, resource: str) -> DataFrame:
    """Rows of ``raw`` (raw_seq, source_modified_at, payload) as typed columns plus ``error``, NULL where all is well.

    The payload is parsed by one projection, its fields are typed one by one, and the first error in the order of columns makes the record
    poison as a whole; its wrong columns are NULL. Media, rooms and unit types take their time from the raw row, others
    from the payload.
    """
    out = typed_rows(raw, resource)
    # as a generated column the error is a value that filters use: they would else copy the making of all columns below it
    return out.select(*out.columns[:-1], F.explode(F.array("error")).alias("error"))


def typed_rows(raw: DataFrame, resource: str, names_only: bool = False) -> DataFrame:
    """``project`` whose error is made wherever it is named. With ``names_only`` leftover fields are an array of their names, without texts made of their values."""
    r = RESOURCES[resource]
    key = Col(r.key, "string", required=True)
    columns = [key, *parse.METADATA, *r.columns]
    names = [*[c.payload for c in columns], "ModificationTimestamp"]
    rows = raw.select("raw_seq", F.col("source_modified_at").alias("raw_modified_at"), "payload", parse.record(F.col("payload"), names).alias("f"), parse.plain(F.col("payload"), columns).alias("g"))
    # fields, their types and texts, values, errors: each is made once, in projections that the optimizer does not fold into one
    read = {n: sql for c in columns for n, sql in parse.read(c).items()}
    values, errors = {c.column: parse.value(c) for c in columns}, {c.column: parse.error(c) for c in columns}
    if r.own_timestamp:
        read["__own"] = parse.required_timestamp("payload")
        values["source_modified_at"], errors["source_modified_at"] = "__own.value", "__own.error"
    else:
        values["source_modified_at"], errors["source_modified_at"] = "raw_modified_at", "case when source_modified_at is null then 'source_modified_at: absent' end"
    values["mlg_can_view"] = f"coalesce({values['mlg_can_view']}, true)"
    if "resource_type" in values:
        values["resource_type"] = f"lower({values['resource_type']})"
        errors["resource_type"] = f"coalesce({errors['resource_type']}, case when resource_type not in {MEDIA_OWNERS} then 'ResourceName: not a known owner' end)"
    known = [*names, *(["Media", "Rooms", "UnitTypes"] if resource == "property" else [])]
    extended = parse.extended_names if names_only else parse.extended
    left = [extended(F.col("payload"), known).alias("extended_fields")] if r.extended else []
    cut = rows.select("*", parse.no_object(F.col("payload"), F.col("f")).alias("no_object"), *left)
    kept = ["raw_seq", "no_object", *["extended_fields"] * r.extended]
    cut = cut.selectExpr(*kept, "raw_modified_at", *[f"{sql} as `{n}`" for n, sql in read.items()])
    order = [r.key_column, "source_modified_at", *[c.column for c in parse.METADATA], *[c.column for c in r.columns]]
    made = cut.selectExpr(*kept, *read, *[f"{values[n]} as `{n}`" for n in order])
    error = f"coalesce(case when no_object then 'payload: not a JSON object' end, {', '.join(errors[n] for n in order)})"
    return made.selectExpr("raw_seq", *[f"`{n}`" for n in order], *["extended_fields"] * r.extended, f"{error} as error")


def poison_split(projected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, (raw_seq, error) of the poison)."""
    return projected.where("error is null").drop("error"), projected.where("error is not null").select("raw_seq", "error")


def poison_cutoff(projected: DataFrame, quarantine: bool = False) -> DataFrame:
    """Good rows strictly before the first poison row, which the next run meets again; all good rows if ``quarantine``."""
    if quarantine:
        return projected.where("error is null").drop("error")
    good = projected.where("error is null").drop("error")
    first = projected.where("error is not null").agg(F.min("raw_seq")).first()[0]  # a number, so that the filter goes below the typing of the rows
    return good if first is None else good.where(F.col("raw_seq") < first)


def project_resource(raw: DataFrame, resource: str) -> DataFrame:
    """``project`` of one resource's rows of the ledger."""
    return project(raw.where(F.col("resource") == resource), resource)
