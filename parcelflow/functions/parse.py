"""Strictly typed values from JSON payloads, as SQL over a struct of VARIANTs.

Absent and null give NULL. A value of the wrong JSON type or form gives an error, which makes the record poison: casts
alone would not do, since they read numbers from strings and timestamps from bare dates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.plans.registry import Col

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WHOLE = {"int16": "smallint", "int32": "int", "int64": "bigint"}


def record(payload: Column, keys: list[str]) -> Column:
    """The fields of a payload as a struct of VARIANTs, in one pass: f0, f1, ... in the order of ``keys``; ``bad`` is the text if
    it is no JSON. Absent fields are NULL."""
    # fields are found by their payload names, so the schema has these; the names differ in more than case
    fields = ", ".join(f"`{k}` variant" for k in keys)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}
    return F.from_json(payload, f"{fields}, `_bad` string", strict)


def plain(payload: Column, columns: list[Col]) -> Column:
    """The texts of fields, and the lists of strings, as a struct by payload names, whatever their JSON types; a number is the text that it is.

    Beside ``record``, which tells the types: a VARIANT is cast through an expression made for each value, which costs more than reading the payload again.
    """
    fields = ", ".join(f"`{c.payload}` {'array<string>' if c.kind == 'strings' else 'string'}" for c in columns if c.kind != "bool")
    return F.from_json(payload, fields, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})


def no_object(payload: Column, fields: Column) -> Column:
    """Whether a payload is no JSON object."""
    return payload.isNull() | fields.isNull() | fields["_bad"].isNotNull() | ~F.ltrim(payload).startswith("{")


def read(col: Col, fields: str = "f", texts: str = "g") -> dict[str, str]:
    """SQL of what a typed column is made of, by the name to give it: the JSON type of its field (``__k_``), and its text or elements (``__t_``).

    The columns of ``read``, ``value`` and ``error`` are three projections, so that each is made once; in one, the types and
    texts are made anew wherever they are named, in methods too long to be compiled. As text, since there are some hundred of
    these in a projection and each Column operator is a call to the JVM.
    """
    field = f"{fields}.`{col.payload}`"
    kind, text = f"schema_of_variant({field})", f"{texts}.`{col.payload}`"
    if col.kind == "bool":
        text = f"try_variant_get({field}, '$', 'boolean')"
    elif col.kind.startswith("decimal"):  # exponents are evaluated
        text = f"case when {kind} in ('DOUBLE', 'FLOAT') then try_variant_get({field}, '$', 'string') else {text} end"
    return {f"__k_{col.column}": kind, f"__t_{col.column}": text}


def value(col: Col) -> str:
    """SQL of a typed column's value, from what ``read`` has made."""
    kind, text = f"`__k_{col.column}`", f"`__t_{col.column}`"
    if col.kind == "string":
        return f"nullif({text}, '')"
    if col.kind in ("timestamp", "date"):
        form, how = (RFC3339, "") if col.kind == "timestamp" else (DATE, ", 'yyyy-MM-dd'")
        return f"case when {text} rlike r'{form}' then try_to_timestamp({text}{how}) end"
    if col.kind.startswith("decimal"):
        return f"case when {text} rlike r'{NUMBER}' then try_cast({text} as {col.kind}) end"
    if col.kind == "bool":
        return text
    if col.kind in _WHOLE:
        return f"case when {kind} = 'BIGINT' then try_cast({text} as {_WHOLE[col.kind]}) end"
    # a null element of a list of strings is an empty string
    return f"case when size({text}) > 0 then transform({text}, x -> coalesce(x, '')) end"


def error(col: Col) -> str:
    """SQL of a typed column's error, from its value and what ``read`` has made; NULL where the field is absent or null."""
    kind, text, out = f"`__k_{col.column}`", f"`__t_{col.column}`", f"`{col.column}`"
    if col.kind == "string":
        good = f"{kind} = 'STRING'"
    elif col.kind in ("timestamp", "date"):
        good = f"{kind} = 'STRING' and ({text} = '' or {out} is not null)"
    elif col.kind.startswith("decimal"):
        good = f"({kind} in ('STRING', 'BIGINT', 'DOUBLE', 'FLOAT') or startswith({kind}, 'DECIMAL')) and {out} is not null"
    elif col.kind == "bool":
        good = f"{kind} = 'BOOLEAN'"
    elif col.kind in _WHOLE:
        good = f"{out} is not null"
    else:
        good = f"{kind} in ('ARRAY<STRING>', 'ARRAY<VOID>')"  # of strings and nulls, or empty
    wrong = f"case when {kind} <> 'VOID' and not ({good}) then '{col.payload}: not a {col.kind}' end"
    return f"coalesce({wrong}, case when {out} is null then '{col.payload}: required' end)" if col.required else wrong


def required_timestamp(payload: str, fields: str = "f", key: str = "ModificationTimestamp") -> str:
    """SQL of (value, error) of a timestamp with three distinct errors: absent, null or empty, malformed."""
    value = f"{fields}.`{key}`"
    kind, text = f"schema_of_variant({value})", f"try_variant_get({value}, '$', 'string')"
    out = f"case when {kind} = 'STRING' and {text} rlike r'{RFC3339}' then try_to_timestamp({text}) end"
    error = f"""case when {out} is not null then null when not coalesce(array_contains(json_object_keys({payload}), '{key}'), false) then '{key}: absent'
      when {value} is null or {kind} = 'VOID' or {kind} = 'STRING' and {text} = '' then '{key}: empty' else '{key}: malformed' end"""
    return f"case when {payload} is not null then named_struct('value', {out}, 'error', {error}) end"


#: What every record has besides its typed columns.
METADATA = (Col("OriginatingSystemName", "string"), Col("MlgCanView", "bool"), Col("MlgCanUse", "strings"))


def extended(text: Column, known: list[str]) -> Column:
    """The payload's other keys, in order, as a map of JSON texts; NULL if there are none.

    The texts keep JSON's types ("5" is not 5) and do not depend on the order of keys in nested objects.
    """
    left = F.map_entries(F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: ~k.isin(known)))
    pairs = F.array_sort(F.transform(left, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"))))
    # the array of one is a LET: the payload is read once
    return F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, F.map_from_entries(p)))[0]


def extended_names(text: Column, known: list[str]) -> Column:
    """The names of the fields of ``extended``; NULL if there are none."""
    names = F.array_distinct(F.filter(F.map_keys(F.from_json(text, "map<string,variant>")), lambda k: ~k.isin(known)))
    return F.transform(F.array(names), lambda n: F.when(F.size(n) > 0, n))[0]
