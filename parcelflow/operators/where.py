"""Composable row filters: a nested dict becomes one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffix of a field name -> predicate. NULL never matches but for IsNil.
_OPS = {
    "NEQ": lambda c, v: c != v,
    "NotIn": lambda c, v: ~c.isin(*v),
    "In": lambda c, v: c.isin(*v),
    "GTE": lambda c, v: c >= v,
    "GT": lambda c, v: c > v,
    "LTE": lambda c, v: c <= v,
    "LT": lambda c, v: c < v,
    "IsNil": lambda c, v: c.isNull() if v else c.isNotNull(),
    "NotNil": lambda c, v: c.isNotNull() if v else c.isNull(),
    "ContainsFold": lambda c, v: F.lower(c).contains(v.lower()),
    "Contains": lambda c, v: c.contains(v),
    "HasPrefix": lambda c, v: c.startswith(v),
    "HasSuffix": lambda c, v: c.endswith(v),
    "EqualFold": lambda c, v: F.lower(c) == v.lower(),
    "HasAll": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
    "HasAny": lambda c, v: F.arrays_overlap(F.array(*map(F.lit, v)), c),
}


def _fields(df: DataFrame) -> dict[str, str]:
    """Both spellings of a column, snake_case and camelCase, -> the column."""
    camel = lambda n: n.split("_")[0] + "".join(p.capitalize() for p in n.split("_")[1:])
    return {n: n for n in df.columns} | {camel(n): n for n in df.columns}


#: Edge name -> (table, its column, own column[, edges of that table]).
Edges = dict[str, tuple]


def predicate(df: DataFrame, where: dict | None, edges: Edges | None = None) -> Column:
    """``{field: value, fieldOP: value, and: [...], or: [...], not: {...}, hasEdge: bool, hasEdgeWith: {...}}`` as a Column.

    An edge is an EXISTS subquery, which Catalyst makes a semi, anti or existence join, wherever it stands; filters with
    edges go through ``where``.
    """
    fields = _fields(df)
    names = {f"has{e[0].upper()}{e[1:]}{w}": (e, w) for e in edges or {} for w in ("", "With")}

    def related(name: str, value) -> Column:
        edge, with_ = names[name]
        table, theirs, own, *inner = edges[edge]
        if with_:
            table = where_(table, value, *inner)
        found = table.select(F.col(theirs).alias("__edge")).where(F.col("__edge") == F.col(_outer(own)).outer()).exists()
        return found if with_ or value else ~found

    def one(name: str, value) -> Column:
        if name == "and":
            return reduce(Column.__and__, (build(w) for w in value), F.lit(True))
        if name == "or":
            return reduce(Column.__or__, (build(w) for w in value)) if value else F.lit(True)
        if name == "not":
            return ~build(value)
        if name in names:
            return related(name, value)
        if name in fields:
            return F.col(fields[name]) == value
        for op, f in _OPS.items():
            if name.endswith(op) and name.removesuffix(op) in fields:
                return f(F.col(fields[name.removesuffix(op)]), value)
        raise ValueError(f"no such field or operator: {name}")

    def build(w: dict) -> Column:
        return reduce(Column.__and__, (one(k, v) for k, v in w.items()), F.lit(True))

    return build(where or {})


def _outer(own: str) -> str:
    """The name that a column goes by in subqueries, where the other table may have a column of the same name."""
    return f"__own_{own}"


def where_(df: DataFrame, spec: dict | None, edges: Edges | None = None) -> DataFrame:
    own = {_outer(e[2]): F.col(e[2]) for e in (edges or {}).values()}
    return df.withColumns(own).where(predicate(df, spec, edges)).drop(*own)


def visible(df: DataFrame) -> DataFrame:
    return df.where("mlg_can_view")


def where(df: DataFrame, spec: dict | None, edges: Edges | None = None) -> DataFrame:
    """Rows that match; ``edges`` name other tables: {edge: (table, its column, own column)}, a fourth item those tables' edges.

    ``hasEdge: true`` keeps rows with a related one, false those without; ``hasEdgeWith: {...}`` those with a related row
    that matches. Edges may stand anywhere: under and, or, not, and in the filter of another edge.
    """
    return where_(df, spec, edges)
