"""Exact deduplication by progressive refinement: length, then a hash of the first characters, then a full hash.

Texts are equal when they are identical after each ``[\\x20\\x09-\\x0D]+`` becomes one space. Only rows that share
their normalised length with another row have their prefix hashes compared, only rows that share length and prefix hash are
fully hashed (SHA-256, which stands for the content). Null counts as the empty text. All grouping is by aggregation
with map-side combine over narrow rows, so a third of all rows in one group meets in no task. Texts are exchanged at
most once, and only those of rows that may have to go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Marks, columns, dealt, written

PREFIX = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _first(column: Column) -> Column:
    """Orders ids with nulls last."""
    return F.struct(column.isNull().alias("none"), column.alias("id"))


def _heads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, size, prefix, text) of all rows, lazily; row_key is a hash of the text as it is, text is normalised."""
    one = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_key"), normalised(F.col(text_col)).alias("text"))
    return one.select("id", "row_key", F.length("text").alias("size"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix"), "text")


def _repeated(heads: DataFrame) -> DataFrame:
    """(size, prefix) that more than one of the written rows have; prefixes are compared where sizes repeat."""
    often = written(heads.groupBy("size").count().where("count > 1").select(F.xxhash64("size")), "sizes")
    pairs = Marks(often).split(heads, F.xxhash64("size"))[0].groupBy("size", "prefix").count().where("count > 1")
    return written(pairs.select("size", "prefix"), "prefixes")


def _survivors(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``rows`` that have one of ``pairs``, and perhaps a few more, whose full hash will tell."""
    key = F.xxhash64("size", "prefix")
    return Marks(written(pairs.select(key), "pairs")).split(rows, key)[0]


def _groups(full: DataFrame) -> DataFrame:
    """Rows (id, full) -> (full, keep, n, same) of the texts that more than one row has.

    ``keep`` is the smallest id (null only if all are), ``n`` the group's rows, ``same`` how many of them have that id.
    """
    by_id = full.groupBy("full", "id").agg(F.count("*").alias("rows"))
    groups = by_id.groupBy("full").agg(F.sum("rows").alias("n"), F.min(F.struct(_first(F.col("id")).alias("first"), "rows")).alias("m"))
    return written(groups.where("n > 1").select("full", F.col("m.first.id").alias("keep"), "n", F.col("m.rows").alias("same")), "groups")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of rows that repeat both text and smallest id, exactly one is kept. Null ids come last; null texts are equal to
    empty ones. Other columns are ignored; an empty table gives an empty one. As every row's hash is asked for here, the texts
    are read once for length, prefix and full hash together, and the refinement goes over these.
    """
    hashed = written(_heads(docs, id_col, text_col).select("id", "size", "prefix", F.sha2("text", 256).alias("full")), "hashed")
    groups = _groups(_survivors(hashed, _repeated(hashed)).select("id", "full"))
    # rows that are the same in all respects are counted here and dealt out again below, the first of them as kept
    rows = hashed.groupBy("id", "full").agg(F.count("*").alias("rows"))
    joined = rows.join(groups.select("full", "keep", "n"), "full", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        "rows",
        F.col("full").alias("text_sha256"),
    )
    return dealt(joined, "rows").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (the one with the smallest id, null last); same columns.

    Of rows that repeat that id too, one stays. Null and empty texts are equal; an empty table stays empty.
    A bit map of the repeated pairs of length and prefix hash tells which texts have to be hashed in full; another one, of
    the rows that go, tells which rows have to meet the list of these.
    """
    heads = _heads(docs, id_col, text_col)
    pairs = _repeated(written(heads.select("size", "prefix"), "heads"))
    hashed = written(_survivors(heads, pairs).select("id", "row_key", F.sha2("text", 256).alias("full")), "hashed")
    groups = _groups(hashed)
    judged = hashed.distinct().join(groups.select("full", "keep", "same"), "full")
    stays = F.col("id").eqNullSafe(F.col("keep"))
    gone = written(judged.where(~stays | (F.col("same") > 1)).select(F.col("id").alias("gone_id"), "row_key", "full", stays.alias("one")), "gone")
    maybe, kept = Marks(written(gone.select("row_key"), "gone_keys")).split(docs, F.xxhash64(text_col))
    text = maybe[text_col]
    same_row = maybe[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text) == gone["row_key"]) & (F.sha2(normalised(text), 256) == gone["full"])
    kept = kept.union(maybe.join(gone.hint("merge"), same_row, "left_anti"))
    repeated = gone.where("one").select("gone_id", "row_key", "full")
    if repeated.isEmpty():
        return kept
    found = maybe.join(repeated, maybe[id_col].eqNullSafe(repeated["gone_id"]) & (F.xxhash64(text) == repeated["row_key"]) & (F.sha2(normalised(text), 256) == repeated["full"]))
    order = F.xxhash64(*[maybe[f"`{c}`"] for c, kind in maybe.dtypes if "map<" not in kind and "variant" not in kind])
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate([maybe[f"`{c}`"] for c in maybe.columns])])
    one = found.groupBy(repeated["gone_id"], repeated["full"]).agg(F.min_by(row, order).alias("row"))
    return kept.union(one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
