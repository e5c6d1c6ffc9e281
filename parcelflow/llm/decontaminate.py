"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short test items hide in long documents, so what counts is containment: the share of an item's word shingles that the
document has. Items are partitioned by their number of shingles, sizes up to a power of two. An item's sketch is its
bottom-k MinHash: its k shingles that come first in a random order. k is EXTRA + 1 more than the shingles that a match
at the threshold may lack in an item of the partition's largest size (fewer where the item has fewer), so a document that contains enough
of an item has at least EXTRA + 1 shingles of its sketch, and no match is lost however long the document is. Pairs that meet in
fewer, such as by one very common shingle, end there, before any is verified.

Documents are read once. A bit map of the items' shingle hashes (16 MB at most, whatever the items) tells which few shingles of a
document leave the map; these are joined with the sketches, and the pairs found are verified by joining the shingles
themselves. Items never meet on the driver, and more items make no more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Marks, dealt, marked, written
from .words import Words, mix, slices, windowed

WORDS, CONTAINMENT, PROBES = 5, 0.8, 4
#: Shingles of a sketch beyond those that a match may lack and one.
EXTRA = 4
#: ASCII letters in lower case, other ASCII but digits as blanks, other characters unchanged.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD)


class Shingles:
    """The shingles of several texts: the windows of ``n`` words, for each n of ``lengths``."""

    def __init__(self, texts: list[str | None], lengths: list[int]):
        folds = [folded(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in folds], dtype=np.int64)])
        self.data = b"".join(folds)
        self.words = Words(np.frombuffer(self.data, dtype=np.uint8), offsets)
        hashes, self.size = self.words.hashes(), np.diff(self.words.first)
        owner = np.repeat(np.arange(len(texts)), self.size)
        none = np.zeros(0, dtype=np.int64)
        first, of, many, found = [none], [none], [none], [none.astype(np.uint64)]
        for n in lengths:
            out = windowed(hashes, n)
            inside = np.flatnonzero(owner[: len(out)] == owner[n - 1 :]) if len(out) else none
            first.append(inside)
            of.append(owner[inside])
            many.append(np.full(len(inside), n))
            found.append(out[inside])
        self.first, self.owner, self.length, self.hash = (np.concatenate(x) for x in (first, of, many, found))

    def bytes_of(self, at: np.ndarray) -> list[bytes]:
        """The shingles themselves, words joined by one blank."""
        data, start, end = self.data, self.words.start, self.words.end
        spans = zip(start[self.first[at]].tolist(), end[self.first[at] + self.length[at] - 1].tolist(), strict=True)
        return [b" ".join(data[a:b].split()) for a, b in spans]


_ITEM = "item_id long, item_key long, item_shingles int, words int, hash long, shingle binary, sketch boolean, least int"


def item_shingles(items: DataFrame, words: int, containment: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct shingle of each item: its hash, the shingle, whether it is in the item's sketch, and how many of
    the sketch a match has at least.

    An item of fewer words than ``words`` is one shingle. Rows that repeat id and text are one item; texts that share an
    id are items of their own. Items with null or wordless text have no shingles and never match.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                count = Shingles(texts, []).size
                for n in sorted(set(np.minimum(count, words).tolist()) - {0}):
                    row = np.flatnonzero(np.minimum(count, words) == n)
                    s = Shingles([texts[i] for i in row], [n])
                    # distinct shingles of an item, in a random order of their hashes
                    order = np.lexsort((mix(s.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), s.owner))
                    keep = order[np.concatenate([[True], (s.hash[order][1:] != s.hash[order][:-1]) | (s.owner[order][1:] != s.owner[order][:-1])])]
                    owner = s.owner[keep]
                    size = np.bincount(owner, minlength=len(row))
                    largest = [(1 << int(x).bit_length()) - 1 for x in size]
                    lack = np.array([k - math.ceil(containment * k - 1e-9) for k in largest])
                    sketch = np.minimum(size, lack + 1 + EXTRA)
                    least = np.maximum(sketch - lack, 1)
                    rank = np.arange(len(keep)) - (np.cumsum(size) - size)[owner]
                    ids = part.take(pa.array(row[owner]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.column("item_id"), ids.column("item_key"), pa.array(size[owner], pa.int32()), pa.array(np.full(len(keep), n), pa.int32()),
                            pa.array(s.hash[keep].view(np.int64)), pa.array(s.bytes_of(keep), pa.binary()), pa.array(rank < sketch[owner]), pa.array(least[owner], pa.int32()),
                        ],
                        names=["item_id", "item_key", "item_shingles", "words", "hash", "shingle", "sketch", "least"],
                    )

    one = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return one.withColumn("item_key", F.xxhash64("item_id", "text")).mapInArrow(run, _ITEM)


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (doc_id, row_key, text) -> (doc_id, row_key, hash, shingle, rows): what documents may share with ``items``.

    ``rows``: how many rows of ``docs`` repeat this id and text.
    """
    marks = Marks(written(items.select("hash").distinct(), "item-hashes"), PROBES)
    bits = docs.sparkSession.sparkContext.broadcast(marks.bytes())
    lengths = sorted(r["words"] for r in items.select("words").distinct().collect())  # WORDS of them at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = Shingles(part.column("text").to_pylist(), lengths)
                at = marked(bits.value, s.hash, PROBES)
                at = at[np.lexsort((s.hash[at], s.owner[at]))]
                at = at[np.append(True, (s.hash[at[1:]] != s.hash[at[:-1]]) | (s.owner[at[1:]] != s.owner[at[:-1]]))[: len(at)]]
                ids = part.take(pa.array(s.owner[at]))
                yield pa.RecordBatch.from_arrays([ids.column("doc_id"), ids.column("row_key"), pa.array(s.hash[at].view(np.int64)), pa.array(s.bytes_of(at), pa.binary())], names=["doc_id", "row_key", "hash", "shingle"])

    found = docs.mapInArrow(run, "doc_id long, row_key long, hash long, shingle binary")
    return found.groupBy("doc_id", "row_key", "hash", "shingle").agg(F.count("*").alias("rows"))


def _pairs(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(none, id, row_key, item_key, item_id): the documents and items that meet in enough of the item's sketch."""
    sketches = items.where("sketch").select("hash", "shingle", "item_key", "item_id", "least")
    met = hits.join(sketches, ["hash", "shingle"]).groupBy("none", "id", "row_key", "item_key", "item_id").agg(F.count("*").alias("met"), F.first("least").alias("least"))
    return met.where("met >= least").drop("met", "least")


def _matches(docs: DataFrame, items: DataFrame, words: int, containment: float) -> DataFrame:
    """``docs`` (doc_id, row_key, text) -> (doc_id, row_key, item_id, item_key, shared, item_shingles, rows)."""
    shingled = written(item_shingles(items, words, containment), "items")
    hits = written(_hits(docs, shingled), "hits").withColumn("none", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    wanted = _pairs(hits, shingled).join(shingled.select("item_key", F.col("item_id").alias("its_id"), "item_shingles", "hash", "shingle"), "item_key")
    wanted = wanted.where(F.col("item_id").eqNullSafe(F.col("its_id")))
    shared = wanted.join(hits.drop("doc_id"), ["none", "id", "row_key", "hash", "shingle"]).groupBy("none", "id", "row_key", "item_id", "item_key")
    counted = shared.agg(F.count("*").cast("int").alias("shared"), F.max("item_shingles").alias("item_shingles"), F.max("rows").alias("rows"))
    enough = counted.where(F.col("shared") >= containment * F.col("item_shingles") - 1e-9)
    return enough.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "row_key", "item_id", "item_key", "shared", "item_shingles", "rows")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): one row per document row and item that it contains.

    Null, empty and wordless documents contain nothing, nor does an empty table; without items nothing is contained. Repeated
    document rows are each reported; rows of ``items`` that repeat id and text are one item. Texts compare in lower case
    with ASCII punctuation as blanks; an item of fewer words than a shingle is contained where its words stand in a row.
    Other columns are ignored.
    """
    text = F.col(text_col)
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key"), text.alias("text"))
    found = dealt(written(_matches(one, items, words, containment).select("doc_id", "item_id", "shared", "item_shingles", "rows"), "found"), "rows")
    return found.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def _text_keys(text: Column) -> tuple[Column, Column]:
    """What tells texts apart: two 64-bit hashes."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that contain an item; same columns.

    Null, empty and wordless texts stay; repeated rows go or stay together; without items all stay. Only rows whose
    text hash is marked are exchanged.
    """
    first, second = _text_keys(F.col(text_col))
    matches = _matches(docs.select(first.alias("doc_id"), second.alias("row_key"), F.col(text_col).alias("text")), items, words, containment)
    gone = written(matches.select(F.col("doc_id").alias("gone_one"), F.col("row_key").alias("gone_two")).distinct(), "gone")
    maybe, kept = Marks(gone.select("gone_one")).split(docs, first)
    first, second = _text_keys(maybe[text_col])
    return kept.union(maybe.join(gone.hint("merge"), (first == gone["gone_one"]) & (second == gone["gone_two"]), "left_anti"))


def contaminated_sql(words: int = WORDS, containment: float = CONTAINMENT) -> str:
    """The same in DuckDB SQL, over ``documents`` and ``benchmark``."""
    split = "list_filter(string_split_regex(regexp_replace(lower(text), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' +'), lambda x: x <> '')"
    window = "array_to_string(list_slice(w, i, i + {n} - 1), ' ')"
    return f"""with items as (select distinct item_id, text from benchmark where text is not null),
bw as (select row_number() over () as item, item_id, {split} as w from items),
b as (select distinct item, item_id, s, least(len(w), {words}) as n from (select item, item_id, w, unnest(list_transform(range(1, len(w) - least(len(w), {words}) + 2), lambda i: {window.format(n=f"least(len(w), {words})")})) as s from bw where len(w) > 0)),
size as (select item, count(*) as shingles from b group by 1),
dw as (select row_number() over () as doc, doc_id, {split} as w from documents where text is not null),
d as (select distinct doc, doc_id, n, s from (select doc, doc_id, lens.n, unnest(list_transform(range(1, len(w) - lens.n + 2), lambda i: {window.format(n="lens.n")})) as s
  from dw join (select distinct n from b) lens on len(w) >= lens.n))
select doc_id, item_id, cast(count(*) as integer) as shared, cast(any_value(shingles) as integer) as item_shingles, count(*) / any_value(shingles) as containment
from d join b using (s, n) join size using (item) group by doc, doc_id, item, item_id having count(*) >= {containment} * any_value(shingles) - 1e-9"""
