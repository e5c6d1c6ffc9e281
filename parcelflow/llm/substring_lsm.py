"""Substring deduplication with a log-structured index of window fingerprints.

Every window of ``words`` consecutive words is represented in the index without storing it on its own. Inside a
window the 8-word gram with the smallest hash (leftmost on ties) is its *anchor*; equal windows have equal anchors.
Neighbouring windows that share one anchor form a *context*; about 2 of 29 positions are anchors. A run of the index
is an immutable Parquet table sorted by anchor: one entry for each distinct context, with the digest of its words,
whether it occurs once or more often, and the place where it stands (the only one, while it occurs once).

* ``append`` turns a new batch into such entries and merge-joins them with the runs, by anchor. A context that now occurs
  twice repeats as a whole. Where an anchor has several contexts, the windows of those places are read from the texts and
  compared by the digests of their words; the 29 or fewer windows of a context fit into one bit mask. What repeats is
  logged by place, for the new batch and for earlier ones. Then the entries become a run.
* Runs of one level are compacted into one of the next when there are ``fan_in`` of them.
* ``remove_repeats`` drops the words that the log covers.

Appending reads the runs, not the old texts, but for the texts of places that share an anchor with a new and different context:
their keys go through a bit map, and only what is found moves. No group is ever gathered: counts are aggregated
map-side, joins may be split by adaptive execution.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Marks, new_folder, removed, scratch, written
from .words import Words, slices, windowed

GRAM, DIGEST, FAN_IN = 8, 16, 3


def _words_of(column: pa.Array) -> tuple[Words, bytes]:
    """The words of some texts, and their bytes with one blank between the words of a text."""
    texts = [b" ".join((t or "").encode().split()) for t in column.to_pylist()]
    data = b"".join(texts)
    return Words(np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *map(len, texts)])), data


def _digests(w: Words, data: bytes, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """BLAKE2b of words first to last, which stands for the words."""
    spans = zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)
    return pa.array([hashlib.blake2b(data[a:b], digest_size=DIGEST).digest() for a, b in spans], pa.binary())


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the index of the leftmost smallest one."""
    n = len(values) - width + 1
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        size = len(best) - step
        left = best[:size] <= best[step:]
        best, at = np.where(left, best[:size], best[step:]), np.where(left, at[:size], at[step:])
        span += step
    return at[:n]


def _contexts(w: Words, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, anchor gram's hash, first and last window of each context of the texts."""
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < words:
        return none, none.astype(np.uint64), none, none
    grams = windowed(hashes, GRAM)
    anchor = _first_smallest(grams, words - GRAM + 1)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inside = np.flatnonzero(text[: len(anchor)] == text[words - 1 :])
    if not len(inside):
        return none, none.astype(np.uint64), none, none
    anchor = anchor[inside]
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = inside[begins], inside[np.append(begins[1:], len(inside)) - 1]
    return text[first], grams[anchor[begins]], first, last


def _entries(words: int):
    """Rows (doc_id, row_key, gram, context, first, last) of the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, data = _words_of(part.column("text"))
                text, gram, first, last = _contexts(w, w.hashes(), words)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(text)),
                            part.column("row_key").take(pa.array(text)),
                            pa.array(gram.view(np.int64)),
                            _digests(w, data, first, last + words - 1),
                            pa.array((first - w.first[text]).astype(np.int32)),
                            pa.array((last - w.first[text]).astype(np.int32)),
                        ],
                        names=["doc_id", "row_key", "gram", "context", "first", "last"],
                    )

    return run


_PLACE = "doc_id long, row_key long, first int, last int"
_ENTRY = "doc_id long, row_key long, gram long, context binary, first int, last int"
_RUN = f"gram long, context binary, n int, {_PLACE}"
_LOG = f"{_PLACE}, mask long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, and a key that tells rows with the same id and different texts apart."""
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return one.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _same():
    """The join of a row's text, as its_doc and its_key, with what was found in it."""
    return F.col("row_key").eqNullSafe(F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_doc"))


def _windows(words: int):
    """The windows of the contexts in ``places``: rows (gram, n, window, bit, doc_id, row_key, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, data = _words_of(part.column("text"))
                listed = part.column("places")
                flat = listed.flatten()
                text = np.repeat(np.arange(len(part)), np.diff(np.asarray(listed.offsets)))
                gram, n, first, last = (np.asarray(flat.field(k)) for k in ("gram", "n", "first", "last"))
                size = last - first + 1
                place = np.repeat(np.arange(len(size)), size)
                bit = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
                start = w.first[text[place]] + first[place] + bit
                row = pa.array(text[place])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[place]), pa.array(n[place]), _digests(w, data, start, start + words - 1), pa.array(bit.astype(np.int32)),
                        part.column("doc_id").take(row), part.column("row_key").take(row), pa.array(first[place]), pa.array(last[place]),
                    ],
                    names=["gram", "n", "window", "bit", "doc_id", "row_key", "first", "last"],
                )

    return run


def _remove(words: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
            count, removed, digest, kept_text = [], [], [], []
            for text, marks in zip(texts, places, strict=True):
                parts = (text or "").encode().split()
                count.append(len(parts))
                if marks:
                    covered = np.zeros(len(parts) + 1, dtype=np.int64)
                    for m in marks:
                        first, last, mask = m["first"], m["last"], m["mask"]
                        whole = mask == -1
                        for a, b in [(first, last)] if whole else [(s, s) for s in range(first, last + 1) if mask >> (s - first) & 1]:
                            covered[a] += 1
                            covered[b + words] -= 1
                    keep = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
                    parts = [parts[i] for i in keep]
                removed.append(count[-1] - len(parts))
                kept = b" ".join(parts)
                digest.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_text.append(kept.decode())
            out = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept_text, pa.string())] * keep_text, names + ["kept_text"] * keep_text)

    return run


def _place() -> list[Column]:
    """The place of any one row of a group: ``first`` takes all columns from the same row."""
    return [F.first(c).alias(c) for c in ("doc_id", "row_key", "first", "last")]


class WindowIndex:
    """The index in a shared folder: runs by level, and the log of what repeats. It can be opened again from its folder.

    ``history``: the documents that were appended before, needed when an index is opened again.
    """

    def __init__(self, spark: SparkSession, words: int = 35, folder: str | None = None, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN):
        if not 16 <= words <= 70:
            raise ValueError("words must be from 16 to 70, so that a context's windows fit a 63-bit mask")
        self.spark, self.words, self.fan_in = spark, words, fan_in
        self.folder = folder or new_folder(spark, "window-index")
        self.batches: list[DataFrame] = [] if history is None else [_keyed(history, id_col, text_col)]
        self.runs: list[tuple[int, str]] = []
        self.logs: list[str] = []
        self.version = 0
        if folder is not None:
            self._open()

    def _open(self) -> None:
        try:
            listed = self.spark.read.parquet(f"{self.folder}/manifest").orderBy("version", "path").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.version = max(r["version"] for r in listed)
        now = [r for r in listed if r["version"] == self.version]
        self.runs = [(r["level"], f"{self.folder}/{r['path']}") for r in now if r["level"] >= 0]
        self.logs = [f"{self.folder}/{r['path']}" for r in now if r["level"] < 0]

    def _commit(self) -> None:
        """The list of runs and logs, as a new version: what readers see changes at once."""
        self.version += 1
        name = lambda path: path.rpartition("/")[2]
        rows = [(level, name(path)) for level, path in self.runs] + [(-1, name(path)) for path in self.logs]
        self.spark.createDataFrame(rows, "level int, path string").coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version}")

    def _store(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{self.version:06d}-{len(self.runs):03d}"
        df.write.mode("overwrite").parquet(path)  # an append that was cut short may have left a folder there
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Join a new batch with the runs, log what repeats, and add a run. Null and short texts have no windows."""
        batch = _keyed(docs, id_col, text_col)
        with scratch(self.spark):
            new = written(batch.mapInArrow(_entries(self.words), _ENTRY), "entries")
            distinct = new.groupBy("gram", "context").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), *_place())
            run = self._store(distinct.sortWithinPartitions("gram"), "run")
            log = self._store(self._repeats(batch, new, self._read([run], _RUN)), "log")
        self.batches.append(batch)
        self.runs.append((0, run))
        self.logs.append(log)
        merged = self._compact()
        self._commit()
        for path in merged:
            removed(self.spark, path)

    def _repeats(self, batch: DataFrame, new: DataFrame, distinct: DataFrame) -> DataFrame:
        """(doc_id, row_key, first, last, mask): what repeats now that the batch is there, by place in any batch.

        Anchors are compared through bit maps, so that runs and entries are not exchanged; what these let through too
        much stands in one place only, or has nothing new, and repeats nothing.
        """
        place = F.struct("doc_id", "row_key", "first", "last")
        anchors = written(distinct.groupBy("gram").agg(F.sum("n").alias("n")), "anchors")
        old = self.entries()
        if self.runs:
            old = written(Marks(anchors.select("gram")).split(old, F.col("gram"))[0], "old")
        often = written(anchors.where("n > 1").select("gram").union(old.select("gram")).distinct(), "often")
        met = Marks(often).split(distinct, F.col("gram"))[0].withColumn("fresh", F.lit(True)).union(old.withColumn("fresh", F.lit(False)))
        was = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("int")
        met = met.groupBy("gram", "context").agg(was(F.col("fresh")).alias("here"), was(~F.col("fresh")).alias("before"), F.min(F.when(~F.col("fresh"), place)).alias("earlier"), F.min(F.when(F.col("fresh"), place)).alias("now"))
        met = written(met.withColumn("n", F.least(F.col("here") + F.col("before"), F.lit(2)).cast("int")), "met")
        whole = met.where("n > 1")
        again, key = whole.where("here > 0").select("gram", "context"), F.xxhash64("gram", "context")
        maybe = Marks(written(again.select(key), "again")).split(new, key)[0]
        marks = maybe.join(again, ["gram", "context"]).select("doc_id", "row_key", "first", "last", F.lit(-1).cast("long").alias("mask"))
        marks = marks.union(whole.where("here > 0 and before = 1").select("earlier.*", F.lit(-1).cast("long")))
        # only an anchor with several contexts, one of them new and one of them single, leaves anything to tell
        mixed = met.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least"), F.min("before").alias("new")).where("contexts > 1 and least = 1 and new = 0")
        listed = Marks(written(mixed.select("gram"), "mixed")).split(met, F.col("gram"))[0]
        listed = listed.select("gram", "n", F.coalesce("earlier", "now").alias("p")).select("p.doc_id", "p.row_key", F.struct("gram", "n", "p.first", "p.last").alias("place"))
        places = written(listed.groupBy("doc_id", "row_key").agg(F.collect_list("place").alias("places")), "places")
        texts = reduce(DataFrame.union, [*self.batches, batch])
        texts = Marks(places.select("row_key")).split(texts, F.col("row_key"))[0].distinct()
        read = texts.withColumnsRenamed({"doc_id": "its_doc", "row_key": "its_key"}).join(places, _same()).select("doc_id", "row_key", "text", "places")
        windows = written(read.mapInArrow(_windows(self.words), f"gram long, n int, window binary, bit int, {_PLACE}"), "windows")
        twice = windows.groupBy("gram", "window").agg(F.sum("n").alias("total")).where("total > 1").select("gram", "window")
        partly = windows.where("n = 1").join(twice, ["gram", "window"]).groupBy("doc_id", "row_key", "first", "last")
        return marks.union(partly.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))

    def _compact(self) -> list[str]:
        """Merge the runs of a level into one of the next as long as a level has ``fan_in`` of them; what was merged."""
        level, gone = 0, []
        while level <= max(n for n, _ in self.runs):
            same = [path for n, path in self.runs if n == level]
            if len(same) >= self.fan_in:
                merged = self._read(same, _RUN).groupBy("gram", "context").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), *_place())
                path = self._store(merged.sortWithinPartitions("gram"), f"run-level-{level + 1}")
                self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, path)]
                gone += same
            level += 1
        return gone

    def entries(self) -> DataFrame:
        return self._read([path for _, path in self.runs], _RUN)

    def remove_repeats(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
        """One row per row of ``docs`` (which must have been appended): what is left without repeated windows.

        Null, empty and short texts lose nothing; rows that repeat id and text get the same result each; an empty table gives
        an empty one. Windows are judged against all batches appended so far. Only rows with repeats are exchanged.
        """
        batch = _keyed(docs, id_col, text_col)
        marks = self._read(self.logs, _LOG).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "last", "mask")).alias("places"))
        marks = written(marks, "places")
        maybe, clean = Marks(marks.select("row_key")).split(batch, F.col("row_key"))
        texts = maybe.withColumnsRenamed({"doc_id": "its_doc", "row_key": "its_key"})
        joined = texts.join(marks.hint("merge"), _same(), "left").select(F.col("its_doc").alias("doc_id"), "text", "places")
        both = joined.union(clean.select("doc_id", "text", F.lit(None).cast(marks.schema["places"].dataType)))
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
        return both.mapInArrow(_remove(self.words, keep_text), schema)
