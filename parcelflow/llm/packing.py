"""Packing token sequences by best-fit decreasing.

Documents are tokenised and cut into full windows and a rest. Pieces are dealt to groups by a hash; within a group the
longest piece goes first, each into the tightest open window that still holds it, found by a segment tree indexed by
remaining capacity. A group has tens of thousands of pieces, so that it packs nearly as well as all pieces together
(each group leaves a few unfilled windows), and the groups grow in number with the corpus, not in size.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import slices

WINDOW, END, GROUP_PIECES = 2048, 1, 40_000
TOKENIZER = "word_bpe_49k.json"
#: Bytes of a worker's memory for each of two generations of stems whose ids are known.
MEMORY = 48 << 20
#: Bytes of text whose words are looked at together.
TOGETHER = 4 << 20
#: Words of these letters, and whatever of these marks follows, have the ids of either part.
_LETTERS, _MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?%#&$*"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo:
    """Token ids (as little-endian 32-bit integers) of whole texts, by their words between blanks.

    The tokenizer drops white space, never joins across it, lower-cases, and takes letters and other characters apart.
    So a text's ids are those of its words, and a word of plain letters and marks has those of either part. The distinct
    words of many texts are cut into stems and marks together; stems not known yet are encoded together, and told
    apart by the mark that the last token of each has. When about ``memory`` bytes are known, the generation
    before the last one is dropped.
    """

    def __init__(self, path: str, memory: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memory, self.size = memory, 0
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _keep(self, key: str, value: bytes) -> None:
        self.now[key] = value
        self.size += len(key) + len(value) + 200

    def _learn(self, stems: list[str]) -> None:
        """``stems`` are of letters only, or of marks only."""
        ids = self._ids(" ".join(stems))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(stems) and ends[-1] == len(ids):
            raw, at = ids.tobytes(), 0
            for stem, end in zip(stems, (4 * ends).tolist(), strict=True):
                self._keep(stem, raw[at:end])
                at = end
        else:  # a vocabulary without such marks
            for stem in stems:
                self._keep(stem, self._ids(stem).tobytes())

    def _known(self, keys: pa.Array, simple: bool) -> list[bytes]:
        if self.size > self.memory:
            self.old, self.now, self.size = self.now, {}, 0
        keys = keys.to_pylist()
        found = list(map(self.now.get, keys))
        unknown = []
        for key in [k for k, ids in zip(keys, found, strict=True) if ids is None]:
            if (ids := self.old.get(key)) is None:
                unknown.append(key)
            else:
                self._keep(key, ids)
        if simple and unknown:
            self._learn(unknown)
        elif unknown:
            for key in unknown:
                self._keep(key, self._ids(key).tobytes())
        return [self.now[key] if ids is None else ids for key, ids in zip(keys, found, strict=True)]

    def texts(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and where each text begins (and the last one ends)."""
        listed = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        first = np.asarray(listed.offsets).astype(np.int64)
        words = listed.flatten().dictionary_encode()
        kinds = words.dictionary.filter(pc.not_equal(words.dictionary, ""))
        number = np.full(len(words.dictionary), -1)  # the empty word, which blanks at a text's ends leave, has no ids
        number[np.asarray(pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False))] = np.arange(len(kinds))
        stem = pc.utf8_rtrim(kinds, _MARKS)
        plain = np.asarray(pc.match_substring_regex(stem, _LETTERS).to_numpy(zero_copy_only=False), dtype=bool)
        ids: list[bytes] = [b""] * len(kinds)
        # plain words: stems and marks apart; all others are encoded as they are
        at = np.flatnonzero(plain)
        if len(at):
            stems = pc.utf8_lower(stem.take(pa.array(at))).dictionary_encode()
            known = self._known(stems.dictionary, True)
            cut = pc.utf8_length(stem.take(pa.array(at))).to_numpy(zero_copy_only=False)
            marked = cut < pc.utf8_length(kinds.take(pa.array(at))).to_numpy(zero_copy_only=False)
            of = np.asarray(stems.indices)
            for i, k in zip(at[~marked].tolist(), of[~marked].tolist(), strict=True):
                ids[i] = known[k]
            tails = [w[c:] for w, c in zip(kinds.take(pa.array(at[marked])).to_pylist(), cut[marked].tolist(), strict=True)]
            tail_ids = dict(zip(t := sorted(set(tails)), self._known(pa.array(t, pa.string()), True), strict=True)) if tails else {}
            for i, k, tail in zip(at[marked].tolist(), of[marked].tolist(), tails, strict=True):
                ids[i] = known[k] + tail_ids[tail]
        odd = np.flatnonzero(~plain)
        if len(odd):
            for i, found in zip(odd.tolist(), self._known(kinds.take(pa.array(odd)), False), strict=True):
                ids[i] = found
        ids.append(np.array([end], dtype="<u4").tobytes())
        ids.append(b"")
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        word = np.insert(number[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64), first[1:] - first[0], len(ids) - 2)
        there = np.cumsum(size[word])
        out = flat[np.repeat(begin[word] - (there - size[word]), size[word]) + np.arange(there[-1] if len(there) else 0)]
        return out, np.concatenate([[0], there[first[1:] - first[0] + np.arange(len(column))]])


_memos: dict[tuple, _Memo] = {}


def token_ids(column: pa.Array, path: str, end: int = END, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts (null: none), each followed by ``end``, and where each text begins."""
    if (path, memory) not in _memos:
        _memos[path, memory] = _Memo(path, memory)
    return _memos[path, memory].texts(column, end)


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut into full windows and a rest.

    Null and empty texts are the end id alone; an empty table has no pieces.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=TOGETHER):
                ids, first = token_ids(part.column("text"), path, end, memory)
                total = np.diff(first)
                parts = -(-total // window)
                row = np.repeat(np.arange(len(total)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(total[row] - start, window)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((first[row] + start).tolist(), (first[row] + start + length).tolist(), strict=True)]
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total[row])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *numbers], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return one.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class BestFit:
    """Open windows by remaining capacity; a segment tree finds the smallest capacity that is large enough."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.used: list[int] = []

    def _mark(self, capacity: int, there: int) -> None:
        node = capacity + self.leaves
        self.tree[node] = there
        while node > 1:
            node >>= 1
            now = self.tree[2 * node] | self.tree[2 * node + 1]
            if self.tree[node] == now:
                return
            self.tree[node] = now

    def _tightest(self, length: int) -> int | None:
        node = length + self.leaves
        if self.tree[node]:
            return length
        while node > 1:
            if not node & 1 and self.tree[node + 1]:  # the sibling to the right holds the next larger capacities
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def put(self, length: int) -> tuple[int, int]:
        """The window that takes a piece, and the offset there."""
        capacity = self._tightest(length)
        if capacity is None:
            where, capacity = len(self.used), self.window
            self.used.append(0)
        else:
            where = self.open[capacity].pop()
            if not self.open[capacity]:
                self._mark(capacity, 0)
        offset = self.used[where]
        self.used[where] += length
        rest = capacity - length
        if rest:
            self.open[rest].append(where)
            if len(self.open[rest]) == 1:
                self._mark(rest, 1)
        return where, offset


def pack(cut: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` (a written table of pieces) with sequence_id and offset; of an empty table, an empty one.

    The place of a row in the written table takes part in the deal, so that pieces which repeat in all respects spread over the
    groups; a task that is run again meets the same places.
    """
    groups = max(1, -(-cut.count() // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        fit = BestFit(window)
        places = np.array([fit.put(n) for n in group.column("length").to_pylist()], dtype=np.int64)
        sequence = (np.asarray(group.column("part")) << 32) + places[:, 0]
        return group.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(places[:, 1]))

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(run, ", ".join(f"{c} long" for c in [*cut.columns, "sequence_id", "offset"]))


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per piece of every row of ``docs``: the columns of ``pieces``, sequence_id and offset.

    Repeated rows are packed each; a null id is a document like any other; a null or empty text is its end token. Other columns
    are ignored; an empty table gives an empty one.
    """
    return pack(written(pieces(docs, path, window, id_col=id_col, text_col=text_col, memory=memory), "pieces"), window)
