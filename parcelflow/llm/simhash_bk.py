"""SimHash near-duplicate groups with BK-trees.

A BK-tree keeps fingerprints so that a child hangs on its parent by their integer Hamming distance d; a search within
radius r that stands at distance d from a node needs only the edges d - r to d + r.

A tree over the whole corpus would have to go to every executor, and every fingerprint would have to search all of it,
so the trees are sharded by keys which a pair within the radius is bound to share (or, for wide radii, shares with
known probability), and are dealt out by shuffle. A large shard is cut into blocks
and every pair of blocks is a tree and its queries, so memory is bounded and no link is lost. Each tree returns a spanning
forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Marks, written
from .words import mix, slices

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PART = 1 << 16  # shingles that are unpacked to bits at once
_FRONTIER = 1 << 21  # pairs of a query and a node that are looked at together


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``words``-word shingles of a lower-cased text, repeats included.

    A shorter text is one shingle; a text without words (or null) has none.
    """
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits for each lane: set where more than half of the hashes have the bit. Later lanes remix the hashes."""
    out = np.zeros(lanes, dtype=np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        own = hashes if not lane else mix(hashes + np.uint64(lane))
        count = np.zeros(64, dtype=np.int64)
        for i in range(0, len(own), _PART):
            eight = own[i : i + _PART].astype("<u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(eight, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(count * 2 > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int, lanes: int, minima: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp array<long>, minima array<long>) of every whole text.

    ``minima``: for so many random orders of the shingles, the hash of the first one (a text without words: zeros).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, firsts = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                prints.append(simhash(hashes, lanes))
                firsts.append([mix(hashes ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min() for i in range(minima)] if len(hashes) else [0] * minima)
            as_lists = lambda rows, n: pa.ListArray.from_arrays(np.arange(0, (len(rows) + 1) * n, n) if n else np.zeros(len(rows) + 1, np.int64), pa.array(np.array(rows, dtype=np.uint64).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_lists(prints, lanes), as_lists(firsts, minima)], names=["doc_id", "fp", "minima"])

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return one.mapInArrow(run, "doc_id long, fp array<long>, minima array<long>")


def block_keys(fp: Column, radius: int, count: int) -> Column:
    """Keys of which two 64-bit fingerprints within ``radius`` share at least one, for about ``count`` fingerprints.

    The bits are cut into blocks; a key is all but ``radius`` of them. More blocks make longer keys and more of them;
    the fewest are taken whose keys have at least as many bits as tell ``count`` random fingerprints apart.
    """
    need = math.log2(max(count, 2)) + 2
    blocks = next((b for b in range(radius + 1, radius + 5) if 64 * (b - radius) // b >= need), radius + 4)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(number), fp[0].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of many shards: row i belongs to the tree of row ``root[i]``."""

    def __init__(self, fp: np.ndarray, root: np.ndarray):
        self.fp, self.edges = fp, fp.shape[1] * 64 + 1
        todo, node = np.flatnonzero(root != np.arange(len(root))), root.copy()
        codes, children = [], []
        while len(todo):
            code = node[todo] * self.edges + _distance(fp[todo], fp[node[todo]])
            unique, winner, which = np.unique(code, return_index=True, return_inverse=True)
            codes.append(unique)
            children.append(todo[winner])
            node[todo] = todo[winner][which]
            rest = np.ones(len(todo), dtype=bool)
            rest[winner] = False
            todo = todo[rest]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(code)
        self.code, self.child = code[order], (np.concatenate(children) if children else code)[order]

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, tree row) within ``radius``, by levels; ``query`` are rows of ``fp``."""
        node = root
        while len(query):
            d = _distance(self.fp[query], self.fp[node])
            hit = (d <= radius) & (query != node)
            yield query[hit], node[hit]
            low = np.searchsorted(self.code, node * self.edges + np.maximum(d - radius, 0))
            high = np.searchsorted(self.code, node * self.edges + np.minimum(d + radius, self.edges - 1), side="right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            query, node = np.repeat(query, size), self.child[at]


def _join(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; name[i] leads to the smallest row of i's set."""
    while True:
        a, b = name[a], name[b]
        apart = a != b
        if not apart.any():
            return
        pair = np.unique(np.maximum(a, b)[apart] * len(name) + np.minimum(a, b)[apart])
        a, b = pair // len(name), pair % len(name)
        np.minimum.at(name, a, b)
        while not np.array_equal(name, up := name[name]):
            name[:] = up


def _hits(fp: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, in_query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, tree row) of one shard within ``radius``; ``shard`` is sorted."""
    tree = np.flatnonzero(in_tree)
    begins = np.flatnonzero(np.concatenate([[True], shard[tree][1:] != shard[tree][:-1]])) if len(tree) else tree
    size = np.diff(np.append(begins, len(tree)))
    root_of_shard = dict(zip(shard[tree[begins]].tolist(), zip(tree[begins].tolist(), size.tolist(), strict=True), strict=True))
    rows = np.flatnonzero(in_query)
    found = [root_of_shard.get(s, (-1, 0)) for s in shard[rows].tolist()]
    root, cost = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
    here = root >= 0
    rows, root, cost = rows[here], root[here], cost[here]
    own = np.arange(len(fp))
    own[tree] = np.repeat(tree[begins], size)
    forest = Forest(fp, own)
    group = (np.cumsum(cost) - cost) // _FRONTIER
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        yield from forest.search(rows[a:b], root[a:b], radius)


class Sets:
    """The shingle sets of some rows."""

    def __init__(self, lists: pa.ListArray, similarity: float):
        self.first, self.similarity = np.asarray(lists.offsets).astype(np.int64), similarity
        self.first = self.first - self.first[0]
        values, self.ids = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        self.mark = np.zeros(len(values), dtype=bool)

    def alike(self, row: int, others: np.ndarray) -> np.ndarray:
        """Whether the exact Jaccard similarity of ``row`` and each of ``others`` reaches the threshold."""
        own = self.ids[self.first[row] : self.first[row + 1]]
        size = self.first[others + 1] - self.first[others]
        ends = np.cumsum(size)
        self.mark[own] = True
        there = self.mark[self.ids[np.repeat(self.first[others] - (ends - size), size) + np.arange(size.sum())]]
        self.mark[own] = False
        total = np.concatenate([[0], np.cumsum(there)])
        shared = total[ends] - total[ends - size]
        return shared >= self.similarity * (len(own) + size - shared) - 1e-9


def _join_alike(name: np.ndarray, q: np.ndarray, t: np.ndarray, sets: Sets) -> None:
    """Merge the sets of q[i] and t[i] where the rows are alike; pairs that others have connected need no look."""
    apart = np.flatnonzero(name[q] != name[t])
    apart = apart[np.argsort(q[apart], kind="stable")]
    q, t = q[apart], t[apart]
    cuts = np.flatnonzero(np.diff(q)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(q)], strict=True):
        others = t[a:b][name[t[a:b]] != name[q[a:b]]]
        if len(others):
            others = others[sets.alike(q[a], others)]
            _join(name, np.full(len(others), q[a]), others)


def spanning_links(
    fp: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, in_query: np.ndarray, radius: int, sets: Sets | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows a, b) that connect whatever rows of one shard lie within ``radius`` (and are alike)."""
    name = np.arange(len(fp))
    for q, t in _hits(fp, shard, in_tree, in_query, radius):
        if sets is None:
            _join(name, q, t)
        else:
            _join_alike(name, q, t, sets)
    linked = np.flatnonzero(name != np.arange(len(fp)))
    return linked, name[linked]


def _as_lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.uint64), *rows])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat.view(np.int64)))


def _shards(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, shard numbers, and which rows are in the tree and which are queries."""
    fp = np.asarray(table.column("fp").combine_chunks().flatten()).view(np.uint64).reshape(-1, width)
    keys = np.stack([np.asarray(table.column(c)) for c in ("key", "one", "two")], axis=1)
    shard = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
    block = np.asarray(table.column("block"))
    return fp, shard, block == keys[:, 2], block == keys[:, 1]


def _by_shards(work, limit: int, size=len):
    """``work`` on tables of whole shards, gathered up to about ``limit`` by ``size`` of the batches, sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(size, held)) < limit:
                continue
            table = pa.Table.from_batches(held)
            keys = np.stack([np.asarray(table.column(c)) for c in ("key", "one", "two")], axis=1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(ends):
                yield work(table.slice(0, ends[-1] + 1))
                held = table.slice(ends[-1] + 1).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _trees(lanes: int, radius: int, gather: int = 1 << 17):
    """Batches sorted by shard -> links of fingerprints. Whole shards are gathered up to about ``gather`` rows."""

    def links(table: pa.Table) -> pa.RecordBatch:
        fp, *where = _shards(table, lanes)
        a, b = spanning_links(fp, *where, radius)
        return pa.RecordBatch.from_arrays([_as_lists(list(fp[x])) for x in (a, b)], names=["a", "b"])

    return _by_shards(links, gather)


def _close(lanes: int, radius: int, gather: int = 1 << 17):
    """Batches sorted by shard -> (key, fp) of the rows with a tree hit; ``fp`` has one number more than lanes."""

    def close(table: pa.Table) -> pa.RecordBatch:
        fp, *where = _shards(table, lanes + 1)
        near = np.zeros(len(fp), dtype=bool)
        for q, t in _hits(fp[:, :lanes], *where, radius):
            near[q] = near[t] = True
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(table.column("key"))[near]), _as_lists(list(fp[near]))], names=["key", "fp"])

    return _by_shards(close, gather)


def _checked(lanes: int, radius: int, similarity: float, gather: int = 16 << 20):
    """As ``_trees``, but links are tree hits whose shingle sets are alike; gathers up to about ``gather`` bytes."""

    def links(table: pa.Table) -> pa.RecordBatch:
        fp, *where = _shards(table, lanes + 1)
        lists = table.column("shingles").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        a, b = spanning_links(fp[:, :lanes], *where, radius, Sets(lists, similarity))
        return pa.RecordBatch.from_arrays([_as_lists(list(fp[x])) for x in (a, b)], names=["a", "b"])

    return _by_shards(links, gather, lambda batch: batch.nbytes)


#: Fingerprints of the largest block.
BLOCK = 1 << 16


def _dealt(members: DataFrame, weight: Column | None = None, limit: int = BLOCK, block_size: int = BLOCK) -> DataFrame:
    """``members`` (key, fp, ...) -> (key, fp, block, one, two): larger shards are pairs of blocks.

    The blocks of a shard grow with the square root of its members, in number as in size, up to ``block_size`` members or
    ``limit`` of ``weight``. So no task gets much more than others, and a member of n is sent some sqrt(n) / 16 times.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("n"), (weight if weight is not None else F.count("*")).alias("weight")).where("n > 1")
    blocks = F.greatest(F.ceil(F.sqrt("n") / 16), F.ceil(F.col("n") / block_size), F.ceil(F.col("weight") / limit)).cast("int")
    shards = written(counts.select("key", blocks.alias("blocks")), "shards")
    large = written(shards.where("blocks > 1"), "large")
    members = Marks(shards.select("key")).split(members.select("key", "fp"), F.col("key"))[0]
    one = F.lit(0)
    if large.isEmpty():
        return members.select("key", "fp", one.alias("block"), one.alias("one"), one.alias("two"))
    # a large shard's members meet their number of blocks in 64 places
    maybe, whole = Marks(large.select("key")).split(members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(64))), F.col("key"))
    salted = large.select("key", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("salt"))
    cut = maybe.join(salted, ["key", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("blocks").cast("long")).cast("int"))
    paired = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("one"), F.greatest("block", x).alias("two")))
    pairs = cut.select("key", "fp", "block", F.explode(paired).alias("pair")).select("key", "fp", "block", "pair.one", "pair.two")
    return pairs.union(whole.select("key", "fp", one, one, one))


def _sorted_shards(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "block", "fp")


def tree_links(nodes: DataFrame, lanes: int, radius: int, tree_size: int = BLOCK) -> DataFrame:
    """``nodes`` (fp, keys) with distinct fp -> (a, b): fingerprints of a shard within ``radius``, as a spanning forest."""
    members = nodes.select("fp", F.explode("keys").alias("key")).distinct()
    return _sorted_shards(_dealt(members, block_size=tree_size)).mapInArrow(_trees(lanes, radius), "a array<long>, b array<long>")


def _by_minima() -> Column:
    return F.transform("minima", lambda x, i: F.xxhash64(i, x))


def minima_members(nodes: DataFrame, common: int = 1 << 12) -> DataFrame:
    """``nodes`` (fp, minima), written -> (fp, key): one key for each MinHash.

    A shingle that very many unlike texts have in common makes a shard of them all. Such a shard (more than ``common``
    members, and for each other order of the shingles at least a quarter as many first ones) is cut by the other
    MinHashes: texts of similarity 0.8 in it miss all seven once in 78,000. Shards of texts that are alike stay whole.
    """
    each = nodes.select("fp", "minima", F.posexplode("minima").alias("i", "x")).select("fp", "minima", "i", F.xxhash64("i", "x").alias("key"))
    large = written(each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > common), "large")
    if large.isEmpty():
        return each.select("fp", "key")
    others = each.join(large, "key").select("fp", "key", "n", "i", F.posexplode("minima").alias("j", "y")).where("i <> j")
    kinds = others.groupBy("key", "n", "j").agg(F.approx_count_distinct("y").alias("kinds"))
    mixed = written(kinds.groupBy("key").agg(F.min(F.col("kinds") / F.col("n")).alias("share")).where("share > 0.25").select("key"), "mixed")
    cut = others.join(mixed, "key").select("fp", F.xxhash64("key", "j", "y").alias("key"))
    return each.join(mixed, "key", "left_anti").select("fp", "key").union(cut)


def _classes(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` with component_id, the smallest doc_id that ``links`` of ``nodes`` lead to."""
    names = written(connected_components(links), "components")
    linked = names.join(nodes, names.node == nodes.fp).select("fp", "name", "least")
    smallest = linked.groupBy("name").agg(F.min("least").alias("component"))
    found = written(linked.join(smallest, "name").select("fp", "component"), "linked")
    whole = nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(written(whole, "classes"), "fp")


def near_groups(prints: DataFrame, lanes: int, radius: int, tree_size: int = BLOCK) -> DataFrame:
    """``prints`` (doc_id, fp, minima), already written -> (doc_id, fp, component_id).

    Fingerprints link within ``radius``; component_id is the smallest doc_id that links lead to. With ``minima`` the
    shards are MinHash keys, else blocks of the single lane's bits (then no link is missed). Null doc_id is never
    smallest unless a component has no other.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("minima").alias("minima")), "fingerprints")
    keys = F.when(F.size("minima") > 0, _by_minima()).otherwise(block_keys(F.col("fp"), radius, nodes.count())) if lanes == 1 else _by_minima()
    links = tree_links(nodes.select("fp", keys.alias("keys")), lanes, radius, tree_size)
    return _classes(prints.select("doc_id", "fp"), nodes, links)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit fingerprints, all links within ``radius`` bits.

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows and ties share a
    component. Other columns of ``docs`` are ignored. An empty table gives an empty one.
    """
    prints = written(fingerprints(docs, words, 1, id_col=id_col, text_col=text_col).select("doc_id", "fp", "minima"), "prints")
    out = near_groups(prints, 1, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints for a similarity rather than a radius: 256 bits, and keys from eight orders of the shingles.
LANES, MINIMA = 4, 8
#: Standard deviations of the distance above its mean that the search for candidates allows.
DEVIATIONS = 6
#: Shingles of a block of a shard whose links are checked.
BLOCK_SHINGLES = 1 << 20


def radius_for(similarity: float, lanes: int = LANES) -> int:
    """A Hamming distance that texts whose shingle sets have this Jaccard similarity hardly ever exceed."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * lanes * part + DEVIATIONS * math.sqrt(64 * lanes * part * (1 - part)))


def _set_of(text: str | None, words: int) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes, sorted, and a hash of them all."""
    own = np.unique(shingle_hashes(text, words))
    return own, xxhash.xxh64_intdigest(own.tobytes(), seed=SEED)


def set_prints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, fp array<long>, minima array<long>): as ``fingerprints``, of shingle sets.

    The last number of fp is the hash of the set, so rows with one fp have one set; row_key is a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(MINIMA)]
        for batch in batches:
            prints, firsts = [], []
            for text in batch.column("text").to_pylist():
                own, name = _set_of(text, words)
                prints.append(np.append(simhash(own, LANES), np.uint64(name)))
                firsts.append(np.array([mix(own ^ o).min() if len(own) else 0 for o in orders], dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), _as_lists(prints), _as_lists(firsts)], names=["doc_id", "row_key", "fp", "minima"])

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return one.mapInArrow(run, "doc_id long, row_key long, fp array<long>, minima array<long>")


def _sets(words: int):
    """(fp, text) -> (fp, shingles), where the text has the set that fp names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                last = np.asarray(part.column("fp").flatten()).view(np.uint64).reshape(len(part), -1)[:, -1].tolist()
                found = [_set_of(text, words) for text in part.column("text").to_pylist()]
                keep = pa.array([i for i, (_, name) in enumerate(found) if name == last[i]], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("fp").take(keep), _as_lists([found[i][0] for i in keep.to_pylist()])], names=["fp", "shingles"])

    return run


def similar_groups(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", tree_size: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, common: int = 1 << 12) -> DataFrame:
    """(fp, doc_id, row_key, component_id): texts link where the Jaccard similarity of their shingle sets is ``similarity`` or more.

    BK-trees give candidates; only these have their sets made again and dealt to the shards where they have a hit.
    There every hit that joins two groups is checked on the sets, so a shard of copies costs one look each.
    """
    prints = written(set_prints(docs, words, id_col, text_col), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.max("minima").alias("minima")), "fingerprints")
    radius = radius_for(similarity)
    members = minima_members(nodes.select("fp", "minima"), common)
    close = _sorted_shards(_dealt(members, block_size=tree_size)).mapInArrow(_close(LANES, radius), "key long, fp array<long>")
    close = written(close.distinct(), "close")
    wanted = written(close.select("fp").distinct().join(nodes.select("fp", "row_key"), "fp"), "wanted")
    texts, _ = Marks(wanted.select("row_key")).split(docs.select(F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text")), F.col("row_key"))
    texts = texts.join(wanted, "row_key").select("fp", "text").distinct()
    sets = written(texts.mapInArrow(_sets(words), "fp array<long>, shingles array<long>"), "sets")
    sized = close.join(sets.select("fp", F.size("shingles").alias("size")), "fp")
    rows = written(_dealt(sized, F.sum("size"), block_shingles, tree_size), "dealt").join(sets, "fp")
    links = _sorted_shards(rows.select("key", "one", "two", "block", "fp", "shingles")).mapInArrow(_checked(LANES, radius, similarity), "a array<long>, b array<long>")
    return _classes(prints.select("doc_id", "row_key", "fp"), nodes.select("fp", "least"), links)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document (the smallest id) of each group of near-duplicates; same columns.

    Texts link where the Jaccard similarity of their ``words``-word shingles is at least ``similarity``, by exact sets.
    What is not looked at: two such texts miss all eight MinHash keys once in 390,000 at 0.8, and fingerprints
    are hardly ever further apart than the radius. Rows with a null id are never dropped, nor rows that repeat the id that stays.
    Null, empty and wordless texts are near-duplicates of one another; an empty table stays empty.
    """
    groups = similar_groups(docs, words, similarity, id_col, text_col)
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct(), "gone")
    maybe, kept = Marks(gone.select("gone_key")).split(docs, F.xxhash64(text_col))
    same_row = (maybe[id_col].cast("long") == gone["gone_id"]) & (F.xxhash64(maybe[text_col]) == gone["gone_key"])
    return kept.union(maybe.join(gone.hint("merge"), same_row, "left_anti"))
