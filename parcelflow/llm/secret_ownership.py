"""Secret scans with corpus-wide ownership frequency.

Patterns and a test for random-looking tokens give candidates. A candidate's value (only its SHA-256 leaves the
document) is looked up in the whole corpus: a value that several owners or repositories hold is a copied example,
one that a single owner holds looks live. Random-looking tokens are reported only where they look live; pattern
matches always, with the number that look live beside.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("assign", "access", "hex")
ADDED = "random"
#: A value with at least so many distinct owners or repositories is an example.
EXAMPLE_OWNERS = 3
ENTROPY = 3.5

# Fixed patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def random_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens outside of ``base`` with digits, both cases and high entropy."""
    out, at = [], 0
    ends = sorted((a, b) for a, _, b, _ in base)
    for m in _RANDOM.finditer(text):
        v = m[0]
        if not (re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v)) or entropy(v) < ENTROPY:
            continue
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not any(a < m.end() and b > m.start() for a, b in ends[at : at + 4]):
            out.append((m.start(), len(KINDS), m.end(), v))
    return out


_FOUND = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,hash:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
    for batch in batches:
        counts, hashes, found = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            n = Counter(k for _, k, _, _ in base)
            counts.append([n[k] for k in range(3)])
            hashes.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest())
            found.append([{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()} for a, k, b, v in base + random_spans(text or "", base)])
        numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        columns = [batch.column("doc_id"), batch.column("owner"), batch.column("repository"), *numbers, pa.array(hashes, pa.string()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """``candidates`` (hash, owner, repository) -> (hash, owners, repositories); a missing owner is one of its own."""
    each = candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("pairs"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example), one row per row of ``docs``.

    Counts and hash are those of the pattern matches; ``spans`` has the added ones too. Null text counts as empty.
    Rows that repeat id and secrets get the same result each. A missing owner or repository is one of its own. Other columns
    are ignored; an empty table gives an empty one.
    """
    one = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository")
    )
    rows = written(one.mapInArrow(_scan, _FOUND), "secrets").withColumn("key", F.xxhash64("doc_id", "found"))
    each = rows.where(F.size("found") > 0).select("doc_id", "key", "owner", "repository", F.explode("found").alias("f"))
    known = written(ownership(each.select("f.hash", "owner", "repository")), "ownership")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_owners)
    judged = each.select("doc_id", "key", "f.hash", "f.start", "f.kind", "f.end").join(known, "hash").select("doc_id", "key", F.struct("start", "kind", "end", live.alias("live")).alias("s"))
    by_row = judged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    by_row = by_row.withColumnsRenamed({"doc_id": "its_doc", "key": "its_key"})
    same = F.col("key").eqNullSafe(F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_doc"))
    joined = rows.join(by_row, same, "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,live:boolean>>)")).alias("all"))
    shown = F.filter("all", lambda s: (s["kind"] < len(KINDS)) | s["live"])
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(shown, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
