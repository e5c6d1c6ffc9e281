"""Members of JSON texts as they are written: numbers, escapes and blanks inside a value stay as the feed has sent them.

Spark's own parsers read a value and write it again, which makes 250000.0 of 250000.00. These find where values begin and end, and cut the text there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

_scan = json.JSONDecoder(parse_int=str, parse_float=str).scan_once  # (value, its end); only where a value ends matters
_NOT = (ValueError, IndexError, RecursionError, StopIteration)  # what a text that is no JSON raises
_BLANKS = " \t\n\r"
_BLANK = re.compile(f"[{_BLANKS}]*")


def _skip(text: str, at: int) -> int:
    return _BLANK.match(text, at).end() if text[at : at + 1] in _BLANKS else at


def members(text: str, lists: dict[str, list[str] | None] | None = None, names: Collection[str] = ()) -> list[tuple[str, int, int, int]] | None:
    """(key, where the key begins, where its value begins, where that ends) of an object's members; None if the text is no object.

    Of the members in ``names`` the texts of the elements are put into ``lists`` on the way, None for one that is no array.
    """
    scan, at, out = _scan, _skip(text, 0), []
    if text[at : at + 1] != "{":
        return None
    at = _skip(text, at + 1)
    if text[at : at + 1] == "}":
        return out if _skip(text, at + 1) == len(text) else None
    try:
        while True:  # blanks are looked for where the next character is none of those that may stand there
            if text[at] != '"':
                return None
            key, end = scan(text, at)
            if text[end] != ":":
                end = _skip(text, end)
                if text[end] != ":":
                    return None
            value = end + 1 if text[end + 1] not in _BLANKS else _skip(text, end + 1)
            if key in names:
                lists[key], end = _elements(text, value) if text[value] == "[" else (None, scan(text, value)[1])
            else:
                end = scan(text, value)[1]
            out.append((key, at, value, end))
            if text[end] in _BLANKS:
                end = _skip(text, end)
            if text[end] == "}":
                return out if _skip(text, end + 1) == len(text) else None
            if text[end] != ",":
                return None
            at = end + 1 if text[end + 1] not in _BLANKS else _skip(text, end + 1)
    except _NOT:
        return None


def _elements(text: str, at: int) -> tuple[list[str], int]:
    """The texts of the elements of the array that begins at ``at``, and where it ends; one of ``_NOT`` is raised if it is none."""
    scan, at, out = _scan, _skip(text, at + 1), []
    if text[at] == "]":
        return out, at + 1
    while True:
        end = scan(text, at)[1]
        out.append(text[at:end])
        if text[end] in _BLANKS:
            end = _skip(text, end)
        if text[end] == "]":
            return out, end + 1
        if text[end] != ",":
            raise ValueError(text[end])
        at = end + 1 if text[end + 1] not in _BLANKS else _skip(text, end + 1)


def items(text: str, at: int = 0) -> list[str] | None:
    """The texts of the elements of an array that begins at ``at``; None if there is none."""
    at = _skip(text, at)
    try:
        return _elements(text, at)[0] if text[at : at + 1] == "[" else None
    except _NOT:
        return None


def without(text: str, names: set[str]) -> str:
    """An object's text without some members; a text that is no object, or has none of them, as it is."""
    found = members(text)
    if not found or not any(m[0] in names for m in found):
        return text
    return "{" + ",".join(text[begin:end] for key, begin, _, end in found if key not in names) + "}"


@F.pandas_udf(ArrayType(StringType()))
def page_items(envelopes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The records of page envelopes: the elements of ``value``."""

    def one(text: str | None) -> list[str] | None:
        found = [m for m in (members(text) or []) if m[0] == "value"] if text else []
        return items(text, found[-1][2]) if found else None

    for batch in envelopes:
        yield batch.map(one)


def _cut(links: dict[str, str]):
    """A function of one payload: its text without the arrays named in ``links``, and the texts of the elements of each, without the link named there."""
    quoted_links = {n: (link, f'"{link}"') for n, link in links.items()}
    none = [None] * (1 + len(links))

    def one(text: str | None) -> list:
        arrays = {}
        found = members(text, arrays, links) if text else None
        if found is None:
            return none
        if not arrays:
            return [text, *none[1:]]
        kept = []
        for key, begin, value, end in found:
            if key not in links:
                kept.append(text[begin:end])
            elif arrays[key] and text.find(quoted_links[key][1], value, end) >= 0:
                link, quoted = quoted_links[key]
                arrays[key] = [without(x, {link}) if quoted in x else x for x in arrays[key]]
        return ["{" + ",".join(kept) + "}", *[arrays.get(n) for n in links]]

    return one


def record_cutter(links: dict[str, str]):
    """A function of payloads: the text without the embedded arrays named in ``links``, and the texts of the elements of each, without the link named there."""
    one = _cut(links)

    @F.pandas_udf(StructType([StructField("rest", StringType()), *[StructField(n, ArrayType(StringType())) for n in links]]))
    def cut(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in payloads:
            yield pd.DataFrame([one(t) for t in batch], columns=["rest", *links])

    return cut


def plainly_named(key: str):
    """A test of the text of a JSON value: True only if it is an object in which a string that is not empty has this name, False also where that would take a closer look.

    True leaves no room for another reader of JSON to see it otherwise: no escapes, no objects inside, the name once, no numbers that are none, no length
    at which parsers have limits.
    """
    quoted, named = f'"{key}"', re.compile(rf'"{re.escape(key)}"[{_BLANKS}]*:[{_BLANKS}]*"[^"]').search
    return lambda text: text[:1] == "{" and len(text) <= 1_000 and "\\" not in text and text.count("{") == text.count(quoted) == 1 and named(text) is not None and "NaN" not in text and "Infinity" not in text


def split_records(records: DataFrame, links: dict[str, str], keys: dict[str, str] | None = None, room: int = 1_000_000, most: int = 1 << 22) -> DataFrame:
    """Rows whose last column is a payload -> a row for each text that ``record_cutter`` makes of it, beside the other columns.

    ``kind`` is the array's number in ``links`` and ``pos`` the place in it, both -1 for what stays of the record; ``ord`` numbers the elements of
    all arrays, each array having ``room`` numbers or as many as the longest needs. Rows leave as rows, not as lists to be exploded; a batch of
    them ends after ``most`` characters of payloads. With ``keys``, by array, only elements leave, and of these not the ones that plainly have their key.
    """
    kept = [StructField(f.name, f.dataType) for f in records.schema.fields[:-1]]
    schema = StructType([*kept, StructField("kind", IntegerType()), StructField("pos", IntegerType()), StructField("ord", LongType()), StructField("text", StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _cut(links)
        plain = [plainly_named(keys[n]) for n in links] if keys else None
        for batch in batches:
            first, chars, counts, steps, places, texts = 0, 0, [], [], [], []
            payloads = batch.column(batch.num_columns - 1).to_pylist()
            for row, payload in enumerate(payloads):
                rest, *lists = one(payload)
                step = room
                if plain is None:
                    places.append(-1)
                    texts.append(rest)
                counts.append(plain is None)
                for kind, found in enumerate(lists):
                    some = found or ()
                    step = max(step, len(some))
                    if plain is None:
                        places += range(len(some))
                    elif some:
                        test = plain[kind]
                        left = [(at, text) for at, text in enumerate(some) if not test(text)]
                        places += [at for at, _ in left]
                        some = [text for _, text in left]
                    texts += some
                    counts.append(len(some))
                steps.append(step)
                chars += len(payload or "")
                if chars > most or row == len(payloads) - 1:
                    yield made(batch.slice(first, row + 1 - first), np.array(counts, dtype=np.int64), np.array(steps), np.array(places, dtype=np.int64), texts)
                    first, chars, counts, steps, places, texts = row + 1, 0, [], [], [], []

    def made(batch: pa.RecordBatch, counts: np.ndarray, steps: np.ndarray, places: np.ndarray, texts: list) -> pa.RecordBatch:
        """``counts`` are the texts of each payload: what stays of it, and those of each array."""
        kind = np.repeat(np.tile(np.arange(-1, len(links)), len(steps)), counts)
        row = np.repeat(np.arange(len(steps)), counts.reshape(len(steps), -1).sum(axis=1))
        number = np.where(kind < 0, -1, kind * steps[row] + places)
        columns = [c.take(pa.array(row)) for c in batch.columns[:-1]]
        columns += [pa.array(kind.astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(number), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return records.mapInArrow(split, schema)
