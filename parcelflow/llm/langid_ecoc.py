"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit, a binary naive-Bayes classifier over hashed character 1- to 3-grams says
how much the text looks like the languages whose bit is set. Decoding takes the codeword with the least loss, the
loss of a bit being the logistic loss of its margin weighted by how well that bit told the languages apart in
training; a close second marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sampled
from .words import slices

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Bound of the fit: rows that it learns from (chosen by a hash of id and text; whole texts).
LEARN_ROWS = 20_000
#: Texts whose best language has less than this share are flagged.
AMBIGUOUS = 0.6
_SHARPNESS = 3.0
_SLICE = 1 << 18  # bytes of text whose n-grams are looked at together; they take some 120 times as much
_is_letter: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's letter classes."""
    return any(map(str.isalpha, text or ""))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every character n-gram that has a letter; case is ignored, non-letters are gaps."""
    if not _is_letter:
        _is_letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    text = np.cumsum(code == 0)
    c = np.where(_is_letter[0][code], code, 0).astype(np.uint32)
    gap = np.zeros(1, dtype=np.uint32)
    before = np.concatenate([gap, c[:-1]]) if len(c) else c
    ahead = np.concatenate([gap, before[:-1]]) if len(c) else c
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)

    def hashed(*parts: np.ndarray) -> np.ndarray:
        h = np.full(len(c), len(parts), dtype=np.uint32)
        for p in parts:
            h = (h ^ p) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (h * np.uint32(0x85EBCA77)) >> shift

    found, owner = [], []
    for grams, here in ((hashed(c), c != 0), (hashed(before, c), (c != 0) | (before != 0)), (hashed(ahead, before, c), before != 0)):
        at = np.flatnonzero(here)
        found.append(grams[at])
        owner.append(text[at])
    return np.concatenate(found), np.concatenate(owner)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1, rows and columns all different.

    Up to seven languages: the exhaustive code (all splits). Beyond: random splits, eight for each doubling and 24
    more, drawn from a fixed seed.
    """
    if n <= 7:
        splits = np.arange(1, 1 << max(n - 1, 1))
        bits = splits[None, :] >> np.arange(n)[:, None] & 1
        return np.where(bits[:, : max(1, (1 << (n - 1)) - 1)], 1, -1)
    rng = np.random.default_rng(7)
    width = 24 + 8 * int(np.ceil(np.log2(n)))
    return np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(width)], axis=1)


@dataclass
class Model:
    """languages, their codewords, and for each bit: weight of each bucket, scale of the margin, weight in the loss."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LEARN_ROWS) -> Model:
    """Learn from labelled ``docs``: about ``rows`` whole texts, chosen by a hash of id and text.

    The n-grams are counted on the executors; the driver gets the counts by language and bucket, whose number the rows and
    BUCKETS bound. Rows with null text or language teach nothing; without labelled rows nothing is learned.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chosen = labelled.where(sampled(F.xxhash64("id", "text"), rows, labelled.count())).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                langs = part.column("lang").to_pylist()
                gram, owner = _grams(part.column("text").to_pylist())
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])
                    counts[lang] = counts.get(lang, 0) + np.bincount(gram[own[owner]], minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return _model(counted.column("lang").to_pylist(), counted.column("bucket").to_numpy(), counted.column("n").to_numpy())


def _model(langs: list[str], bucket: np.ndarray, n: np.ndarray) -> Model:
    """The model of n-gram counts, one entry for each language and bucket that occurs."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), *[np.zeros(0)] * 3)
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in langs])
    order = np.lexsort((bucket, lang))
    lang, bucket, n = lang[order], bucket[order], n[order]
    size = len(languages)
    all_of = np.bincount(lang, weights=n, minlength=size) + 0.5 * BUCKETS
    base, part = 0.5 / all_of, n / all_of[lang]  # share of a bucket: base, and part where it occurs; languages count alike
    code = codewords(size)

    def mean(of: np.ndarray) -> np.ndarray:
        of = of if of.any() else np.ones(size, dtype=bool)
        return (base[of].sum() + np.bincount(bucket, weights=part * of[lang], minlength=BUCKETS)) / of.sum()

    weight, centre, scale, trust = [], [], [], []
    for bit in code.T:
        w = np.log(mean(bit == 1) / mean(bit == -1))
        means = base * w.sum() + np.bincount(lang, weights=part * w[bucket], minlength=size)  # the margin to expect of each language
        high, low = (means[bit == s].mean() if (bit == s).any() else 0.0 for s in (1, -1))
        weight.append(w.astype(np.float32))
        centre.append((high + low) / 2)
        scale.append(max((high - low) / 2, 1e-9))
        trust.append(min(1.0, (bit * (means - centre[-1]) / scale[-1]).min() + 1e-3) if size > 1 else 1.0)
    return Model(languages, code, np.stack(weight, axis=1), np.array(centre), np.array(scale), np.maximum(np.array(trust), 0.05))


def decode(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    has = [has_letter(t) for t in texts]
    if not model.languages or not any(has):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    gram, owner = _grams([t or "" for t in texts])
    n = np.bincount(owner, minlength=len(texts))
    margin = np.stack([np.bincount(owner, weights=model.weight[gram, b], minlength=len(texts)) for b in range(model.code.shape[1])], axis=1)
    margin = np.clip((margin / np.maximum(n, 1)[:, None] - model.centre) / model.scale, -3, 3)
    loss = np.stack([(model.trust * np.logaddexp(0, -_SHARPNESS * margin * word)).sum(axis=1) for word in model.code], axis=1)
    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share = odds / odds.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    score = np.where(has, share.max(axis=1), 0.0)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score, np.array(has) & (score < AMBIGUOUS)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``; only the text is an input.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Texts are judged whole.
    """
    names, types = docs.columns, docs.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, _SLICE):
                lang, score, unsure = decode(model, part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per row: learned from the rows that are not held out.

    Null, empty and letterless texts are ``und`` with score 0, and so are all where no row is labelled. Repeated rows get the
    same result; other columns are ignored; an empty table gives an empty one.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those whose language cannot be told: null or letterless text, or ambiguous; same columns.

    Where no row is labelled nothing can be told and nothing stays. Repeated rows are judged alike.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, _SLICE):
                lang, _, unsure = decode(model, part.column(text_col).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and not u for x, u in zip(lang, unsure.tolist(), strict=True)]))

    return docs.mapInArrow(run, docs.schema)
