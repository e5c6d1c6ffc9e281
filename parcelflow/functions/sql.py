"""The search predicates as SQL functions, for queries written in ``spark.sql``.

``register`` makes temporary functions of built-in expressions, which Catalyst inlines. What is dear stands in branches, as text, since a
function called in a branch would be evaluated for every row:

    word_similarity(query, text)                   as ``trigram.word_similarity``; NULL if either is
    fuzzy_match(query, text, threshold)            whether it reaches the threshold, looking closer only at texts that may
    geodesic_metres(lat, lng, to_lat, to_lng)      as ``geo.geodesic``
    within_radius(lat, lng, to_lat, to_lng, metres)   as ``geo.reached``; false where a coordinate is NULL

Functions of these may not be called inside a lambda; that is a limit of Spark's SQL functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import FLATTENING, A, B


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


_GRAMS = r"""flatten(transform(filter(split(lower(text), r'[^\p{L}\p{N}]+'), w -> w <> ''),
  w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3))))"""

#: Of the trigrams q (distinct) and t (in order): the best Jaccard similarity of q with a run of t.
_PART = "array_distinct(slice(t, a, b - a + 1))"
_RUN = _let("part", _PART, _let("shared", "size(array_intersect(part, q))", "shared / (size(q) + size(part) - shared)"))
_BEST = f"""coalesce({_let("hits", "filter(sequence(1, size(t)), i -> size(t) > 0 and array_contains(q, get(t, i - 1)))",
    f"array_max(transform(hits, a -> array_max(transform(filter(hits, b -> b >= a), b -> {_RUN}))))")}, 0D)"""

_F, _SECOND = f"{FLATTENING!r}D", f"{(A * A - B * B) / (B * B)!r}D"


def _terms(lam: str, then: str) -> str:
    """``then`` with the auxiliary values of Vincenty's formula at a longitude difference as x (ss, cs, sa, m), c2."""
    sines = f"named_struct('ss', sqrt(pow(p.cu2 * sin({lam}), 2) + pow(p.cu1 * p.su2 - p.su1 * p.cu2 * cos({lam}), 2)), 'cs', p.su1 * p.su2 + p.cu1 * p.cu2 * cos({lam}), 'up', p.cu1 * p.cu2 * sin({lam}))"
    with_alpha = "named_struct('ss', y.ss, 'cs', y.cs, 'sa', if(y.ss = 0, 0D, y.up / y.ss))"
    with_middle = "named_struct('ss', z.ss, 'cs', z.cs, 'sa', z.sa, 'c2', 1 - z.sa * z.sa, 'm', if(1 - z.sa * z.sa < 1e-12, 0D, z.cs - 2 * p.su1 * p.su2 / (1 - z.sa * z.sa)))"
    return _let("y", sines, _let("z", with_alpha, _let("x", with_middle, then)))


def _vincenty(turns: int) -> str:
    """Of p: su1, cu1, su2, cu2 (sines and cosines of reduced latitudes) and l (difference of longitudes)."""
    k = f"{_F} / 16 * x.c2 * (4 + {_F} * (4 - 3 * x.c2))"
    step = _let("k", k, f"p.l + (1 - k) * {_F} * x.sa * (atan2(x.ss, x.cs) + k * x.ss * (x.m + k * x.cs * (-1 + 2 * x.m * x.m)))")
    state = f"aggregate(sequence(1, {turns}), named_struct('now', p.l, 'before', p.l + 1), (s, n) -> named_struct('now', {_terms('s.now', step)}, 'before', s.now))"
    big = "1 + sq / 16384 * (4096 + sq * (-768 + sq * (320 - 175 * sq)))"
    small = "sq / 1024 * (256 + sq * (-128 + sq * (74 - 47 * sq)))"
    cube = "small / 6 * x.m * (-3 + 4 * x.ss * x.ss) * (-3 + 4 * x.m * x.m)"
    delta = f"small * x.ss * (x.m + small / 4 * (x.cs * (-1 + 2 * x.m * x.m) - {cube}))"
    metres = _let("sq", f"x.c2 * {_SECOND}", _let("small", small, f"{B!r}D * ({big}) * (atan2(x.ss, x.cs) - {delta})"))
    return _let("e", state, f"if(abs(e.now - e.before) < 1e-9, {_terms('e.now', metres)}, cast(null as double))")


_REDUCED = "atan(" + repr(1 - FLATTENING) + "D * tan(radians({0})))"
_PLACE = "named_struct(" + ", ".join(f"'{f[0]}u{n}', {f}({_REDUCED.format(x)})" for n, x in ((1, "to_lat"), (2, "lat")) for f in ("sin", "cos")) + ", 'l', radians(lng - to_lng))"
_GEODESIC = _let("p", _PLACE, _vincenty(12))
_SPHERE = f"""{2 * (2 * A + B) / 3!r}D * asin(sqrt(least(1D, pow(sin(radians(lat - to_lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(to_lat)) * pow(sin(radians(lng - to_lng) / 2), 2))))"""
_PLACES = "lat DOUBLE, lng DOUBLE, to_lat DOUBLE, to_lng DOUBLE"

#: (signature, result, body); each may use those before it.
FUNCTIONS = [
    ("text_trigrams(text STRING)", "ARRAY<STRING>", _GRAMS),
    ("best_trigram_run(q ARRAY<STRING>, t ARRAY<STRING>)", "DOUBLE", _BEST),
    ("word_similarity(query STRING, text STRING)", "DOUBLE", "if(query is null or text is null, null, best_trigram_run(array_distinct(text_trigrams(query)), text_trigrams(text)))"),
    # a run shares no more trigrams than the whole text does
    ("run_reaches(q ARRAY<STRING>, t ARRAY<STRING>, threshold DOUBLE)", "BOOLEAN", f"if(size(array_intersect(t, q)) >= threshold * size(q) - 1e-9, {_BEST} >= threshold, false)"),
    ("fuzzy_match(query STRING, text STRING, threshold DOUBLE)", "BOOLEAN", "if(query is null or text is null, null, run_reaches(array_distinct(text_trigrams(query)), text_trigrams(text), threshold))"),
    (f"geodesic_metres({_PLACES})", "DOUBLE", _GEODESIC),
    # the sphere's distance decides but for a ring
    (f"within_radius({_PLACES}, metres DOUBLE)", "BOOLEAN", f"coalesce({_let('far', _SPHERE, f'case when far <= metres * 0.993D then true when far >= metres * 1.007D then false else {_GEODESIC} <= metres end')}, false)"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL; doing so again changes nothing."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
