"""Personal data: pattern matches, and a skip-chain conditional random field that makes labels consistent.

Emails, IP addresses, payment cards and phone numbers are found by patterns. What the patterns cannot see is that a
number or name elsewhere in the document is the same one, written otherwise: a phone number without its plus sign or its
country code, a card with a digit mistyped, the part of an address before the @. All such mentions of a document are the
nodes of a conditional random field over the labels none, email, ip, card and phone. Neighbouring mentions share a
transition potential (the chain); mentions of one key share a skip potential, however far apart, and so, with a
potential of their own, do mentions of similar keys (one edit apart, or the last seven or more digits of a phone number). Each
mention has at most one skip edge of either kind to an earlier one, never all pairs. Loopy sum-product message passing gives
each mention's beliefs; mentions that no pattern matched are reported where a label other than none has more than half.

All potentials are trained, by pseudo-likelihood, on a bounded sample of documents that the patterns label. For each
match the training also sees it written otherwise (without what made the pattern match), so that the skip potentials learn
how much a twin says; the same without a twin, and numbers that no pattern matched, teach what personal data is not.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sampled

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Bound of the fit: documents (chosen by a hash of id and text; whole texts).
LEARN_ROWS = 5_000
CHAIN_GAP = 80  # characters between neighbours of the chain
STEPS, PENALTY = 400, 0.02
SWEEPS, TOLERANCE = 30, 1e-4

# Fixed patterns. A run that is looked at from its start alone, and possessive repeats, keep them linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])++")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{5,}+")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_JOINTS = re.compile(r"[._%+-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``local@domain`` searched from the left: each @ takes all local characters before it since the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)  # an @ ends whatever could be local
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


@dataclass
class Mention:
    start: int
    end: int
    label: int  # what a pattern says; 0: no pattern matched
    key: str
    shape: str


def _shape(kind: str, text: str) -> str:
    """What a mention looks like, without what makes a pattern match: digits, what parts them, check digit; or a name."""
    if kind == "name":
        return "name"
    digits, parts = _digits(text), {c for c in text if not c.isdigit() and c != "+"}
    return f"{min(len(digits), 20)}{'.' if '.' in parts else '-' if parts else ''}{'c' if 13 <= len(digits) <= 19 and luhn(digits) else ''}"


def _name_key(name: str) -> str:
    return _JOINTS.sub("", name).lower()


def _told_apart(name: str) -> bool:
    """Whether a name is hardly a common word: it has digits or joints, or ten letters."""
    return len(name) >= 5 and (len(name) >= 10 or re.search(r"[0-9._%+-]", name) is not None)


def _runs(text: str, m: re.Match, keys: set[str], ends: set[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, key) of the mentions in a run of numbers: stretches of whole groups that are a known key, an ip's
    four groups, or a key's last digits, longest first; what lies between, if it has seven to nineteen digits."""
    groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
    i = free = 0

    def rest(a: int, b: int) -> Iterator[tuple[int, int, str]]:
        digits = "".join(text[x:y] for x, y in groups[a:b])
        if 7 <= len(digits) <= 19:
            yield groups[a][0], groups[b - 1][1], digits

    while i < len(groups):
        best, digits = None, ""
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            four = ".".join(text[x:y] for x, y in groups[i : j + 1]) if j == i + 3 else ""
            if four in keys or digits in keys or digits in ends:
                best = j, four if four in keys else digits
        if best is None:
            i += 1
            continue
        yield from rest(free, i)
        j, key = best
        yield groups[i][0], groups[j][1], key
        i = free = j + 1
    yield from rest(free, len(groups))


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Mention]:
    """What patterns matched, and the numbers and names outside of that; by position."""
    out, names, keys, ends = [], set(), set(), set()
    for kind, a, b in base:
        own = text[a:b]
        key = _name_key(own.partition("@")[0]) if kind == "email" else own if kind == "ip" else _digits(own)
        if kind == "email":
            if _told_apart(own.partition("@")[0]):
                names.add(key)
        else:
            keys.add(key)
        if kind == "phone":
            ends.update(key[i:] for i in range(1, len(key) - 6))
        out.append(Mention(a, b, LABELS.index(kind), key, _shape("name" if kind == "email" else kind, own)))
    taken = np.zeros(len(text) + 1, dtype=bool)
    for _, a, b in base:
        taken[a:b] = True
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            for a, b, key in _runs(text, m, keys, ends):
                if not taken[a:b].any():
                    out.append(Mention(a, b, 0, key, _shape("number", text[a:b])))
                    taken[a:b] = True
    if names:
        near = {cut for name in names if len(name) >= 8 for cut in _cuts(name)}
        for m in _NAME.finditer(text):
            own = m[0].rstrip(".")
            key = _name_key(own)
            if (key in names or len(key) >= 8 and _told_apart(own) and any(c in near for c in _cuts(key))) and not taken[m.start() : m.end()].any():
                out.append(Mention(m.start(), m.start() + len(own), 0, key, "name"))
    return sorted(out, key=lambda x: (x.start, x.end, x.label))


_PRIME, _BASE, _ANY = (1 << 61) - 1, 0x1F3D5B79A2C4E6F, 0x110001


def _hash(key: str) -> int:
    """A polynomial of the characters' numbers modulo 2^61 - 1."""
    h = 0
    for c in key:
        h = (h * _BASE + ord(c) + 1) % _PRIME
    return h


def _cuts(key: str) -> Iterator[int]:
    """Hashes of a key, of the key with any one character open, and without any one: keys that are one edit apart have one of these in common.

    They come from the hashes of what is before and after the character, so that a key of any length takes time in proportion to it.
    """
    before, power = [0], [1]
    for c in key:
        before.append((before[-1] * _BASE + ord(c) + 1) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    n = len(key)
    yield before[n]
    for i in range(n):
        after = (before[n] - before[i + 1] * power[n - i - 1]) % _PRIME
        yield ((before[i] * _BASE + _ANY) * power[n - i - 1] + after) % _PRIME
        yield (before[i] * power[n - i - 1] + after) % _PRIME


def edges(nodes: list[Mention]) -> tuple[list[int], list[int], list[int]]:
    """(from, to, kind) of each edge: 0 neighbours, 1 equal keys, 2 similar keys (of which one is a pattern's)."""
    a, b, kind = [], [], []
    last: dict[str, int] = {}
    like: dict[int, int] = {}

    def link(x: int, y: int, k: int) -> None:
        a.append(min(x, y))
        b.append(max(x, y))
        kind.append(k)

    matched = [i for i, m in enumerate(nodes) if m.label]
    for i in matched:  # what a later mention can be similar to
        for cut in _cuts(nodes[i].key) if len(nodes[i].key) >= 8 and nodes[i].label != 2 else ():
            like.setdefault(cut, i)
        if nodes[i].label == 4:
            for j in range(1, len(nodes[i].key) - 6):
                like.setdefault(_hash(nodes[i].key[j:]), i)
    same = {nodes[i].key for i in matched}
    for i, m in enumerate(nodes):
        if i and m.start - nodes[i - 1].end <= CHAIN_GAP:
            link(i - 1, i, 0)
        if m.key in last:
            link(last[m.key], i, 1)
        elif not m.label and m.key not in same:
            found = next((like[c] for c in (_cuts(m.key) if len(m.key) >= 8 else [_hash(m.key)]) if c in like), None)
            if found is not None:
                link(found, i, 2)
        last[m.key] = i
    return a, b, kind


@dataclass
class Potentials:
    """Log-potentials: of each shape (unseen ones: none), of what a pattern says, and of the labels at an edge by its kind."""

    shape: dict[str, np.ndarray] = field(default_factory=dict)
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((3, 5, 5)))


def beliefs(nodes: list[Mention], p: Potentials) -> np.ndarray:
    """Label probabilities of each mention, by damped loopy sum-product message passing."""
    n = len(nodes)
    unary = np.array([p.shape.get(m.shape, 0) + p.evidence[m.label] for m in nodes])
    a, b, kind = edges(nodes)
    if not a:
        return _softmax(unary)
    ahead = p.pair[np.array(kind)]
    source, target = np.array(a + b), np.array(b + a)
    pair = np.concatenate([ahead, ahead.transpose(0, 2, 1)])
    back = np.roll(np.arange(2 * len(a)), len(a))
    message = np.zeros((2 * len(a), 5))
    for _ in range(SWEEPS):
        total = unary.copy()
        np.add.at(total, target, message)
        out = (total[source] - message[back])[:, :, None] + pair
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        done = np.abs(new - message).max() < TOLERANCE
        message = 0.5 * message + 0.5 * new if not done else new
        if done:
            break
    total = unary.copy()
    np.add.at(total, target, message)
    return _softmax(total)[:n]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def inferred(text: str, base: list[tuple[str, int, int]], p: Potentials) -> tuple[list[tuple[str, int, int]], int]:
    """Mentions without a match of their own that message passing labels, and how many such mentions it judged."""
    nodes = mentions(text, base)
    open_ = [i for i, m in enumerate(nodes) if not m.label]
    if not open_:
        return [], 0
    found = beliefs(nodes, p)[open_]
    best = found.argmax(axis=1)
    return [(LABELS[k], nodes[i].start, nodes[i].end) for i, k, q in zip(open_, best, found.max(axis=1), strict=True) if k and q > 0.5], len(open_)


def _otherwise(m: Mention) -> Iterator[tuple[str, int]]:
    """(shape, kind of edge) of a match written otherwise: without what made the pattern match, and not quite the same."""
    yield m.shape, 1
    plain = str(min(len(m.key), 20)) if m.label in (3, 4) else m.shape
    yield plain + "c" * (m.shape.endswith("c") and plain != m.shape), 1
    if m.label != 2 and len(m.key) >= 8:
        yield plain, 2
    if m.label == 4:
        yield from ((str(n), 2) for n in range(7, len(m.key)))


def examples(text: str) -> Iterator[tuple[str, int, int, int, int, int, int]]:
    """(shape, match, label left, label right, label of the equal, of the similar, label) of each mention, -1 for no such
    neighbour; and of each match written otherwise, as if it stood elsewhere, with and without its twin."""
    nodes = mentions(text, base_spans(text))
    around = np.full((len(nodes), 4), -1)
    for a, b, kind in zip(*edges(nodes), strict=True):
        if kind:
            around[a, 1 + kind], around[b, 1 + kind] = nodes[b].label, nodes[a].label
        else:
            around[a, 1], around[b, 0] = nodes[b].label, nodes[a].label
    matched = {m.key for m in nodes if m.label}
    for m, near in zip(nodes, around.tolist(), strict=True):
        if m.label or m.key not in matched and near[3] < 1:  # what a twin of a match is, the patterns do not tell
            yield (m.shape, m.label, *near, m.label)
        for shape, kind in _otherwise(m) if m.label else ():
            yield (shape, 0, -1, -1, *((m.label, -1) if kind == 1 else (-1, m.label)), m.label)
            # the same without a twin, by itself or next to a match, is nothing, and so is a twin of nothing
            yield from ((shape, 0, left, right, twin, -1, 0) for left, right, twin in ((-1, -1, -1), (m.label, -1, -1), (-1, m.label, -1), (-1, -1, 0)))


def train(counts: list[tuple[tuple[str, int, int, int, int, int, int], int]]) -> Potentials:
    """Potentials that maximise the pseudo-likelihood of ``counts`` of examples, with a quadratic penalty."""
    p = Potentials()
    if not counts:
        return p
    names = sorted({c[0] for c, _ in counts})
    shape = np.array([names.index(c[0]) for c, _ in counts])
    match, left, right, equal, similar, label = np.array([c[1:] for c, _ in counts]).T
    weight = np.sqrt([n for _, n in counts])[:, None]
    weight /= weight.sum()
    want = np.eye(5)[label]
    one = lambda x: np.eye(6)[x][:, :5]  # noqa: E731  -1 is a row of zeros
    sides = one(left), one(right), one(equal), one(similar)
    by_shape, by_match = np.eye(len(names))[shape], np.eye(5)[match]
    # what all labels share is a parameter of its own, so that rare kinds learn from frequent ones
    own = {"shape": np.zeros((len(names), 5)), "match": np.zeros((5, 5)), "chain": np.zeros((5, 5)), "equal": np.zeros((5, 5)), "similar": np.zeros((5, 5)), "agree": np.zeros(3)}
    personal, same = np.diag([0.0, 1, 1, 1, 1]), np.eye(5)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in own.items()}

    def whole() -> tuple[np.ndarray, np.ndarray]:
        two = [own[k] + own[k].T + own["agree"][1 + i] * same for i, k in enumerate(("equal", "similar"))]
        return own["match"] + own["agree"][0] * personal, np.stack([own["chain"], *two])

    for step in range(1, STEPS + 1):
        evidence, pair = whole()
        score = by_shape @ own["shape"] + by_match @ evidence + sides[0] @ pair[0] + sides[1] @ pair[0].T + sides[2] @ pair[1] + sides[3] @ pair[2]
        off = weight * (_softmax(score) - want)
        g = {"shape": by_shape.T @ off, "match": by_match.T @ off, "chain": sides[0].T @ off + off.T @ sides[1], "equal": sides[2].T @ off, "similar": sides[3].T @ off}
        g["agree"] = np.array([(g["match"] * personal).sum(), (g["equal"] * same).sum(), (g["similar"] * same).sum()])
        for k in ("equal", "similar"):
            g[k] = g[k] + g[k].T
        for k, v in own.items():
            first, second = moment[k]
            slope = g[k] + PENALTY * 0.01 * v
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            v -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    p.shape = dict(zip(names, own["shape"], strict=True))
    p.evidence, p.pair = whole()
    return p


_EXAMPLE = ("shape", "match", "left", "right", "equal", "similar", "label")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LEARN_ROWS) -> Potentials:
    """Train on about ``rows`` whole texts; the driver gets how often each kind of example occurs, a bounded table."""
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chosen = one.where(sampled(F.xxhash64("id", "text"), rows, one.count())).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(examples(text))
        columns = list(zip(*found, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:]], pa.array(found.values(), pa.int64())], names=[*_EXAMPLE, "n"])

    schema = "shape string, " + ", ".join(f"`{c}` int" for c in _EXAMPLE[1:]) + ", n long"
    counts = chosen.mapInArrow(count, schema).groupBy(*[f"`{c}`" for c in _EXAMPLE]).agg(F.sum("n").alias("n"))
    return train(sorted(((tuple(r)[:7], r["n"]) for r in counts.collect())))


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_judged), one row per row of ``docs``.

    Counts and hash are those of the pattern matches; ``spans`` has the added ones too. ``n_judged`` is how many mentions
    without a match message passing judged, ``n_added`` how many it labelled. Null counts as empty; an empty table gives
    an empty one. Other columns are ignored. Each text is read whole, on its own; no shuffle but that of the fit's counts.
    """
    potentials = fit(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans, extra = [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more, judged = inferred(text or "", base, potentials)
                kinds = Counter(k for k, _, _ in base)
                counts.append([kinds[k] for k in KINDS])
                hashes.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
                extra.append((len(more), judged))
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            last = [pa.array([e[i] for e in extra], pa.int64()) for i in range(2)]
            columns = [batch.column("doc_id"), *numbers, pa.array(hashes, pa.string()), pa.array(spans, pa.string()), *last]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_judged"])

    one = docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text"))
    return one.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_judged long")
