"""Personal data by exact patterns, and by a skip-chain conditional random field that adds what goes with them."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import parts_of
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 5_000     # documents with digits or @ that the field is fitted on
ROUNDS = 20          # of message passing, or until messages stand still
SURE = 0.5           # chance above which a token is marked

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_OF_INTEREST = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")
_EDGES = "\"'()[]{}<>,;:.!?="


def _emails(text: str):
    """Leftmost matches of the pattern, found from each @ outwards: a long run without @ costs nothing."""
    begin, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > begin and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            begin = domain.end()
        at = text.find("@", max(at + 1, begin))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of all exact patterns, by kind, then start; kinds may overlap each other."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Words with a digit or @, without punctuation at their edges: ``(start, end, number of the word)``."""
    if not _OF_INTEREST.search(text):
        return []
    found = []
    for n, m in enumerate(_TOKEN.finditer(text)):
        if _OF_INTEREST.search(m.group()):
            core = m.group().rstrip(_EDGES)
            start = m.start() + len(core) - len(core.lstrip(_EDGES))
            if start < m.start() + len(core):
                found.append((start, m.start() + len(core), n))
    return found


def features(token: str, before: str) -> tuple[int, ...]:
    """What is true of a token's shape and of the candidate before it."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = len(re.findall(r"(?<=[0-9])\.(?=[0-9])", token))
    at = token.find("@")
    bucket = next(i for i, most in enumerate((0, 2, 4, 6, 9, 12, 19, math.inf)) if digits <= most)
    number = "".join(c for c in token if c in "0123456789")
    plain = not token.strip("0123456789 -")
    return (1, plain and 13 <= digits <= 19 and _luhn(number), plain and 13 <= digits <= 19, at > 0, at > 0 and "." in token[at:], *(bucket == i for i in range(8)), digits == len(token), dots == 3, 0 < dots < 3,
            token.startswith("+"), before.startswith("+"), "-" in token and digits > 5, "(" in token or ")" in token,
            dots == 3 and not token.strip("0123456789.") and all(map(_small, token.split("."))), letters > 0 and digits > 0, letters > digits, "=" in token or "/" in token, len(token) > 30)


def skip_links(tokens: list[str]) -> list[tuple[int, int]]:
    """Pairs of repeated or similar tokens, however far apart: each with the last one before it that has the same
    letters and digits, the same last seven digits, or the same name before an @."""
    links, last = set(), {}
    for i, token in enumerate(tokens):
        bare = "".join(c for c in token.lower() if c.isalnum())
        digits = "".join(c for c in token if c in "0123456789")
        keys = [("same", bare)] if len(bare) > 2 else []
        if len(digits) >= 7:
            keys.append(("digits", digits[-7:]))
        name = token.lower().partition("@")[0]
        if len(name) > 4:
            keys.append(("name", name))
        for key in keys:
            if key in last:
                links.add((last[key], i))
            last[key] = i
    return sorted(links)


def covering(spans: list[tuple[int, int, int]], tokens: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token that an exact span overlaps, 0 for the others; labels are kinds counted from 1."""
    labels = np.zeros(len(tokens), dtype=np.int64)
    for kind in reversed(range(len(KINDS))):
        own = [(a, b) for k, a, b in spans if k == kind]
        j = 0
        for i, (start, end, _) in enumerate(tokens):
            while j < len(own) and own[j][1] <= start:
                j += 1
            if j < len(own) and own[j][0] < end:
                labels[i] = kind + 1
    return labels


def _table(text: str):
    spans, places = base_spans(text), candidates(text)
    tokens = [text[a:b] for a, b, _ in places]
    return spans, places, tokens, covering(spans, places)


def _observed(batches):
    """Counts of shapes with labels, of labels side by side, and of labels of linked tokens."""
    counts: Counter = Counter()
    for batch in batches:
        for text in (t for _, texts in parts_of(batch) for t in texts):
            _, places, tokens, labels = _table(text)
            for i, token in enumerate(tokens):
                shape = "".join("01"[bool(f)] for f in features(token, tokens[i - 1] if i else ""))
                counts["shape", shape, int(labels[i]), 0] += 1
                if i and places[i][2] - places[i - 1][2] <= 2:
                    counts["chain", "", int(labels[i - 1]), int(labels[i])] += 1
            for a, b in skip_links(tokens):
                counts["skip", "", int(labels[a]), int(labels[b])] += 1
    rows = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()),
         pa.array([r[3] for r in rows], pa.int32()), pa.array([counts[r] for r in rows], pa.int64())],
        names=["what", "shape", "one", "two", "n"])


def _softmax_weights(shapes: np.ndarray, labels: np.ndarray, counts: np.ndarray, steps: int = 500, hold: float = 0.01) -> np.ndarray:
    """Multinomial logistic regression on grouped rows by accelerated gradient steps."""
    classes = len(KINDS) + 1
    weights = np.zeros((shapes.shape[1], classes))
    moment = weights.copy()
    target = np.eye(classes)[labels]
    share = (counts / counts.sum())[:, None]
    for step in range(steps):
        ahead = weights + 0.9 * moment
        scores = shapes @ ahead
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = shapes.T @ (share * (p - target)) + hold * ahead / len(labels)
        moment = 0.9 * moment - 0.5 * gradient
        weights = weights + moment
    return weights


def fit(docs: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> dict:
    """The field's potentials, from the exact spans of at most ``rows`` documents that hold a digit or @, the first in
    hash order of their ids.

    Token potentials are a softmax regression on shapes; potentials of neighbours are how much more often than by
    chance two labels stand side by side; that of linked tokens is one weight for having the same label.
    """
    of_interest = docs.filter(F.col("text").rlike("[0-9@]") & F.col(key).isNotNull())
    chosen = of_interest.select(F.col(key).alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(rows)
    # At most ``rows`` ids are broadcast.
    sample = of_interest.join(F.broadcast(materialise(chosen, "field-ids")), F.col(key) == F.col("_chosen"), "left_semi").select("text")
    counted = sample.mapInArrow(_observed, "what string, shape string, one int, two int, n long").groupBy("what", "shape", "one", "two").agg(F.sum("n").alias("n"))
    found = counted.orderBy("what", "shape", "one", "two").collect()
    classes = len(KINDS) + 1
    shapes = [r for r in found if r["what"] == "shape"]
    pairs = np.ones((classes, classes))
    linked = {True: 1.0, False: 1.0}
    for r in found:
        if r["what"] == "chain":
            pairs[r["one"], r["two"]] += r["n"]
        elif r["what"] == "skip":
            linked[r["one"] == r["two"]] += r["n"]
    pairs /= pairs.sum()
    chain = np.clip(np.log(pairs / (pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True))), -2, 2)
    if shapes:
        token = _softmax_weights(np.array([[float(c) for c in r["shape"]] for r in shapes]), np.array([r["one"] for r in shapes]), np.array([float(r["n"]) for r in shapes]))
    else:
        token = np.zeros((len(features("", "")), classes))
    return {"token": token, "chain": chain, "skip": min(max(math.log(linked[True] / linked[False]), 0.5), 4.0) * np.eye(classes)}


def marginals(unary: np.ndarray, one: np.ndarray, two: np.ndarray, potential: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Chances of all labels by loopy message passing: sums of products, half of each old message kept.

    ``unary`` is (tokens, labels); edge e joins ``one[e]`` and ``two[e]`` with the log potentials ``potential[e]``.
    """
    edges, labels = len(one), unary.shape[1]
    ends = np.concatenate([one, two])            # messages to two[e], then to one[e]
    goals = np.concatenate([two, one])
    tables = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(edges, 2 * edges), np.arange(edges)])
    messages = np.zeros((2 * edges, labels))
    for _ in range(rounds if edges else 0):
        belief = unary.copy()
        np.add.at(belief, goals, messages)
        out = (belief[ends] - messages[back])[:, :, None] + tables
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        new = 0.5 * messages + 0.5 * new
        still = np.abs(new - messages).max() < 1e-3
        messages = new
        if still:
            break
    belief = unary.copy()
    np.add.at(belief, goals, messages)
    belief -= belief.max(axis=1, keepdims=True)
    chance = np.exp(belief)
    return chance / chance.sum(axis=1, keepdims=True)


def find(text: str, field: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Exact spans, and those that the field adds: tokens outside all exact spans whose likeliest label is a kind."""
    spans, places, tokens, labels = _table(text)
    if not len(places) or (labels > 0).all():
        return spans, []
    shapes = np.array([features(t, tokens[i - 1] if i else "") for i, t in enumerate(tokens)], dtype=np.float64)
    unary = shapes @ field["token"]
    known = np.flatnonzero(labels)
    # An exact span settles its tokens' labels.
    unary[known] = -50.0
    unary[known, labels[known]] = 0.0
    number = np.array([p[2] for p in places])
    chain = np.flatnonzero(np.diff(number) <= 2)
    skips = np.array(skip_links(tokens), dtype=np.int64).reshape(-1, 2)
    one, two = np.concatenate([chain, skips[:, 0]]), np.concatenate([chain + 1, skips[:, 1]])
    potential = np.concatenate([np.broadcast_to(field["chain"], (len(chain), *field["chain"].shape)), np.broadcast_to(field["skip"], (len(skips), *field["skip"].shape))])
    chance = marginals(unary, one, two, potential)
    added = []
    for i in np.flatnonzero((labels == 0) & (chance.argmax(axis=1) > 0) & (chance.max(axis=1) > SURE)):
        kind = int(chance[i].argmax()) - 1
        start, end, n = places[i]
        if added and added[-1][0] == kind and added[-1][3] == n - 1:
            # Words side by side with one label are one span.
            added[-1] = (kind, added[-1][1], end, n)
        else:
            added.append((kind, start, end, n))
    return spans, [a[:3] for a in added]


def _found(batches, field):
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        rows = []
        for text in texts:
            spans, added = find(text, field)
            rows.append([{"kind": k, "start": a, "end": b, "exact": exact} for some, exact in ((spans, True), (added, False)) for k, a, b in some])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, kind)], names=["id", "spans"])


def personal_data(docs: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``id`` and ``spans`` of ``(kind, start, end, exact)``, by kind, then start.

    ``kind`` counts ``KINDS`` from 0; places are code points, ends exclusive; ``exact`` tells the patterns' spans from
    those that the field adds. Null texts are empty and have no spans.

    The field's tokens are the words with a digit or @. Neighbours and, however far apart, repeated or similar tokens
    share potentials; message passing over a document's tokens carries a label from a token that an exact span
    settles to those like it. Links join each token to the last one like it, so their number grows with the text.
    """
    field = fit(docs, key, rows)
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _found(batches, field), f"id {kind}, spans array<struct<kind:int,start:long,end:long,exact:boolean>>")
    return found.withColumn("spans", F.array_sort("spans"))
