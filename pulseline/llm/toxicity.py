"""Toxicity by a subsequence string kernel and a linear SVM over Nyström landmarks.

Kernel: two strings are alike as they share character triples in order, gaps allowed;
a triple that spans s characters counts ``DECAY ** s``, and the kernel is scaled to 1 for
equal strings. So an inserted or dropped character costs a little, not the match.

Units are a sentence's words in lower case without punctuation around them, each also
with its letters only if others stand between them, and runs of single letters joined
(s t u p i d). Words longer than ``UNIT`` characters are cut into overlapping windows, so
whole texts are read. Joins are units too: the letters of every two or more neighbouring
words of ``JOINED`` letters together at most, so that spaces and punctuation are gaps like
others (s t u pid, s - t - u - p - i - d) and insults of several words are seen. Words
without letters count as gaps there.

Training: sentences of at most ``SAMPLE`` labelled documents of each class (smallest
hash of doc_id, texts up to ``SAMPLE_CHARS`` long), never a held-out one. A label holds
for a text, so a toxic text stands for its telling units: those with a four-letter run
that a share of ``SUPPORT`` of the toxic texts has, ``ODDS`` times as often as the clean
ones, or else, from the second of ``ROUNDS`` rounds on, the one that the SVM finds worst.
Telling joins have such a run across each border between their words and none within a
word; runs are counted for them over the texts' letters without gaps.
Near copies count once. Units of clean texts count as clean, the commonest
``CLEAN_UNITS`` of them, the commonest ``CLEAN_JOINS`` joins and, from the second round
on, as many joins that the SVM finds worst; all of them together weigh ``FALSE_ALARM`` times the telling
ones. Landmarks are the commonest telling units and as many clean ones, any at first and
then those nearest to the border; Nyström features are kernel values to them, whitened.
As kernel and SVM are linear in the triples, the trained model is one table of weights.

Score: the largest decision value over a text's units and joins, through a logistic curve fitted
on the sample. Tasks keep the values of up to ``REMEMBERED`` units; nothing is shuffled. Texts are
scored ``PIECE`` characters at a time, long ones in pieces with the same units and joins.

Defined results: repeated rows get equal scores, a row without doc_id is scored and never held out; texts without units (null, empty, blank) get the score of the lowest
decision value of the sample. Without both classes in the sample every score is 0.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECAY = 0.7
UNIT = 24
JOINED = 16
CLASSES = 64
SAMPLE = 2000
SAMPLE_CHARS = 20_000
FALSE_ALARM = 20.0
LANDMARKS = 160
SURELY_CLEAN = -0.7
ROUNDS = 2
ODDS = 100.0
SUPPORT = 0.01
CLEAN_UNITS = 30_000
CLEAN_JOINS = 10_000
FOLDS = 5
REMEMBERED = 300_000

# Characters scored at a time.
PIECE = 1 << 19
# Letters whose joins are summed at a time, and what those sums may lack in precision.
LETTERS = 1 << 14
SLACK = 1e-4

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = re.compile(r"\s")
# Ends a word that is not a single letter, so that no run of single letters crosses it.
_CUT = re.compile(r"(?<=[^\W_]{2})\s")


def units_of(text: str | None) -> set[str]:
    """What the kernel compares: see above."""
    words = [w.strip(string.punctuation) for w in (text or "").lower().split()]
    units, run = set(words), []
    for word in words:
        if len(word) == 1:
            run.append(word)
        elif word and run:
            if len(run) > 2:
                units.add("".join(run))
            run = []
    if len(run) > 2:
        units.add("".join(run))
    units.discard("")
    return units


def _reach(text: str, at: int) -> str:
    """The letters of the words after the blank at ``at`` that a join which begins before it may take in."""
    found, count, own, end = [], 0, 0, at
    for hit in _LETTER.finditer(text, at):
        if _BLANK.search(text, end, hit.start()):
            if count >= JOINED:
                break
            found.append(" ")
            own = 0
        found.append(hit.group())
        count, own, end = count + 1, own + 1, hit.end()
        if own > JOINED:
            break
    return "".join(found)


def pieces(text: str) -> Iterator[tuple[str, str]]:
    """Cuts a text into parts of about ``PIECE`` characters whose units together are the text's, each with the letters
    that joins from its end on reach into. A word, or a run of single letters, is never cut, however long."""
    at, letter, reach = 0, -1, ""
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        if letter < cut.start():  # else the next letter is the one that is known already
            letter = found.start() if (found := _LETTER.search(text, cut.start())) else len(text)
            reach = _reach(text, cut.start()) if found else ""
        yield text[at:cut.start()], reach
        at = cut.start()
    yield text[at:], ""


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
    """(row, part, reach) of all texts' pieces, some 256 or about ``PIECE`` characters at a time."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for part, reach in pieces(text or ""):
            if group and (len(group) == 256 or size + len(part) > PIECE):
                yield group
                group, size = [], 0
            group.append((row, part, reach))
            size += len(part)
    if group:
        yield group


def variants(unit: str) -> list[str]:
    """Windows of a unit, and of its letters alone if it has others."""
    letters = _NOT_LETTERS.sub("", unit)
    found = []
    for value in {unit, letters} - {""}:
        found += [value] if len(value) <= UNIT else [value[k:k + UNIT] for k in range(0, len(value) - UNIT // 2, UNIT // 2)]
    return found


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 2 for letters (what ``_NOT_LETTERS`` leaves), 1 for blanks, else 0."""
    return np.array([1 if c.isspace() else 2 * (c.isalnum() and not c.isdecimal()) for c in map(chr, range(0x110000))], dtype=np.int8)


@dataclass
class Joins:
    """Runs of two or more neighbouring words with 3 to ``JOINED`` letters together."""
    points: np.ndarray  # letters of all texts
    starts: np.ndarray  # of each word, its first letter
    text: np.ndarray    # of each join, the number of its text
    word: np.ndarray    # its first word
    words: np.ndarray
    first: np.ndarray   # its first letter
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> "Joins":
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le"), dtype=np.uint32)
        kinds = _kinds()[points]
        at = np.flatnonzero(kinds == 2)
        word = np.cumsum(kinds == 1, dtype=np.int32)[at]
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), at[starts], side="right")
        ends = np.append(starts[1:], len(at))
        found, begin = [], np.arange(len(starts))
        for n in range(2, JOINED + 1):
            begin = begin[begin < len(starts) - n + 1]
            length = ends[begin + n - 1] - starts[begin]
            near = (length <= JOINED) & (text[begin] == text[begin + n - 1])
            begin, length = begin[near], length[near]
            long = length >= 3
            found.append((begin[long], np.full(long.sum(), n), length[long]))
        begin, words, length = map(np.concatenate, zip(*found))
        return cls(points[at], starts, text[begin], begin, words, starts[begin], length)

    @cached_property
    def classes(self) -> np.ndarray:
        """Character classes of the letters."""
        return _class_of(self.points)

    def keys(self) -> np.ndarray:
        """A hash of each join's letters."""
        factors = np.random.default_rng(1).integers(1, 1 << 62, JOINED) * 2 + 1
        found = np.zeros(len(self.first), dtype=np.int64)
        for n in range(JOINED):
            rows = np.flatnonzero(self.length > n)
            found[rows] += (self.points[self.first[rows] + n].astype(np.int64) + 1) * factors[n]
        return found

    def string(self, n: int) -> str:
        return self.points[self.first[n]:self.first[n] + self.length[n]].tobytes().decode("utf-32-le")

    def telling(self, runs: set[str]) -> np.ndarray:
        """Places of the joins that have one of ``runs`` across each border and in no word."""
        letters = self.points.tobytes().decode("utf-32-le")
        hits = np.array([k for k in range(len(letters) - 3) if letters[k:k + 4] in runs], dtype=np.int64)
        begin, end = (np.searchsorted(self.starts, h, side="right") - 1 for h in (hits, hits + 3))
        crossed, inside = np.zeros((2, len(self.starts) + 1), dtype=np.int64)
        inside[begin[begin == end]] = 1
        for n in range(1, 4):  # a run crosses three borders at most
            crossed[(begin + n)[begin + n <= end]] = 1
        crossed, inside = (np.append(0, np.cumsum(x)) for x in (crossed, inside))
        after = self.word + self.words
        return np.flatnonzero((crossed[after] - crossed[self.word + 1] == self.words - 1) & (inside[after] == inside[self.word]))


@lru_cache(maxsize=UNIT + 1)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    places = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]
    i, j, k = (np.array(p, dtype=np.int64) for p in zip(*places))
    weight = DECAY ** (k - i + 1)
    return i, j, k, (weight / np.linalg.norm(weight)).astype(np.float32)


def _classes(strings: list[str]) -> np.ndarray:
    """One row of character classes per string (all of one length)."""
    return _class_of(np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)).reshape(len(strings), -1)


def _class_of(points: np.ndarray) -> np.ndarray:
    points = points.astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + (points * 40503 >> 4) % (CLASSES - 27))


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, triple codes, weights) of strings of equal length, in parts. Strings of fewer
    than three characters have no triples and are left out."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    for n in np.unique(lengths[lengths >= 3]).tolist():
        i, j, k, weight = _triples(n)
        rows = np.flatnonzero(lengths == n)
        step = max(1, (1 << 19) // len(i))
        for first in range(0, len(rows), step):
            part = rows[first:first + step]
            c = _classes([strings[r] for r in part])
            yield part, (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k], weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Norm of each row of triples; 1 if none repeats, more otherwise."""
    order = np.argsort(codes, axis=1)
    ranked, weighed = np.take_along_axis(codes, order, 1), weight[order]
    new = np.ones(codes.shape, dtype=bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    sums = np.add.reduceat(weighed.ravel(), np.flatnonzero(new.ravel()))
    each = new.sum(axis=1)
    return np.sqrt(np.add.reduceat(sums * sums, np.cumsum(each) - each))


def kernel_norms(classes: np.ndarray) -> np.ndarray:
    """What ``norms`` has, to about ``SLACK``, of strings of equal length, one column of classes each, by the kernel's
    recursion over pairs of letters instead of by sorting triples."""
    n, count = classes.shape
    found = np.empty(count)
    for at in range(0, count, step := max(1, (1 << 16) // n ** 2)):
        part = classes[:, at:at + step]
        same = (part[:, None] == part).astype(np.float32)
        ending = same.copy()  # weight of equal subsequences that end at two letters
        for _ in range(2):
            for k in range(1, n):
                ending[k] += np.float32(DECAY) * ending[k - 1]
            for k in range(1, n):
                ending[:, k] += np.float32(DECAY) * ending[:, k - 1]
            longer = np.zeros_like(same)
            np.multiply(ending[:-1, :-1], same[1:, 1:], out=longer[1:, 1:])
            ending = longer
        found[at:at + step] = np.sqrt(ending.sum(axis=(0, 1)))
    return found * _triples(n)[3][0]


@dataclass
class Landmarks:
    """Triple weights of some strings, kept for the triples that any of them has."""
    number: np.ndarray   # of each triple; 0 for all others
    weights: np.ndarray  # one row per string, one column per number

    @classmethod
    def of(cls, strings: list[str]) -> "Landmarks":
        parts = list(by_length(strings))
        used = np.unique(np.concatenate([codes.ravel() for _, codes, _ in parts]))
        number = np.zeros(CLASSES ** 3, dtype=np.int32)
        number[used] = np.arange(1, len(used) + 1)
        weights = np.zeros((len(strings), len(used) + 1), dtype=np.float32)
        for rows, codes, weight in parts:
            size = norms(codes, weight)
            for n, row in enumerate(rows):
                np.add.at(weights[row], number[codes[n]], weight / size[n])
        return cls(number, weights)

    def combined(self, alpha: np.ndarray) -> np.ndarray:
        """Weight of every triple in the weighted sum of the strings."""
        return (alpha @ self.weights).astype(np.float32)[self.number]


def kernel_to(strings: list[str], landmarks: Landmarks) -> np.ndarray:
    """Kernel values, strings x landmarks."""
    found = np.zeros((len(strings), len(landmarks.weights)), dtype=np.float32)
    for rows, codes, weight in by_length(strings):
        size, places = norms(codes, weight), landmarks.number[codes]
        for n, table in enumerate(landmarks.weights):
            found[rows, n] = (table[places] @ weight) / size
    return found


@dataclass
class Model:
    table: np.ndarray  # weight of each triple
    bias: float
    floor: float       # decision value of a text without units
    slope: float
    offset: float

    def decisions(self, strings: list[str]) -> np.ndarray:
        """Decision values. A string's norm is 1 at least, so a value below ``SURELY_CLEAN`` without
        it is left undivided: no such string can be toxic, and clean ones are ordered by the undivided value."""
        found = np.full(len(strings), self.bias, dtype=np.float32)
        for rows, codes, weight in by_length(strings):
            value = self.table[codes] @ weight
            near = np.flatnonzero(value + self.bias > SURELY_CLEAN)
            if len(near):
                value[near] /= norms(codes[near], weight)
            found[rows] += value
        return found

    def joined(self, joins: Joins, some: np.ndarray | None = None) -> np.ndarray:
        """Decision values of all or ``some`` joins, as ``decisions`` has them; equal ones are valued once."""
        starts, lengths = (joins.first, joins.length) if some is None else (joins.first[some], joins.length[some])
        found = np.full(len(starts), self.bias, dtype=np.float32)
        letters = joins.classes.astype(np.int32)
        keys = np.random.default_rng(1).integers(1, 1 << 62, JOINED) * 2 + 1
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            c = letters[starts[rows][:, None] + np.arange(n)]
            _, own, back = np.unique((c + 1) @ keys[:n], return_index=True, return_inverse=True)
            i, j, k, weight = _triples(n)
            value = np.zeros(len(own), dtype=np.float32)
            by_span = dict(zip((k - i).tolist(), weight.tolist()))
            for at in range(0, len(own), 4096):
                picked = own[at:at + 4096]
                # Two at least, as numpy adds a single column in another order.
                part = np.ascontiguousarray(c[np.resize(picked, max(2, len(picked)))].T)
                middle, sums = part * CLASSES, np.zeros(part.shape[1], dtype=np.float32)
                for a in range(n - 2):
                    for b in range(a + 2, n):
                        codes = middle[a + 1:b] + (part[a] * CLASSES ** 2 + part[b])
                        sums += self.table.take(codes).sum(axis=0) * np.float32(by_span[b - a])
                value[at:at + 4096] = sums[:len(picked)]
            near = np.flatnonzero(value + self.bias > SURELY_CLEAN)
            step = max(1, (1 << 19) // len(i))
            for at in range(0, len(near), step):
                part = c[own[near[at:at + step]]]
                value[near[at:at + step]] /= norms((part[:, i] * CLASSES + part[:, j]) * CLASSES + part[:, k], weight)
            found[rows] += value[back]
        return found

    def undivided(self, joins: Joins) -> np.ndarray:
        """Decision values of joins as ``joined`` has them, but with norm 1, to about ``SLACK``. What the triples between
        two letters weigh does not depend on the join, so it is summed once for each two letters that some join may hold;
        a run's total is that of its two runs without an end letter, less what both have, and what lies between its ends."""
        found = np.full(len(joins.first), self.bias)
        letters, size = joins.classes, np.diff(joins.starts, append=len(joins.points))
        # Letters of its word before and after each letter: a join holds whole words.
        before = np.arange(len(letters)) - np.repeat(joins.starts, size)
        after = np.repeat(size, size) - 1 - before
        order = np.argsort(joins.first, kind="stable")
        rows = [order[joins.length[order] == n] for n in range(JOINED + 1)]
        firsts = [joins.first[r] for r in rows]
        for at in range(0, len(letters), LETTERS):
            c = letters[at:at + LETTERS + JOINED]
            middle, total, shorter = c * CLASSES, np.zeros(len(c)), np.zeros(len(c))  # of runs of n - 1 and n - 2 letters
            for n in range(3, min(JOINED, len(c)) + 1):
                runs = len(c) - n + 1
                outer = middle[:runs] * CLASSES + c[n - 1:]
                held = np.flatnonzero(before[at:at + runs] + after[at + n - 1:at + n - 1 + runs] <= JOINED - n)
                some = 2 * len(held) < runs
                if some:
                    outer = outer[held]
                between = np.zeros(len(outer), dtype=np.float32)
                for k in range(1, n - 1):
                    inner = middle[k:k + runs]
                    between += self.table.take(outer + (inner.take(held) if some else inner))
                grown = total[:runs] + total[1:runs + 1] - shorter[1:runs + 1]
                grown[held if some else slice(None)] += between * DECAY ** n
                total, shorter = grown, total
                low, high = np.searchsorted(firsts[n], (at, at + LETTERS))
                found[rows[n][low:high]] += grown[firsts[n][low:high] - at] * (_triples(n)[3][0] / DECAY ** 3)
        return found

    def worst_joins(self, texts: list[str | None], known: np.ndarray | None = None) -> np.ndarray:
        """The largest decision value over each text's joins, or the ``known`` value if that is larger; -inf without any.
        Cheaper values, right to ``SLACK``, tell the few joins that may have it."""
        joins = Joins.of(texts)
        worst = np.full(len(texts), -np.inf) if known is None else known.astype(np.float64)
        value = self.undivided(joins)
        high, low = value + SLACK, value - SLACK
        near = np.flatnonzero((value > SURELY_CLEAN - SLACK) & (np.maximum(value, self.bias) + SLACK >= worst[joins.text]))
        for n in np.unique(joins.length[near]).tolist():
            rows = near[joins.length[near] == n]
            divided = self.bias + (value[rows] - self.bias) / kernel_norms(joins.classes[joins.first[rows] + np.arange(n)[:, None]])
            undecided = value[rows] <= SURELY_CLEAN + SLACK
            high[rows] = np.where(undecided, np.maximum(divided, value[rows]), divided) + SLACK
            low[rows] = np.where(undecided, np.minimum(divided, value[rows]), divided) - SLACK
        least = worst.copy()
        np.maximum.at(least, joins.text, low)
        rows = np.flatnonzero(high >= least[joins.text])
        np.maximum.at(worst, joins.text[rows], self.joined(joins, rows))
        return worst

    def score(self, decision: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * decision + self.offset))))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, cost: float = 1e7) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = cost * weight / weight.sum()
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    loss = lambda w: w @ ridge @ w + weight @ np.maximum(0, 1 - y * (x @ w)) ** 2
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        inside = np.flatnonzero(y * (x @ w) < 1)
        near = x[inside] * weight[inside, None]
        step = np.linalg.solve(ridge + near.T @ x[inside], near.T @ y[inside]) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w, before, now = w + size * step, now, loss(w + size * step)
        if before - now <= 1e-7 * before:
            break
    return w[:-1], float(w[-1])


def _logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps; classes weigh the same, targets are softened."""
    target = np.where(labels, 0.995, 0.005)
    weight = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum())
    x, w = np.stack([values, np.ones(len(values))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        w = w - np.linalg.solve((x.T * curve) @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * w)
    return float(w[0]), float(w[1])


def _first_copies(bags: list[list[str]]) -> list[int]:
    """Places of the bags whose long unit of smallest checksum no earlier bag has; near
    copies nearly always share it."""
    seen, first = set(), []
    for n, bag in enumerate(bags):
        mark = min((zlib.crc32(u.encode()) for u in bag if len(u) > 8), default=-1 - n)
        if mark not in seen:
            seen.add(mark)
            first.append(n)
    return first


def _common_joins(texts: list[str | None]) -> Counter:
    """The commonest ``CLEAN_JOINS`` joins that stand twice or more; only hashes are kept of all."""
    parts = lambda: (Joins.of(texts[first:first + 64]) for first in range(0, len(texts), 64))
    keys, counts = np.unique(np.concatenate([joins.keys() for joins in parts()]), return_counts=True)
    top = np.lexsort((keys, -counts))[:CLEAN_JOINS]
    times, found = dict(zip(keys[top].tolist(), counts[top].tolist())), Counter()
    for joins in parts():
        own, rows = np.unique(joins.keys(), return_index=True)
        for key, n in zip(own.tolist(), rows.tolist()):
            if times.get(key, 0) > 1:
                found[joins.string(n)] = times.pop(key)
    return found


def _near_joins(model: Model, texts: list[str | None]) -> dict[str, tuple[int, float]]:
    """Count and decision value of the ``CLEAN_JOINS`` joins that the model finds worst."""
    count, value = Counter(), {}
    for first in range(0, len(texts), 64):
        joins = Joins.of(texts[first:first + 64])
        found = model.joined(joins)
        for n in np.flatnonzero(found > SURELY_CLEAN).tolist():
            unit = joins.string(n)
            count[unit] += 1
            value[unit] = float(found[n])
    return {u: (count[u], value[u]) for u in sorted(value, key=lambda u: (-value[u], u))[:CLEAN_JOINS]}


def _worst(model: Model, decision: dict[str, float], text: str | None, bag: list[str]) -> str:
    unit, joins = max(bag, key=lambda u: (decision[u], u)), Joins.of([text])
    if len(joins.first):
        found = model.joined(joins)
        if found.max() > decision[unit]:
            return joins.string(int(found.argmax()))
    return unit


def train(texts: list[str | None], toxic: list[bool], seed: int = 3) -> Model | None:
    """A model from labelled texts; None without both classes."""
    labels = np.array(toxic, dtype=bool)
    if not labels.any() or labels.all():
        return None
    bags = [sorted({v for u in units_of(t) for v in variants(u) if len(v) >= 3}) for t in texts]
    first = _first_copies(bags)
    texts, bags, labels = [texts[i] for i in first], [bags[i] for i in first], labels[first]
    if not labels.any() or labels.all():
        return None
    runs = lambda bag: {u[k:k + 4] for u in bag for k in range(len(u) - 3)}
    inside, outside = Counter(), Counter()
    for bag, label in zip(bags, labels):
        (inside if label else outside).update(runs(bag))
    rate = (~labels).sum() / labels.sum()
    telling = {r for r, n in inside.items() if n >= max(3, SUPPORT * labels.sum()) and n * rate >= ODDS * (outside[r] + 0.1)}
    toxic_bags = [bag for bag, label in zip(bags, labels) if label and bag]
    squeezed = lambda text: runs((_NOT_LETTERS.sub("", (text or "").lower()),))
    inside, outside = Counter(), Counter()
    for text in (t for t, label in zip(texts, labels) if label):
        inside.update(squeezed(text))
    often = {r for r, n in inside.items() if n >= max(3, SUPPORT * labels.sum())}
    for text in (t for t, label in zip(texts, labels) if not label):
        outside.update(often & squeezed(text))
    crossing = {r for r in often if inside[r] * rate >= ODDS * (outside[r] + 0.1)}
    toxic_joins = []
    for text in (t for t, bag, label in zip(texts, bags, labels) if label and bag):
        joins = Joins.of([text])
        toxic_joins.append({joins.string(n) for n in joins.telling(crossing).tolist()})
    held = Counter(u for bag, label in zip(bags, labels) if not label for u in bag)
    clean = sorted(held, key=lambda u: (-held[u], u))[:CLEAN_UNITS]
    spread = [clean[i] for i in np.random.default_rng(seed).permutation(len(clean))[:LANDMARKS // 2]]
    times = Counter(u for bag in toxic_bags for u in bag if not telling.isdisjoint(runs((u,))))
    times.update(u for joins in toxic_joins for u in joins)
    every = sorted({u for bag in bags for u in bag})
    toxic_texts = [t for t, bag, label in zip(texts, bags, labels) if label and bag]
    clean_texts = [t for t, label in zip(texts, labels) if not label]
    joined = _common_joins(clean_texts)
    held.update(joined)
    clean = list(dict.fromkeys(clean + sorted(joined)))
    model, decision = None, {}
    for n in range(ROUNDS):
        total = sum(held[u] ** 0.5 for u in clean)
        if not times or not clean:
            return None
        common = [u for u, _ in times.most_common(LANDMARKS // 2)]
        landmarks = sorted({*common, *spread})
        tabled = Landmarks.of(landmarks)
        values, vectors = np.linalg.eigh(kernel_to(landmarks, tabled).astype(np.float64))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
        positive = sorted(times)
        y = np.array([1.0] * len(positive) + [-1.0] * len(clean))
        weight = np.array([times[u] / times.total() for u in positive] + [FALSE_ALARM * held[u] ** 0.5 / total for u in clean])
        w, bias = _svm(kernel_to(positive + clean, tabled) .astype(np.float64) @ whiten, y, weight)
        model = Model(tabled.combined(whiten @ w), bias, 0.0, 1.0, 0.0)
        decision = dict(zip(every, model.decisions(every).tolist()))
        if n + 1 == ROUNDS:
            break
        near = _near_joins(model, clean_texts)
        held.update({u: count for u, (count, _) in near.items() if u not in joined})
        clean = list(dict.fromkeys(clean + sorted(near)))
        by_worst = dict(zip(clean, model.decisions(clean).tolist()))
        spread = sorted(clean, key=lambda u: (-by_worst[u], u))[:LANDMARKS // 2]
        times = Counter()
        for text, bag, joins in zip(toxic_texts, toxic_bags, toxic_joins):
            times.update([u for u in bag if not telling.isdisjoint(runs((u,)))] + sorted(joins) or [_worst(model, decision, text, bag)])
    low = min(decision.values())
    tops = np.array([max((decision[u] for u in bag), default=low) for bag in bags])
    for first in range(0, len(texts), 64):
        tops[first:first + 64] = np.maximum(tops[first:first + 64], model.worst_joins(texts[first:first + 64]))
    slope, offset = _logistic(tops, labels)
    return Model(model.table, model.bias, low, slope, offset)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out()))
    # a few times the sample, as some texts are missing or too long; at most 8 * SAMPLE ids
    pick = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * SAMPLE) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (texts.join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id").where(F.length("text") <= SAMPLE_CHARS)
             .dropDuplicates(["doc_id"]))
    parts = [found.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    rows = sorted(parts[0].unionByName(parts[1]).collect(), key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.toxic == 1 for r in rows])


def _score(model: Model):
    known: dict[str, float] = {}

    def units(bags: list[set[str]]) -> list[float]:
        """The largest decision value of each bag; -inf of an empty one."""
        if len(known) >= REMEMBERED:
            known.clear()
        new = list({u for bag in bags for u in bag if u not in known})
        if new:
            own = [variants(u) for u in new]
            flat = model.decisions([v for vs in own for v in vs]).tolist()
            at = 0
            for unit, vs in zip(new, own):
                known[unit] = max(flat[at:at + len(vs)], default=model.floor)
                at += len(vs)
        return [max(map(known.__getitem__, bag), default=-math.inf) for bag in bags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                best, worst = np.full((2, part.num_rows), -np.inf)
                for group in _groups(part.column("text").to_pylist()):
                    rows = [row for row, _, _ in group]
                    np.maximum.at(best, rows, units([units_of(text) for _, text, _ in group]))
                    np.maximum.at(worst, rows, model.worst_joins([text + reach for _, text, reach in group], best[rows]))
                best[np.isinf(best)] = model.floor
                scores = [model.score(value) for value in np.maximum(best, worst).tolist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])
    return run


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id and score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))
    return texts.mapInArrow(_score(model), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
