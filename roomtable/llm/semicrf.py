"""Semi-Markov conditional random field over the few parts of a text that can hold an entity.

A region is a run of blank-separated words that hold a digit or an '@', with a cue word
before it. It is cut to tokens; a segmentation covers the tokens with single outside
tokens (score 0) and entity segments of at most MAX_TOKENS tokens. A segment of a kind
scores the dot product of the kind's weights and the features of the whole span, so
boundaries and types are chosen together by dynamic programming. Text outside regions
can hold no segment, so leaving it out changes nothing. Tokens that no segment covers
part a region into stretches which are decided apart from each other.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from roomtable.llm.spanarrays import BETWEEN, KINDS, MAX_TOKENS, NAMES, Candidates, candidates

#: Posterior that a segment needs before it is reported.
CERTAIN = 0.9
#: A segment of a lower score has a smaller posterior: without it, the others keep their scores.
_LEAST = math.log(CERTAIN / (1 - CERTAIN)) - 1e-9
_STEPS = 120
_DECAY = 0.0003
_HALF = 11  # features whose weights are summed up in the lower table
_LARGE = 1e150

_SIGN = re.compile(r"[0-9@]")
_REST = re.compile(r"[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*)*")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_AT = re.compile(r"[\[(](?:at|AT)[\])]")
_AT_WORD = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9._-]+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]+)*")

Piece = tuple[int, int]
Span = tuple[str, int, int]


def signed(text: str) -> bool:
    """The text holds a digit or an '@'."""
    return _SIGN.search(text) is not None


def regions(text: str) -> Iterator[Piece]:
    """Stretches of the text that can hold an entity, in order and apart from each other."""
    found, done = [], 0
    for m in _REST.finditer(text):
        start, end = m.span()
        found.append((max(done, *(text.rfind(x, done, start) + 1 for x in _BLANKS)), end))
        done = end
    if ("(" in text or "[" in text) and _AT.search(text):
        found += [m.span() for m in _AT_WORD.finditer(text)]
        found.sort()
    end = 0
    for k, (start, stop) in enumerate(found):
        if start < end:
            continue
        end = stop
        for s, e in found[k + 1 : k + 3]:
            if s <= end + 1:
                end = max(end, e)
        yield start, end


def _joined(texts: list[str], pieces: list[list[Piece]]) -> tuple[str, list[int], Candidates]:
    """The joined texts, where each one starts, and the candidates of their pieces."""
    offsets = [0, *itertools.accumulate(len(x) + len(BETWEEN) for x in texts)]
    spread = [(at + s, at + e, at) for at, some in zip(offsets, pieces, strict=False) for s, e in some]
    table = np.array(spread, np.int64).reshape(-1, 3)
    whole = BETWEEN.join(texts)
    return whole, offsets, candidates(whole, table[:, :2], table[:, 2])


def _stretches(found: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate the number of its stretch, for each stretch its first token and how many it has.

    Two stretches part where no candidate has a token on either side.
    """
    n = len(found.begin)
    across = np.cumsum(np.bincount(found.first + 1, minlength=n + 1)[: n + 1] - np.bincount(found.stop, minlength=n + 1)[: n + 1])
    starts = np.flatnonzero(across[:n] == 0)
    number = np.searchsorted(starts, found.first, "right") - 1
    return number, starts, np.diff(np.append(starts, n))


def _sure(size: int, firsts: list[int], stops: list[int], scores: list[float], free: list[bool]) -> list[int]:
    """Free candidates of the best segmentation with a posterior of CERTAIN; candidates of `size` tokens, by their stop."""
    n = len(firsts)
    best, choice = [0.0] * (size + 1), [-1] * (size + 1)
    c = 0
    for j in range(1, size + 1):
        top, pick = best[j - 1], -1
        while c < n and stops[c] == j:
            if (value := best[firsts[c]] + scores[c]) > top:
                top, pick = value, c
            c += 1
        best[j], choice[j] = top, pick
    chosen, j = [], size
    while j:
        c = choice[j]
        if c >= 0 and free[c]:
            chosen.append(c)
        j = firsts[c] if c >= 0 else j - 1
    if not chosen:
        return []
    # ahead: sums over segmentations of the first tokens, the last MAX_TOKENS of them to one scale;
    # share, stay: of the segmentations up to a token, those that end with the candidate or outside
    ahead, stay, share = [1.0] * (size + 1), [1.0] * (size + 1), [0.0] * n
    c = 0
    for j in range(1, size + 1):
        total, begun = ahead[j - 1], c
        while c < n and stops[c] == j:
            share[c] = ahead[firsts[c]] * math.exp(scores[c])
            total += share[c]
            c += 1
        stay[j] = ahead[j - 1] / total
        for k in range(begun, c):
            share[k] /= total
        ahead[j] = total
        if total > _LARGE:
            for k in range(max(0, j - MAX_TOKENS), j + 1):
                ahead[k] /= _LARGE
    visit, wanted, found = [0.0] * size + [1.0], set(chosen), []
    c = n - 1
    for j in range(size, 0, -1):
        here = visit[j]
        visit[j - 1] += here * stay[j]
        while c >= 0 and stops[c] == j:
            part = here * share[c]
            visit[firsts[c]] += part
            if part >= CERTAIN and c in wanted:
                found.append(c)
            c -= 1
    return found[::-1]


@dataclass
class Field:
    """Weights by (kind, feature)."""

    weights: np.ndarray

    @functools.cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """By kind, the sums of the weights of each set of the lower and of the upper features."""
        tables = []
        for part in (self.weights[:, :_HALF], self.weights[:, _HALF:]):
            sets = np.arange(1 << part.shape[1])[:, None] >> np.arange(part.shape[1]) & 1
            tables.append(part @ sets.T)
        return tables[0], tables[1]

    def _scores(self, found: Candidates) -> np.ndarray:
        low, high = self._sums
        return low[found.kind, found.code & (1 << _HALF) - 1] + high[found.kind, found.code >> _HALF]

    def _scored(self, text: str, region: Piece):
        """Tokens of a region, its candidates (first token, token after the last, kind, features) and their scores."""
        found = candidates(text, np.array([region], np.int64), np.zeros(1, np.int64))
        tokens = list(zip(found.begin.tolist(), found.end.tolist(), strict=True))
        made = [(i, j, KINDS[k], [f for f in range(len(NAMES)) if x >> f & 1]) for i, j, k, x in zip(*(a.tolist() for a in (found.first, found.stop, found.kind, found.code)), strict=True)]
        return tokens, made, self._scores(found).tolist()

    def posteriors(self, tokens: list[Piece], made: list, scores: list[float]) -> tuple[list[float], float]:
        """Posterior of each candidate segment and the log of the sum over segmentations."""
        chart = _Chart(np.array([x[0] for x in made], np.int64), np.array([x[1] for x in made], np.int64), np.zeros(len(made), np.int64), np.array([len(tokens)]))
        sure, total = chart.posteriors(np.array(scores, float))
        return sure.tolist(), float(total.sum())

    def spans(self, texts: list[str], taken: list[list[Piece]]) -> list[list[Span]]:
        """For each text, segments of the best segmentation whose posterior is at least CERTAIN and that overlap none of `taken`."""
        out: list[list[Span]] = [[] for _ in texts]
        pieces = [list(regions(x)) for x in texts]
        rows = [k for k, x in enumerate(pieces) if x]
        if not rows:
            return out
        _, offsets, found = _joined([texts[k] for k in rows], [pieces[k] for k in rows])
        scores = self._scores(found)
        strong = np.flatnonzero(scores >= _LEAST)
        begin, end = found.begin[found.first[strong]], found.end[found.stop[strong] - 1]
        if apart := sorted((at + s, at + e) for at, k in zip(offsets, rows, strict=False) for s, e in taken[k]):
            before = np.searchsorted([s for s, _ in apart], end, "left")
            ends = np.maximum.accumulate([0, *(e for _, e in apart)])
            strong = strong[ends[before] <= begin]
        if not len(strong):
            return out
        number, starts, sizes = _stretches(found)
        wanted = np.unique(number[strong])
        mark = np.zeros(len(starts), bool)
        mark[wanted] = True
        use = np.flatnonzero(mark[number])
        use = use[np.argsort(found.stop[use], kind="stable")]
        free = np.zeros(len(scores), bool)
        free[strong] = True
        bounds = np.searchsorted(number[use], wanted, "left").tolist() + [len(use)]
        shift = starts[number[use]]
        firsts, stops = (found.first[use] - shift).tolist(), (found.stop[use] - shift).tolist()
        values, open_ = scores[use].tolist(), free[use].tolist()
        for k, size in enumerate(sizes[wanted].tolist()):
            a, b = bounds[k], bounds[k + 1]
            for c in _sure(size, firsts[a:b], stops[a:b], values[a:b], open_[a:b]):
                x = use[a + c]
                start, end = int(found.begin[found.first[x]]), int(found.end[found.stop[x] - 1])
                row = bisect_left(offsets, start + 1) - 1
                out[rows[row]].append((KINDS[found.kind[x]], start - offsets[row], end - offsets[row]))
        return out


class _Chart:
    """Posteriors of the candidates of many stretches, all stretches a token at a time."""

    def __init__(self, first: np.ndarray, stop: np.ndarray, number: np.ndarray, sizes: np.ndarray):
        """By candidate its tokens, counted from its stretch's first, and its stretch; by stretch its number of tokens."""
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        self.sizes = sizes[order]
        self.base = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.by = np.argsort(stop, kind="stable")
        self.rank = rank[number[self.by]]
        self.source, self.target = self.base[self.rank] + first[self.by], self.base[self.rank] + stop[self.by]
        levels = np.arange(int(sizes.max(initial=0)) + 2)
        self.bounds = np.searchsorted(stop[self.by], levels).tolist()
        self.active = (len(sizes) - np.searchsorted(self.sizes[::-1], levels)).tolist()

    def posteriors(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each candidate, and by stretch the log of the sum over its segmentations."""
        scores = scores[self.by]
        ahead = np.zeros(int((self.sizes + 1).sum()))
        top = len(self.active) - 2
        for j in range(1, top + 1):
            n, some = self.active[j], slice(self.bounds[j], self.bounds[j + 1])
            at = self.base[:n] + j
            outside = ahead[at - 1]
            parts = np.exp(ahead[self.source[some]] + scores[some] - outside[self.rank[some]])
            ahead[at] = outside + np.log1p(np.bincount(self.rank[some], parts, n))
        share = np.exp(ahead[self.source] + scores - ahead[self.target])
        visit, sure = np.zeros(len(ahead)), np.zeros(len(scores))
        visit[self.base + self.sizes] = 1
        for j in range(top, 0, -1):
            n, some = self.active[j], slice(self.bounds[j], self.bounds[j + 1])
            at = self.base[:n] + j
            here = visit[at]
            visit[at - 1] += here * np.exp(ahead[at - 1] - ahead[at])
            sure[some] = here[self.rank[some]] * share[some]
            np.add.at(visit, self.source[some], sure[some])
        out = np.empty(len(scores))
        out[self.by] = np.minimum(sure, 1.0)
        return out, ahead[self.base + self.sizes]


def _checksum(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _variants(rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Written variants of entities, and look-alikes that are none."""
    made: list[tuple[str, list[Span]]] = []

    def add(before: str, entity: str, after: str, kind: str | None) -> None:
        span = [(kind, len(before), len(before) + len(entity))] if kind else []
        made.append((before + entity + after, span))

    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    for _ in range(40):
        a, b, c = digits(3), digits(3), digits(4)
        cue = rng.choice(["call ", "phone: ", "tel. ", "mobile "])
        add(cue, f"({a}) {b}-{c}", rng.choice(["", " x", "."]), "phone")
        add(cue, f"{a}-{b}-{c}", rng.choice(["", " x", ","]), "phone")
        add("x ", f"+{digits(1)} ({a}) {b}-{c}", rng.choice(["", "###", " x"]), "phone")
        add("mail ", f"{word()}{rng.choice([' ', ''])}(at){rng.choice([' ', ''])}{word()}.com", "", "email")
        add("x ", f"{word()} [at] {word()} [dot] org", " x", "email")
        add("x ", f"{word()}.{digits(2)}@{word()}.example.com", rng.choice(["", "$$$", " x"]), "email")
        add("x ", ".".join(str(rng.randint(0, 255)) for _ in range(4)), rng.choice(["", "!!", " x"]), "ip")
        body = digits(15)
        full = next(body + d for d in "0123456789" if _checksum(body + d))
        add(rng.choice(["x ", "card "]), full, rng.choice(["", "###", " x"]), "card")
        add("card ", rng.choice(" -.").join(full[i : i + 4] for i in (0, 4, 8, 12)), "", "card")
        wrong = next(body + d for d in "0123456789" if not _checksum(body + d))
        add("x ", wrong, " x", None)
        add("x ", f"{a}-{b}-{c}", " x", None)
        add("x ", digits(rng.randint(7, 15)), " x", None)
        add("x ", digits(rng.randint(20, 30)), " x", None)
        add("x ", f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}", " x", None)
        add("x ", f"{digits(1)}.{digits(2)}.{digits(1)}", " x", None)
        add("x ", f"{rng.randint(256, 999)}.{digits(3)}.{digits(2)}.{digits(3)}", " x", None)
        add("x ", f"{digits(4)} {digits(4)} {digits(2)}", " x", None)
        add("x ", f"{word()}{digits(8)}{word()}{digits(9)}", " x", None)
        add("x ", f"{digits(2)}.{digits(6)} {digits(2)}.{digits(6)}", " x", None)
        add("x ", f"@{word()} {digits(3)}", "", None)
    return made


def fit(gold: list[tuple[str, list[Span]]], seed: int = 7) -> Field:
    """Weights of the highest regularised likelihood, by adaptive gradient steps.

    A gold segment that is no candidate, or overlaps another one, is left out. Candidates
    of the same kind and features have one score, so a step adds up their residuals first.
    """
    rng = random.Random(seed)
    examples = [*gold, *_variants(rng)]
    _, offsets, found = _joined([text for text, _ in examples], [list(regions(text)) for text, _ in examples])
    places = zip(found.kind.tolist(), found.begin[found.first].tolist(), found.end[found.stop - 1].tolist(), strict=True)
    at = {place: c for c, place in enumerate(places)}
    truth = np.zeros(len(at))
    for (_, spans), shift in zip(examples, offsets, strict=False):
        free = 0
        for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
            c = at.get((KINDS.index(kind), shift + start, shift + end))
            if c is not None and found.first[c] >= free:
                truth[c] = 1
                free = found.stop[c]
    number, starts, sizes = _stretches(found)
    held, number = np.unique(number, return_inverse=True)
    chart = _Chart(found.first - starts[held][number], found.stop - starts[held][number], number, sizes[held])
    many = len(np.unique(found.region[found.first]))
    shapes, shape = np.unique(found.kind.astype(np.int64) << len(NAMES) | found.code, return_inverse=True)
    table = np.zeros((len(shapes), len(KINDS), len(NAMES)))
    table[np.arange(len(shapes)), shapes >> len(NAMES)] = shapes[:, None] >> np.arange(len(NAMES)) & 1
    table = table.reshape(len(shapes), -1)
    weights, squares = np.zeros(table.shape[1]), np.full(table.shape[1], 1e-2)
    for _ in range(_STEPS):
        sure, _ = chart.posteriors((table @ weights)[shape])
        slope = np.bincount(shape, truth - sure, len(shapes)) @ table - _DECAY * many * weights
        squares += slope**2
        weights += 1.5 * slope / np.sqrt(squares)
    return Field(weights.reshape(len(KINDS), len(NAMES)))
