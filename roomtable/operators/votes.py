"""The vanishing point vote of one photo, as NumPy arrays of draws by segments.

The same rule as the joins in `perspective`, which cast the votes of photos with too many
segments for one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from roomtable.functions.draws import drawn_values, share_values


@dataclass(frozen=True)
class VoteRules:
    """Limits of the vanishing point vote. Published defaults, in degrees, draws and shares of the width."""

    vertical_deg: float = 12.0
    tolerance_deg: float = 1.6
    draws: int = 600
    min_support: float = 0.8
    min_count: int = 4
    rounds: int = 3
    keep_refined: float = 0.9


#: Steps of the inverse iteration; the first is the least-squares point itself.
REFINE_STEPS = 8


@dataclass(frozen=True)
class Lines:
    """Segments of a photo; `seg` holds their numbers, `known` whether they have one."""

    seg: np.ndarray
    known: np.ndarray
    x: np.ndarray
    y: np.ndarray
    dx: np.ndarray
    dy: np.ndarray
    la: np.ndarray
    lb: np.ndarray
    lc: np.ndarray
    length: np.ndarray

    @staticmethod
    def between(seg: np.ndarray, known: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Lines:
        length = np.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
        size = np.where(length == 0, 1.0, length)
        return Lines(
            seg, known, (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / size, (y1 - y0) / size,
            (y0 - y1) / size, (x1 - x0) / size, (x0 * y1 - x1 * y0) / size, length,
        )

    def take(self, where: np.ndarray) -> Lines:
        return Lines(*(getattr(self, name)[where] for name in self.__dataclass_fields__))

    def angles(self, vx: np.ndarray, vy: np.ndarray) -> np.ndarray:
        """Degrees between each segment and the ray from its middle to each point: points by segments."""
        ax, ay = np.subtract.outer(vx, self.x), np.subtract.outer(vy, self.y)
        reach = np.sqrt(ax * ax + ay * ay)
        here = reach < 1e-9
        sine = np.where(here, 0.0, np.abs(self.dx * ay - self.dy * ax) / np.where(here, 1.0, reach))
        return np.degrees(np.arcsin(np.fmin(1.0, sine)))


def _pairs(lines: Lines, photo: int, number: int, rules: VoteRules) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two segments of each distinct pair, in the order of their first draws."""
    none = np.zeros(0, np.int64)
    long = (lines.length > 0) | np.isnan(lines.length)
    open_ = np.flatnonzero(long & lines.known)
    if long.sum() < rules.min_count or not len(open_):
        return none, none
    numbers, code = np.unique(lines.seg[open_], return_inverse=True)
    draw = np.arange(rules.draws, dtype=np.int64)[:, None]
    key = -np.log(share_values(drawn_values(photo, number, draw, lines.seg[open_]))) / lines.length[open_]
    key[np.isnan(key)] = np.inf
    a = key.argmin(axis=1)
    key[code == code[a][:, None]] = np.inf
    b = key.argmin(axis=1)
    pair = np.minimum(code[a], code[b]) * len(numbers) + np.maximum(code[a], code[b])
    first = np.sort(np.unique(pair, return_index=True)[1])
    first = first[code[a][first] != code[b][first]]
    return open_[a[first]], open_[b[first]]


def _crossings(lines: Lines, a: np.ndarray, b: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The points, in the order of the pairs, where lines cross and a horizon can be."""
    p, q = lines.take(a), lines.take(b)
    hx, hy, hw = p.lb * q.lc - p.lc * q.lb, p.lc * q.la - p.la * q.lc, p.la * q.lb - p.lb * q.la
    apart = (np.abs(p.dx * q.dy - p.dy * q.dx) >= np.sin(np.radians(1.0))) & (np.abs(hw) >= 1e-12)
    vx, vy = hx[apart] / hw[apart], hy[apart] / hw[apart]
    inside = (vy > -0.5 * height) & (vy < 1.5 * height) & (np.abs(vx - width / 2) <= 12 * width)
    return vx[inside], vy[inside]


def _votes(lines: Lines, vx: np.ndarray, vy: np.ndarray, rules: VoteRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and number of the votes for each point, and who casts them."""
    angle = lines.angles(vx, vy)
    near = angle < rules.tolerance_deg
    weight = np.where(near, lines.length * (1 - angle / rules.tolerance_deg), 0.0)
    return weight.sum(axis=1), near.sum(axis=1), near


def _nearest_point(lines: Lines) -> tuple[float, float] | None:
    """The point whose homogeneous vector all lines come nearest to, as `perspective` finds it."""
    m = {i + j: float((lines.length * getattr(lines, "l" + i) * getattr(lines, "l" + j)).sum()) for i, j in ("aa", "ab", "ac", "bb", "bc", "cc")}
    a, b = m["bb"] * m["cc"] - m["bc"] * m["bc"], m["ac"] * m["bc"] - m["ab"] * m["cc"]
    c, d = m["ab"] * m["bc"] - m["ac"] * m["bb"], m["aa"] * m["cc"] - m["ac"] * m["ac"]
    e, f = m["ab"] * m["ac"] - m["aa"] * m["bc"], m["aa"] * m["bb"] - m["ab"] * m["ab"]
    if f == 0:
        return None
    x, y = c / f, e / f
    for _ in range(REFINE_STEPS):
        under = c * x + e * y + f
        if under == 0:
            return None
        x, y = (a * x + b * y + c) / under, (b * x + d * y + e) / under
    return x, y


def photo_points(lines: Lines, photo: int, width: int, height: int, rules: VoteRules) -> list[tuple[int, float, float, float, int]]:
    """(rank, x, y, support, count) of up to `rules.rounds` points, strongest first."""
    found = []
    for number in range(1, rules.rounds + 1):
        vx, vy = _crossings(lines, *_pairs(lines, photo, number, rules), width, height)
        totals, counts, near = _votes(lines, vx, vy, rules)
        if not counts.any():
            break
        # the first of equals is that of the earliest draw
        best = int(np.where(counts > 0, np.floor(totals * 1e6 + 0.5), -np.inf).argmax())
        x, y, total, n = float(vx[best]), float(vy[best]), float(totals[best]), int(counts[best])
        moved = _nearest_point(lines.take(near[best]))
        if moved is not None and -0.5 * height < moved[1] < 1.5 * height:
            again, count, _ = _votes(lines, np.array([moved[0]]), np.array([moved[1]]), rules)
            if count[0] and again[0] >= rules.keep_refined * total:
                x, y, total, n = *moved, float(again[0]), int(count[0])
        if total / width < rules.min_support or n < rules.min_count:
            break
        found.append((number, x, y, total / width, n))
        lines = lines.take(lines.angles(np.array([x]), np.array([y]))[0] >= 2 * rules.tolerance_deg)
    return found
