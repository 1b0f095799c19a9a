"""Pseudo-random integers from counters, by arithmetic that every SQL engine writes alike.

The counters are mixed linearly modulo a prime, then raised to the fifth power twice; the
fifth power is a permutation modulo that prime, so distinct mixes stay distinct. All steps
fit in 63 bits and use only `*`, `+` and `%`.
"""

from __future__ import annotations

import numpy as np

PRIME = 2**31 - 1
_BASE = 48_271
_SHIFT = 1_013_904_223


def drawn(name: str, *counters: str | int) -> list[str]:
    """Select items, each using the ones before it, that end in `name`: an integer from 0 to PRIME - 1.

    Spark and the checks run the same text. The helper columns start with an underscore
    and the name.
    """
    mixed = [
        f"(cast({c} AS bigint) % {PRIME} + {PRIME}) % {PRIME} * {pow(_BASE, k + 1, PRIME)} % {PRIME}"
        for k, c in enumerate(counters)
    ]
    steps = [f"({' + '.join([*mixed, str(_SHIFT)])}) % {PRIME} AS _{name}0"]
    for k in (0, 3):
        x = f"_{name}{k}"
        steps += [f"{x} * {x} % {PRIME} AS _{name}{k + 1}", f"_{name}{k + 1} * _{name}{k + 1} % {PRIME} AS _{name}{k + 2}"]
        last = f"_{name}{k + 2} * {x} % {PRIME}"
        steps.append(f"({last} + {_SHIFT}) % {PRIME} AS _{name}3" if k == 0 else f"{last} AS {name}")
    return steps


def share(name: str) -> str:
    """SQL: the drawn integer as a double between 0 and 1, both excluded."""
    return f"((cast({name} AS double) + 0.5D) / {PRIME}D)"


def share_sql(name: str) -> str:
    """Twin of `share` for the checks."""
    return f"((({name})::DOUBLE + 0.5e0) / {PRIME}e0)"


def drawn_values(*counters: int | np.ndarray) -> np.ndarray:
    """Twin of `drawn` for arrays, which broadcast."""
    mixed = sum(np.asarray(c, np.int64) % PRIME * pow(_BASE, k + 1, PRIME) % PRIME for k, c in enumerate(counters))
    x = (mixed + _SHIFT) % PRIME
    for last in (False, True):
        square = x * x % PRIME
        x = square * square % PRIME * x % PRIME
        x = x if last else (x + _SHIFT) % PRIME
    return x


def share_values(values: np.ndarray) -> np.ndarray:
    """Twin of `share` for arrays."""
    return (values + 0.5) / PRIME
