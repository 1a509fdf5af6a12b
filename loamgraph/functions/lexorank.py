"""Sibling ranks: base-36 strings with a free place between any two.

A rank never ends in the lowest digit, so a smaller one always fits before it.
An open end counts on by one at the sixth digit instead of halving, which keeps
ranks short when items are always appended or always put first.
"""

from __future__ import annotations

import os

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
WIDTH = 6  # digits at which an open end counts on (fixed value)
_BASE = len(DIGITS)


def _text(value: int, width: int) -> str:
    out = ""
    for _ in range(width):
        value, d = divmod(value, _BASE)
        out = DIGITS[d] + out
    return out


def _counted(rank: str, by: int) -> str | None:
    """The next rank of the same width in one direction; None where its digits run out."""
    width = max(WIDTH, len(rank))
    value = int(rank.ljust(width, "0"), _BASE) + by
    if value % _BASE == 0:  # would end in the lowest digit
        value += by
    return _text(value, width) if 0 < value < _BASE**width else None


def _halved(low: str, high: str | None) -> str:
    """The middle at the first digit with room; between neighbouring digits that is one behind those of ``low``."""
    width = max(len(low), len(high or "")) + 1
    padded = low.ljust(width, "0")
    same = len(os.path.commonprefix([padded, high])) if high is not None else 0
    a, b = DIGITS.index(padded[same]), DIGITS.index(high[same]) if high is not None else _BASE
    if b - a > 1:
        return padded[:same] + DIGITS[(a + b) // 2]
    rest = padded[same + 1 :] + "0"
    full = len(rest) - len(rest.lstrip(DIGITS[-1]))
    return padded[: same + 1] + rest[:full] + DIGITS[(DIGITS.index(rest[full]) + _BASE) // 2]


def is_rank(rank: str) -> bool:
    return bool(rank) and rank[-1] != "0" and all(c in DIGITS for c in rank)


def between(low: str | None, high: str | None) -> str:
    """A rank strictly between two ranks; None is an open end."""
    for r in (low, high):
        if r is not None and not is_rank(r):
            raise ValueError(f"not a rank: {r!r}")
    if low is not None and high is not None and low >= high:
        raise ValueError("the lower rank must sort first")
    one_end = _counted(low, 1) if high is None and low is not None else _counted(high, -1) if low is None and high is not None else None
    return one_end or _halved(low or "", high)


def spaced(n: int) -> list[str]:
    """``n`` ascending ranks."""
    out: list[str] = []
    for _ in range(n):
        out.append(between(out[-1] if out else None, None))
    return out
