"""Sorted runs of suffixes, front-coded, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings known to agree up to ``at``."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    while end - at > 1:
        mid = (at + end) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            end = mid
    return at


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the string before, length of the rest, all rests) of sorted strings of at most 255 bytes."""
    shared, rests, last = bytearray(), [], b""
    for s in strings:
        n = common_prefix(last, s)
        shared.append(n)
        rests.append(s[n:])
        last = s
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def decoded(shared: bytes, lengths: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the string before, string) in order."""
    last, at = b"", 0
    for n, length in zip(shared, lengths, strict=True):
        last = last[:n] + rests[at : at + length]
        at += length
        yield n, last


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the string before, string) of all sorted runs in one order; equal strings by run.

    Every head carries the length of its common prefix with the string that
    was put out last. Of two heads the one with the longer prefix comes first,
    unseen; only at equal lengths are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[int, bytes] | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one that it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        n = common_prefix(s, t, p)
        if n == len(s) == len(t):
            first = a < b
        else:
            first = n == len(s) or n < len(t) and s[n] < t[n]
        won, lost = (a, b) if first else (b, a)
        prefix[lost] = n
        return won, lost

    winners = [*([0] * k), *range(k)]
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[1]
    while heads[best] is not None:
        yield best, prefix[best], heads[best][1]
        heads[best] = head = next(runs[best], None)
        prefix[best] = head[0] if head else 0
        i = (best + k) // 2
        while i:
            best, losers[i] = play(best, losers[i])
            i //= 2


def class_ends(shared: np.ndarray, least: int) -> np.ndarray:
    """The number of each string's class when strings with a common prefix of ``least`` or more are one class."""
    return np.cumsum(shared < least)
