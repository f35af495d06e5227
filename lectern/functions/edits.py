"""Levenshtein distances of many pairs at once, in numpy.

A column of a pair's table is held as the differences between neighbours, 64 rows to a word.  A word
needs the word above it at the same column, so at step t word b is at column t - b, and one
operation serves all words of all pairs of a batch.  Only words near the diagonals that a path
of at most ``most`` edits can touch take part; what lies outside counts as too large.  So a result of
at most ``most`` is the distance, and any other pair is taken again with twice the room.  The words
at the top go as soon as no path through them can still be as short in any pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Pair = tuple[np.ndarray, np.ndarray]

WORDS = 6_000  # handled by one operation
TABLE = 8 << 20  # words of a batch's table of symbols
ONE, TOP = np.uint64(1), np.uint64(63)


def _trimmed(a: np.ndarray, b: np.ndarray) -> Pair:
    """Without what both begin and end with; the longer one first."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n -= start
    if n:
        differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
        end = n - 1 - int(differ[-1]) if len(differ) else n
        a, b = a[: len(a) - end], b[: len(b) - end]
    return (a, b) if len(a) >= len(b) else (b, a)


def _first_room(a: np.ndarray, b: np.ndarray) -> int:
    """Texts of one length never need more edits than places that differ; else a guess."""
    if len(a) == len(b):
        return int(np.count_nonzero(a != b))
    return min(len(a), len(a) - len(b) + max(16, len(b) // 8))


def _band(pair: Pair, most: int) -> tuple[int, int]:
    """How far a path of ``most`` edits gets below and above the first diagonal."""
    more = len(pair[0]) - len(pair[1])
    spare = (most - more) // 2
    return more + spare, max(1, spare)


def _symbols(pairs: Sequence[Pair]) -> tuple[list[Pair], int]:
    """Symbols as numbers from 1 in the first texts, 0 for those of the second ones that these lack."""
    known, first = np.unique(np.concatenate([a for a, _ in pairs]), return_inverse=True)
    out, at = [], 0
    second = np.concatenate([b for _, b in pairs])
    place = np.minimum(np.searchsorted(known, second), len(known) - 1)
    place = np.where(known[place] == second, place + 1, 0)
    end = 0
    for a, b in pairs:
        out.append((first[at : at + len(a)] + 1, place[end : end + len(b)]))
        at, end = at + len(a), end + len(b)
    return out, len(known) + 1


def _banded(pairs: Sequence[Pair], rooms: Sequence[int]) -> np.ndarray:
    """The pairs' distances where they are within their rooms, else something larger."""
    coded, alphabet = _symbols(pairs)
    bands = [_band(p, k) for p, k in zip(pairs, rooms, strict=True)]
    down, up = max(d for d, _ in bands), max(u for _, u in bands)
    rows, columns = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    n_words, n = -(-rows // 64), len(pairs)
    starts = [max(1, 64 * b + 1 - down) for b in range(n_words)]
    ends = [min(columns, 64 * b + 64 + up) for b in range(n_words)]

    matches = np.zeros(n_words * n * alphabet, np.uint64)
    text = np.zeros((columns, n), np.int64)  # from the last column to the first
    due: dict[int, list[int]] = {}
    for p, (a, b) in enumerate(coded):
        row = np.arange(len(a))
        np.add.at(matches, ((row >> 6) * n + p) * alphabet + a, ONE << (row & 63).astype(np.uint64))
        text[columns - len(b) :, p] = b[::-1]
        due.setdefault(len(b) + (len(a) - 1) // 64, []).append(p)
    base = (np.arange(n_words * n) * alphabet).reshape(n_words, n)

    rises, falls = np.full((n_words, n), ~np.uint64(0)), np.zeros((n_words, n), np.uint64)
    score = np.zeros((n_words, n), np.int64)
    # what comes into a word from above, at this step and at the next; outside it counts as a rise
    ins, outs = [np.zeros((2, n_words + 1, n), np.uint64) for _ in range(2)]
    ins[0, 0] = outs[0, 0] = 1
    wide = min(n_words, (down + up) // 64 + 3)
    at_, eq_, x_, y_, z_ = np.empty((wide, n), np.int64), *(np.empty((wide, n), np.uint64) for _ in range(4))
    found = np.zeros(n, np.int64)
    first_length, second_length, room = (np.array(x, np.int64) for x in ([len(a) for a, _ in pairs], [len(b) for _, b in pairs], rooms))
    lo = hi = 0
    for t in range(1, max(due) + 1):
        while hi < n_words and starts[hi] + hi <= t:
            score[hi] = 64 * (hi + 1) if starts[hi] == 1 else score[hi - 1] - ins[0, hi].view(np.int64) + ins[1, hi].view(np.int64) + 64
            hi += 1
        while lo < hi and t - lo > ends[lo]:
            lo += 1
        size = hi - lo
        if size:
            at, eq, x, y, z = at_[:size], eq_[:size], x_[:size], y_[:size], z_[:size]
            pv, mv, rise, fall = rises[lo:hi], falls[lo:hi], ins[0, lo:hi], ins[1, lo:hi]
            out_rise, out_fall = outs[0, lo + 1 : hi + 1], outs[1, lo + 1 : hi + 1]
            np.add(base[lo:hi], text[columns - t + lo : columns - t + hi], out=at)
            matches.take(at, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=x)  # vertical
            np.bitwise_or(eq, fall, out=eq)
            np.bitwise_and(eq, pv, out=y)
            np.add(y, pv, out=y)
            np.bitwise_xor(y, pv, out=y)
            np.bitwise_or(y, eq, out=y)  # horizontal
            np.bitwise_or(y, pv, out=z)
            np.invert(z, out=z)
            np.bitwise_or(z, mv, out=z)  # rises along the row
            np.bitwise_and(y, pv, out=y)  # falls along the row
            np.right_shift(z, TOP, out=out_rise)
            np.right_shift(y, TOP, out=out_fall)
            np.left_shift(z, ONE, out=z)
            np.bitwise_or(z, rise, out=z)
            np.left_shift(y, ONE, out=y)
            np.bitwise_or(y, fall, out=y)
            np.bitwise_and(z, x, out=mv)
            np.bitwise_or(x, z, out=x)
            np.invert(x, out=x)
            np.bitwise_or(y, x, out=pv)
            scored = score[lo:hi]
            np.add(scored, out_rise.view(np.int64), out=scored)
            np.subtract(scored, out_fall.view(np.int64), out=scored)
            outs[0, lo], outs[1, lo] = 1, 0
        while t % 32 == 0 and lo < hi - 1:
            # one of its 64 rows may have 63 edits less than the last, and be 63 nearer to the last diagonal
            left = np.abs(first_length - 64 * (lo + 1) - second_length + (t - lo))
            if not ((score[lo] + left - 126 > room) | (t - lo > second_length) | (64 * lo >= first_length)).all():
                break
            lo += 1
        for p in due.get(t, ()):
            last, rest = divmod(len(pairs[p][0]) - 1, 64)
            below = ~np.uint64(0) << np.uint64(rest) << ONE
            found[p] = score[last, p] - int(np.bitwise_count(rises[last, p] & below)) + int(np.bitwise_count(falls[last, p] & below))
        ins, outs = outs, ins
    return found


def many_edits(pairs: Sequence[Pair]) -> np.ndarray:
    """Levenshtein distance of each pair of arrays of numbers."""
    out = np.zeros(len(pairs), np.int64)
    todo: list[tuple[int, Pair, int]] = []
    for k, (a, b) in enumerate(pairs):
        a, b = _trimmed(a, b)
        if len(b):
            todo.append((k, (a, b), _first_room(a, b)))
        else:
            out[k] = len(a)
    while todo:
        todo.sort(key=lambda x: (len(x[1][1]), len(x[1][0]), x[2]))
        again, at = [], 0
        while at < len(todo):
            least, end, down, up = len(todo[at][1][1]), at, 1, 1
            while end < len(todo):
                _, pair, room = todo[end]
                below, above = _band(pair, room)
                below, above, size = max(down, below), max(up, above), end - at + 1
                n_words = -(-len(pair[0]) // 64)
                at_once = min(n_words, (below + above) // 64 + 2) * size
                if end > at and (at_once > WORDS or len(pair[1]) > 1.25 * least + 16 or n_words * size * 100 > TABLE or below + above > 2 * sum(_band(*todo[at][1:])) + 128):
                    break
                down, up, end = below, above, end + 1
            batch = todo[at:end]
            got = _banded([p for _, p, _ in batch], [room for *_, room in batch])
            for (k, pair, room), edits in zip(batch, got.tolist(), strict=True):
                if edits <= room:
                    out[k] = edits
                else:
                    again.append((k, pair, min(len(pair[0]), 2 * room)))
            at = end
        todo = again
    return out
