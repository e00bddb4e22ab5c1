"""The matching-blocks ratio (2 M / T) of many pairs of short strings at once.

The longest common block of two strings is taken (the first in the first string, then in the second, among equals), then those to its
left and to its right, and so on; M is the number of letters in blocks.  All open pieces of a batch are solved together, a
letter of the first strings at a time, over arrays of small numbers; pieces are ordered by length so that little is padded.
With a cutoff, a pair is given up as soon as its blocks and what can still match cannot reach it.

From ``LONG`` letters on, the second string's common letters count as noise in the definition followed here
(Python's ``difflib``); such pairs are left to it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Length of a second string from which its common letters are noise; pieces solved together.
LONG, TOGETHER = 200, 2048


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), first


def _pieces(codes: np.ndarray, start: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
    """One column a piece."""
    at = np.arange(int(length.max()))[:, None]
    inside = at < length
    return np.where(inside, codes[np.where(inside, start + at, 0)], np.uint8(pad) if codes.dtype == np.uint8 else codes.dtype.type(pad))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin in a, begin in b, length) of each column's longest common block."""
    kind = np.uint8 if max(len(a), len(b)) < 255 else np.uint16
    run = np.zeros((len(b) + 1, a.shape[1]), kind)
    longer, equal, most = np.empty(b.shape, kind), np.empty(b.shape, bool), np.empty(a.shape[1], kind)
    best, at_a, at_b = np.zeros(a.shape[1], kind), *(np.zeros(a.shape[1], np.int64) for _ in range(2))
    for i in range(len(a)):
        # lengths of the common blocks that end at letter i of a and each letter of b
        np.add(run[:-1], kind(1), out=longer)
        np.equal(b, a[i], out=equal)
        np.multiply(longer, equal, out=run[1:])
        np.max(run, 0, out=most)
        more = np.flatnonzero(most > best)
        if len(more):
            best[more] = most[more]
            size = best[more].astype(np.int64)
            at_a[more] = i + 1 - size
            at_b[more] = run[:, more].argmax(0) - size
    return at_a, at_b, best.astype(np.int64)


def ratios(first: list[str], second: list[str], cutoff: float | None = None) -> np.ndarray:
    """The ratio of each pair; with a cutoff, 0 for pairs that do not reach it."""
    n = len(first)
    size_a, size_b = np.array([len(x) for x in first], np.int64), np.array([len(x) for x in second], np.int64)
    total = size_a + size_b
    out = np.zeros(n)
    slow = np.flatnonzero(size_b >= LONG)
    matched = np.zeros(n, np.int64)
    (code_a, start_a), (code_b, start_b) = _codes(first), _codes(second)
    letters, small = np.unique(np.concatenate([code_a, code_b]), return_inverse=True)
    # a letter as a small number; two are kept for padding
    kind = np.uint8 if len(letters) < 254 else np.uint16 if len(letters) < 65_534 else np.uint32
    small = (small + 2).astype(kind)
    code_a, code_b = small[: len(code_a)], small[len(code_a) :]
    pair = np.flatnonzero((size_b < LONG) & (size_a > 0) & (size_b > 0))
    # open pieces: pair, begin and length in either string
    pa, la, pb, lb = start_a[:-1][pair], size_a[pair], start_b[:-1][pair], size_b[pair]
    spare = np.minimum(size_a, size_b)  # letters that may still match
    while len(pair):
        order = np.argsort(la * LONG + lb, kind="stable")
        pair, pa, la, pb, lb = (x[order] for x in (pair, pa, la, pb, lb))
        found = [[] for _ in range(3)]
        for k in range(0, len(pair), TOGETHER):
            s = slice(k, k + TOGETHER)
            block = _longest(_pieces(code_a, pa[s], la[s], 0), _pieces(code_b, pb[s], lb[s], 1))
            for to, x in zip(found, block):
                to.append(x)
        i, j, size = (np.concatenate(x) for x in found)
        np.add.at(matched, pair, size)
        # what is left of a block and right of it, where it can match
        right_a, right_b = la - i - size, lb - j - size
        np.add.at(spare, pair, np.minimum(i, j) + np.minimum(right_a, right_b) - np.minimum(la, lb))
        left, right = (size > 0) & (i > 0) & (j > 0), (size > 0) & (right_a > 0) & (right_b > 0)
        none = np.flatnonzero(size == 0)
        np.add.at(spare, pair[none], -(np.minimum(i, j) + np.minimum(right_a, right_b))[none])
        both = lambda x, y: np.concatenate([x[left], y[right]])
        pair, pa, la, pb, lb = both(pair, pair), both(pa, pa + i + size), both(i, right_a), both(pb, pb + j + size), both(j, right_b)
        if cutoff is not None:
            reach = 2.0 * (matched + spare) >= cutoff * total - 1e-9
            pair, pa, la, pb, lb = (x[reach[pair]] for x in (pair, pa, la, pb, lb)) if len(pair) else (pair, pa, la, pb, lb)
    some = total > 0
    out[some] = 2.0 * matched[some] / total[some]
    out[~some] = 1.0
    for k in slow:
        out[k] = SequenceMatcher(None, first[k], second[k]).ratio()
    if cutoff is not None:
        out[out < cutoff] = 0.0
    return out
