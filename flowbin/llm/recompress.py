"""Locally consistent parsing of word sequences by recompression.

A round names every maximal run of one symbol and then every adjacent pair whose left
symbol is in the round's left half of the alphabet and whose right symbol is in its right
half.  A name is a hash of what it stands for and the halves are decided by a hash bit, so
equal runs and pairs get equal names in every task and no naming table has to be shuffled.

Whether two neighbours are joined depends on these two alone.  Inside equal substrings the
parse is therefore equal but for a symbol or two at either end of each round, and
:func:`anchors` walks every window inwards accordingly.
"""

from __future__ import annotations

import numpy as np

from flowbin.llm.textscan import Words, mix, windows

ROUNDS = 6
LEAST_WORDS = 3
FIRST_LEVEL = 2  # below, symbols are too short to be anchors

_U = np.uint64
_NONE = _U((1 << 64) - 1)


def name_runs(symbol: np.ndarray, row: np.ndarray):
    """Replace each maximal run of one symbol by one name; a lone symbol keeps its own.

    Returns the base symbol, name and first index of every run, and the run of each symbol.
    """
    new = np.empty(len(symbol), bool)
    new[0] = True
    new[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    base = symbol[start]
    name = base.copy()
    length = np.diff(np.append(start, len(symbol)))
    many = length > 1
    name[many] = mix(base[many] ^ mix(length[many].astype(np.uint64), 3), 2)
    return base, name, start, np.cumsum(new) - 1


def name_pairs(base: np.ndarray, name: np.ndarray, row: np.ndarray, salt: int):
    """Replace each neighbouring pair of a left and a right symbol by one name.

    Returns the class of each symbol (True: left), the new names, the index of each new
    symbol's first part, and the new symbol of each old one.
    """
    left = (mix(base, 16 + salt) & _U(1)).astype(bool)
    joined = np.zeros(len(name), bool)
    joined[1:] = left[:-1] & ~left[1:] & (row[1:] == row[:-1])
    head = np.flatnonzero(~joined)
    to_new = np.cumsum(~joined) - 1
    new = name[head].copy()
    second = np.flatnonzero(joined)
    new[to_new[second]] = mix(name[second - 1] * _U(0x9E3779B97F4A7C15) + name[second], 4)
    return left, new, head, to_new


def anchors(w: Words, hashes: np.ndarray, size: int):
    """One anchor for every window of ``size`` words, the same wherever the window stands.

    Each round leaves a range of symbols that lie inside the window whatever surrounds it.
    The anchor is the one of these, over the higher levels, that covers LEAST_WORDS words
    or more and has the least hash (leftmost if several), so that neighbouring windows
    mostly share theirs.  A window without one (long runs of one word) is its own anchor.

    Returns first word, window hash, anchor name, and the anchor's first word, per window.
    """
    at, whole = windows(w, hashes, size)
    if len(at) == 0:
        return at, whole, whole, at
    name, where, order = whole.copy(), at.copy(), np.full(len(at), _NONE)
    base, symbol, begin, to_run = name_runs(hashes, w.row)
    row = w.row[begin]
    # the outer runs may go on outside the window
    live, lo, hi = np.arange(len(at)), to_run[at] + 1, to_run[at + size - 1] - 1
    for salt in range(ROUNDS):
        ok = lo <= hi
        live, lo, hi = live[ok], lo[ok], hi[ok]
        if len(live) == 0:
            break
        if salt >= FIRST_LEVEL:
            rank = mix(symbol, 7) | _U(1)
            rank[np.diff(np.append(begin, len(hashes))) < LEAST_WORDS] = _NONE
            best, least = lo.copy(), rank[lo]
            for step in range(1, int((hi - lo).max()) + 1):
                other = np.minimum(lo + step, hi)
                lower = rank[other] < least
                best[lower] = other[lower]
                least = np.minimum(least, rank[other])
            lower = least < order[live]
            chosen, best = live[lower], best[lower]
            order[chosen], name[chosen], where[chosen] = least[lower], symbol[best], begin[best]
        left, new, head, to_new = name_pairs(base, symbol, row, salt)
        # a right symbol at the left end, or a left one at the right end, may be joined outwards
        lo, hi = to_new[lo + ~left[lo]], to_new[hi - left[hi]]
        base, symbol, row, begin = new, new, row[head], begin[head]
    return at, whole, mix(name, 6), where
