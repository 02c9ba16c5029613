"""Suffix arrays by induced sorting, and permuted common prefixes, both in time linear in the text.

Suffixes are classified as smaller or larger than their successors; leftmost-smaller substrings are sorted by one round of
induction and named; where names repeat, the string of names is sorted by the same procedure; the order of the
leftmost-smaller suffixes then induces all others.  The bytes of a shard have few symbols with many suffixes each, and
their buckets are walked with arrays; strings of names have many symbols with few suffixes each, and are walked with lists.
"""

from __future__ import annotations

import numpy as np

#: Alphabets of more symbols than bytes and two separators are walked suffix by suffix.
BYTES = 258


def _is_small(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last symbol is the unique smallest."""
    differs = np.flatnonzero(s[1:] != s[:-1])
    small = np.ones(len(s), bool)
    small[: differs[-1] + 1] = np.repeat(s[differs + 1] > s[differs], np.diff(differs, prepend=-1))
    return small


def _place(sa: np.ndarray, s: np.ndarray, j: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Append positions ``j``, in order, to the buckets of their symbols, upwards (step 1) or downwards (step -1)."""
    if not len(j):
        return
    symbols = s[j]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    size = np.diff(np.append(first, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(first, size)
    if step > 0:
        sa[ends[symbols] + rank] = j[order]
        ends[symbols[first]] += size
    else:
        sa[ends[symbols] - 1 - rank] = j[order]
        ends[symbols[first]] -= size


def _induce_bytes(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array induced from leftmost-smaller positions in the given order, a bucket's suffixes at a time."""
    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    begin, end = np.cumsum(counts) - counts, np.cumsum(counts)
    sa = np.full(n, -1, np.int32)
    lms_symbols = s[lms]
    order = np.argsort(lms_symbols, kind="stable")
    by_symbol = lms[order]
    cut = np.searchsorted(lms_symbols[order], np.arange(sigma + 1))
    tail = begin.copy()
    for c in np.flatnonzero(counts):  # larger suffixes, left to right
        at = begin[c]
        while at < tail[c]:
            chunk, at = sa[at : tail[c]], tail[c]
            j = chunk[chunk > 0] - 1
            _place(sa, s, j[~small[j]], tail, 1)
        chunk = by_symbol[cut[c] : cut[c + 1]]
        _place(sa, s, chunk[chunk > 0] - 1, tail, 1)
    head = end.copy()
    sa[0] = n - 1  # the last symbol stands alone in the first bucket, and a larger suffix before it
    for c in np.flatnonzero(counts)[:0:-1]:  # smaller suffixes, right to left
        at = end[c]
        while at > head[c]:
            chunk, at = sa[head[c] : at][::-1], head[c]
            j = chunk[chunk > 0] - 1
            _place(sa, s, j[small[j]], head, -1)
        chunk = sa[begin[c] : tail[c]][::-1]
        j = chunk[chunk > 0] - 1
        _place(sa, s, j[small[j]], head, -1)
    return sa


def _induce_names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same, a suffix at a time; what is appended to a bucket is met later in the same walk."""
    counts = np.bincount(s, minlength=sigma)
    ends = np.cumsum(counts)
    symbols = s[lms]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    last = np.searchsorted(symbols, symbols, side="right")
    start = np.full(len(s), -1, np.int64)
    start[ends[symbols] - last + np.arange(len(lms))] = lms[order]
    # The bucket that the suffix before each one goes to in either walk; -1 for none, and for places not yet written (-1).
    larger, smaller = np.full(len(s) + 1, -1, np.int64), np.full(len(s) + 1, -1, np.int64)
    larger[1:-1] = np.where(small[:-1], -1, s[:-1])
    smaller[1:-1] = np.where(small[:-1], s[:-1], -1)
    sa, to, place = start.tolist(), larger.tolist(), (ends - counts).tolist()
    for p in sa:
        c = to[p]
        if c >= 0:
            at = place[c]
            sa[at] = p - 1
            place[c] = at + 1
    to, place = smaller.tolist(), ends.tolist()
    for p in reversed(sa):  # each is written before it is met
        c = to[p]
        if c >= 0:
            at = place[c] - 1
            sa[at] = p - 1
            place[c] = at
    return np.array(sa, np.int32)


def _named(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the substrings of ``s`` at ``starts``, which are in order; equal ones get the same."""
    a, b, size = starts[:-1], starts[1:], sizes[1:]
    same = sizes[:-1] == size
    live, k = np.flatnonzero(same), 0
    while len(live):
        differ = s[a[live] + k] != s[b[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ & (size[live] > k)]
    return np.cumsum(np.append(False, ~same))


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes of ``s``, whose last symbol occurs once and is the smallest."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable").astype(np.int32)
    induce = _induce_bytes if sigma <= BYTES else _induce_names
    small = _is_small(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(s, small, lms, sigma)
    ordered = sa[is_lms[sa]]
    stop = np.zeros(n, np.int32)
    stop[lms] = np.append(lms[1:] + 1, n)
    names = _named(s, ordered, stop[ordered] - ordered)
    if names[-1] + 1 < len(lms):
        name_at = np.zeros(n, np.int32)
        name_at[ordered] = names
        ordered = lms[suffix_array(name_at[lms], int(names[-1]) + 1)]
    return induce(s, small, ordered, sigma)


def _agreement(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, compared four at a time; symbols are below 2^15."""
    padded = np.append(s, [0, 0, 0]).astype(np.uint16)
    words = np.ascontiguousarray(np.ndarray(len(s), np.uint64, padded, strides=(2,)))
    out, live, k = np.zeros(len(a), np.int32), np.arange(len(a)), 0
    while len(live):
        x = words[a[live] + k] ^ words[b[live] + k]
        out[live] = k + ((x & np.uint64(0xFFFF)) == 0) + ((x & np.uint64(0xFFFFFFFF)) == 0).astype(np.int32) + ((x & np.uint64(0xFFFFFFFFFFFF)) == 0)
        k += 4
        live = live[x == 0]
    return out


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, how many symbols (at most ``most``) its suffix shares with the one before it in ``sa``.

    Where the symbols before a suffix and before its neighbour are equal, it shares one symbol less than the suffix at the
    place before does; only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    follows = (before[1:] > 0) & (s[:-1] == s[np.maximum(before[1:], 1) - 1])
    compared = np.flatnonzero(np.append(True, ~follows))
    found = np.zeros(len(compared), np.int32)
    real = before[compared] >= 0
    found[real] = _agreement(s, compared[real], before[compared[real]])
    run = np.diff(np.append(compared, n))
    return np.minimum(np.repeat(found + compared, run) - np.arange(n), most)
