"""Repeated strings of a minimum length in a collection, by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def _sorted(key: np.ndarray, bits: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sorted keys). Keys that leave room for their place are sorted as plain numbers, which is several times faster."""
    if bits <= free:
        packed = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        return (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
    places = np.argsort(key)
    return places, key[places]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols or more: a few symbols at once, then doubled lengths, where still tied."""
    n = len(symbols)
    bits, width = n.bit_length(), max(1, int(symbols.max()).bit_length())
    have = min(8, (64 - bits) // width)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(have, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = key << np.uint64(width) | padded[k : k + n]
    order, ranked = _sorted(key, bits, 64 - have * width)
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.zeros(n + 1, np.uint64)  # of a suffix: where its group starts, plus one; of the empty one 0
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0))
    tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    while have < depth and len(tied):
        at = order[tied]
        key = rank[at] << np.uint64(bits) | rank[np.minimum(at + have, n)]
        by, key = _sorted(key, bits, 64 - 2 * bits)  # groups are in order already, so they stay where they are
        at = at[by]
        order[tied] = at
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))] + 1
        tied = tied[~(head & np.concatenate((head[1:], [True])))]
        have *= 2
    return order


def close_boundaries(bwt: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the rising lengths, open[i]: the suffixes of ranks i - 1 and i share that many symbols or more, where the first has as many
    before its terminator.

    Breadth first, intervals of strings w are extended backward to cw. An interval that ends where no
    common prefix is known yet shows that it is |w| there. So values come up in increasing order, each
    once; what is still unknown when a length is reached is that long, and at the last the expansion stops.
    Terminators (symbol 0) are never prepended.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int32)  # the rank of a suffix with the symbol before it prepended
    back[by_symbol] = np.arange(n, dtype=np.int32)
    ordered = bwt[by_symbol]
    same = ordered[1:] == ordered[:-1]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # the nearest ranks with the same symbol
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    live = bwt != 0
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    found = []
    for k in range(lengths[-1]):
        if k in lengths:
            found.append(open_.copy())
        if not len(low):
            continue
        size = high - low + 1
        one = low[size == 1]
        one = back[one[live[one]]]
        many = size > 1
        if many.any():
            lo, hi, size = low[many], high[many], size[many]
            row = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            alive = live[row]
            first = row[alive & (before[row] < np.repeat(lo, size))]
            last = row[alive & (after[row] > np.repeat(hi, size))]
            low = np.concatenate((one, np.sort(back[first])))  # the new intervals are disjoint
            high = np.concatenate((one, np.sort(back[last])))
        else:
            low = high = one
        new = open_[high + 1]
        low, high = low[new], high[new]
        open_[high + 1] = False
    return [*found, open_]


def repeated_starts(texts: list[bytes], lengths: tuple[int, ...], windows: list[int]) -> list[np.ndarray]:
    """By position of the concatenated texts (one terminator after each), for each of the rising lengths, whether the string of so
    many bytes there starts elsewhere too. Only the first windows[k] places of text k count as starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(sizes) - 1
    used = np.bincount(raw, minlength=256) > 0
    spare = np.bincount(np.delete(raw, ends), minlength=256) > 0
    if spare.all():
        raise ValueError("all 256 byte values occur; UTF-8 never has 0xFF")
    code = np.cumsum(spare) * used  # ranks of the bytes that occur; 0 is left for terminators
    symbols = code[raw].astype(np.uint8)
    symbols[ends] = 0
    order = suffix_order(symbols, lengths[-1])
    room = np.repeat(ends, sizes) - np.arange(len(raw))
    mine = (np.arange(len(raw)) - np.repeat(ends - sizes + 1, sizes) < np.repeat(windows, sizes))[order]
    found = []
    for length, open_ in zip(lengths, close_boundaries(symbols[order - 1], lengths)):
        run = np.concatenate(([0], np.cumsum(~(open_[1:-1] & (room[order[:-1]] >= length)))))
        out = np.zeros(len(raw), bool)
        out[order[mine & (np.bincount(run, weights=mine)[run] > 1)]] = True
        found.append(out)
    return found
