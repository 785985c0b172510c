"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

The steps are those of linear-time induced sorting: suffixes are typed as
smaller or larger than their right neighbour, the substrings between leftmost
smaller positions are sorted and named, recursively until names are distinct,
and all suffixes are induced from their order. Induction goes through runs of
buckets at once: a run ends where an entry would induce into the run itself,
and chains of one repeated symbol are written in one step.
"""

from __future__ import annotations

import numpy as np

from estatelens.llm.words import BASE, BASE_INVERSE, mixed, powers


def _rank_in_group(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted ``x``: each element's rank among its equals, and the distinct values with their counts."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.diff(np.append(first, len(x)))
    return np.arange(len(x)) - np.repeat(first, count), x[first], count


def _scan(sa: np.ndarray, t: np.ndarray, ok: np.ndarray, start: np.ndarray, left: np.ndarray, seed: int | None) -> None:
    """Fills the head of every bucket of ``sa`` from what stands before: i - 1 for each i whose predecessor is of the type ``ok``.

    ``start`` has each bucket's first place (one more at the end), ``left``
    how many equal symbols precede a position directly.
    """
    fill = start[:-1].copy()
    if seed is not None:
        sa[fill[t[seed]]] = seed
        fill[t[seed]] += 1
    k, n = len(start) - 1, len(t)
    low, span = 0, 64
    while low < k and start[low] < n:
        high = max(low + 1, int(np.searchsorted(start, start[low] + span, "right")) - 1)
        entries = sa[start[low] : start[high]]
        entries = entries[entries >= 0]
        if not len(entries):
            low = high
            continue
        bucket, head = t[entries], ok[entries]
        chain = left[entries] * head
        before = entries - chain - 1
        valid = before >= 0
        valid &= ok[before]
        into = t[before]
        if valid.any() and (least := int(into[valid].min())) < high:
            span = max(64, 2 * int(start[least] - start[low]))
            high = least
            m = int(np.searchsorted(bucket, high))
            entries, bucket, head, chain, before, valid, into = (x[:m] for x in (entries, bucket, head, chain, before, valid, into))
        else:
            span = min(2 * span, 1 << 20)
        if chain.any():
            total = int(chain.sum())
            of = np.repeat(np.arange(len(entries)), chain)
            step = np.arange(total) - np.repeat(np.cumsum(chain) - chain, chain) + 1
            order = np.lexsort((of, step, bucket[of]))
            of, step = of[order], step[order]
            rank, values, count = _rank_in_group(bucket[of])
            sa[fill[bucket[of]] + rank] = entries[of] - step
            fill[values] += count
            order = np.lexsort((np.where(head, chain, n), bucket))
            before, valid, into = before[order], valid[order], into[order]
        before, into = before[valid], into[valid]
        if len(before):
            order = np.argsort(into, kind="stable")
            before, into = before[order], into[order]
            rank, values, count = _rank_in_group(into)
            sa[fill[into] + rank] = before
            fill[values] += count
        low = high


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of all suffixes of ``t`` (symbols 0..k-1) in order; an end counts as smaller than any symbol."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.int32)
    place = np.arange(n)
    change = np.append(np.sign(t[1:] - t[:-1]), -1)
    next_change = np.minimum.accumulate(np.where(change != 0, place, n)[::-1])[::-1]
    smaller = change[next_change] > 0
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    left = place - np.maximum.accumulate(np.where(np.append(True, t[1:] != t[:-1]), place, 0))
    turned, start_turned = (k - 1 - t).astype(np.int32), n - start[::-1]

    def induced(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, dtype=np.int64)
        if len(order):
            symbol = t[order]
            by = np.argsort(symbol, kind="stable")
            symbol, order = symbol[by], order[by]
            rank, values, count = _rank_in_group(symbol)
            sa[np.repeat(start[values + 1] - count, count) + rank] = order
        _scan(sa, t, ~smaller, start, left, n - 1)
        sa[(sa >= 0) & smaller[sa]] = -1
        _scan(sa[::-1], turned, smaller, start_turned, left, None)
        return sa

    sa = induced(lms)
    if len(lms) < 2:
        return sa
    ordered = sa[is_lms[sa]]
    following = np.append(lms[1:], n - 1)
    size_at, end_at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    end_at[lms] = following + 1
    size_at[lms] = following + 1 - lms
    size_at[lms[-1]] = 0  # the last one runs into the end: like no other
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(t.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)])
    print_ = (total[end_at[ordered]] - total[ordered]) * powers(BASE_INVERSE, n)[ordered]
    size = size_at[ordered]
    new = np.append(True, (size[1:] != size[:-1]) | (print_[1:] != print_[:-1]))
    name_at = np.zeros(n, dtype=np.int32)
    name_at[ordered] = np.cumsum(new) - 1
    names = int(new.sum())
    if names < len(lms):
        ordered = lms[suffix_array(name_at[lms], names)]
    return induced(ordered)


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of ``data`` (bytes) the common prefix with the suffix before it in ``sa``.

    Where the symbols before both suffixes agree, the value is the one at the
    position before less one; only the others are compared.
    """
    n = len(data)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
    eight = padded[: n + 8].copy()
    for b in range(1, 8):
        eight |= padded[b : n + 8 + b] << np.uint64(8 * b)
    place = np.arange(n)
    agree = (place > 0) & (phi > 0)
    agree[agree] = data[place[agree] - 1] == data[phi[agree] - 1]
    base = np.flatnonzero(~agree)
    value = np.zeros(n, dtype=np.int64)
    i = base[phi[base] >= 0]
    a, b = i.copy(), phi[i]
    while len(i):
        off = eight[a] ^ eight[b]
        lowest = off & (~off + np.uint64(1))
        same = np.where(off == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, n - np.maximum(a, b))
        value[i] += same
        on = (off == 0) & (np.maximum(a, b) + 8 < n)
        i, a, b = i[on], a[on] + 8, b[on] + 8
    own = np.maximum.accumulate(np.where(agree, 0, place))
    return np.maximum(0, value[own] - (place - own))


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """Which positions start ``length`` bytes that also start at another position of ``data``."""
    sa = suffix_array(data.astype(np.int32), 256)
    long = permuted_lcp(data, sa) >= length
    out = long.copy()
    out[sa[:-1]] |= long[sa[1:]]
    return out
